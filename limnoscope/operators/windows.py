"""Rolling-origin windows and supervised samples."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from limnoscope.functions.columns import to_target
from limnoscope.schema import (
    EPS, HORIZON, KEYS, LOOK_BACK, STRIDE_DAYS, TEST_DAYS, TRAIN_DAYS,
)


def _last_window(first, last, train_days: int, stride_days: int, n_windows: int | None) -> Column:
    """Number of a station's last window: its train part ends on or before the station's last day."""
    if n_windows is not None:
        return F.lit(n_windows - 1)
    return F.floor((F.datediff(last, first) - F.lit(train_days)) / F.lit(stride_days)).cast("int")


def rolling_anchors(first_days: DataFrame, train_days: int = TRAIN_DAYS, test_days: int = TEST_DAYS,
                    stride_days: int = STRIDE_DAYS, n_windows: int | None = None,
                    first_day: str = "d0", last_day: str = "d1", keys: Sequence[str] = KEYS) -> DataFrame:
    """(start, train_end, test_end) of every window, from one first and last day per station.

    Windows cover the station's whole span: all whose train part ends on or
    before its last day.  ``n_windows`` asks for that many, span or not.
    """
    start = F.date_add(F.col(first_day), (F.col("window_id") * stride_days).cast("int"))
    last = _last_window(F.col(first_day), F.col(last_day) if n_windows is None else None, train_days, stride_days, n_windows)
    return (first_days.select(*keys, first_day, last.alias("_last")).filter(F.col("_last") >= 0)
            .select(*keys, first_day, F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("window_id"))
            .select(*keys, "window_id", start.alias("start"),
                    F.date_add(start, train_days).alias("train_end"),
                    F.date_add(start, train_days + test_days).alias("test_end")))


def first_days(df: DataFrame, day: str = "day", keys: Sequence[str] = KEYS) -> DataFrame:
    """First and last day of each station, ``d0`` and ``d1``."""
    return df.groupBy(*keys).agg(F.min(day).alias("d0"), F.max(day).alias("d1"))


def assign_windows(df: DataFrame, d0: dt.date | str | None = None, train_days: int = TRAIN_DAYS,
                   test_days: int = TEST_DAYS, stride_days: int = STRIDE_DAYS,
                   n_windows: int | None = None, day: str = "day",
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Copy each day to all windows that contain it, with ``is_train_row``.

    The window numbers follow from the day's offset by arithmetic, so there is
    no range join: each row is exploded into ``ceil(span / stride)`` copies at
    most.  Without ``d0`` windows start at the station's first day.  Windows are
    those of :func:`rolling_anchors`.
    """
    group = W.partitionBy(*keys)
    df = df.withColumn("d0", F.min(day).over(group) if d0 is None else F.lit(str(d0)).cast("date"))
    span = train_days + test_days
    off = F.datediff(day, "d0")
    lo = F.greatest(F.lit(0), F.ceil((off - F.lit(span - 1)) / F.lit(stride_days)).cast("int"))
    last = F.max(day).over(group) if n_windows is None else F.lit(None)
    df = df.withColumn("_last", _last_window(F.col("d0"), last, train_days, stride_days, n_windows))
    hi = F.least(F.col("_last"), F.floor(off / F.lit(stride_days)).cast("int"))
    ids = F.when((off >= 0) & (lo <= hi), F.sequence(lo, hi))
    start = F.date_add("d0", F.col("window_id") * stride_days)
    return (df.withColumn("window_id", F.explode(ids))
            .withColumns({"train_end": F.date_add(start, train_days),
                          "test_end": F.date_add(start, span)})
            .withColumn("is_train_row", F.col(day) < F.col("train_end")).drop("d0", "_last"))


def split_by_position(df: DataFrame, ts: str, train_frac: float = 0.7, val_frac: float = 0.15,
                      keys: Sequence[str] = KEYS) -> DataFrame:
    """``part`` = train / val / test by row position within the station."""
    order = W.partitionBy(*keys).orderBy(ts)
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return (df.withColumns({"_i": F.row_number().over(order) - 1,
                            "_tr": F.floor(n * F.lit(train_frac)), "_va": F.floor(n * F.lit(val_frac))})
            .withColumn("part", F.when(F.col("_i") < F.col("_tr"), "train")
                        .when(F.col("_i") < F.col("_tr") + F.col("_va"), "val").otherwise("test"))
            .drop("_i", "_tr", "_va"))


def supervised_windows(rows: DataFrame, target: str, ts: str = "day", look_back: int = LOOK_BACK,
                       horizon: int = HORIZON, keys: Sequence[str] = ("site_id", "window_id"),
                       train_row: Column | str | None = "is_train_row",
                       fit_frac: float = 0.7, carry: Sequence[str] = (),
                       history: Sequence[str] = ()) -> DataFrame:
    """One row per forecast origin.

    Positions are row positions: a missing day is simply not there.  Sample ``i``
    looks back over rows ``i .. i+T-1``, its origin is row ``i+T-1`` and its
    targets are the next ``H`` rows; ``n - T - H`` samples exist, one fewer than
    would fit.  With ``train_row`` the train samples number
    ``max(0, train rows - T - H + 1)``, counted by rows so that a missing cut
    day changes nothing; else they are the first ``fit_frac`` of the samples.

    ``y`` and ``delta`` hold the horizons as arrays.  ``history`` columns are
    added as arrays of the ``T`` rows of the look-back (named ``<column>_hist``);
    most models need only the aggregates of :func:`features.window_stats`.
    """
    T, H = look_back, horizon
    order = W.partitionBy(*keys).orderBy(ts)
    whole = W.partitionBy(*keys)
    pos = F.row_number().over(order) - 1
    ahead = [F.lead(target, h).over(order) for h in range(1, H + 1)]
    cols = {"_pos": pos, "_n": F.count(F.lit(1)).over(whole), "y": F.array(*ahead)}
    if train_row is not None:
        flag = F.col(train_row) if isinstance(train_row, str) else train_row
        cols["_ntr"] = F.sum(flag.cast("int")).over(whole)
    frame = order.rowsBetween(-(T - 1), 0)
    cols |= {f"{c}_hist": F.collect_list(c).over(frame) for c in history}
    out = rows.withColumns(cols).withColumn("sample", F.col("_pos") - F.lit(T - 1))
    n_samples = F.col("_n") - F.lit(T + H)
    n_train = (F.greatest(F.lit(0), F.col("_ntr") - F.lit(T + H - 1)) if train_row is not None
               else F.floor(n_samples * F.lit(fit_frac)))
    out = out.filter((F.col("sample") >= 0) & (F.col("sample") < n_samples))
    return out.select(
        *keys, F.col(ts).alias("origin"), "sample", F.col(target).alias("cur"), "y",
        F.transform("y", lambda v: v - F.col(target)).alias("delta"),
        n_samples.cast("int").alias("n_samples"), n_train.cast("int").alias("n_train"),
        (F.col("sample") < n_train).alias("is_train"),
        *[c for c in carry if c not in (*keys, ts)], *[f"{c}_hist" for c in history])


def by_horizon(samples: DataFrame, ids: Sequence[str] = ("site_id", "window_id", "origin")) -> DataFrame:
    """Arrays to rows: one row per (sample, h) with ``y_h`` and ``delta_h``."""
    keep = [c for c in samples.columns if c not in (*ids, "y", "delta")]
    pairs = F.arrays_zip(F.col("y").alias("y"), F.col("delta").alias("d"))
    return (samples.select(*ids, *keep, F.posexplode(pairs).alias("_h", "_p"))
            .select(*ids, *keep, (F.col("_h") + 1).alias("h"), F.col("_p.y").alias("y_h"),
                    F.col("_p.d").alias("delta_h")))


def delta_scale(samples: DataFrame, keys: Sequence[str] = ("site_id", "window_id")) -> DataFrame:
    """Population std of all train deltas over all horizons, plus epsilon."""
    return (samples.filter("is_train").select(*keys, F.explode("delta").alias("_d"))
            .groupBy(*keys).agg((F.stddev_pop("_d") + F.lit(EPS)).alias("delta_scale"),
                                F.count("_d").alias("n_deltas")))


def target_scale(samples_h: DataFrame, kind: str, keys: Sequence[str] = ("site_id", "window_id"), floor: float = 1.0) -> DataFrame:
    """Population std of a transformed target over all train samples and horizons of a window, plus epsilon: ``scale``."""
    target = to_target(kind, "cur", "y_h", floor)
    return samples_h.filter("is_train").groupBy(*keys).agg((F.stddev_pop(target) + F.lit(EPS)).alias("scale"), F.count(target).alias("n_targets"))


def window_norm_stats(rows: DataFrame, columns: Sequence[str],
                      keys: Sequence[str] = ("site_id", "window_id")) -> DataFrame:
    """Train-row mean and sample std (+ epsilon) per window and column, long form."""
    from limnoscope.operators.grid import unpivot_columns

    long = unpivot_columns(rows.filter("is_train_row"), columns, keys)
    return long.groupBy(*keys, "variable").agg(
        F.avg("value").alias("mean"), (F.stddev_samp("value") + F.lit(EPS)).alias("std"),
        F.count("value").alias("n"))
