"""Model features of gridded series.

The windows here run over grid rows of one station, so their length is bounded
by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from limnoscope.functions.columns import (
    direction_terms, log_concentration, season_terms, wind_components,
)
from limnoscope.schema import KEYS


def with_wind(df: DataFrame, speed: str = "wind_speed", direction: str = "wind_dir",
              cross: str | None = None) -> DataFrame:
    """``wind_u``, ``wind_v``, ``wind_sin``, ``wind_cos`` and, for a concentration
    column ``cross``, the product ``wind_cross``."""
    u, v = wind_components(speed, direction)
    s, c = direction_terms(direction)
    out = df.withColumns({"wind_u": u, "wind_v": v, "wind_sin": s, "wind_cos": c})
    return out.withColumn("wind_cross", F.col("wind_u") * F.col(cross)) if cross else out


def with_season(df: DataFrame, ts: str = "cell") -> DataFrame:
    s, c = season_terms(ts)
    return df.withColumns({"season_sin": s, "season_cos": c})


def standard_scores(df: DataFrame, columns: Sequence[str], log: Sequence[str] = (),
                    keys: Sequence[str] = KEYS, eps: float = 1e-12) -> DataFrame:
    """Log1p of the non-negative part of ``log`` columns, then z-scores over the
    station's whole series."""
    out = df.withColumns({c: log_concentration(c) for c in log}) if log else df
    whole = W.partitionBy(*keys)
    return out.withColumns({c: (F.col(c) - F.avg(c).over(whole)) / (F.stddev_samp(c).over(whole) + F.lit(eps))
                            for c in columns})


def difference(df: DataFrame, columns: Sequence[str], steps: int, ts: str,
               keys: Sequence[str] = KEYS, suffix: str = "_diff", ahead: bool = False) -> DataFrame:
    """Change over ``steps`` rows: since then, or with ``ahead`` until then."""
    order = W.partitionBy(*keys).orderBy(ts)
    if ahead:
        return df.withColumns({f"{c}{suffix}": F.lead(c, steps).over(order) - F.col(c)
                               for c in columns})
    return df.withColumns({f"{c}{suffix}": F.col(c) - F.lag(c, steps).over(order)
                           for c in columns})


def window_stats(df: DataFrame, columns: Sequence[str], ts: str, length: int = 30,
                 change: int = 6, extremes: bool = False,
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """Last value, mean, population std and change over the trailing ``length`` rows.

    ``change`` rows back is the other end of the change; the first rows of a
    series, which have none, get 0.
    """
    order = W.partitionBy(*keys).orderBy(ts)
    frame = order.rowsBetween(-(length - 1), 0)
    # A window of pos 0..6 has no value seven rows before its end by position.
    pos = F.row_number().over(order)
    out = {}
    for c in columns:
        out[f"{c}_last"] = F.col(c)
        out[f"{c}_mean"] = F.avg(c).over(frame)
        out[f"{c}_std"] = F.stddev_pop(c).over(frame)
        out[f"{c}_change"] = F.when(pos > change + 1, F.col(c) - F.lag(c, change).over(order)).otherwise(0.0)
        if extremes:
            out[f"{c}_min"] = F.min(c).over(frame)
            out[f"{c}_max"] = F.max(c).over(frame)
    return df.withColumns(out)


def slow_features(df: DataFrame, columns: Sequence[str], ts: str, windows: Sequence[int] = (30, 60, 90),
                  rows_per_day: int = 1, std_columns: Sequence[str] = (), fill: bool = True,
                  keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean, slope per day-length and std of the strictly earlier rows.

    A window counts once it is half full.  ``fill`` carries values forward and
    gives the head the first value there is.
    """
    from limnoscope.operators.align import fill_forward

    order = W.partitionBy(*keys).orderBy(ts)
    out = df.withColumn("_pos", F.row_number().over(order).cast("double"))
    made = {}
    for c in columns:
        for days in windows:
            rows = days * rows_per_day
            past = order.rowsBetween(-rows, -1)
            full = F.count(c).over(past) >= rows // 2
            made[f"slow_{c}_mean_{days}d"] = F.when(full, F.avg(c).over(past))
            made[f"slow_{c}_slope_{days}d"] = F.when(
                full, F.regr_slope(F.col(c), F.col("_pos")).over(past) / F.lit(float(days)))
            if c in std_columns:
                made[f"slow_{c}_std_{days}d"] = F.when(full, F.stddev_samp(c).over(past))
    out = out.withColumns(made).drop("_pos")
    return fill_forward(out, list(made), ts, keys) if fill else out


def trend_features(df: DataFrame, ts: str, lag: int = 8, temp: str = "delta_T",
                   grad: str = "thermo_grad", keys: Sequence[str] = KEYS,
                   drop_head: bool = True) -> DataFrame:
    """Stratification trend: change over ``lag`` rows, OLS slope over ``lag + 1`` rows."""
    order = W.partitionBy(*keys).orderBy(ts)
    out = df.withColumn("_pos", F.row_number().over(order).cast("double"))
    ready = F.col("_pos") > lag
    frame = order.rowsBetween(-lag, 0)
    out = out.withColumns({
        "trend_dT": F.col(temp) - F.lag(temp, lag).over(order),
        "slope_dT": F.when(ready, F.regr_slope(F.col(temp), F.col("_pos")).over(frame)),
        "d_thermo_grad": F.col(grad) - F.lag(grad, lag).over(order),
    })
    return (out.filter(ready) if drop_head else out).drop("_pos")


def detrend(df: DataFrame, value: str, ts: str, width: int = 240, min_rows: int = 56,
            keys: Sequence[str] = KEYS, name: str = "residual") -> DataFrame:
    """Subtract the centred rolling median.

    An even width reaches one row further back than ahead.  Where the centred
    window is too empty the trailing one is used, then the station's median.
    """
    order = W.partitionBy(*keys).orderBy(ts)
    centred = order.rowsBetween(-(width // 2), width - width // 2 - 1)
    trailing = order.rowsBetween(-(width - 1), 0)

    def base(frame):
        return F.when(F.count(value).over(frame) >= min_rows,
                      F.percentile(value, F.lit(0.5)).over(frame))

    overall = F.percentile(value, F.lit(0.5)).over(W.partitionBy(*keys))
    return df.withColumn(name, F.col(value) - F.coalesce(base(centred), base(trailing), overall))


def site_history(df: DataFrame, value: str, ts: str, history: int = 365, min_history: int = 60,
                 min_month: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per station and row a forecast from earlier rows only.

    Persistence: last value with the std of the trailing ``history`` rows.
    Climatology: mean and std of all earlier rows of the same month when there
    are at least ``min_month`` and they vary, else those of the trailing rows.
    Stations need ``min_history + 10`` rows.
    """
    rows = df.filter(F.col(value).isNotNull())
    order = W.partitionBy(*keys).orderBy(ts)
    past = order.rowsBetween(-history, -1)
    month_past = (W.partitionBy(*keys, "_month").orderBy(ts)
                  .rowsBetween(W.unboundedPreceding, -1))
    out = rows.withColumns({
        "_month": F.month(ts), "_pos": F.row_number().over(order),
        "_n": F.count(F.lit(1)).over(W.partitionBy(*keys)),
        "mu_persist": F.lag(value).over(order), "sd_persist": F.stddev_samp(value).over(past),
        "_mu": F.avg(value).over(past),
    }).withColumns({
        "_mn": F.count(F.lit(1)).over(month_past), "_mm": F.avg(value).over(month_past),
        "_ms": F.stddev_samp(value).over(month_past),
    })
    monthly = (F.col("_mn") >= min_month) & (F.col("_ms") > 1e-3)
    sd = F.when(monthly, F.col("_ms")).otherwise(F.col("sd_persist"))
    return (out.filter((F.col("_n") >= min_history + 10) & (F.col("_pos") > min_history))
            .withColumns({
                "mu_clim": F.when(monthly, F.col("_mm")).otherwise(F.col("_mu")),
                "sd_clim": F.when(sd.isNull() | F.isnan(sd) | (sd < 1e-3),
                                  F.greatest(F.col("sd_persist"), F.lit(1e-2))).otherwise(sd),
            })
            .select(*keys, ts, F.col(value).alias("y"), "mu_persist", "sd_persist", "mu_clim", "sd_clim"))
