"""Labels: bloom state, stratification, warning level, class weights.

Thresholds are exact percentiles.  Their groups are grid rows of one station
(and layer, and window), so a ``percentile`` aggregate never holds more values
than the calendar has cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from limnoscope.schema import KEYS, LINK_BAND, TOP_BAND, WARNING_CUTS


def layer_quantiles(cells: DataFrame, value: str = "total_conc",
                    probs: dict[str, float] | None = None,
                    keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean, maximum and exact quantiles per station and depth."""
    probs = probs or {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    q = F.percentile(value, F.array(*[F.lit(p) for p in probs.values()]))
    return (cells.filter(F.col(value).isNotNull()).groupBy(*keys, "depth")
            .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"),
                 q.alias("_q"))
            .select(*keys, "depth", "n", "mean", "max",
                    *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(probs)]))


def band_median(cells: DataFrame, value: str = "total_conc", band: tuple[float, float] = TOP_BAND,
                at: str = "day", keys: Sequence[str] = KEYS) -> DataFrame:
    """Median over the depths of a band at each time, missing depths skipped."""
    inside = F.col("depth").between(*band)
    return (cells.filter(inside).groupBy(*keys, at)
            .agg(F.percentile(value, F.lit(0.5)).alias("band")))


def bloom_state(cells: DataFrame, value: str = "total_conc", quantile: float = 0.9,
                min_layers: int = 3, top_band=TOP_BAND, link_band=LINK_BAND, at: str = "day",
                keys: Sequence[str] = KEYS, fit=None) -> DataFrame:
    """Bloom state per station and time: the band median is above the band's own
    quantile and at least ``min_layers`` layers are above theirs.

    The cells are brought together by station once; layer thresholds, band
    medians and the band threshold are windows inside that partitioning, so
    nothing is shuffled again and nothing is joined.  ``fit`` (a boolean column
    of the cells) limits the rows the thresholds are fitted on.
    """
    keys = list(keys)
    fitted = F.lit(True) if fit is None else fit
    lo, hi = min(top_band[0], link_band[0]), max(top_band[1], link_band[1])
    rows = (cells.filter(F.col("depth").between(lo, hi)).withColumn("_fit", fitted)
            .select(*keys, at, "depth", F.col(value).alias("_v"), "_fit").repartition(*keys))
    in_link = F.col("depth").between(*link_band)
    rows = rows.withColumn("_lq", F.percentile(F.when(F.col("_fit") & in_link, F.col("_v")), F.lit(quantile))
                           .over(W.partitionBy(*keys, "depth")))
    in_top = F.when(F.col("depth").between(*top_band), F.col("_v"))
    state = rows.groupBy(*keys, at).agg(
        F.percentile(in_top, F.lit(0.5)).alias("band"), F.max("_fit").alias("_fit"),
        F.coalesce(F.sum((F.col("_v") > F.col("_lq")).cast("int")), F.lit(0)).alias("n_layers"))
    state = state.withColumn("band_q", F.percentile(F.when(F.col("_fit"), F.col("band")), F.lit(quantile))
                             .over(W.partitionBy(*keys)))
    on = F.coalesce(F.col("band") > F.col("band_q"), F.lit(False)) & (F.col("n_layers") >= min_layers)
    return state.select(*keys, at, "band", "band_q", "n_layers", on.cast("int").alias("bloom"))


def stratified(rows: DataFrame, ts: str = "day", fit_frac: float = 0.7, value: str = "delta_T",
               keys: Sequence[str] = ("site_id", "window_id")) -> DataFrame:
    """``strat`` = 1 where the contrast exceeds the median of the first ``fit_frac``
    of the rows of the window, whatever the train cut is."""
    order = W.partitionBy(*keys).orderBy(ts)
    whole = W.partitionBy(*keys)
    fit = F.row_number().over(order) <= F.floor(F.count(F.lit(1)).over(whole) * F.lit(fit_frac))
    out = rows.withColumn("_fit", F.when(fit, F.col(value)))
    return (out.withColumn("strat_threshold", F.percentile("_fit", F.lit(0.5)).over(whole))
            .withColumn("strat", (F.col(value) > F.col("strat_threshold")).cast("int")).drop("_fit"))


def warning_levels(samples: DataFrame, cuts: Sequence[float] = WARNING_CUTS,
                   keys: Sequence[str] = ("site_id", "window_id")) -> DataFrame:
    """Level 0..len(cuts) of the peak of the coming days: how many train
    quantiles of the peak lie strictly below it."""
    peak = F.when(F.col("is_train"), F.col("peak"))
    q = F.percentile(peak, F.array(*[F.lit(c) for c in cuts])).over(W.partitionBy(*keys))
    return (samples.withColumn("peak", F.array_max("y")).withColumn("cuts", q)
            .withColumn("level", F.size(F.filter("cuts", lambda c: c < F.col("peak")))))


def bloom_labels(samples: DataFrame, bloom: str | None = "bloom") -> DataFrame:
    """Two-level label: the bloom state of the origin, which must have been carried."""
    if not bloom or bloom not in samples.columns:
        raise ValueError("bloom mode needs the bloom state column")
    return samples.withColumn("level", F.col(bloom).cast("int"))


def class_weights(labelled: DataFrame, label: str = "level", n_levels: int = 4,
                  keys: Sequence[str] = ("site_id", "window_id"), balanced: bool = False) -> DataFrame:
    """Inverse-frequency weight of every level, also of those that do not occur.

    By default ``1 / (count + 1)`` scaled to sum to the number of levels; with
    ``balanced`` it is ``n / (n_levels * (count + 1))``.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(n_levels - 1))).alias("_level")
    counts = labelled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_total"),
        F.array(*[F.sum((F.col(label) == i).cast("bigint")) for i in range(n_levels)]).alias("_c"))
    inverse = F.transform("_c", lambda c: F.lit(1.0) / (c + 1))
    total = F.aggregate(inverse, F.lit(0.0), lambda a, v: a + v)
    return (counts.withColumn("_sum", total).select(*keys, levels, "_total", "_c", "_sum")
            .select(*keys, F.col("_level").alias(label), F.get("_c", "_level").alias("n"),
                    (F.col("_total") / (F.lit(float(n_levels)) * (F.get("_c", "_level") + 1)) if balanced
                     else F.lit(float(n_levels)) / (F.get("_c", "_level") + 1) / F.col("_sum"))
                    .alias("weight")))
