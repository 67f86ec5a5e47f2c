"""Forecast scores, calibration and their aggregation.

All metrics are aggregates with partial sums, so pooled groups (one horizon of
all stations) cost no more than their map-side partials.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnoscope.functions.columns import as_col
from limnoscope.functions.scores import crps_quantiles, quantile_at
from limnoscope.operators.slices import known_around
from limnoscope.schema import KEYS, QUANTILE_LEVELS
from limnoscope.session import settled


def errors(df: DataFrame, prediction: Column | str, observed: Column | str,
           by: Sequence[str]) -> DataFrame:
    """RMSE and MAE by any grouping (overall, horizon, layer)."""
    e = as_col(observed) - as_col(prediction)
    return df.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                               F.count(F.lit(1)).alias("n"))


def score_rows(forecasts: DataFrame, levels: Sequence[float] = QUANTILE_LEVELS, q: str = "q",
               y: str = "y_h", current: str = "cur", low: float = 0.10, high: float = 0.90) -> DataFrame:
    """Per forecast row: CRPS, persistence CRPS, cover (both ends inclusive), width, error."""
    lo, mid, hi = (quantile_at(q, levels, p) for p in (low, 0.50, high))
    return forecasts.withColumns({
        "crps": crps_quantiles(q, levels, y),
        "crps_persist": F.abs(F.col(y) - F.col(current)),
        "covered": F.col(y).between(lo, hi).cast("double"),
        "width": hi - lo,
        "sq_err": (F.col(y) - mid) * (F.col(y) - mid),
    })


def interval_summary(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    return scored.groupBy(*by).agg(F.avg("covered").alias("coverage"), F.avg("width").alias("width"),
                                   F.count(F.lit(1)).alias("n"))


def skill(model: Column | str, baseline: Column | str) -> Column:
    """Percent improvement over the baseline; null where the baseline is 0."""
    m, b = as_col(model), as_col(baseline)
    return F.when(b != 0, (b - m) / F.when(b != 0, b) * F.lit(100.0))


def evaluation_units(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """The unit every summary averages over, e.g. (station, window, member)."""
    return scored.groupBy(*by).agg(
        F.avg("crps").alias("crps"), F.avg("crps_persist").alias("crps_persist"),
        F.avg("covered").alias("coverage"), F.avg("width").alias("width"),
        F.sqrt(F.avg("sq_err")).alias("rmse"), F.count(F.lit(1)).alias("n_rows"),
    ).withColumn("skill", skill("crps", "crps_persist"))


def summary_lattice(scored: DataFrame, keys: Sequence[str] = KEYS, window: str = "window_id",
                    member: str = "member", horizon: str = "h") -> DataFrame:
    """Mean and population std per window, member, horizon and overall, in one tidy table.

    Window, member and overall rows average (window, member) units; horizon rows
    average (window, member, horizon) units.  ``skill_of_means`` compares the
    averaged scores, ``mean_skill`` averages the skill of the units.
    """
    unit = [*keys, window, member]
    # The scored rows are read once, into sums per unit and horizon; all else follows from these.
    metrics = ("crps", "crps_persist", "covered", "sq_err")
    states = scored.groupBy(*unit, horizon).agg(*[F.sum(c).alias(f"_s_{c}") for c in metrics], *[F.count(c).alias(f"_n_{c}") for c in metrics])
    per_unit = states.groupBy(*unit).agg(
        F.collect_list(F.struct(F.col(horizon).alias("h"), *[F.col(f"_{k}_{c}").alias(f"{k}_{c}") for k in "sn" for c in metrics])).alias("_h"),
        F.struct(*[F.sum(f"_{k}_{c}").alias(f"{k}_{c}") for k in "sn" for c in metrics]).alias("_all"))

    def row(level, part, sums):
        mean = {c: sums[f"s_{c}"] / F.when(sums[f"n_{c}"] > 0, sums[f"n_{c}"]) for c in metrics}
        return F.struct(F.lit(level).alias("level"), part.cast("string").alias("part"), mean["crps"].alias("crps"), mean["crps_persist"].alias("crps_persist"),
                        mean["covered"].alias("coverage"), F.sqrt(mean["sq_err"]).alias("rmse"))

    whole = F.col("_all")
    rows = F.concat(F.array(row("window", F.col(window), whole), row("member", F.col(member), whole), row("overall", F.lit("all"), whole)),
                    F.transform("_h", lambda s: row("horizon", s["h"], s)))
    tagged = per_unit.select(*keys, F.inline(rows)).withColumn("skill", skill("crps", "crps_persist"))
    return tagged.groupBy(*keys, "level", "part").agg(
        F.avg("crps").alias("crps_mean"), F.stddev_pop("crps").alias("crps_std"),
        F.avg("crps_persist").alias("crps_persist"), F.avg("skill").alias("mean_skill"),
        F.avg("coverage").alias("coverage_mean"), F.avg("rmse").alias("rmse_mean"),
        F.count(F.lit(1)).alias("n_units")).withColumn("skill_of_means", skill("crps_mean", "crps_persist"))


def quantile_ensemble(forecasts: DataFrame, n_levels: int, by: Sequence[str], q: str = "q",
                      carry: Sequence[str] = ("y_h", "cur")) -> DataFrame:
    """Element-wise mean of the members' quantiles; one aggregation, no explode."""
    return forecasts.groupBy(*by).agg(
        F.array(*[F.avg(F.get(q, F.lit(i))) for i in range(n_levels)]).alias(q),
        *[F.min(c).alias(c) for c in carry], F.count(F.lit(1)).alias("n_members"))


def member_range(units: DataFrame, by: Sequence[str]) -> DataFrame:
    """Best, average and worst member per window."""
    return units.groupBy(*by).agg(
        F.min("crps").alias("best_crps"), F.avg("crps").alias("avg_crps"), F.max("crps").alias("worst_crps"),
        F.min("rmse").alias("best_rmse"), F.avg("rmse").alias("avg_rmse"),
        F.max("coverage").alias("best_coverage"), F.avg("coverage").alias("avg_coverage"))


def day_blocks(by_horizon: DataFrame, value: str, keys: Sequence[str], steps_per_day: int = 8,
               horizon: str = "h") -> DataFrame:
    """Mean of a per-horizon metric by forecast day."""
    day = (F.floor((F.col(horizon) - 1) / F.lit(steps_per_day)) + 1).alias("day_ahead")
    return by_horizon.groupBy(*keys, day).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n_steps"))


# --------------------------------------------------------------- binary events
def probability_summary(df: DataFrame, p: str, outcome: str, by: Sequence[str],
                        threshold: float = 0.5) -> DataFrame:
    """Accuracy at a threshold and Brier score."""
    y = F.col(outcome).cast("double")
    right = ((F.col(p) > threshold).cast("double") == y).cast("double")
    return df.groupBy(*by).agg(F.avg(right).alias("accuracy"),
                               F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"),
                               F.count(F.lit(1)).alias("n"))


def calibration_table(df: DataFrame, p: str, outcome: str, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Mean probability and observed rate per probability bin."""
    b = F.greatest(F.lit(0), F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("p_mean"),
        F.avg(F.col(outcome).cast("double")).alias("observed"))


def expected_calibration_error(table: DataFrame, by: Sequence[str]) -> DataFrame:
    gap = F.col("n") * F.abs(F.col("p_mean") - F.col("observed"))
    return table.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def best_threshold(df: DataFrame, p: str, outcome: str, by: Sequence[str],
                   thresholds: Sequence[float] = tuple(0.02 + 0.01 * i for i in range(97))) -> DataFrame:
    """The threshold with the highest accuracy, the lowest such on a tie.

    Rows are counted by how many thresholds lie below their probability; running
    sums over these few counts give the accuracy at every threshold without
    copying a row per threshold.
    """
    taus = sorted(float(t) for t in thresholds)
    grid = F.array(*[F.lit(t) for t in taus])
    slot = F.size(F.filter(grid, lambda t: t < F.col(p)))
    y = F.col(outcome).cast("bigint")
    counts = df.groupBy(*by, slot.alias("_slot")).agg(
        F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg"))
    packed = counts.groupBy(*by).agg(
        F.sum(F.col("_pos") + F.col("_neg")).alias("n"), F.collect_list(F.struct("_slot", "_pos", "_neg")).alias("_c"))

    def correct(i):
        # threshold i: predicted positive are the slots above i
        return F.aggregate("_c", F.lit(0).cast("bigint"), lambda acc, c: acc + F.when(
            c["_slot"] > i, c["_pos"]).otherwise(c["_neg"]))

    scored = F.transform(grid, lambda t, i: F.struct(correct(i).alias("ok"), (-t).alias("neg_tau")))
    best = F.array_max(scored)
    return packed.withColumn("_b", best).select(
        *by, (-F.col("_b.neg_tau")).alias("tau"), (F.col("_b.ok") / F.col("n")).alias("accuracy"), "n")


def direction_rates(samples_h: DataFrame, by: Sequence[str], delta: str = "delta_h") -> DataFrame:
    """Share of rises and the accuracy of always calling the commoner direction."""
    up = F.avg((F.col(delta) > 0).cast("double"))
    return (samples_h.groupBy(*by).agg(up.alias("up_rate"), F.count(F.lit(1)).alias("n"))
            .withColumn("constant_accuracy", F.greatest("up_rate", F.lit(1.0) - F.col("up_rate"))))


# --------------------------------------------------------------- class labels
def class_summary(df: DataFrame, label: str, predicted: str, by: Sequence[str]) -> DataFrame:
    d = F.col(label) - F.col(predicted)
    return df.groupBy(*by).agg(F.avg((d == 0).cast("double")).alias("accuracy"),
                               F.sqrt(F.avg((d * d).cast("double"))).alias("ordinal_rmse"),
                               F.count(F.lit(1)).alias("n"))


def class_recall(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, label).agg(
        F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("recall"), F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------- distributions
def histogram(df: DataFrame, value: str, bins: int = 60, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width density histogram between minimum and maximum, the last bin closed."""
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull())
    span = [F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n")]
    if keys:
        joined = rows.join(rows.groupBy(*keys).agg(*span), keys)
    else:
        whole = rows.agg(F.struct(*span)).scalar()
        joined = rows.withColumn("_span", whole).select("*", "_span.*").drop("_span")
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(F.col("_hi") > F.col("_lo"),
               F.least(F.floor((F.col(value) - F.col("_lo")) / F.when(width > 0, width)),
                       F.lit(bins - 1))).otherwise(0).cast("int")
    counts = joined.groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("_lo").alias("_lo"), F.min("_hi").alias("_hi"), F.min("_n").alias("_n"))
    return counts.select(*keys, "bin", "n", (F.col("_lo") + F.col("bin") * width).alias("left_edge"),
                         F.when(width > 0, F.col("n") / (F.col("_n") * F.when(width > 0, width))).alias("density"))


def pit_histogram(df: DataFrame, pit: str = "pit", bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    b = F.least(F.floor(F.col(pit) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(pit).alias("pit_mean"))


# --------------------------------------------------------------- data profile
def interval_counts(df: DataFrame, ts: str, keys: Sequence[str] = KEYS, rows_a_slice: int | None = None) -> DataFrame:
    """How often each sampling interval (seconds) occurs between consecutive readings.

    Readings at one instant are counted first (their mutual interval is 0); then each
    instant is compared with the one before it, in slices of bounded size.
    """
    keys = list(keys)
    instants = (df.filter(F.col(ts).isNotNull()).groupBy(*keys, F.col(ts).alias("_t")).agg(F.count(F.lit(1)).alias("_n")))
    instants = settled(instants.withColumn("_at", F.unix_micros(F.col("_t").cast("timestamp"))))
    zero = instants.select(*keys, F.lit(0.0).alias("seconds"), (F.col("_n") - 1).alias("n")).filter("n > 0")
    before = known_around(instants, "_at", keys, {"t": F.col("_at")}, strict=True, rows_a_slice=rows_a_slice)
    steps = before.filter(F.col("_prev_t").isNotNull()).select(
        *keys, ((F.col("_at") - F.col("_prev_t")) / F.lit(1e6)).alias("seconds"), F.lit(1).cast("bigint").alias("n"))
    return zero.unionByName(steps).groupBy(*keys, "seconds").agg(F.sum("n").alias("n"))


def median_interval(counts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Exact median of the sampling interval from its counts."""
    from limnoscope.operators.ranks import pooled_quantiles

    total = counts.groupBy(*keys).agg(F.sum("n").alias("n_intervals"))
    return pooled_quantiles(counts, "seconds", {"median_seconds": 0.5}, keys, count="n").join(total, list(keys))


def column_profile(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows, nulls, mean and exact p5/p50/p95 of each column, for groups of any size."""
    from limnoscope.operators.grid import unpivot_columns
    from limnoscope.operators.ranks import pooled_quantiles

    ids = [*keys, "variable"]
    long = unpivot_columns(df, columns, list(keys))
    base = long.groupBy(*ids).agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"),
                                  F.avg("value").alias("mean"))
    q = pooled_quantiles(long, "value", {"p5": 0.05, "p50": 0.5, "p95": 0.95}, ids)
    share = 1 - F.col("n_values") / F.col("n_rows")
    return (base.join(q, ids, "left").withColumn("null_share", share)
            .withColumn("sparse", F.col("null_share") > 0.05))
