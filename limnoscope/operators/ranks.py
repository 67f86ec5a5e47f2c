"""Exact order statistics that do not need one task per group.

A ``percentile`` aggregate or a ``row_number`` window holds a whole group in
one task.  That is fine for rows of a regridded station (their count is bounded
by the calendar) but not for pooled groups such as "every forecast of horizon
3", which may be a third of all rows.  Here rows are first collapsed to
distinct values (map-side, so ties cost nothing) and stored; groups beyond
:data:`slices.ROWS_A_SLICE` values are cut into order-preserving slices at sampled
quantiles, the running counts are taken per slice, and the totals of the slices
below, one row per slice, are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from limnoscope.operators.slices import join_keys, sliced
from limnoscope.session import settled


def ranked_values(df: DataFrame, value: str, keys: Sequence[str] = (), weight: str | None = None,
                  carry: dict[str, Column] | None = None, count: str | None = None,
                  rows_a_slice: int | None = None) -> DataFrame:
    """One row per (keys, value): ``n`` rows there, ``below`` rows with a smaller
    value, ``total`` rows of the group; with ``weight`` also ``w``, ``w_below``
    and ``w_total``.  ``carry`` adds sums kept per distinct value (``<name>_total`` for the group).
    ``count`` names a column that says how many rows a row stands for.
    """
    keys, x = list(keys), F.col(value)
    aggs = {"n": F.sum(count) if count else F.count(F.lit(1))}
    if weight:
        aggs["w"] = F.sum(weight)
    aggs |= carry or {}
    # Adding 0.0 turns -0.0 into 0.0, so both fall into one group.
    rows = df.filter(x.isNotNull() & ~F.isnan(x)).withColumn(value, x + F.lit(0.0))
    group = keys or ["_all"]
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
    distinct = settled(rows.groupBy(*group, value).agg(*[c.alias(k) for k, c in aggs.items()]))
    sums = {"n": "below"} | ({"w": "w_below"} if weight else {})
    totals = {"n": "total"} | ({"w": "w_total"} if weight else {}) | {c: f"{c}_total" for c in carry or {}}
    parts = sliced(distinct, value, group, rows_a_slice)
    inside = W.partitionBy(*group, "_slice").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    whole = W.partitionBy(*group)
    run = whole.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = parts.groupBy(*group, "_slice").agg(*[F.sum(c).alias(f"_{c}") for c in totals])
    slices = slices.select(*group, "_slice", *[F.coalesce(F.sum(f"_{c}").over(run), F.lit(0)).alias(f"_off_{c}") for c in sums],
                           *[F.sum(f"_{c}").over(whole).alias(t) for c, t in totals.items()])
    return join_keys(parts, slices, [*group, "_slice"]).select(
        *keys, value, *aggs, *[(F.col(f"_off_{c}") + F.col(f"_in_{c}")).alias(b) for c, b in sums.items()], *totals.values())


def pooled_quantiles(df: DataFrame, value: str, probs: dict[str, float],
                     keys: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Exact quantiles by linear interpolation, one column per entry of ``probs``."""
    keys = list(keys)
    ranked = ranked_values(df, value, keys, count=count)

    def point(p):
        at = F.lit(float(p)) * (F.col("total") - 1)
        lo = F.max(F.when(F.col("below") <= F.floor(at), F.col(value)))
        hi = F.max(F.when(F.col("below") <= F.ceil(at), F.col(value)))
        frac = F.max(at - F.floor(at))
        return lo + (hi - lo) * frac

    grouped = ranked.groupBy(*keys) if keys else ranked.groupBy()
    return grouped.agg(*[point(p).alias(name) for name, p in probs.items()])


def order_statistic(df: DataFrame, value: str, k: Column, keys: Sequence[str] = (),
                    name: str = "value_k") -> DataFrame:
    """The ``k``-th smallest value of each group; ``k`` may use the column ``total``."""
    keys = list(keys)
    ranked = ranked_values(df, value, keys)
    hit = ranked.filter((F.col("below") < k) & (k <= F.col("below") + F.col("n")))
    return hit.select(*keys, F.col(value).alias(name), F.col("total").alias("n_scores"))


def weighted_quantile(df: DataFrame, value: str, weight: str, level: float,
                      keys: Sequence[str] = (), name: str = "value_w") -> DataFrame:
    """First value whose cumulated weight reaches ``level`` of the group's weight."""
    keys = list(keys)
    ranked = ranked_values(df, value, keys, weight=weight)
    # The last value always qualifies, whatever rounding does to the running sum.
    reached = ((F.col("w_below") + F.col("w") >= F.lit(level) * F.col("w_total"))
               | (F.col("below") + F.col("n") == F.col("total")))
    pick = ranked.filter(reached)
    grouped = pick.groupBy(*keys) if keys else pick.groupBy()
    return grouped.agg(F.min(value).alias(name), F.max("total").alias("n_scores"))


def with_average_rank(df: DataFrame, value: str, keys: Sequence[str] = (),
                      name: str = "rank") -> DataFrame:
    """Attach the 1-based rank, ties averaged; rows without a value get null."""
    keys = list(keys)
    ranked = ranked_values(df, value, keys).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(value).alias("_v"),
        (F.col("below") + (F.col("n") + 1) / F.lit(2.0)).alias(name))
    cond = (F.col(value) + F.lit(0.0)) == F.col("_v")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(ranked, cond, "left").drop("_v", *[f"_k_{k}" for k in keys])


def roc_auc(df: DataFrame, score: str, label: str, keys: Sequence[str] = (),
            name: str = "auc") -> DataFrame:
    """Area under the ROC curve from rank sums; null when one class is missing."""
    keys = list(keys)
    ranked = ranked_values(df, score, keys, carry={"pos": F.sum(F.col(label).cast("bigint"))})
    mean_rank = F.col("below") + (F.col("n") + 1) / F.lit(2.0)
    grouped = ranked.groupBy(*keys) if keys else ranked.groupBy()
    sums = grouped.agg(F.max("pos_total").alias("n_pos"), F.max("total").alias("_n"),
                       F.sum(mean_rank * F.col("pos")).alias("_r"))
    pos, neg = F.col("n_pos"), F.col("_n") - F.col("n_pos")
    auc = F.when((pos > 0) & (neg > 0),
                 (F.col("_r") - pos * (pos + 1) / F.lit(2.0)) / (pos * neg))
    return sums.select(*keys, "n_pos", neg.alias("n_neg"), auc.alias(name))
