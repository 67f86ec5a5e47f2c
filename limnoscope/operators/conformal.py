"""Split-conformal adjustment of the 10-90 % interval and its seasonal variants.

Score ranks come from :mod:`ranks`, so a calibration pool may be of any size.
All scores of a call share one ranking pass: they are rows of (side, score).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnoscope.functions.columns import as_col, month_distance, season_weight
from limnoscope.operators.ranks import order_statistic, weighted_quantile

_ALL = ("abs50", "symabs", "low", "up")


def conformity_scores(df: DataFrame, q10="q10", q50="q50", q90="q90", y="y_h",
                      sides: Sequence[str] = _ALL, carry: Sequence[str] = ()) -> DataFrame:
    """Rows (side, score): distance to the median, signed excess, and the excess below / above."""
    q10, q50, q90, y = map(as_col, (q10, q50, q90, y))
    made = {"abs50": F.abs(y - q50), "symabs": F.greatest(q10 - y, y - q90),
            "low": F.greatest(q10 - y, F.lit(0.0)), "up": F.greatest(y - q90, F.lit(0.0))}
    rows = F.array(*[F.struct(F.lit(s).alias("side"), made[s].alias("score")) for s in sides])
    return df.select(*carry, F.inline(rows))


def conformal_k(alpha: float, n: Column | str = "total") -> Column:
    """Finite-sample order statistic, clipped to 1..n."""
    k = F.ceil((as_col(n) + 1) * F.lit(1.0 - alpha))
    return F.greatest(F.lit(1), F.least(k, as_col(n)))


def _wide(per_side: DataFrame, value: str, keys: Sequence[str], sides: Sequence[str]) -> DataFrame:
    return per_side.groupBy(*keys).agg(
        *[F.max(F.when(F.col("side") == s, F.col(value))).alias(f"adj_{s}") for s in sides],
        F.max("n_scores").alias("n_scores"))


def calibrate(cal: DataFrame, alpha: float, keys: Sequence[str], sides: Sequence[str] = _ALL,
              **columns) -> DataFrame:
    """Adjustment per group and side: ``adj_abs50``, ``adj_symabs``, ``adj_low``, ``adj_up``."""
    scores = conformity_scores(cal, sides=sides, carry=keys, **columns)
    stat = order_statistic(scores, "score", conformal_k(alpha), [*keys, "side"])
    return _wide(stat, "value_k", keys, sides)


def calibrate_weighted(pool: DataFrame, alpha: float, keys: Sequence[str], month: str = "month",
                       centre: str = "centre_month", sigma: float = 1.0, **columns) -> DataFrame:
    """As :func:`calibrate` for the two sides, scores weighted by season distance."""
    weighed = pool.withColumn("_w", season_weight(month, centre, sigma))
    scores = conformity_scores(weighed, sides=("low", "up"), carry=[*keys, "_w"], **columns)
    stat = weighted_quantile(scores, "score", "_w", 1.0 - alpha, [*keys, "side"])
    return _wide(stat, "value_w", keys, ("low", "up"))


def season_pool(pool: DataFrame, month: str = "month", centre: str = "centre_month",
                width: int = 1) -> DataFrame:
    """Rows whose month is at most ``width`` from the centre on the yearly circle."""
    return pool.filter(month_distance(month, centre) <= width)


def previous_year_block(samples: DataFrame, month: str, centre: str, year: str, test_year: str,
                        width: int = 1) -> tuple[DataFrame, DataFrame]:
    """Train samples without, and only, the same-season block of the year before the test."""
    held = (month_distance(month, centre) <= width) & (F.col(year) == F.col(test_year) - 1)
    held = F.coalesce(held, F.lit(False))
    return samples.filter(~held), samples.filter(held)


def calibrate_seasonal(pool: DataFrame, alpha: float, keys: Sequence[str], month: str = "month",
                       centre: str = "centre_month", **columns) -> DataFrame:
    """Season-regression variant: month means of the scores (a month without rows takes the
    overall mean), smoothed with weights 1/4, 1/2, 1/4 around the year, are taken out of
    the scores; the adjustment is the centre month's level plus the conformal quantile of
    what is left."""
    ids = [*keys, "side"]
    scores = conformity_scores(pool, sides=("low", "up"), carry=[*keys, month, centre], **columns)
    by_month = F.array(*[F.avg(F.when(F.col(month) == m, F.col("score"))) for m in range(1, 13)])
    levels = scores.groupBy(*ids).agg(by_month.alias("_m"), F.avg("score").alias("_all"),
                                      F.max(centre).alias("_centre"))
    levels = levels.withColumn("_m", F.transform("_m", lambda v: F.coalesce(v, F.col("_all"))))
    smooth = F.transform("_m", lambda v, i: F.get("_m", (i + 11) % 12) * 0.25 + v * 0.5
                         + F.get("_m", (i + 1) % 12) * 0.25)
    levels = levels.select(*ids, smooth.alias("_level"), "_centre")
    rest = (scores.join(levels, ids)
            .withColumn("_rest", F.col("score") - F.get("_level", F.col(month) - 1)))
    stat = order_statistic(rest, "_rest", conformal_k(alpha), ids)
    total = F.get("_level", F.col("_centre") - 1) + F.col("value_k")
    return _wide(stat.join(levels, ids).withColumn("value_k", total), "value_k", keys, ("low", "up"))


def adjusted_intervals(df: DataFrame, methods: Sequence[str] = ("raw", "abs50", "symabs", "cqr"),
                       q10="q10", q50="q50", q90="q90") -> DataFrame:
    """Apply joined-on adjustments: one row per method with ``lower``, ``middle``, ``upper``.

    An adjusted interval always contains the median.
    """
    lo, mid, hi = map(as_col, (q10, q50, q90))
    ends = {
        "raw": lambda: (lo, hi),
        "abs50": lambda: (mid - F.col("adj_abs50"), mid + F.col("adj_abs50")),
        "symabs": lambda: (lo - F.col("adj_symabs"), hi + F.col("adj_symabs")),
        "cqr": lambda: (lo - F.col("adj_low"), hi + F.col("adj_up")),
    }
    rows = []
    for method in methods:
        if method not in ends:
            raise ValueError(f"unknown conformal method: {method}")
        a, b = ends[method]()
        if method != "raw":
            a, b = F.least(a, mid), F.greatest(b, mid)
        rows.append(F.struct(F.lit(method).alias("method"), a.alias("lower"), mid.alias("middle"), b.alias("upper")))
    return df.select("*", F.inline(F.array(*rows)))


def finite_sample_index(n: int, level: float) -> int:
    """The same order statistic for plain numbers."""
    return max(1, min(math.ceil((n + 1) * level), n))
