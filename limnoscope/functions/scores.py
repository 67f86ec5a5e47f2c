"""Probabilistic scores and probability-of-rise formulas as column expressions.

Quantile forecasts are ``array<double>`` columns with the levels given as a
Python sequence.  No Python function runs per row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnoscope.functions.columns import as_col, let, normal_cdf, normal_pdf


def sorted_quantiles(q) -> Column:
    """Uncross a quantile forecast."""
    return F.array_sort(as_col(q))


def quantile_at(q, levels: Sequence[float], level: float) -> Column:
    """The forecast at one of its own levels."""
    for i, p in enumerate(levels):
        if math.isclose(p, level):
            return F.get(as_col(q), F.lit(i))
    raise ValueError(f"level {level} is not among {tuple(levels)}")


def array_median(q) -> Column:
    """Median of an array without nulls."""
    s = F.array_sort(as_col(q))
    n = F.size(s)
    lo = F.get(s, F.floor((n - 1) / 2).cast("int"))
    hi = F.get(s, F.floor(n / 2).cast("int"))
    return (lo + hi) / F.lit(2.0)


def crps_quantiles(q, levels: Sequence[float], y) -> Column:
    """CRPS of the piecewise-linear distribution through the quantile knots.

    The outer slopes are continued to probability 0 and 1.  Per segment the
    quantile function is a line, so ``2 * integral (1{y <= Q(a)} - a)(Q(a) - y) da``
    has a closed form on both sides of the level where the line crosses ``y``.
    A flat segment is given slope 1, a collapsed forecast scores the distance
    to its median, and the result is never below 0.
    """
    p = sorted(float(v) for v in levels)
    if len(p) < 2:
        raise ValueError("at least two quantile levels are needed")
    y, s = as_col(y), F.sort_array(as_col(q))
    n = len(p)
    at = [F.get(s, F.lit(i)) for i in range(n)]
    low = at[0] - (at[1] - at[0]) * F.lit(p[0] / (p[1] - p[0]))
    high = at[-1] + (at[-1] - at[-2]) * F.lit((1.0 - p[-1]) / (p[-1] - p[-2]))
    knots, bounds = [low, *at, high], [0.0, *p, 1.0]

    def area(i):
        # Below the crossing level c and above it the same w and m count but for the second term.
        a, b = bounds[i], bounds[i + 1]
        slope = (knots[i + 1] - knots[i]) / F.lit(b - a)
        m = F.when(F.abs(slope) < 1e-12, F.lit(1.0)).otherwise(slope)
        w = y - knots[i] + m * F.lit(a)
        c = F.least(F.greatest(w / m, F.lit(a)), F.lit(b))
        whole = w * F.lit(b * b - a * a) - m * F.lit(2.0 * (b * b * b - a * a * a) / 3.0)
        return whole + (F.lit(b) - c) * (m * (F.lit(b) + c) - w * 2.0)

    # Written out per segment, without functions of arrays, so that it is compiled and shared parts are computed once.
    total = sum((area(i) for i in range(1, n + 1)), area(0))
    to_median = F.abs(y - (at[(n - 1) // 2] + at[n // 2]) / F.lit(2.0))
    collapsed = F.when((high - low) < 1e-9, F.lit(1)).otherwise(F.lit(0))
    return F.greatest(F.get(F.array(total, to_median), collapsed), F.lit(0.0))


def crps_energy(q, y) -> Column:
    """CRPS of the equally weighted sample ``q``: E|X-y| - E|X-X'|/2."""
    q, y = as_col(q), as_col(y)
    n = F.size(q).cast("double")
    near = F.aggregate(q, F.lit(0.0), lambda acc, v: acc + F.abs(v - y)) / n
    # For sorted x, sum over all pairs |x_i - x_j| = 2 * sum (2i - n + 1) x_i.
    order = F.transform(F.sort_array(q), lambda v, i: v * (i * 2 - n + 1))
    spread = F.aggregate(order, F.lit(0.0), lambda acc, v: acc + v) * 2 / (n * n)
    return near - spread / 2


def crps_gaussian(mean, std, y) -> Column:
    s = F.greatest(as_col(std), F.lit(1e-6))
    return s * let((as_col(y) - as_col(mean)) / s, lambda z: (
        z * (normal_cdf(z) * 2 - 1) + normal_pdf(z) * 2 - F.lit(1 / math.sqrt(math.pi))))


def pinball(q, levels: Sequence[float], y) -> Column:
    """Sum over the levels of the quantile loss."""
    y = as_col(y)
    pairs = F.arrays_zip(as_col(q).alias("q"), F.array(*[F.lit(float(p)) for p in levels]).alias("p"))
    return F.aggregate(
        pairs, F.lit(0.0),
        lambda acc, v: acc + F.greatest(v["p"] * (y - v["q"]), (v["p"] - 1) * (y - v["q"])),
    )


def crps_pinball(q, levels: Sequence[float], y) -> Column:
    """CRPS approximated by twice the mean quantile loss; |y - q| for a point."""
    return pinball(q, levels, y) * F.lit(2.0 / len(levels))


def pit(q, y) -> Column:
    """Rank of ``y`` among the quantiles, ties counted half, scaled to [0, 1]."""
    y = as_col(y)
    hits = F.aggregate(
        as_col(q), F.lit(0.0),
        lambda acc, v: acc + F.when(v < y, 1.0).when(v == y, 0.5).otherwise(0.0),
    )
    return hits / F.size(as_col(q))


# ------------------------------------------------------- probability of a rise
# Width of the normal 10-90 range, and the largest |z|.
NORMAL_RANGE, LARGEST_Z = 2.563, 5.0


def _ordered(q10, q50, q90) -> tuple[Column, Column, Column]:
    """The three quantiles ascending: quantiles of separate models can cross."""
    low, mid, high = map(as_col, (q10, q50, q90))
    return F.least(low, mid, high), F.greatest(F.least(low, mid), F.least(F.greatest(low, mid), high)), F.greatest(low, mid, high)


def prob_up_gaussian(q10, q50, q90) -> Column:
    """Normal law through the median with the 10-90 range as its width."""
    q10, q50, q90 = _ordered(q10, q50, q90)
    sigma = (q90 - q10) / F.lit(NORMAL_RANGE)
    z = (F.when(sigma > 1e-9, q50 / F.greatest(sigma, F.lit(1e-12)))
         .when(q50 > 0, F.lit(LARGEST_Z)).when(q50 < 0, F.lit(-LARGEST_Z)).otherwise(F.lit(0.0)))
    return let(normal_cdf(z), lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)))


_PROBS = (0.0, 0.1, 0.5, 0.9, 1.0)


def with_prob_up(df: DataFrame, q10, q50, q90, *, linear="p_linear", monotone="p_monotone") -> DataFrame:
    """P(change > 0) from three quantiles of the change, by a linear and by a
    monotone cubic (Fritsch-Carlson) distribution function through five knots.

    The outer knots continue the outer segments to probability 0 and 1.  The
    segment that holds 0 is found first and its ends are taken from arrays, so
    each formula appears once in the generated code.
    """
    w = df.withColumns(dict(zip(("_low", "_mid", "_high"), _ordered(q10, q50, q90), strict=True)))
    low, mid, high = F.col("_low"), F.col("_mid"), F.col("_high")
    probs = F.array(*[F.lit(p) for p in _PROBS])
    dy = [b - a for a, b in zip(_PROBS, _PROBS[1:])]
    w = w.withColumn("_x", F.array(low - (mid - low) / 4, low, mid, high, high + (high - mid) / 4))

    def x(i):
        return F.get("_x", F.lit(i))

    w = w.withColumn("_h", F.array(*[x(i + 1) - x(i) for i in range(4)]))

    def h(i):
        return F.get("_h", F.lit(i))

    def inner(i):
        """Slope at knot i: weighted harmonic mean of the neighbouring secants, written
        with inverse secants h/dy so that tied knots need no infinity."""
        left, right = h(i - 1) * 2 + h(i), h(i - 1) + h(i) * 2
        denom = left * h(i - 1) / F.lit(dy[i - 1]) + right * h(i) / F.lit(dy[i])
        return F.when(F.abs(denom) >= 1e-12, (left + right) / F.when(F.abs(denom) >= 1e-12, denom)).otherwise(0.0)

    def outer(i):
        return F.when(h(i) > 0, F.lit(dy[i]) / F.when(h(i) > 0, h(i))).otherwise(0.0)

    at = sum((x(i) <= 0).cast("int") for i in (2, 3)) + (x(1) <= 0).cast("int")
    w = w.withColumns({"_d": F.array(outer(0), inner(1), inner(2), inner(3), outer(3)), "_i": at})
    i = F.col("_i")
    width, left = F.get("_h", i), F.get("_x", i)
    w = w.withColumns({
        "_t": F.when(width > 0, -left / F.when(width > 0, width)).otherwise(0.0),
        "_y0": F.get(probs, i), "_y1": F.get(probs, i + 1),
        "_r0": width * F.get("_d", i), "_r1": width * F.get("_d", i + 1),
    })
    t, y0, y1 = F.col("_t"), F.col("_y0"), F.col("_y1")
    cubic = ((t * t * t * 2 - t * t * 3 + 1) * y0 + (t * t * t - t * t * 2 + t) * F.col("_r0")
             + (t * t * 3 - t * t * t * 2) * y1 + (t * t * t - t * t) * F.col("_r1"))

    def at_zero(value):
        inside = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
        return F.when(x(0) >= 0, F.lit(0.0)).when(x(4) <= 0, F.lit(1.0)).otherwise(inside)

    flat = (x(3) - x(1)) < 1e-9
    collapsed = F.when(x(2) > 1e-9, F.lit(0.0)).when(x(2) < -1e-9, F.lit(1.0)).otherwise(F.lit(0.5))
    return w.withColumns({
        linear: F.lit(1.0) - at_zero(y0 + t * (y1 - y0)),
        monotone: F.lit(1.0) - F.when(flat, collapsed).otherwise(at_zero(cubic)),
    }).drop("_low", "_mid", "_high", "_x", "_h", "_d", "_i", "_t", "_y0", "_y1", "_r0", "_r1")
