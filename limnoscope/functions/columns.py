"""Scalar expressions: casts, grid time, season, wind, transforms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it.

    A long expression that is repeated in a formula would be repeated in the
    generated code as well, up to its size limit.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---------------------------------------------------------------- casts
def pad_site_id(site_id, width: int = 4) -> Column:
    """Left-pad with zeros to ``width``; longer ids are kept whole."""
    s = as_col(site_id).cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def finite_or_null(x) -> Column:
    """NaN becomes null, so that it is skipped by means and found by ``dropna``."""
    x = as_col(x)
    return F.when(~F.isnan(x), x)


def mean(x) -> Column:
    """Average that skips null and NaN."""
    return F.avg(finite_or_null(as_col(x).cast("double")))


def coerce_double(x) -> Column:
    """Number or null: text that is no number, and NaN, becomes null."""
    return finite_or_null(as_col(x).try_cast("double"))


#: Forms of time that spreadsheet exports use besides ISO.
TIME_FORMATS = ("yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy/M/d", "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d",
                "yyyy.M.d H:m:s", "yyyy.M.d H:m", "yyyy.M.d")


def coerce_timestamp(x, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """Time or null: ISO text first, then the first of ``formats`` that fits."""
    text = F.trim(as_col(x).cast("string"))
    return F.coalesce(text.try_cast("timestamp_ntz"),
                      *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats])


# ---------------------------------------------------------------- time
def floor_to_grid(ts, hours: int = 3) -> Column:
    """Start of the grid cell holding ``ts``; ``hours`` must divide a day.

    Only calendar fields are used, so the result keeps the input type and does
    not depend on the session time zone.
    """
    if 24 % hours:
        raise ValueError("a grid step must divide 24 hours; use floor_to_days for longer steps")
    t = as_col(ts)
    return t - F.make_dt_interval(
        F.lit(0), F.hour(t) % F.lit(hours), F.minute(t), F.extract(F.lit("SECOND"), t)
    )


def floor_to_days(day, origin, days: int) -> Column:
    """First day of the ``days``-long step counted from ``origin``."""
    d, o = as_col(day), as_col(origin)
    return F.date_add(o, (F.floor(F.datediff(d, o) / F.lit(days)) * days).cast("int"))


def hours_between(later, earlier) -> Column:
    return F.timestamp_diff("MICROSECOND", as_col(earlier), as_col(later)) / F.lit(3.6e9)


def day_fraction_of_year(ts) -> Column:
    t = as_col(ts)
    return F.dayofyear(t) + (F.hour(t) + F.minute(t) / F.lit(60.0)) / F.lit(24.0)


def season_terms(ts) -> tuple[Column, Column]:
    """Sine and cosine of the fractional day of year over 365.25 days."""
    angle = F.lit(2 * math.pi) * day_fraction_of_year(ts) / F.lit(365.25)
    return F.sin(angle), F.cos(angle)


def month_distance(a, b) -> Column:
    """Months apart on the yearly circle, 0 to 6."""
    d = F.abs(as_col(a) - as_col(b)) % 12
    return F.least(d, F.lit(12) - d)


def season_weight(month, centre, sigma: float = 1.0) -> Column:
    """Gaussian weight of a month by its circular distance from ``centre``."""
    d = month_distance(month, centre)
    return F.exp(-(d * d) / F.lit(2.0 * sigma * sigma))


# ---------------------------------------------------------------- wind
def wind_components(speed, direction) -> tuple[Column, Column]:
    """Vector components; take them before averaging, an angle has no mean."""
    angle = F.radians(as_col(direction))
    return as_col(speed) * F.cos(angle), as_col(speed) * F.sin(angle)


def direction_terms(direction) -> tuple[Column, Column]:
    angle = F.radians(as_col(direction))
    return F.sin(angle), F.cos(angle)


# ---------------------------------------------------------------- scaling
def log_concentration(x) -> Column:
    return F.log1p(F.greatest(as_col(x), F.lit(0.0)))


def zscore(x, mean, std) -> Column:
    """``std`` is the fitted scale, which already carries its epsilon."""
    return (as_col(x) - as_col(mean)) / as_col(std)


def to_target(kind: str, current, future, floor: float = 1.0) -> Column:
    """Training target of a forecast: difference, relative, log ratio or log."""
    cur, fut = as_col(current), as_col(future)
    if kind == "abs_delta":
        return fut - cur
    if kind == "rel_delta":
        return (fut - cur) / F.greatest(cur, F.lit(floor))
    if kind == "log_ratio":
        return F.log1p(fut) - F.log1p(cur)
    if kind == "abs_log":
        return F.log1p(fut)
    raise ValueError(f"unknown target kind: {kind}")


def from_target(kind: str, current, target, floor: float = 1.0) -> Column:
    """Back to concentration from a target made by :func:`to_target`."""
    cur, tgt = as_col(current), as_col(target)
    if kind == "abs_delta":
        return cur + tgt
    if kind == "rel_delta":
        return cur + F.greatest(cur, F.lit(floor)) * tgt
    if kind == "log_ratio":
        return F.expm1(F.log1p(cur) + tgt)
    if kind == "abs_log":
        return F.expm1(tgt)
    raise ValueError(f"unknown target kind: {kind}")


def quantiles_from_target(kind: str, current, quantiles, scale=1.0, floor: float = 1.0) -> Column:
    """A quantile forecast of a scaled target, an array, back to concentration.

    ``scale`` is what the target was divided by (:func:`windows.target_scale`). All
    transforms increase with the target, so the order of the levels is kept.
    """
    unit = as_col(scale) if not isinstance(scale, float) else F.lit(scale)
    return F.transform(as_col(quantiles), lambda q: from_target(kind, current, q * unit, floor))


# ---------------------------------------------------------------- normal law
# --- fixed values: Abramowitz & Stegun 7.1.26, |error| <= 1.5e-7 ------------
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z) -> Column:
    def cdf(v):
        x = F.abs(v) / F.lit(math.sqrt(2.0))
        t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
        poly = F.lit(0.0)
        for a in reversed(ERF_A):
            poly = (poly + F.lit(a)) * t
        tail = F.lit(0.5) * poly * F.exp(-x * x)
        return F.when(v >= 0, F.lit(1.0) - tail).otherwise(tail)

    return let(as_col(z), cdf)


def normal_pdf(z) -> Column:
    z = as_col(z)
    return F.exp(F.lit(-0.5) * z * z) / F.lit(math.sqrt(2 * math.pi))
