"""Depth profiles: stratification, thermocline, sensor depth selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from limnoscope.functions.columns import as_col
from limnoscope.schema import KEYS, depth_column


def with_stratification(wide: DataFrame, depths: Sequence[float]) -> DataFrame:
    """``delta_T`` (shallowest minus deepest) and ``thermo_grad`` of a wide table.

    The gradient is positive only where deeper water is warmer and is floored at
    0.  A missing depth makes both null instead of being skipped.
    """
    ds = sorted(float(d) for d in depths)
    temp = [F.col(depth_column("temp", d)) for d in ds]
    known = temp[0].isNotNull()
    for t in temp[1:]:
        known = known & t.isNotNull()
    slopes = [(b - a) / F.lit(db - da) for a, b, da, db in zip(temp, temp[1:], ds, ds[1:])]
    return wide.withColumns({
        "delta_T": temp[0] - temp[-1],
        "thermo_grad": F.when(known, F.greatest(F.lit(0.0), F.lit(0.0), *slopes)),
    })


def stratification(profiles: DataFrame, by: Sequence[str], temp: str = "water_temp") -> DataFrame:
    """The same indices from long rows, one per (profile, depth)."""
    order = W.partitionBy(*by).orderBy("depth")
    grad = ((F.lead(temp).over(order) - F.col(temp))
            / (F.lead("depth").over(order) - F.col("depth")))
    return (profiles.withColumn("_g", grad).groupBy(*by)
            .agg((F.min_by(temp, "depth") - F.max_by(temp, "depth")).alias("delta_T"),
                 F.greatest(F.lit(0.0), F.coalesce(F.max("_g"), F.lit(0.0))).alias("thermo_grad"),
                 F.count(F.lit(1)).alias("n_depths")))


def water_density(temp):
    """Density of fresh water (kg/m3) from temperature, Martin & McCutcheon (1999)."""
    t = as_col(temp)
    return F.lit(1000.0) * (F.lit(1.0) - (t + 288.9414) * (t - 3.9863) * (t - 3.9863)
                            / (F.lit(508929.2) * (t + 68.12963)))


def thermocline(profiles: DataFrame, by: Sequence[str], temp: str = "water_temp",
                min_slope: float = 0.1, seasonal: bool = True, peak_share: float = 0.15,
                min_range: float = 1.0) -> DataFrame:
    """Thermocline depth per profile after Read et al. (2011).

    The layer with the steepest density gradient, its midpoint shifted towards
    the steeper neighbour; ``seasonal`` takes the deepest local gradient peak
    above ``max(peak_share * steepest, min_slope)``.  Null for profiles with
    fewer than three depths or a temperature range below ``min_range``.
    ``by`` should contain the time, so one group is one profile.
    """
    by = list(by)
    order = W.partitionBy(*by).orderBy("depth")
    p = (profiles.filter(F.col(temp).isNotNull())
         .withColumn("_rho", water_density(temp))
         .withColumns({
             "_z2": F.lead("depth").over(order), "_rho2": F.lead("_rho").over(order),
             "_range": F.max(temp).over(W.partitionBy(*by)) - F.min(temp).over(W.partitionBy(*by)),
             "_k": F.count(F.lit(1)).over(W.partitionBy(*by)),
         })
         .filter(F.col("_z2").isNotNull())
         .withColumn("_s", (F.col("_rho2") - F.col("_rho")) / (F.col("_z2") - F.col("depth")))
         .withColumn("_mid", (F.col("depth") + F.col("_z2")) / 2))
    p = p.withColumns({
        "_s_up": F.lag("_s").over(order), "_s_dn": F.lead("_s").over(order),
        "_mid_up": F.lag("_mid").over(order), "_mid_dn": F.lead("_mid").over(order),
        "_max": F.max("_s").over(W.partitionBy(*by)),
    })
    up, down = F.col("_s") - F.col("_s_up"), F.col("_s") - F.col("_s_dn")
    # Weighted shift: the flatter the step to one neighbour, the nearer the peak
    # lies to that side.
    w_dn = (F.col("_mid_dn") - F.col("_mid")) / down
    w_up = (F.col("_mid") - F.col("_mid_up")) / up
    refined = F.when(
        (up > 0) & (down > 0),
        F.col("_z2") * (w_dn / (w_dn + w_up)) + F.col("depth") * (w_up / (w_dn + w_up)),
    ).otherwise(F.col("_mid"))
    p = p.withColumn("_at", refined)
    peak = ((F.col("_s") > F.greatest(F.col("_max") * peak_share, F.lit(min_slope)))
            & (F.col("_s_up").isNull() | (up > 0)) & (F.col("_s_dn").isNull() | (down > 0)))
    steepest = F.max_by("_at", F.struct("_s", -F.col("depth")))
    deepest = F.max_by(F.when(peak, F.col("_at")), F.when(peak, F.col("depth")))
    depth = F.coalesce(deepest, steepest) if seasonal else steepest
    usable = (F.max("_range") >= min_range) & (F.max("_k") >= 3)
    return p.groupBy(*by).agg(
        F.when(usable & (depth > 0), depth).alias("thermo_depth"),
        F.max("_k").alias("n_depths"))


# ------------------------------------------------------------ depth selection
def bracket_weights(depths: Sequence[float], subset: Sequence[float]) -> dict[float, list[float]]:
    """Linear interpolation of every depth from the observed ones, ends held flat.

    Gives per depth the weight of each observed depth; at most two are non-zero.
    """
    obs = sorted(float(d) for d in subset)
    out = {}
    for d in depths:
        w = [0.0] * len(obs)
        if d <= obs[0]:
            w[0] = 1.0
        elif d >= obs[-1]:
            w[-1] = 1.0
        else:
            j = next(i for i, o in enumerate(obs) if o >= d)
            share = (d - obs[j - 1]) / (obs[j] - obs[j - 1])
            w[j - 1], w[j] = 1.0 - share, share
        out[float(d)] = w
    return out


def _squared_error(depths, subset, prefix):
    obs = sorted(float(d) for d in subset)
    hidden = [float(d) for d in depths if float(d) not in set(obs)]
    weights = bracket_weights(depths, obs)
    total = F.lit(0.0)
    for d in hidden:
        guess = F.lit(0.0)
        for o, w in zip(obs, weights[d]):
            if w:
                guess = guess + F.col(depth_column(prefix, o)) * F.lit(w)
        err = guess - F.col(depth_column(prefix, d))
        total = total + err * err
    return total, len(hidden)


def subset_rmse(wide: DataFrame, subsets: dict[str, Sequence[float]], depths: Sequence[float],
                prefix: str = "temp", keys: Sequence[str] = KEYS) -> DataFrame:
    """RMSE over the hidden depths of rebuilding the profile from each subset.

    All subsets are scored in one pass over the rows; an empty subset scores the
    spread around each depth's mean.
    """
    aggs = []
    for name, subset in subsets.items():
        if not subset:
            spread = [F.var_samp(depth_column(prefix, d)) for d in depths]
            total = spread[0]
            for v in spread[1:]:
                total = total + v
            aggs.append(F.sqrt(total / F.lit(float(len(spread)))).alias(name))
        else:
            sq, n_hidden = _squared_error(depths, subset, prefix)
            aggs.append(F.sqrt(F.avg(sq) / F.lit(float(n_hidden))).alias(name) if n_hidden
                        else F.lit(0.0).alias(name))
    grouped = wide.groupBy(*keys) if keys else wide.groupBy()
    scores = grouped.agg(*aggs)
    return scores.unpivot(list(keys), list(subsets), "subset", "rmse")


def greedy_depths(wide: DataFrame, depths: Sequence[float], budget: int,
                  prefix: str = "temp") -> list[tuple[float, float]]:
    """Choose ``budget`` depths one by one, each step the one that lowers the
    rebuild error most (the shallowest on a tie), over all rows of ``wide``.

    Each step is one job that scores every candidate; what reaches the driver is
    one row of at most ``len(depths)`` numbers.
    """
    ds = [float(d) for d in depths]
    chosen: list[tuple[float, float]] = []
    for _ in range(min(budget, len(ds))):
        have = [d for d, _ in chosen]
        candidates = {f"c{i}": [*have, d] for i, d in enumerate(ds) if d not in have}
        aggs = []
        for name, subset in candidates.items():
            sq, n_hidden = _squared_error(ds, subset, prefix)
            aggs.append((F.sqrt(F.avg(sq) / F.lit(float(n_hidden))) if n_hidden
                         else F.lit(0.0)).alias(name))
        row = wide.agg(*aggs).first().asDict()
        best = min(candidates, key=lambda c: (row[c], ds[int(c[1:])]))
        chosen.append((ds[int(best[1:])], row[best]))
    return chosen


def greedy_depths_by_site(wide: DataFrame, depths: Sequence[float], budget: int,
                          prefix: str = "temp", keys: Sequence[str] = KEYS) -> DataFrame:
    """The same selection separately for every station, without the driver.

    The rebuild error of any subset is a quadratic form in the second moments
    ``E[x_a x_b]`` of the depths, so one aggregation per station (a moment for
    each pair of depths) carries all the data there is to read.  The greedy
    steps then run on one row per station.
    """
    ds = sorted(float(d) for d in depths)
    n = len(ds)
    cols = [F.col(depth_column(prefix, d)) for d in ds]
    moments = wide.groupBy(*keys).agg(
        *[F.avg(cols[i] * cols[j]).alias(f"_m{i}_{j}") for i in range(n) for j in range(i, n)])
    m = F.array(*[F.array(*[F.col(f"_m{min(i, j)}_{max(i, j)}") for j in range(n)])
                  for i in range(n)])
    base = moments.select(*keys, m.alias("_m"), F.array().cast("array<int>").alias("_sel"),
                          F.array().cast("array<double>").alias("_err"))

    positions = F.sequence(F.lit(0), F.lit(n - 1))
    depth_values = F.array(*[F.lit(d) for d in ds])

    def score(sel):
        """Mean squared rebuild error of the hidden depths for the sorted subset ``sel``."""
        def one(i):
            lo = F.coalesce(F.array_max(F.filter(sel, lambda s: s <= i)), F.array_min(sel))
            hi = F.coalesce(F.array_min(F.filter(sel, lambda s: s >= i)), F.array_max(sel))
            z_lo, z_hi, z = F.get(depth_values, lo), F.get(depth_values, hi), F.get(depth_values, i)
            v = F.when(hi > lo, (z - z_lo) / F.when(hi > lo, z_hi - z_lo)).otherwise(F.lit(0.0))
            u = F.lit(1.0) - v

            def mm(a, b):
                return F.get(F.get(F.col("_m"), a), b)
            return (u * u * mm(lo, lo) + v * v * mm(hi, hi) + mm(i, i) + u * v * 2 * mm(lo, hi)
                    - u * 2 * mm(lo, i) - v * 2 * mm(hi, i))
        hidden = F.filter(positions, lambda i: ~F.array_contains(sel, i))
        total = F.aggregate(F.transform(hidden, one), F.lit(0.0), lambda acc, e: acc + e)
        return F.when(F.size(hidden) > 0, total / F.greatest(F.size(hidden), F.lit(1))).otherwise(0.0)

    state = base
    for _ in range(min(budget, n)):
        sel = F.col("_sel")
        candidates = F.transform(
            F.filter(positions, lambda i: ~F.array_contains(sel, i)),
            lambda i: F.struct(score(F.array_append(sel, i)).alias("e"), i.alias("i")))
        state = (state.withColumn("_best", F.array_min(candidates))
                 .withColumn("_sel", F.array_append("_sel", F.col("_best.i")))
                 .withColumn("_err", F.array_append(
                     "_err", F.sqrt(F.greatest(F.col("_best.e"), F.lit(0.0)))))
                 .drop("_best"))
    return state.select(
        *keys, F.posexplode(F.arrays_zip(F.col("_sel").alias("s"), F.col("_err").alias("e"))).alias("step", "_z"),
    ).select(*keys, (F.col("step") + 1).alias("step"),
             F.get(depth_values, F.col("_z.s")).alias("depth"), F.col("_z.e").alias("rmse"))
