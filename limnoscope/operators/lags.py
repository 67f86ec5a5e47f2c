"""Dependence between depths, variables and lags.

Lagged products are formed inside one window per station: each row collects its
next (or previous) rows once and the pairs are aggregated where they arise, so
no series is joined with itself.  The series are gridded, hence bounded by the
calendar; rows times lags is reduced map-side to one row per lag.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from limnoscope.functions.columns import let, normal_cdf
from limnoscope.operators.slices import numbered
from limnoscope.schema import KEYS, depth_column
from limnoscope.session import settled


def depth_correlation(wide: DataFrame, depths: Sequence[float], prefix: str = "conc",
                      keys: Sequence[str] = KEYS) -> DataFrame:
    """Pearson correlation of every pair of depths (pairwise complete), one aggregation
    over the wide table; gives rows (depth_a <= depth_b, corr, n)."""
    ds = sorted(float(d) for d in depths)
    pairs = [(a, b) for i, a in enumerate(ds) for b in ds[i:]]
    col = {d: F.col(depth_column(prefix, d)) for d in ds}
    both = {(a, b): col[a].isNotNull() & col[b].isNotNull() for a, b in pairs}
    stats = wide.groupBy(*keys).agg(
        F.array(*[F.corr(col[a], col[b]) for a, b in pairs]).alias("_r"),
        F.array(*[F.sum(both[p].cast("bigint")) for p in pairs]).alias("_n"))
    grid = F.array(*[F.struct(F.lit(a).alias("depth_a"), F.lit(b).alias("depth_b"),
                              F.get("_r", F.lit(i)).alias("corr"), F.get("_n", F.lit(i)).alias("n"))
                     for i, (a, b) in enumerate(pairs)])
    return stats.select(*keys, F.inline(grid))


def correlation_summary(corr: DataFrame, groups: dict[str, tuple[float, float]],
                        keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean correlation of neighbouring depths, inside each depth group and across groups.

    ``groups`` maps a name to its depth range (both ends inclusive).
    """
    off = corr.filter(F.col("depth_a") < F.col("depth_b"))
    names = list(groups)

    def group_of(c):
        out = F.lit(None).cast("string")
        for n in reversed(names):
            out = F.when(F.col(c).between(*groups[n]), F.lit(n)).otherwise(out)
        return out

    nearest = W.partitionBy(*keys, "depth_a").orderBy("depth_b")
    adjacent = (off.withColumn("_k", F.row_number().over(nearest)).filter("_k = 1")
                .groupBy(*keys).agg(F.avg("corr").alias("mean_corr"), F.count(F.lit(1)).alias("n_pairs"))
                .withColumn("relation", F.lit("adjacent")))
    tagged = (off.withColumns({"_a": group_of("depth_a"), "_b": group_of("depth_b")})
              .filter(F.col("_a").isNotNull() & F.col("_b").isNotNull()))
    relation = F.when(F.col("_a") == F.col("_b"), F.concat(F.lit("within "), F.col("_a"))) \
        .otherwise(F.concat(F.col("_a"), F.lit(" to "), F.col("_b")))
    inside = tagged.groupBy(*keys, relation.alias("relation")).agg(
        F.avg("corr").alias("mean_corr"), F.count(F.lit(1)).alias("n_pairs"))
    return adjacent.select(*inside.columns).unionByName(inside)


def correlation_by_period(wide: DataFrame, a: str, b: str, period, keys: Sequence[str] = KEYS) -> DataFrame:
    return wide.groupBy(*keys, period.alias("period")).agg(
        F.corr(a, b).alias("corr"), F.count(F.lit(1)).alias("n"))


def feature_correlation(df: DataFrame, features: Sequence[str], targets: Sequence[str],
                        keys: Sequence[str] = KEYS, min_rows: int = 30) -> DataFrame:
    """Pearson and Spearman correlation of each feature with each target, rows where
    both exist, null below ``min_rows``.  Ranks are taken per pair."""
    from limnoscope.operators.ranks import with_average_rank

    combos = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(t).alias("target"),
                                F.col(f).cast("double").alias("x"), F.col(t).cast("double").alias("y"))
                       for f in features for t in targets])
    long = (df.select(*keys, F.inline(combos))
            .filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")))
    ids = [*keys, "feature", "target"]
    ranked = with_average_rank(with_average_rank(long, "x", ids, "rx"), "y", ids, "ry")
    enough = F.count(F.lit(1)) >= min_rows
    return ranked.groupBy(*ids).agg(
        F.when(enough, F.corr("x", "y")).alias("pearson"), F.when(enough, F.corr("rx", "ry")).alias("spearman"),
        F.count(F.lit(1)).alias("n"))


# --- fixed values: cumulative Poisson(1) probabilities up to 8 draws ---------
POISSON1_CDF = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9))


#: Rows of a group that are weighed together.
BOOTSTRAP_CHUNK = 512


def bootstrap_correlation(df: DataFrame, x: str, y: str, row_id: Sequence[str], n_boot: int = 500,
                          seed: int = 0, keys: Sequence[str] = KEYS, min_rows: int = 30) -> DataFrame:
    """95 % interval of the correlation from Poisson-weighted resamples.

    The weight of a row in a resample is a Poisson(1) draw from a hash of (seed,
    resample, row id), so the result does not depend on partitioning and no
    resample is ever materialised: only its weighted moments are summed.  Rows are
    gathered in chunks, dealt by hash; a chunk gives the moments of all resamples, so
    what is exploded is chunks times resamples, not rows times resamples.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    centre = rows.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
                                     F.count(F.lit(1)).alias("n"))
    rows = rows.join(centre, list(keys)).filter(F.col("n") >= min_rows)
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in row_id])
    chunk = F.pmod(F.xxhash64(name), F.ceil(F.col("n") / F.lit(BOOTSTRAP_CHUNK)))
    chunks = (rows.select(*keys, "n", chunk.alias("_chunk"), F.struct(name.alias("id"), (F.col(x) - F.col("_mx")).alias("x"), (F.col(y) - F.col("_my")).alias("y")).alias("_r"))
              .groupBy(*keys, "n", "_chunk").agg(F.collect_list("_r").alias("_rows")))

    def weighed(row, b):
        token = F.md5(F.concat_ws("|", F.lit(str(seed)), b.cast("string"), row["id"]))
        return F.struct((F.conv(F.substring(token, 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))).alias("u"), row["x"].alias("x"), row["y"].alias("y"))

    def add(acc, r):
        w = sum(((r["u"] >= c).cast("double") for c in POISSON1_CDF), F.lit(0.0))
        parts = {"w": w, "x": w * r["x"], "y": w * r["y"], "xx": w * r["x"] * r["x"], "yy": w * r["y"] * r["y"], "xy": w * r["x"] * r["y"]}
        return F.struct(*[(acc[k] + v).alias(k) for k, v in parts.items()])

    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("w", "x", "y", "xx", "yy", "xy")])
    resamples = F.transform(F.sequence(F.lit(1), F.lit(n_boot)),
                            lambda b: F.aggregate(F.transform("_rows", lambda row: weighed(row, b)), zero, add))
    sums = (chunks.select(*keys, "n", F.posexplode(resamples).alias("b", "_m")).groupBy(*keys, "b")
            .agg(*[F.sum(f"_m.{k}").alias(f"s{k}") for k in ("w", "x", "y", "xx", "yy", "xy")], F.max("n").alias("n")).filter("sw > 0"))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("sw")
    r = F.when((vx > 0) & (vy > 0), cov / F.sqrt(F.when((vx > 0) & (vy > 0), vx * vy)))
    return (sums.withColumn("_r", r).groupBy(*keys)
            .agg(F.percentile("_r", F.lit(0.025)).alias("low"), F.percentile("_r", F.lit(0.975)).alias("high"),
                 F.avg("_r").alias("mean"), F.max("n").alias("n")))


# ------------------------------------------------------------------ lag pairs
def _ahead(df: DataFrame, payload, ts: str, max_lag: int, by: Sequence[str], keep: Sequence) -> DataFrame:
    """Each row paired with its next ``max_lag`` rows: columns ``lag`` (1..) and ``_p``."""
    order = W.partitionBy(*by).orderBy(ts)
    nxt = F.collect_list(payload).over(order.rowsBetween(1, max_lag))
    return (df.withColumn("_next", nxt).select(*by, *keep, F.posexplode("_next").alias("_k", "_p"))
            .withColumn("lag", F.col("_k") + 1).drop("_k"))


def autocorrelation(df: DataFrame, value: str, ts: str, max_lag: int,
                    by: Sequence[str] = ("site_id", "variable")) -> DataFrame:
    """``sum x_t x_{t+k} / sum x^2`` of the centred series, and the series length."""
    centred = df.withColumn("_x", F.col(value) - F.avg(value).over(W.partitionBy(*by)))
    pairs = _ahead(centred, F.struct(F.col("_x").alias("x")), ts, max_lag, by, ["_x"])
    top = pairs.groupBy(*by, "lag").agg(F.sum(F.col("_x") * F.col("_p.x")).alias("_s"))
    base = centred.groupBy(*by).agg(F.sum(F.col("_x") * F.col("_x")).alias("_v"), F.count(value).alias("n"))
    return top.join(base, list(by)).select(
        *by, "lag", F.when(F.col("_v") > 0, F.col("_s") / F.when(F.col("_v") > 0, F.col("_v"))).alias("acf"), "n")


def decorrelation_lag(acf: DataFrame, max_lag: int, noise: float = 2.0,
                      by: Sequence[str] = ("site_id", "variable")) -> DataFrame:
    """First lag whose autocorrelation is below ``noise / sqrt(n)``, else ``max_lag``."""
    below = F.abs("acf") < F.lit(noise) / F.sqrt("n")
    return acf.groupBy(*by).agg(
        F.coalesce(F.min(F.when(below, F.col("lag"))), F.lit(max_lag)).alias("first_below"), F.max("n").alias("n"))


def lag_bound(decorrelation: DataFrame, max_lag: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """``tau_max``: twice the slowest target's decorrelation lag, at most ``max_lag``."""
    return decorrelation.groupBy(*keys).agg(
        F.least(F.lit(max_lag), F.max("first_below") * 2).alias("tau_max"))


def _lag_sums(max_lag: int):
    """Per lag the sums n, a, b, aa, bb, ab over the pairs whose earlier value is among the first ``own`` of a stretch."""
    @F.pandas_udf("array<array<double>>")
    def sums(own: pd.Series, stretch: pd.Series) -> pd.Series:
        def of(n, x):
            out = np.zeros((max_lag, 6))
            for lag in range(1, min(max_lag, len(x) - 1) + 1):
                a = x[:min(n, len(x) - lag)]
                b = x[lag:lag + len(a)]
                out[lag - 1] = len(a), a.sum(), b.sum(), a @ a, b @ b, a @ b
            return out.tolist()

        return pd.Series([of(n, np.asarray(x, dtype=float)) for n, x in zip(own, stretch)], dtype=object)

    return sums


def efold_lag(df: DataFrame, value: str, ts: str, max_days: int = 60, rows_per_day: int = 8,
              min_rows: int = 256, by: Sequence[str] = ("site_id", "variable")) -> DataFrame:
    """Days until the lag correlation first falls to 1/e.

    Lags run below ``min(max_days, a third of the series)``; when none falls
    that far the bound is given, and null for short series. A lag at which either
    side does not vary has no correlation.

    A series is cut into stretches, each followed by the rows its last ones are paired
    with; every stretch gives a few sums per lag and no pair becomes a row.
    """
    by, cap = list(by), max_days * rows_per_day
    size_of = max(1024, 4 * cap)
    whole = W.partitionBy(*by)
    rows = (df.filter(F.col(value).isNotNull()).select(*by, F.col(ts).alias("_t"), F.col(value).cast("double").alias("_v"))
            .withColumns({"_i": F.row_number().over(whole.orderBy("_t")) - 1, "_n": F.count(F.lit(1)).over(whole)})
            .withColumn("_x", F.col("_v") - F.avg("_v").over(whole)))
    own = F.floor(F.col("_i") / F.lit(size_of)).cast("int")
    ahead = (own > 0) & (F.col("_i") % size_of < cap - 1)
    stretches = (rows.select(*by, "_i", "_n", "_x", F.explode(F.when(ahead, F.array(own, own - 1)).otherwise(F.array(own))).alias("_s"))
                 .groupBy(*by, "_s").agg(F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_rows"), F.max("_n").alias("_n"),
                                         F.sum((F.floor(F.col("_i") / F.lit(size_of)) == F.col("_s")).cast("int")).alias("_own")))
    sums = stretches.withColumn("_sums", _lag_sums(cap - 1)("_own", F.col("_rows._x"))).select(*by, "_n", F.posexplode("_sums").alias("_k", "_m"))
    names = ("c", "a", "b", "aa", "bb", "ab")
    total = (sums.groupBy(*by, (F.col("_k") + 1).alias("lag"))
             .agg(F.max("_n").alias("n"), *[F.sum(F.get("_m", F.lit(i))).alias(c) for i, c in enumerate(names)]))
    limit = F.least(F.lit(cap), F.floor(F.col("n") / 3))
    c = F.when(F.col("c") > 1, F.col("c"))
    va, vb = F.col("aa") - F.col("a") * F.col("a") / c, F.col("bb") - F.col("b") * F.col("b") / c
    # What rounding leaves of a side that does not vary, at its distance from the mean, is no variance.
    varies = (va > F.col("aa") * 1e-12) & (vb > F.col("bb") * 1e-12)
    r = F.when(varies, (F.col("ab") - F.col("a") * F.col("b") / c) / F.sqrt(F.when(varies, va * vb)))
    first = total.withColumn("r", r).groupBy(*by).agg(
        F.min(F.when((F.col("lag") < limit) & (F.col("r") <= math.exp(-1)), F.col("lag"))).alias("_l"), F.max("n").alias("n"))
    bound = F.least(F.lit(cap), F.floor(F.col("n") / 3))
    days = F.when(F.col("n") >= min_rows,
                  F.coalesce(F.col("_l"), bound) / F.lit(float(rows_per_day)))
    return first.select(*by, F.bround(days, 2).alias("efold_days"), "n")


def lead_scan(df: DataFrame, leader: str, follower: str, ts: str, max_shift: int, step: int = 1,
              by: Sequence[str] = KEYS) -> DataFrame:
    """corr(leader[t], follower[t + h]) for h in -max_shift .. max_shift; h > 0 means it leads."""
    order = W.partitionBy(*by).orderBy(ts)
    rows = df.select(*by, ts, leader, follower).withColumn("_pos", F.row_number().over(order))
    near = order.rowsBetween(-max_shift, max_shift)
    around = F.collect_list(F.struct(F.col("_pos").alias("p"), F.col(follower).alias("b"))).over(near)
    pairs = (rows.withColumn("_near", around)
             .select(*by, F.col(leader).alias("_a"), "_pos", F.explode("_near").alias("_q"))
             .select(*by, "_a", (F.col("_q.p") - F.col("_pos")).alias("shift"), F.col("_q.b").alias("_b")))
    pairs = pairs.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    if step > 1:
        pairs = pairs.filter(F.col("shift") % step == 0)
    return pairs.groupBy(*by, "shift").agg(F.corr("_a", "_b").alias("corr"), F.count(F.lit(1)).alias("n"))


def strongest_shift(scan: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """The shift with the largest absolute correlation, the lowest such on a tie."""
    rows = scan.filter(F.col("corr").isNotNull())
    return rows.groupBy(*by).agg(
        F.min_by(F.struct("shift", "corr"), F.struct((-F.abs("corr")).alias("r"), F.col("shift"))).alias("_b")
    ).select(*by, "_b.shift", "_b.corr")


# ----------------------------------------------------- partial-correlation screen
def partial_correlations(df: DataFrame, targets: Sequence[str], sources: Sequence[str], tau_max: int,
                         ts: str, season: tuple[str, str] = ("season_sin", "season_cos"),
                         keys: Sequence[str] = KEYS) -> DataFrame:
    """Correlation of each target with each source ``lag`` rows earlier, given the
    target's own two previous values and the season.

    The rows hold z-scored columns, so sums of products are well scaled.  One
    aggregation per (target, lag) takes the sums of the target, its conditions
    and every source; their plain correlations follow from those, and the four
    conditions are then removed one by one with the recursion
    ``r_ab.c = (r_ab - r_ac r_bc) / sqrt((1 - r_ac^2)(1 - r_bc^2))``.  A source
    that the conditions explain fully (the target's own lags 1 and 2) gets null.
    """
    order = W.partitionBy(*keys).orderBy(ts)
    s, c = season
    past = F.collect_list(F.array(*[F.col(v) for v in sources])).over(order.rowsBetween(-tau_max, -1))
    rows = df.withColumns({
        "_pos": F.row_number().over(order), "_n": F.count(F.lit(1)).over(W.partitionBy(*keys)), "_past": past,
        **{f"_{t}_1": F.lag(t, 1).over(order) for t in targets},
        **{f"_{t}_2": F.lag(t, 2).over(order) for t in targets}}).filter(F.col("_pos") > tau_max)
    per_target = F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(t).alias("y"), F.col(f"_{t}_1").alias("y1"),
                 F.col(f"_{t}_2").alias("y2")) for t in targets])
    flat = rows.select(*keys, "_n", "_past", F.col(s).alias("s"), F.col(c).alias("c"), F.inline(per_target))
    # _past is oldest first: element j lies tau_max - j rows back.
    base = ["y", "y1", "y2", "s", "c"]
    lagged = (flat.select(*keys, "_n", "target", *base, F.posexplode("_past").alias("_j", "_v"))
              .withColumn("lag", F.lit(tau_max) - F.col("_j")))
    pairs = [(a, b) for i, a in enumerate(base) for b in base[i:]]
    sums = [F.count(F.lit(1)).cast("double").alias("_m"), F.max("_n").alias("n")]
    sums += [F.sum(a).alias(f"_s_{a}") for a in base]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"_s_{a}_{b}") for a, b in pairs]
    for i, v in enumerate(sources):
        x = F.get("_v", F.lit(i))
        sums += [F.sum(x).alias(f"_x{i}"), F.sum(x * x).alias(f"_x{i}_x")]
        sums += [F.sum(x * F.col(b)).alias(f"_x{i}_{b}") for b in base]
    moments = lagged.groupBy(*keys, "target", "lag").agg(*sums)

    def spread(square, total):
        return F.col(square) - F.col(total) * F.col(total) / F.col("_m")

    moments = moments.withColumns({f"_v_{a}": spread(f"_s_{a}_{a}", f"_s_{a}") for a in base}
                                  | {f"_v_x{i}": spread(f"_x{i}_x", f"_x{i}") for i in range(len(sources))})

    def rho(product, a, b, va, vb):
        room = F.col(va) * F.col(vb)
        cov = F.col(product) - F.col(a) * F.col(b) / F.col("_m")
        return F.when(room > 0, cov / F.sqrt(F.when(room > 0, room)))

    known = {f"_r_{a}_{b}": rho(f"_s_{a}_{b}", f"_s_{a}", f"_s_{b}", f"_v_{a}", f"_v_{b}") for a, b in pairs if a != b}
    per_source = F.array(*[
        F.struct(F.lit(v).alias("source"), *[rho(f"_x{i}_{b}", f"_x{i}", f"_s_{b}", f"_v_x{i}", f"_v_{b}").alias(f"_r_x_{b}") for b in base])
        for i, v in enumerate(sources)])
    r = (moments.select(*keys, "target", "lag", "n", *[e.alias(k) for k, e in known.items()], per_source.alias("_all"))
         .select(*keys, "target", "lag", "n", *known, F.inline("_all")))
    names = ["x", *base]
    table = F.struct(*[F.col(f"_r_{a}_{b}").alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i + 1:]])
    for given in ("c", "s", "y2", "y1"):
        names = [v for v in names if v != given]
        table = let(table, _without(given, list(names)))
    return r.select(*keys, "target", "source", "lag", table["x_y"].alias("pcorr"), "n")


def _without(given: str, names: list[str]):
    """Correlations of ``names`` once ``given`` is removed, from those before; null
    where ``given`` explains one of the two fully."""
    order = ["x", "y", "y1", "y2", "s", "c"]

    def step(r):
        def rho(a, b):
            return r[f"{a}_{b}"] if order.index(a) < order.index(b) else r[f"{b}_{a}"]

        out = []
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                ac, bc = rho(a, given), rho(b, given)
                room = (F.lit(1.0) - ac * ac) * (F.lit(1.0) - bc * bc)
                out.append(F.when(room > 1e-12, (rho(a, b) - ac * bc) / F.sqrt(F.when(room > 1e-12, room)))
                           .alias(f"{a}_{b}"))
        return F.struct(*out)

    return step


def screen_lags(pcorr: DataFrame, noise: float = 2.0, top_sources: int = 5, top_lags: int = 3,
                keys: Sequence[str] = KEYS) -> DataFrame:
    """Lags above ``noise / sqrt(n)``: the strongest ``top_lags`` of the strongest
    ``top_sources`` of each target."""
    kept = pcorr.filter(F.abs("pcorr") > F.lit(noise) / F.sqrt("n")).withColumn("_a", F.abs("pcorr"))
    lag_rank = W.partitionBy(*keys, "target", "source").orderBy(F.col("_a").desc(), "lag")
    kept = kept.withColumns({"_lr": F.row_number().over(lag_rank),
                             "_best": F.max("_a").over(W.partitionBy(*keys, "target", "source"))})
    source_rank = F.dense_rank().over(
        W.partitionBy(*keys, "target").orderBy(F.col("_best").desc(), "source"))
    return (kept.withColumn("source_rank", source_rank)
            .filter((F.col("source_rank") <= top_sources) & (F.col("_lr") <= top_lags))
            .select(*keys, "target", "source", "lag", "pcorr", "source_rank", F.col("_lr").alias("lag_rank")))


def forced_candidates(targets_df: DataFrame, season: Sequence[str], tau_max: int,
                      keys: Sequence[str] = KEYS) -> DataFrame:
    """Candidates kept whatever the screen says: the season at every lag and the
    target's own lags 1 and 2.  ``targets_df`` has (keys, target)."""
    lags = F.sequence(F.lit(1), F.lit(tau_max))
    seasonal = targets_df.select(*keys, "target", F.explode(F.array(*[F.lit(s) for s in season])).alias("source")) \
        .select(*keys, "target", "source", F.explode(lags).alias("lag"))
    own = targets_df.select(*keys, "target", F.col("target").alias("source"),
                            F.explode(F.array(F.lit(1), F.lit(2))).alias("lag"))
    return seasonal.unionByName(own)


def fisher_p(pcorr, n, n_conditions: int = 4):
    """Two-sided p-value of a partial correlation by Fisher's z."""
    r = F.least(F.greatest(pcorr, F.lit(-0.999999)), F.lit(0.999999))
    z = let(r, lambda v: F.abs(F.lit(0.5) * F.log((F.lit(1.0) + v) / (F.lit(1.0) - v))))
    return F.lit(2.0) * (F.lit(1.0) - normal_cdf(z * F.sqrt(n - F.lit(n_conditions + 3))))


def benjamini_hochberg(edges: DataFrame, p: str = "p", by: Sequence[str] = KEYS, tie: Sequence[str] = (),
                       name: str = "q") -> DataFrame:
    """False-discovery adjusted p-values per family: p * m / rank, made monotone from the
    largest p downwards and capped at 1."""
    order = W.partitionBy(*by).orderBy(p, *tie)
    down = W.partitionBy(*by).orderBy(F.col(p).desc(), *[F.col(t).desc() for t in tie]) \
        .rowsBetween(W.unboundedPreceding, 0)
    m = F.count(F.lit(1)).over(W.partitionBy(*by))
    raw = edges.withColumn("_raw", F.col(p) * m / F.row_number().over(order))
    return raw.withColumn(name, F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_raw")


def top_edges(edges: DataFrame, alpha: float = 0.05, per_target: int = 12, p: str = "p",
              strength: str = "pcorr", step_hours: int = 12, keys: Sequence[str] = KEYS) -> DataFrame:
    """Significant edges of each target, strongest first."""
    rank = W.partitionBy(*keys, "target").orderBy(F.abs(strength).desc(), "source", "lag")
    return (edges.filter(F.col(p) < alpha).withColumn("rank", F.row_number().over(rank))
            .filter(F.col("rank") <= per_target)
            .withColumn("lag_hours", F.col("lag") * step_hours))


# ------------------------------------------------------------------- spectrum
_BANDS = ((2, 7), (7, 30), (30, 180), (180, 730))


def _factor(n, waves):
    """The divisor of ``n`` that makes the two steps of the transform cheapest."""
    divisors = F.filter(F.sequence(F.lit(1).cast("long"), n), lambda p: n % p == 0)
    cost = F.transform(divisors, lambda p: F.struct((n * F.least(p, waves) + waves * n / p).alias("cost"), p.alias("p")))
    return F.array_min(cost)["p"]


#: Rows of a series that one task may hold and transform; a longer series is shared by all tasks.
SERIES_ROWS = 100_000


def _waves_of_short(rows: DataFrame, by: list[str], rows_per_day: int) -> DataFrame:
    """Rows (by, n, _k, _power) of series that a task holds, each transformed where its rows are."""
    def power(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("_t", "ascending"), ("_v", "ascending")], null_placement="at_start")
        x = table.column("_v").take(order).to_numpy()
        n = len(x)
        low, high = math.floor(n / (730.0 * rows_per_day)) + 1, math.floor(n / (2.0 * rows_per_day))
        wave = np.fft.rfft(x - x.mean())[low:high + 1]
        return (table.slice(0, 1).select(by).append_column("n", pa.array([n], pa.int64())).append_column("_k0", pa.array([low], pa.int64()))
                .append_column("_powers", pa.array([wave.real ** 2 + wave.imag ** 2], pa.list_(pa.float64()))))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)
    return (rows.groupBy(*by).applyInArrow(power, f"{types}, n long, _k0 long, _powers array<double>")
            .select(*by, "n", "_k0", F.posexplode("_powers").alias("_j", "_power"))
            .select(*by, "n", (F.col("_k0") + F.col("_j")).alias("_k"), "_power"))


def _waves_of_long(at: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, n, _k, power) of series whose rows have positions ``_i``, in two aggregations."""
    turn = F.lit(-2 * math.pi)
    waves = F.col("_k1") - F.col("_k0") + 1
    # The angles' whole turns are taken off in integers.
    first = (at.withColumn("_p", _factor(F.col("n"), waves)).withColumn("_q", (F.col("n") / F.col("_p")).cast("long"))
             .select(*by, "n", "_k0", "_k1", "_p", "_q", (F.col("_v") - F.col("_mean")).alias("_x"), F.floor(F.col("_i") / F.col("_q")).alias("_a"),
                     (F.col("_i") % F.col("_q")).alias("_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_p") - 1)).alias("_r"))
             .withColumn("_w", turn * (F.col("_a") * F.col("_r") % F.col("_p")) / F.col("_p"))
             .groupBy(*by, "n", "_k0", "_k1", "_p", "_b", "_r").agg(F.sum(F.col("_x") * F.cos("_w")).alias("_c"), F.sum(F.col("_x") * F.sin("_w")).alias("_s")))
    # The first frequency of the band with this remainder; a remainder may have none.
    lowest = F.col("_k0") + F.pmod(F.col("_r") - F.col("_k0"), F.col("_p"))
    sums = (first.filter(lowest <= F.col("_k1")).select(*by, "n", "_b", "_c", "_s", F.explode(F.sequence(lowest, F.col("_k1"), F.col("_p"))).alias("_k"))
            .withColumn("_w", turn * (F.col("_b") * F.col("_k") % F.col("n")) / F.col("n"))
            .groupBy(*by, "n", "_k").agg(F.sum(F.col("_c") * F.cos("_w") - F.col("_s") * F.sin("_w")).alias("_c"),
                                         F.sum(F.col("_c") * F.sin("_w") + F.col("_s") * F.cos("_w")).alias("_s")))
    return sums.select(*by, "n", "_k", (F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")).alias("_power"))


def spectral_bands(series: DataFrame, value: str, ts: str, rows_per_day: int = 8, min_rows: int = 512,
                   by: Sequence[str] = ("site_id", "depth"), rows_a_slice: int | None = None, series_rows: int | None = None) -> DataFrame:
    """Dominant period and power shares of the bands 2-7, 7-30, 30-180, 180-730 days.

    Only frequencies between 1/730 and 1/2 per day are needed. A series of at most
    ``series_rows`` rows (SERIES_ROWS) is transformed by the task that holds it, in
    ``n log n`` steps. A longer one takes two aggregations: with ``n = p q`` and position
    ``t = q a + b`` first over ``a``, for each ``b`` and each remainder of the frequency by
    ``p``, then over ``b``, turned by ``b k / n``. A row is copied ``p`` times, not once per
    frequency, and sums are partial before each shuffle. ``p`` is the divisor of ``n`` for
    which that is cheapest; for a prime ``n`` the first step does nothing and the second is
    the plain transform. Positions come from slices, so no task holds a long series.
    """
    by, short = list(by), SERIES_ROWS if series_rows is None else series_rows
    x = F.col(value).cast("double")
    rows = settled(series.filter(x.isNotNull() & ~F.isnan(x)).select(*by, F.col(ts).alias("_t"), x.alias("_v")))
    slowest = (F.floor(F.col("n") / F.lit(730.0 * rows_per_day)) + 1).alias("_k0")
    fastest = F.floor(F.col("n") / F.lit(2.0 * rows_per_day)).alias("_k1")
    sizes = (rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("_mean")).filter(F.col("n") >= min_rows)
             .select(*by, "n", "_mean", slowest, fastest).filter("_k0 <= _k1"))
    waves = _waves_of_short(rows.join(sizes.filter(F.col("n") <= short).select(*by), by, "left_semi"), by, rows_per_day)
    long = settled(sizes.filter(F.col("n") > short))
    if not long.isEmpty():
        at = numbered(settled(rows.join(long.select(*by), by, "left_semi")), F.col("_t").cast("timestamp").cast("double"), by, ["_t"], "_i", "_size", rows_a_slice)
        waves = waves.unionByName(_waves_of_long(at.join(long, by), by))
    power = F.col("_power")
    f = F.col("_k") * (F.lit(1.0) / (F.col("n") * F.lit(1.0 / rows_per_day)))
    bands = [F.sum(F.when((f >= 1 / b) & (f < 1 / a), power).otherwise(0.0)).alias(f"_b{a}") for a, b in _BANDS]
    sums = waves.groupBy(*by, "n").agg(
        F.sum(power).alias("_total"), (-F.max(F.struct(power.alias("p"), (-F.col("_k")).alias("k")))["k"]).alias("_top"), *bands)
    return (sums.filter(F.col("_total") > 0)
            .select(*by, "n", (F.col("n") / (F.col("_top") * F.lit(float(rows_per_day)))).alias("dominant_period"),
                    *[(F.col(f"_b{a}") / F.col("_total")).alias(f"share_{a}_{b}d") for a, b in _BANDS]))
