"""Histogram gradient boosting of many small models at once.

A model belongs to one group (station and window) and one target (a horizon, the peak, a
warning level); hundreds or millions of them grow side by side. Features are cut into
bins at the train part's quantiles.

A group is as a rule a few hundred days. Groups of at most ``MOST_ROWS`` complete rows are
spread over the tasks by one shuffle and each grows its trees where its rows are. Larger
groups, and those with missing values, are grown together by Spark: every level of a tree is one aggregation for all
models: sums of gradients and curvatures per (group, target, node, feature, bin), with
partial sums before the shuffle. Running sums over the bins give every split's gain, and
the best split of a node is one row. Splits are joined back to the rows by group, a few
rows per model. A round costs one pass per level, however many models there are, and its
result is written to the checkpoint folder, so lineage stays one round long.

Nothing is collected: neither rows nor trees pass the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from limnoscope.session import settled

IDS = ("site_id", "window_id")
#: Bins are stored in a byte.
_MOST_BINS = 128
LOSSES = ("squared", "logistic", "quantile")
#: Rows of a group that one task may hold; a larger group is shared by all tasks.
MOST_ROWS = 20_000


def binned(samples: DataFrame, features: Sequence[str], bins: int = 16, train: str = "is_train",
           ids: Sequence[str] = IDS, name: str = "bins") -> DataFrame:
    """``name``: the bin of every feature, cut at the group's train quantiles.

    A value's bin is the number of cuts strictly below it; a null is in bin 0.
    Groups without train rows are left out.
    """
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    cuts = samples.filter(train).groupBy(*ids).agg(F.array(*[F.percentile(F.col(f).cast("double"), at) for f in features]).alias("_cuts"))

    def slot(i: int, feature: str) -> Column:
        x = F.col(feature).cast("double")
        below = F.size(F.filter(F.get("_cuts", F.lit(i)), lambda cut: cut < x))
        return F.when(x.isNull() | F.isnan(x), 0).otherwise(below).cast("tinyint")

    return samples.join(cuts, list(ids)).withColumn(name, F.array(*[slot(i, f) for i, f in enumerate(features)])).drop("_cuts")


def _derivatives(loss: str, levels: Sequence[float]) -> tuple[Column, Column]:
    """Negative gradient and curvature at score ``_s`` for value ``_v`` of weight ``_w``; one quantile level per target."""
    v, s, w = F.col("_v"), F.col("_s"), F.col("_w")
    if loss == "squared":
        return w * (v - s), w
    if loss == "quantile":
        level = F.get(F.array(*[F.lit(float(p)) for p in levels]), F.col("target"))
        return w * F.when(v > s, level).otherwise(level - 1.0), w
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-s))
    return w * (v - p), w * p * (F.lit(1.0) - p)


def _start(loss: str, level: float, k: int, weight: Column) -> Column:
    """First score of target ``k``: mean, quantile or log-odds of the train part."""
    v = F.get("_y", F.lit(k))
    if loss == "quantile":
        return F.percentile(v, F.lit(level))
    mean = F.sum(weight * v) / F.sum(weight)
    if loss == "squared":
        return mean
    p = F.greatest(F.lit(0.01), F.least(F.lit(0.99), mean))
    return F.log(p / (F.lit(1.0) - p))


def _split_choice(rows: DataFrame, ids: Sequence[str], loss: str, levels: Sequence[float], step: float, reg: float, min_rows: int, width: int,
                  n_features: int) -> DataFrame:
    """Best split of every node: one row (ids, target, node, feature, bin, left, right).

    ``left`` and ``right`` are what the two sides would add to the score. Without a split
    that gains, ``feature`` is null and both hold the whole node's value.
    """
    ids = list(ids)
    targets = F.zip_with(F.arrays_zip("_y", "_f"), F.col("_node"), lambda t, n: F.struct(t["_y"].alias("_v"), t["_f"].alias("_s"), n.alias("node")))
    per_target = (rows.filter("_train").select(*ids, "_w", "_bins", F.posexplode(targets).alias("target", "_t"))
                  .select(*ids, "target", "_t.node", "_bins", "_w", "_t._v", "_t._s"))
    g, h = _derivatives(loss, levels)
    # One number stands for (target, node, feature, bin), so that a key is short.
    code = ((F.col("_tn") * n_features + F.col("feature")) * _MOST_BINS + F.col("bin")).alias("code")
    hist = (per_target.select(*ids, (F.col("target") * width + F.col("node")).alias("_tn"), g.alias("_g"), h.alias("_h"), F.posexplode("_bins").alias("feature", "bin"))
            .groupBy(*ids, code).agg(F.sum("_g").alias("_g"), F.sum("_h").alias("_h"), F.count(F.lit(1)).alias("_n")))
    place = F.floor(F.col("code") / F.lit(_MOST_BINS)).cast("int")
    tn = F.floor(place / F.lit(n_features)).cast("int")
    hist = hist.select(*ids, F.floor(tn / F.lit(width)).cast("int").alias("target"), (tn % width).alias("node"), (place % n_features).alias("feature"),
                       (F.col("code") % _MOST_BINS).cast("int").alias("bin"), "_g", "_h", "_n")
    whole = W.partitionBy(*ids, "target", "node", "feature")
    below = whole.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = hist.select(*ids, "target", "node", "feature", "bin",
                       *[F.sum(c).over(below).alias(f"{c}l") for c in ("_g", "_h", "_n")],
                       *[F.sum(c).over(whole).alias(f"{c}a") for c in ("_g", "_h", "_n")])
    gl, ga = F.col("_gl"), F.col("_ga")
    hl, ha = F.col("_hl") + reg, F.col("_ha") + reg
    gr, hr = ga - gl, F.col("_ha") - F.col("_hl") + reg
    gain = gl * gl / hl + gr * gr / hr - ga * ga / ha
    fits = (F.col("_nl") >= min_rows) & (F.col("_na") - F.col("_nl") >= min_rows) & (gain > 1e-9)
    # Equal gains (at nine decimals) go to the first feature, then the lowest bin.
    order = F.struct(fits.alias("fits"), F.when(fits, F.round(gain, 9)).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    value = F.lit(step)
    pick = F.struct(F.when(fits, F.col("feature")).alias("feature"), F.col("bin"),
                    F.when(fits, value * gl / hl).otherwise(value * ga / ha).alias("left"),
                    F.when(fits, value * gr / hr).otherwise(value * ga / ha).alias("right"))
    best = sums.groupBy(*ids, "target", "node").agg(F.max_by(pick, order).alias("_b"))
    return best.select(*ids, "target", "node", "_b.*")


def _packed(choice: DataFrame, ids: Sequence[str], width: int) -> DataFrame:
    """All splits of a group in one map, keyed by target and node."""
    entry = F.struct((F.col("target") * width + F.col("node")).alias("k"), F.struct("feature", "bin", "left", "right").alias("v"))
    return choice.groupBy(*ids).agg(F.map_from_entries(F.collect_list(entry)).alias("_splits"))


def _goes_right(split: Column) -> Column:
    return F.coalesce(F.get("_bins", split["feature"]) > split["bin"], F.lit(False))


def boosted_scores(samples: DataFrame, features: Sequence[str], targets: Column, train: str = "is_train", weight: Column | None = None,
                   ids: Sequence[str] = IDS, trees: int = 12, depth: int = 3, step: float = 0.2, bins: int = 16, min_rows: int = 5,
                   reg: float = 1.0, loss: str = "squared", levels: Sequence[float] = (), name: str = "score") -> DataFrame:
    """``samples`` with ``name``, an array of one score per entry of the array column ``targets``.

    Each group's train rows fit one boosted model per target; all rows of the group are
    scored. ``loss`` is squared (scores are values), logistic (log-odds of a target of 0
    and 1) or quantile (``levels``: one per target). ``weight`` weighs train rows. Groups without train
    rows have no scores and are left out.
    """
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    if not 2 <= bins <= _MOST_BINS:
        raise ValueError(f"bins must be between 2 and {_MOST_BINS}")
    ids = list(ids)
    w = F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(0.0))
    x = F.array(*[F.col(f).cast("double") for f in features])
    parts = {"_x": x, "_y": F.transform(targets, lambda v: v.cast("double")), "_w": w, "_train": F.coalesce(F.col(train), F.lit(False))}
    rows = settled(_held_by_a_task(samples, parts, ids))
    first = rows.select("_k").first()
    if first is None:
        return samples.withColumn(name, F.array().cast("array<double>")).limit(0)
    k = first[0]
    if loss == "quantile" and len(levels) != k:
        raise ValueError(f"{k} targets need as many quantile levels")
    is_near = F.col("_near") & F.col("_k").eqNullSafe(k)
    fit = _group_fit(k, trees, depth, step, bins, min_rows, reg, loss, levels, name)
    shape = samples.withColumn(name, F.array().cast("array<double>")).schema
    near = rows.filter(is_near).drop("_near", "_k").withColumns(parts).groupBy(*ids).applyInArrow(fit, shape)
    rest = rows.filter(~is_near).drop("_near", "_k")
    if rest.isEmpty():
        return near
    return near.unionByName(_grown_by_levels(rest, features, parts, train, ids, k, trees, depth, step, bins, min_rows, reg, loss, levels, name))


def _held_by_a_task(samples: DataFrame, parts: dict[str, Column], ids: Sequence[str]) -> DataFrame:
    """``samples`` with ``_k``, the number of targets, and ``_near``: the group's rows are few, of finite numbers, and their train weights not all 0."""
    def finite(c):
        return F.coalesce(F.abs(c) < float("inf"), F.lit(False))

    k, group = F.size(parts["_y"]), W.partitionBy(*ids)
    whole = F.coalesce(F.forall(parts["_x"], finite) & F.forall(parts["_y"], finite) & finite(parts["_w"]), F.lit(False))
    weight = F.sum(F.when(parts["_train"], parts["_w"])).over(group)
    near = (F.count(F.lit(1)).over(group) <= MOST_ROWS) & F.min(whole).over(group) & (F.min(k).over(group) == F.max(k).over(group))
    return samples.withColumns({"_k": k, "_near": near & (weight.isNull() | (weight > 0))})


def _group_fit(k: int, trees: int, depth: int, step: float, bins: int, min_rows: int, reg: float, loss: str, levels: Sequence[float],
               name: str) -> Callable[[pa.Table], pa.Table]:
    """Fit and score of one group that a task holds: its rows with ``name``.

    All it needs is within, so that tasks need not import this module.
    """
    at, quantiles = np.arange(1, bins) / bins, np.array(levels, dtype=float)

    def percentiles(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Per column the interpolated percentiles, as Spark's ``percentile`` has them."""
        values = np.sort(values, axis=0)
        place = at * (len(values) - 1)
        low, high = np.floor(place).astype(int), np.ceil(place).astype(int)
        a, b = values[low], values[high]
        return np.where(a == b, a, (high - place)[:, None] * a + (place - low)[:, None] * b)

    def best_splits(places: np.ndarray, place: np.ndarray, g: np.ndarray, h: np.ndarray | None, nodes: int) -> tuple[np.ndarray, ...]:
        """Per place (target and node) the feature (-1: no split gains), bin, and what the left and right side add."""
        shape = (nodes, bins)

        def sums(weights):
            counted = [np.bincount((place * bins + b[:, None]).ravel(), weights, nodes * bins).reshape(shape) for b in places.T]
            return np.cumsum(counted, axis=2)

        n, gl = sums(None), sums(g.ravel())
        hl = n.astype(float) if h is None else sums(h.ravel())
        na, ga, ha = (v[:, :, -1:] for v in (n, gl, hl))
        with np.errstate(divide="ignore", invalid="ignore"):
            gr, hr, hl, ha = ga - gl, ha - hl + reg, hl + reg, ha + reg
            gain = gl * gl / hl + gr * gr / hr - ga * ga / ha
            fits = (n >= min_rows) & (na - n >= min_rows) & (gain > 1e-9)
            # Equal gains (at nine decimals) go to the first feature, then the lowest bin.
            order = np.where(fits, np.round(gain, 9), -np.inf).transpose(1, 0, 2).reshape(nodes, -1)
            best = order.argmax(axis=1)
            feature, cut, at = best // bins, best % bins, np.arange(nodes)
            split = order[at, best] > -np.inf
            whole = np.where(na[0, :, 0] > 0, step * ga[0, :, 0] / ha[0, :, 0], 0.0)
            left = np.where(split, step * gl[feature, at, cut] / hl[feature, at, cut], whole)
            right = np.where(split, step * gr[feature, at, cut] / hr[feature, at, cut], whole)
        return np.where(split, feature, -1), cut, left, right

    def first_scores(y, w):
        if loss == "quantile":
            return np.array([percentiles(y[:, [i]], quantiles[i:i + 1])[0, 0] for i in range(k)])
        mean = (w * y).sum(axis=0) / w.sum()
        if loss == "squared":
            return mean
        p = np.clip(mean, 0.01, 0.99)
        return np.log(p / (1.0 - p))

    def derivatives(y, s, w):
        if loss == "squared":
            return w * (y - s), None if (w == 1).all() else np.broadcast_to(w, y.shape)
        if loss == "quantile":
            return w * np.where(y > s, quantiles, quantiles - 1.0), None if (w == 1).all() else np.broadcast_to(w, y.shape)
        with np.errstate(over="ignore"):
            p = 1.0 / (1.0 + np.exp(-s))
        return w * (y - p), w * p * (1.0 - p)

    def fit(table: pa.Table) -> pa.Table:
        n = table.num_rows
        train = table["_train"].to_numpy()
        kept = table.drop_columns(["_x", "_y", "_w", "_train"])
        if not train.any():
            return kept.slice(0, 0).append_column(name, pa.array([], pa.list_(pa.float64())))
        x = pc.list_flatten(table["_x"]).to_numpy().reshape(n, -1)
        y = pc.list_flatten(table["_y"]).to_numpy().reshape(n, k)[train]
        w = table["_w"].to_numpy()[train][:, None]
        cuts = percentiles(x[train], at)
        places = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts.T, x.T)], axis=1)
        learned, targets, row = places[train], np.arange(k), np.arange(n)[:, None]
        scores = np.tile(first_scores(y, w), (n, 1))
        for _ in range(trees):
            g, h = derivatives(y, scores[train], w)
            node = np.zeros((n, k), dtype=int)
            for d in range(depth):
                place = targets * (1 << d) + node
                feature, cut, left, right = best_splits(learned, place[train], g, h, k << d)
                goes_right = (feature[place] >= 0) & (places[row, feature[place]] > cut[place])
                node = node * 2 + goes_right
            scores += np.where(goes_right, right[place], left[place])
        offsets = pa.array(np.arange(0, n * k + 1, k), pa.int32())
        return kept.append_column(name, pa.ListArray.from_arrays(offsets, pa.array(scores.ravel())))

    return fit


def _grown_by_levels(samples: DataFrame, features: Sequence[str], parts: dict[str, Column], train: str, ids: Sequence[str], k: int, trees: int,
                     depth: int, step: float, bins: int, min_rows: int, reg: float, loss: str, levels: Sequence[float], name: str) -> DataFrame:
    """The same for groups of any size and with missing values: a level of all trees is one aggregation."""
    width = 1 << depth
    rows = settled(binned(samples, features, bins, train, ids, "_bins").withColumns({c: parts[c] for c in ("_y", "_w")} | {"_train": F.col(train)}))
    start = rows.filter("_train").groupBy(*ids).agg(F.array(*[_start(loss, levels[i] if levels else 0.5, i, F.col("_w")) for i in range(k)]).alias("_f"))
    state = settled(rows.join(start, ids))
    root = F.transform("_y", lambda v: F.lit(0))
    for _ in range(trees):
        grown = state.withColumn("_node", root)
        for d in range(depth):
            splits = _packed(settled(_split_choice(grown, ids, loss, levels, step, reg, min_rows, width, len(features))), ids, width)
            grown = grown.join(splits, ids)
            pick = [F.try_element_at("_splits", F.get("_node", F.lit(i)) + i * width) for i in range(k)]
            if d + 1 < depth:
                node = F.array(*[F.get("_node", F.lit(i)) * 2 + _goes_right(s).cast("int") for i, s in enumerate(pick)])
                grown = grown.withColumn("_node", node).drop("_splits")
            else:
                added = [F.coalesce(F.when(_goes_right(s), s["right"]).otherwise(s["left"]), F.lit(0.0)) for s in pick]
                grown = grown.withColumn("_f", F.array(*[F.get("_f", F.lit(i)) + a for i, a in enumerate(added)]))
        state = settled(grown.drop("_splits", "_node"))
    return state.withColumnRenamed("_f", name).drop("_bins", "_y", "_w", "_train")
