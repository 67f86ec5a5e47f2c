"""Hard negatives by segment summaries: bounds on inner products, refined level by level before exact scoring.

Each vector is cut into segments, at two depths; of every segment the mean and the
deviation (root of the summed squared differences from the mean) are kept. Over a
segment of ``w`` components the inner product of two vectors is
``w * mean * mean'`` plus a rest that is at most the product of their deviations
(Cauchy-Schwarz). Summed over segments this bounds a score from both sides with a
sixteenth of the arithmetic. Pairs whose bounds cannot reach the best scores known so
far (or the wanted range of scores) are settled; the others are bounded by the finer
segments, and what is still open is scored exactly, in integers.

Work is dealt in tiles of a block of anchors and a block of rows, so no task holds more
than ``ROWS_A_TILE`` rows and ``ANCHORS_A_TILE`` anchors and no label, however common,
meets in one task. A first round finds the positives of all anchors, a second one their
negatives; tiles keep only their best few, which are merged per anchor.

Components are integers from -2**28 to 2**28 (larger ones are set to these), so scores
of up to 64 components are exact longs. Missing trailing components count as 0. Rows
with a null id, label or vector, or with a null or non-finite component, take no part.
Rows are told apart by position, so repeated ids and repeated rows are partners like any
others. Ties of score go to the smaller id. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from limnoscope.llm.common import materialise

#: Most rows and anchors of one tile; tables of fewer rows are cut into up to FEWEST_TILES blocks.
ROWS_A_TILE = 1 << 16
ANCHORS_A_TILE = 1 << 15
FEWEST_TILES = 64
SMALL_TILE = 2048

#: Segments of the two levels.
LEVELS = (4, 16)
#: Pairs per step inside a tile, and rows per anchor that are scored at once for a first threshold.
PAIRS = 1 << 21
SEEDS = 16
LARGEST = 1 << 28


def quantised(vector: str, scale: int = 256) -> Column:
    """Components as ``floor(scale * x)``; null where the vector or a component is null or not finite."""
    def floor(x):
        y = F.floor(x.cast("double") * F.lit(float(scale)))
        return F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), y)).cast("int")

    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(F.col(vector).isNotNull() & finite, F.transform(vector, floor))


# ------------------------------------------------------------------ arithmetic of one tile

def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def longest(*columns: pa.ChunkedArray) -> int:
    """Width of a matrix that holds all lists, a multiple of the finest level."""
    most = max((pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns), default=0)
    return max(1, -(-most // LEVELS[-1])) * LEVELS[-1]


class Summaries:
    """A block of vectors with the means and deviations of their segments."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.levels = []
        for k in LEVELS:
            parts = vectors.reshape(len(vectors), k, -1)
            mean = parts.mean(axis=2)
            rest = np.sqrt(np.square(parts - mean[:, :, None]).sum(axis=2))
            # The root of a segment's width goes into the means of both sides.
            self.levels.append((mean * np.sqrt(parts.shape[2]), rest))

    def rows(self, which) -> Summaries:
        out = object.__new__(Summaries)
        out.vectors, out.levels = self.vectors[which], [(m[which], d[which]) for m, d in self.levels]
        return out


def _slack(middle: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Room for rounding: bounds are compared with integers."""
    return 1e-9 * (np.abs(middle) + spread) + 1e-6


def bounds(a: Summaries, x: Summaries, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores of ``a`` (rows) with ``x`` (columns)."""
    (ma, da), (mx, dx) = a.levels[level], x.levels[level]
    middle, spread = ma @ mx.T, da @ dx.T
    spread += _slack(middle, spread)
    return middle - spread, middle + spread


def pair_bounds(a: Summaries, x: Summaries, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    (ma, da), (mx, dx) = a.levels[level], x.levels[level]
    middle, spread = np.einsum("ij,ij->i", ma[i], mx[j]), np.einsum("ij,ij->i", da[i], dx[j])
    spread += _slack(middle, spread)
    return middle - spread, middle + spread


class Scores:
    """Exact scores of two blocks, in doubles where those are exact, else in 64-bit integers."""

    def __init__(self, a: Summaries, x: Summaries):
        top = max(np.abs(a.vectors).max(initial=0), 1) * max(np.abs(x.vectors).max(initial=0), 1) * a.vectors.shape[1]
        self.kind = np.float64 if top < 2 ** 53 else np.int64
        self.a, self.x = a.vectors.astype(self.kind), x.vectors.astype(self.kind)
        self.least = -np.inf if self.kind is np.float64 else np.iinfo(np.int64).min

    def all(self) -> np.ndarray:
        return self.a @ self.x.T

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), self.kind)
        for at in range(0, len(i), PAIRS // 8):
            s = slice(at, at + PAIRS // 8)
            out[s] = np.einsum("ij,ij->i", self.a[i[s]], self.x[j[s]])
        return out


def surviving_scores(a: Summaries, x: Summaries, eligible: np.ndarray, open_pairs) -> tuple[np.ndarray, float]:
    """Exact scores where the bounds leave a pair open, the least value elsewhere.

    ``open_pairs(lower, upper, i, seeds)`` tells which pairs are open: bounds of pairs whose
    anchors are ``i``, and the exact scores of each anchor's seeds.
    """
    exact = Scores(a, x)
    lower, upper = bounds(a, x, 0)
    n = x.vectors.shape[0]
    ranked = np.where(eligible, upper, -np.inf)
    k = min(SEEDS, n)
    seeds = np.argpartition(ranked, n - k, axis=1)[:, n - k:]
    rows = np.repeat(np.arange(len(seeds)), k)
    known = exact.pairs(rows, seeds.ravel()).reshape(seeds.shape)
    known = np.where(np.take_along_axis(eligible, seeds, axis=1), known, exact.least)
    everyone = np.arange(len(seeds))[:, None]
    left = eligible & open_pairs(lower, upper, everyone, known)
    for level in range(1, len(LEVELS)):
        if left.mean() > 0.25:  # dense: one product is cheaper than gathering pairs
            lower, upper = bounds(a, x, level)
            left &= open_pairs(lower, upper, everyone, known)
        else:
            i, j = np.nonzero(left)
            for at in range(0, len(i), PAIRS // 4):
                s = slice(at, at + PAIRS // 4)
                lower, upper = pair_bounds(a, x, level, i[s], j[s])
                left[i[s], j[s]] = open_pairs(lower, upper, i[s], known)
    if left.mean() > 0.125:
        return np.where(left, exact.all(), exact.least), exact.least
    out = np.full(left.shape, exact.least, exact.kind)
    i, j = np.nonzero(left)
    out[i, j] = exact.pairs(i, j)
    return out, exact.least


def best(values: np.ndarray, least, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` highest entries of each row (first among equals): row, column, value. ``values`` is used up."""
    found = []
    every = np.arange(len(values))
    for _ in range(min(k, values.shape[1])):
        at = values.argmax(axis=1)
        value = values[every, at]
        ok = value > least
        found.append((every[ok], at[ok], value[ok]))
        values[every, at] = least
    return tuple(np.concatenate(part) for part in zip(*found, strict=True)) if found else (every[:0],) * 3


def _sorted_tile(anchors: pa.Table, rows: pa.Table):
    rows = rows.sort_by([("id", "ascending")])
    width = longest(anchors["x"], rows["x"])
    return rows, Summaries(matrix(anchors["x"], width)), Summaries(matrix(rows["x"], width))


def _codes(anchors: pa.Table, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Labels of both sides as numbers that are equal where the labels are."""
    both = pa.chunked_array([*anchors["label"].chunks, *rows["label"].chunks], anchors["label"].type)
    codes = both.combine_chunks().dictionary_encode()
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
    return codes[:len(anchors)], codes[len(anchors):]


def _steps(n_anchors: int, n_rows: int):
    size = max(1, PAIRS // max(1, n_rows))
    return (slice(at, min(n_anchors, at + size)) for at in range(0, n_anchors, size))


POSITIVES = "anchor long, id long, score long"
_POSITIVES_ARROW = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
NEGATIVES = "anchor long, k int, id long, score long"
_NEGATIVES_ARROW = pa.schema([("anchor", pa.int64()), ("k", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def tile_positives(anchors: pa.Table, rows: pa.Table, count: int) -> pa.Table:
    """The best ``count`` rows of each anchor's label in this tile, the anchor's own row aside."""
    parts = []
    if len(anchors) and len(rows):
        rows, a, x = _sorted_tile(anchors, rows)
        label_a, label_x = _codes(anchors, rows)
        own, other, ids = anchors["row"].to_numpy(), rows["row"].to_numpy(), rows["id"].to_numpy()
        for s in _steps(len(anchors), len(rows)):
            eligible = (label_a[s, None] == label_x[None, :]) & (own[s, None] != other[None, :])

            def open_pairs(lower, upper, i, known):
                k = min(count, known.shape[1])
                threshold = np.partition(known, known.shape[1] - k, axis=1)[:, known.shape[1] - k].astype(float)
                threshold = threshold if k == count else np.full(len(known), -np.inf)
                return upper >= threshold[i]

            values, least = surviving_scores(a.rows(s), x, eligible, open_pairs)
            i, j, v = best(values, least, count)
            parts.append(pa.table([own[s][i], ids[j], v.astype(np.int64)], schema=_POSITIVES_ARROW))
    return pa.concat_tables(parts) if parts else _POSITIVES_ARROW.empty_table()


def tile_negatives(anchors: pa.Table, rows: pa.Table, count: int, low: int, high: int) -> pa.Table:
    """For each anchor and each of its positives the best ``count`` rows of other labels in the wanted range."""
    parts = []
    if len(anchors) and len(rows):
        rows, a, x = _sorted_tile(anchors, rows)
        label_a, label_x = _codes(anchors, rows)
        own, ids = anchors["row"].to_numpy(), rows["id"].to_numpy()
        wanted = [list(p) for p in anchors["scores"].to_pylist()]
        most = max(map(len, wanted))
        # low * p <= 100 * s <= high * p in whole numbers; ranges that do not exist are empty.
        floor = np.array([[-(-low * p // 100) for p in ps] + [1] * (most - len(ps)) for ps in wanted], np.int64).reshape(-1, most)
        ceil = np.array([[high * p // 100 for p in ps] + [0] * (most - len(ps)) for ps in wanted], np.int64).reshape(-1, most)
        for s in _steps(len(anchors), len(rows)):
            eligible = label_a[s, None] != label_x[None, :]
            lo, hi = floor[s], ceil[s]

            def open_pairs(lower, upper, i, known):
                out = np.zeros(lower.shape, bool)
                for k in range(most):
                    inside = np.where((known >= lo[:, k, None]) & (known <= hi[:, k, None]), known.astype(float), -np.inf)
                    third = np.partition(inside, -count, axis=1)[:, -count] if inside.shape[1] >= count else np.full(len(inside), -np.inf)
                    threshold = np.maximum(third, lo[:, k])
                    out |= (upper >= threshold[i]) & (lower <= hi[:, k][i]) & (lo[:, k] <= hi[:, k])[i]
                return out

            values, least = surviving_scores(a.rows(s), x, eligible, open_pairs)
            for k in range(most):
                i, j, v = best(np.where((values >= lo[:, k, None]) & (values <= hi[:, k, None]), values, least), least, count)
                parts.append(pa.table([own[s][i], np.full(len(i), k, np.int32), ids[j], v.astype(np.int64)], schema=_NEGATIVES_ARROW))
    return pa.concat_tables(parts) if parts else _NEGATIVES_ARROW.empty_table()


# ------------------------------------------------------------------ tiles

def _dealt(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int):
    """Rows and anchors copied to the tiles they belong to, grouped by tile."""
    def block(n):
        return F.pmod(F.col("row"), F.lit(n)).cast("int")

    # Both sides stem from one table; the aliases give the anchors' columns identities of their own.
    left = anchors.select(*[F.col(c).alias(c) for c in anchors.columns], block(anchor_blocks).alias("tile_a"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("tile_r"))
    right = rows.select("*", block(row_blocks).alias("tile_r"), F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("tile_a"))
    return left.groupBy("tile_a", "tile_r").cogroup(right.groupBy("tile_a", "tile_r"))


def _first(df: DataFrame, by: list[str], count: int) -> DataFrame:
    """The best ``count`` rows per group, ranked from 1."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(vectors: DataFrame, is_anchor: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding",
                   positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """Hard negatives of the rows where ``is_anchor`` holds, against all rows.

    For each anchor and each of its first ``positives`` other rows of its label: the first
    ``negatives`` rows of other labels with ``low * p <= 100 * score <= high * p``, ``p``
    being the positive's score. Columns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.
    """
    rows = materialise(
        vectors.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), quantised(vector, scale).alias("x"),
                       F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
        .where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").withColumn("row", F.monotonically_increasing_id()))
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    row_blocks = max(-(-n // ROWS_A_TILE), min(FEWEST_TILES, -(-n // SMALL_TILE)), 1)
    anchor_blocks = max(-(-n_anchors // ANCHORS_A_TILE), 1)
    sides = rows.select("row", "id", "label", "x")
    anchors = rows.where("anchor").select("row", "id", "label", "x")

    found = (_dealt(sides, anchors, row_blocks, anchor_blocks)
             .applyInArrow(lambda a, x: tile_positives(a, x, positives), POSITIVES))
    first = materialise(_first(found, ["anchor"], positives))
    scores = first.groupBy(F.col("anchor").alias("row")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("scores"))
    aimed = anchors.join(scores, "row")
    mined = (_dealt(sides, aimed, row_blocks, anchor_blocks)
             .applyInArrow(lambda a, x: tile_negatives(a, x, negatives, low, high), NEGATIVES))
    mined = _first(mined, ["anchor", "k"], negatives)
    partners = first.select("anchor", (F.col("rank") - 1).alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return (mined.join(partners, ["anchor", "k"]).join(names, "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
