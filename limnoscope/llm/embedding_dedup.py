"""Near-duplicate embeddings by sorted projection passes.

In each pass a vector gets a key of concatenated random hyperplane bits; vectors
are sorted by it and each is compared with the ``WINDOW`` vectors before it. Pairs
of at least the threshold, verified in double precision, are joined to components
over all passes; of a window's links only a spanning forest is kept. The number of
passes follows from the number of different vectors, so that a pair exactly at the
threshold is met with the same probability at every size.

Links are then counted inside components without listing pairs. Vectors within
half the threshold's angle of their component's mean direction are all linked with
each other and need no comparison; only the others are compared, in blocks.

Cases: null, empty and zero vectors, and those with null or non-finite components,
link with nothing and stay alone; equal vectors are one class and all linked;
vectors of different dimension never link; null ids keep a row but name no
component; labels and other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnoscope.llm.common import connected_components, materialise

WINDOW = 64
KEY_BITS = 62
#: Chance that a pair exactly at the threshold is met in some pass.
TARGET_RECALL = 0.98
BLOCK = 256


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows or vanishes."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _classified(batches):
    """(id, vector) to (id, digest of a usable vector or null, its values)."""
    for batch in batches:
        digests, values = [], []
        for vector in batch.column(1).to_pylist():
            usable = bool(vector) and None not in vector
            if usable:
                row = np.array(vector, np.float64)
                usable = bool(np.isfinite(row).all() and np.abs(row).max() > 0)
            digests.append(hashlib.blake2b(row.tobytes(), digest_size=16).digest() if usable else None)
            values.append(vector if usable else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digests, pa.binary()), pa.array(values, batch.schema.field(1).type)],
            names=["id", "digest", "vector"])


def passes_for(different: int, threshold: float, window: int = WINDOW) -> int:
    """Passes after which a pair at the threshold has been neighbours with probability ``TARGET_RECALL``."""
    bit = 1 - math.acos(threshold) / math.pi
    met = bit ** max(0.0, math.log2(max(different, 1) / window))
    return max(4, math.ceil(math.log(1 - TARGET_RECALL) / math.log(1 - min(met, 0.999))))


def _keys(passes: int):
    """(node, vector) to one row per pass with its sort key."""
    def run(frames):
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = (np.int64(1) << np.arange(KEY_BITS)[::-1].astype(np.int64))
        for frame in frames:
            for lo in range(0, len(frame), 1024):
                part = frame.iloc[lo:lo + 1024]
                sizes = part.vector.map(len).to_numpy()
                for dim in np.unique(sizes):
                    some = part[sizes == dim]
                    x = unit(np.stack(some.vector.to_numpy()))
                    for p in range(passes):
                        if (p, dim) not in planes:
                            planes[p, dim] = np.random.default_rng([7, p, int(dim)]).standard_normal((dim, KEY_BITS))
                        key = (x @ planes[p, dim] > 0) @ weights
                        yield pd.DataFrame({"pass": p, "dim": int(dim), "key": key, "node": some.node.to_numpy(),
                                            "vector": list(some.vector)})

    return run


def _forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions a, b) to at most one link per node: to the first of its connected positions."""
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _near(x: np.ndarray, nodes: np.ndarray, fresh: int, threshold: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the last ``fresh`` rows with up to ``window`` rows before each."""
    out_a, out_b = [], []
    begin = len(x) - fresh
    for lo in range(begin, len(x), BLOCK):
        hi, base = min(lo + BLOCK, len(x)), max(0, lo - window)
        like = x[lo:hi] @ x[base:hi].T >= threshold
        a, b = np.nonzero(like)
        a, b = a + lo, b + base
        good = (b < a) & (a - b <= window)
        if good.any():
            p, q = _forest(nodes[base:hi], a[good] - base, b[good] - base)
            out_a.append(p)
            out_b.append(q)
    none = np.zeros(0, np.int64)
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none])


def _windows(threshold: float, window: int):
    """Sorted rows to links (a, b), and the rows at both ends of the partition for the windows across it."""
    def ends(rows: pd.DataFrame, boundary: int, side: int) -> pd.DataFrame:
        return pd.DataFrame({"a": rows.node, "b": rows.node, "boundary": boundary, "side": side, "pass": rows["pass"],
                             "dim": rows["dim"], "vector": rows.vector})

    def run(frames):
        part = TaskContext.get().partitionId()
        columns = ["pass", "dim", "node", "vector"]
        carry, head = pd.DataFrame(columns=columns), 0
        for frame in frames:
            frame = frame[columns]
            if head < window and len(frame):
                first = frame.iloc[:window - head]
                head += len(first)
                yield ends(first, part - 1, 1)
            joined = pd.concat([carry, frame], ignore_index=True) if len(carry) else frame.reset_index(drop=True)
            group = joined["pass"].to_numpy(np.int64) * (1 << 32) + joined["dim"].to_numpy(np.int64)
            cuts = np.flatnonzero(np.diff(group)) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(joined)), strict=True):
                fresh = hi - max(lo, len(carry))
                if fresh > 0:
                    x = unit(np.stack(joined.vector.to_numpy()[lo:hi]))
                    a, b = _near(x, joined.node.to_numpy()[lo:hi].astype(np.int64), fresh, threshold, window)
                    if len(a):
                        yield pd.DataFrame({"a": a, "b": b, "boundary": -1, "side": 0, "pass": 0, "dim": 0, "vector": None})
            carry = joined.iloc[-window:].reset_index(drop=True)
        if len(carry):
            yield ends(carry, part, 0)

    return run


def _across(threshold: float, window: int):
    """Rows on both sides of a partition's border to links; 2 * window rows at most."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, same in frame.groupby(["pass", "dim"]):
            left, right = same[same.side == 0], same[same.side == 1]
            if len(left) and len(right):
                both = pd.concat([left.sort_values("place"), right.sort_values("place")])
                a, b = _near(unit(np.stack(both.vector.to_numpy())), both.a.to_numpy(), len(right), threshold, window)
                out.append(pd.DataFrame({"a": a, "b": b}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return run


def _block_links(threshold: float):
    """Vectors of two blocks of a component (or one, twice) to the copies each is linked with."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(frame.vector.to_numpy()))
        left, right = (frame.side != 1).to_numpy(), (frame.side != 0).to_numpy()
        copies = frame.copies.to_numpy().astype(np.float64)
        linked = x[left] @ x[right].T >= threshold
        node = frame.node.to_numpy()
        same = node[left][:, None] == node[right][None, :]
        linked &= ~same
        if (frame.side == 2).all():  # one block against itself: each pair shows twice
            return pd.DataFrame({"node": node, "links": (linked @ copies).astype(np.int64)})
        return pd.DataFrame({"node": np.concatenate((node[left], node[right])),
                             "links": np.concatenate((linked @ copies[right], copies[left] @ linked)).astype(np.int64)})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9, window: int = WINDOW, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest id of its component) and ``kept`` (it is that id)."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.simpleString()
    rows = materialise(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
                       .mapInArrow(_classified, f"id long, digest binary, vector {kind}"))
    classes = materialise(
        rows.where("digest is not null").groupBy("digest")
        .agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.first("vector").alias("vector"))
        .withColumn("node", F.monotonically_increasing_id()))
    different = classes.count()
    passes = passes_for(different, threshold, window)
    sorted_rows = (classes.select("node", "vector")
                   .mapInPandas(_keys(passes), f"pass int, dim int, key long, node long, vector {kind}")
                   .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "pass", "dim", "key", "node")
                   .sortWithinPartitions("pass", "dim", "key", "node"))
    found = materialise(sorted_rows.mapInPandas(
        _windows(threshold, window), f"a long, b long, boundary int, side int, pass int, dim int, vector {kind}"))
    # order within a side is the order in which the partition wrote it
    across = (found.where("vector is not null").withColumn("place", F.monotonically_increasing_id())
              .groupBy("boundary").applyInPandas(_across(threshold, window), "a long, b long"))
    links = found.where("vector is null").select("a", "b").union(across)
    roots = materialise(connected_components(links))
    members = materialise(classes.select("node", "vector", "copies").join(roots, "node"))
    # mean direction of each component
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double")))
    centre = (members.select("root", length.alias("size"), F.posexplode("vector").alias("pos", "value"))
              .groupBy("root", "pos").agg(F.avg(F.col("value") / F.col("size")).alias("value"))
              .groupBy("root").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("c"))
              .select("root", F.col("c.value").alias("centre")))
    half = math.cos(math.acos(threshold) / 2 - 1e-6)
    dot = F.aggregate(F.zip_with("vector", "centre", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda t, v: t + v)
    norm = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda t, v: t + v * v))
    placed = materialise(
        members.join(centre, "root")
        .withColumn("core", F.coalesce(dot / (length * norm) >= half, F.lit(False))).drop("centre"))
    sizes = placed.groupBy("root").agg(
        F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("core_copies"),
        F.ceil(F.sum(F.col("core").cast("int")) / BLOCK).cast("int").alias("core_blocks"),
        F.ceil(F.sum((~F.col("core")).cast("int")) / BLOCK).cast("int").alias("rest_blocks"))
    known = placed.join(sizes, "root")
    certain = known.where("core").select("node", (F.col("core_copies") - F.col("copies")).alias("links"))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("core"), F.col("core_blocks")).otherwise(F.col("rest_blocks"))).cast("int")
    dealt = known.where("rest_blocks > 0").withColumn("mine", block)
    rest, core = dealt.where("not core"), dealt.where("core")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1)).alias("other")
    columns = ["node", "vector", "copies", "root"]
    # (rest i, rest j), i <= j: side 0, 1, or 2 where a block meets itself; then (rest i, core j)
    among = rest.select(*columns, "mine", upto(F.col("rest_blocks"))).select(
        *columns, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.lit(False).alias("mixed"),
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"))
    out = rest.where("core_blocks > 0").select(*columns, "mine", upto(F.col("core_blocks"))).select(
        *columns, F.col("mine").alias("i"), F.col("other").alias("j"), F.lit(True).alias("mixed"), F.lit(0).alias("side"))
    back = core.select(*columns, "mine", upto(F.col("rest_blocks"))).select(
        *columns, F.col("other").alias("i"), F.col("mine").alias("j"), F.lit(True).alias("mixed"), F.lit(1).alias("side"))
    compared = among.union(out).union(back).groupBy("root", "i", "j", "mixed").applyInPandas(
        _block_links(threshold), "node long, links long")
    counted = certain.union(compared).groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("digest", "node", "copies", "first_id").join(roots, "node", "left").join(counted, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    result = named.join(smallest, "root").select(
        "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = rows.where("digest is not null").select("id", "digest").join(result, "digest").select("id", "n_links", "component_id")
    alone = rows.where("digest is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.union(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
