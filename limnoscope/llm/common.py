"""Helpers shared by the corpus operators: checkpoints, text batches, hashes, components, span removal."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_UPPER_TO_LOWER = bytes(LOWER.tolist())

#: Bytes of text that one numpy step works on; bounds a task's memory whatever the batch.
SLICE_BYTES = 1 << 19


def lower_ascii(text: str) -> str:
    """Lower-cases A-Z only."""
    return text.encode("utf-8", "surrogatepass").translate(_UPPER_TO_LOWER).decode("utf-8", "surrogatepass")


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the reliable checkpoint folder and reads it from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; a folder
    of our own is set only where none is, as in a local test.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def gathered(df: DataFrame, per_task: int) -> tuple[DataFrame, int]:
    """``df`` materialised, to be read by as few tasks as ``per_task`` rows each allow, and that number of tasks."""
    stored = materialise(df)
    tasks = -(-stored.count() // per_task) or 1
    return stored.coalesce(tasks), tasks


def release_memory() -> None:
    """Gives what this process no longer uses back to the system, where its C library can; else freed arrays stay with it."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, with underscores behind those that ``df`` has already (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(column, parts: int):
    """Remainder of crc32 of the value as text."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(parts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` bytes (or one longer row): first, end, bytes, offsets from 0."""
    if not len(column):
        return
    data, offsets = text_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


# ---------------------------------------------------------------- hashes

#: Polynomials modulo a prime; two bases, so that a hash has 62 bits. Modulo a power of two, there would be
#: strings (Thue-Morse) that collide whatever the base.
_PRIME = (1 << 31) - 1
_BASES = (0x2545F491, 0x1B873593)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _folded(x: np.ndarray) -> np.ndarray:
    """Remainders by the prime of values below 2**63."""
    prime, bits = np.uint64(_PRIME), np.uint64(31)
    x = (x & prime) + (x >> bits)
    x = (x & prime) + (x >> bits)
    return np.where(x >= prime, x - prime, x)


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:  # what is there, times base**done
        more = min(done, n - done)
        out[done:done + more] = _folded(out[:more] * np.uint64(pow(base, done, _PRIME)))
        done += more
    return out


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base, its powers 0..n-1 and those of its inverse."""
    if not _powers or len(_powers[0][0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers[:] = [(_powers_of(b, size), _powers_of(pow(b, -1, _PRIME), size)) for b in _BASES]
    return [(up[:n], down[:n]) for up, down in _powers]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64(seed * 0xD1342543DE82EF95 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, a row for each base: bytes [s, e) have the hash ``(H[e] - H[s]) * base**-s``."""
    out = np.zeros((len(_BASES), len(data) + 1), np.uint64)
    prime, bits, letters = np.uint64(_PRIME), np.uint64(31), data.astype(np.uint64) + np.uint64(1)
    for row, (up, _) in zip(out, powers(len(data)), strict=True):
        term = letters * up
        np.cumsum((term & prime) + (term >> bits), out=row[1:])  # below 2**63 for texts below 2**31 bytes
    return out


def span_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span, wherever it stands."""
    high, low = (_folded(_folded(row[ends] - row[starts]) * down[starts])
                 for row, (_, down) in zip(running, powers(running.shape[1]), strict=True))
    return mix((high << np.uint64(31)) | low)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each row the index of its first word."""
    if lower:
        data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    return span_hash(prefix_hash(data), starts, ends), first


def list_array(values, sizes: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column from its values, row after row."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------- components

#: Links that one task takes, a few MB; graphs of more are contracted in rounds.
FEW_LINKS = 1 << 18


def _roots(frames):
    """All links (hi, lo) to (node, root): roots hook onto smaller ones, then every node jumps to its root."""
    ends = pd.concat(frames, ignore_index=True)
    nodes, at = np.unique(ends.to_numpy().ravel(), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    yield pd.DataFrame({"node": nodes, "root": nodes[root]})


def connected_components(edges: DataFrame, max_rounds: int = 60, few: int = FEW_LINKS) -> DataFrame:
    """Components of an undirected graph given as rows (a, b); returns (node, root), root the smallest node.

    At most ``few`` links are settled in one task. More go through alternating star contraction: each round links every node to the smallest
    node of its neighbourhood, first upwards, then downwards, until nothing
    changes. Rounds grow with the logarithm of the longest path; degrees are
    aggregated before the shuffle and a star's centre is joined, not collected.
    Each round is written to the checkpoint folder. Nodes without links and null
    ids have no row.
    """
    links = materialise(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .where("hi <> lo").dropDuplicates())
    total = links.count()
    if 0 < total <= few and links.dtypes == [("hi", "bigint"), ("lo", "bigint")]:
        return links.coalesce(1).mapInPandas(_roots, "node long, root long")
    for _ in range(max_rounds if total else 0):
        both = links.union(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        smallest = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
        large = (both.join(smallest, "hi").where("lo > hi")
                 .select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").dropDuplicates())
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi")
        grown = materialise(
            small.select("hi", F.col("m").alias("lo"))
            .union(small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
            .where("hi <> lo").dropDuplicates())
        now = grown.count()
        same = now == total and grown.join(links, ["hi", "lo"], "left_anti").isEmpty()
        links, total = grown, now
        if same:
            break
    else:
        if total:
            raise RuntimeError("components did not settle")
    roots = links.groupBy("hi").agg(F.min("lo").alias("root")).withColumnRenamed("hi", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").dropDuplicates())


# ---------------------------------------------------------------- removal of spans

REMOVAL = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans; spans that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.empty(len(starts), bool)
    new[0] = True
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


def cut(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The bytes outside the spans; spans must be merged."""
    parts, at = [], 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        parts.append(raw[at:s])
        at = e
    parts.append(raw[at:])
    return b"".join(parts)


def sha256_hex(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
