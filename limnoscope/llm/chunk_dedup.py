"""Substring deduplication by content-defined chunks.

A gear hash of the last 32 bytes rolls over each text; where its lower bits are
zero a chunk ends, unless it would be shorter than ``least`` bytes, and at ``most``
bytes one ends in any case. Borders thus depend on nearby bytes alone: text that
was inserted or cut moves chunks but does not change those after it. Chunks of at
least ``least`` bytes that are equal by 128-bit digest are repeats; the first, by
id and place, stays and the others are removed.

A passage of a few chunks' length can lie so that no whole chunk is in it, and its
edges never are. Repeated passages of at least ``least + average`` bytes are
therefore found by seeds too: of every ``average`` neighbouring strings of ``least``
bytes, the one with the smallest hash, so that each such passage has a seed, the
same wherever it stands. A text's seed meets the first text that holds it, and
bytes are compared from there in both directions, up to ``REACH`` averages beyond
the outermost seeds of a match. What agrees is removed from the later text; inside
one text, from the later place. Whatever is removed thus stands at an earlier place.
A passage whose every seed meets texts that share less than ``least + average``
bytes with it stays. Whole copies of a text lose chunks only.

Digests, not texts, are grouped, with a partial minimum before the shuffle, so a
chunk that a third of all texts hold is one row per task. Of texts that others
repeat, only the stretches around common seeds are moved to those.

Cases: null and empty texts have no chunks and stay as they are; a last chunk
shorter than ``least`` is removed only with a passage; of repeated rows the first
keeps its chunks; null ids come after all others and keep their rows; other columns
are passed through by ``remove_chunks``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnoscope.llm.common import (cut, free_names, list_array, materialise, merge_spans, mix, prefix_hash, signed, span_hash,
                                   text_slices)
from limnoscope.llm.suffix_dedup import _sliding_min

#: Numbers of the gear, from a fixed seed.
GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)
LEAST, AVERAGE, MOST = 64, 128, 1024
#: Averages beyond the outermost seeds of a match that are compared; seeds are at most one average apart.
REACH = 2
#: Bytes of text whose strings are hashed at once; each takes some hundred bytes of memory.
SEED_BYTES = 1 << 17


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash of the 32 bytes up to it: the sum of GEAR[byte] << distance."""
    out = GEAR[data]
    for reach in (1, 2, 4, 8, 16):
        longer = out.copy()
        longer[reach:] += out[:-reach] << np.uint32(reach)
        out = longer
    return out


def chunk_ends(data: np.ndarray, offsets: np.ndarray, least: int, average: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """End of each chunk, and the number of chunks of each row."""
    border = np.flatnonzero(gear_hash(data) & np.uint32(average - 1) == 0) + 1
    spots = np.searchsorted(border, offsets, "right")
    ends, numbers = [], []
    for row in range(len(offsets) - 1):
        at, stop = int(offsets[row]), int(offsets[row + 1])
        n = len(ends)
        for place in border[spots[row]:spots[row + 1]].tolist():
            while place - at > most:
                at += most
                ends.append(at)
            if place - at >= least:
                at = place
                ends.append(at)
        while stop - at > most:
            at += most
            ends.append(at)
        if stop > at:
            ends.append(stop)
        numbers.append(len(ends) - n)
    return np.array(ends, np.int64), np.array(numbers, np.int64)


def _chunks(least: int, average: int, most: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                ends, numbers = chunk_ends(data, offsets, least, average, most)
                rows = np.repeat(np.arange(hi - lo), numbers)
                starts = np.concatenate((offsets[:1], ends[:-1])) if len(ends) else ends
                starts = np.maximum(starts, offsets[:-1][rows]) if len(ends) else ends
                raw = data.tobytes()
                long = ends - starts >= least
                digests = [hashlib.blake2b(raw[s:e], digest_size=16).digest()
                           for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
                kept = np.bincount(rows[long], minlength=hi - lo)
                base = offsets[:-1][rows[long]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.diff(offsets)),
                     pa.array(numbers), list_array(digests, kept, pa.binary()),
                     list_array((starts[long] - base).astype(np.int32), kept), list_array((ends[long] - starts[long]).astype(np.int32), kept)],
                    names=["id", "row", "n_bytes", "n_chunks", "digests", "starts", "sizes"])

    return run, "id long, row long, n_bytes long, n_chunks long, digests array<binary>, starts array<int>, sizes array<int>"


SPANS = "array<struct<a: long, b: long>>"


def repeated_chunks(docs: DataFrame, least: int = LEAST, average: int = AVERAGE, most: int = MOST, id_col: str = "doc_id",
                    text_col: str = "text", row_col: str = "row", packed: bool = False) -> DataFrame:
    """One row per document: id, ``row`` (of ``row_col``), n_bytes, n_chunks, n_removed_chunks, n_removed (bytes) and ``spans``; texts may be packed."""
    text = F.col(text_col) if packed else F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.col(row_col).cast("long").alias("row"))
    run, schema = _chunks(least, average, most)
    chunked = materialise(rows.mapInArrow(_unpacking(run) if packed else run, schema))
    flat = (chunked.select("id", "row", F.explode(F.arrays_zip("digests", "starts", "sizes")).alias("c"))
            .select("id", "row", F.col("c.digests").alias("digest"), F.col("c.starts").alias("start"), F.col("c.sizes").alias("size")))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "start")
    often = (flat.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first"))
             .where("n > 1").select("digest", F.col("first.row").alias("row0"), F.col("first.start").alias("start0")))
    gone = (flat.select("digest", "row", "start", "size").join(often, "digest").where("row <> row0 or start <> start0")
            .groupBy("row").agg(F.count("*").alias("n_removed_chunks"), F.sum("size").alias("n_removed"),
                                F.sort_array(F.collect_list(F.struct(
                                    F.col("start").cast("long").alias("a"), (F.col("start") + F.col("size")).cast("long").alias("b")))).alias("spans")))
    zero = F.lit(0).cast("long")
    return (chunked.select("id", "row", "n_bytes", "n_chunks").join(gone, "row", "left")
            .select(F.col("id").alias(id_col), "row", "n_bytes", "n_chunks", F.coalesce("n_removed_chunks", zero).alias("n_removed_chunks"),
                    F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans")))


# ---------------------------------------------------------------- passages

def agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """Number of first bytes that are equal in both."""
    n, most = 0, min(len(x), len(y))
    while n < most:
        step = min(max(64, n), most - n)
        apart = np.flatnonzero(x[n:n + step] != y[n:n + step])
        if len(apart):
            return n + int(apart[0])
        n += step
    return n


def agreements(x: np.ndarray, y: np.ndarray, hits: list, shortest: int) -> list:
    """Spans of ``x`` of at least ``shortest`` bytes that agree with ``y`` about a hit (place in x, place in y); hits in order."""
    out, done = [], {}
    for i, j in hits:
        if i >= done.get(i - j, 0):
            right = agreeing(x[i:], y[j:])
            left = agreeing(x[:i][::-1], y[:j][::-1])
            done[i - j] = i + right
            if left + right >= shortest:
                out.append((i - left, i + right))
    return out


def seeds(data: np.ndarray, offsets: np.ndarray, least: int, average: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte (in all ``data``) and hash of each seed, in order; ``average`` neighbours with their seeds lie inside one row."""
    count = len(data) - least + 1
    if count < average:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    at = np.arange(count)
    key = span_hash(prefix_hash(data), at, at + least)
    low = np.uint64((1 << 32) - 1)
    smallest = (_sliding_min((key & ~low) | at.astype(np.uint64), average) & low).astype(np.int64)
    windows = np.maximum(np.diff(offsets) - least - average + 2, 0)
    row = np.repeat(np.arange(len(windows)), windows)
    first = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[:-1][row]
    chosen = smallest[first]
    new = np.ones(len(chosen), bool)
    new[1:] = chosen[1:] != chosen[:-1]  # places only grow, and rows have their own
    return row[new], chosen[new], mix(key[chosen[new]], 5)


def _seeds(least: int, average: int):
    """Batches of (id, text, row) to a text's digest, the first of its equal seeds, and the passages that are repeated inside it."""
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1), SEED_BYTES):
                row, at, key = seeds(data, offsets, least, average)
                order = np.lexsort((at, key, row))
                row, at, key = row[order], at[order], key[order]
                again = np.zeros(len(at), bool)
                again[1:] = (row[1:] == row[:-1]) & (key[1:] == key[:-1])
                # each to the one before it, so that a long repetition is one match
                later = np.flatnonzero(again)
                inner = [[] for _ in range(hi - lo)]
                for r, i, j in sorted(zip(row[later].tolist(), at[later].tolist(), at[later - 1].tolist(), strict=True)):
                    inner[r].append((i - int(offsets[r]), j - int(offsets[r])))
                for r, hits in enumerate(inner):
                    text = data[offsets[r]:offsets[r + 1]]
                    inner[r] = [{"a": a, "b": b} for a, b in agreements(text, text, hits, least + average)] if hits else []
                row, at, key = row[~again], at[~again], key[~again]
                kept = np.bincount(row, minlength=hi - lo)
                digests = [hashlib.blake2b(data[x:y].tobytes(), digest_size=16).digest() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(digests, pa.binary()), list_array(signed(key), kept),
                     list_array((at - offsets[row]).astype(np.int32), kept),
                     pa.array(inner, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))],
                    names=["id", "row", "digest", "keys", "starts", "inner"])

    return run, f"id long, row long, digest binary, keys array<long>, starts array<int>, inner {SPANS}"


def _stretches(batches):
    """Rows (row0, packed text, list of from and to) to one row for each stretch."""
    for batch in _few_rows(batches):
        for row, text, wanted in zip(batch.column(0).to_pylist(), unpacked(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            raw = text.encode("utf-8")
            yield pa.RecordBatch.from_arrays(
                [pa.array([row] * len(wanted), pa.int64()), pa.array([w["from0"] for w in wanted], pa.int32()),
                 pa.array([w["to0"] for w in wanted], pa.int32()),
                 pa.array([raw[w["from0"]:w["to0"]] for w in wanted], pa.binary())], names=["row0", "from0", "to0", "bytes"])


def passage_sources(rows: DataFrame, texts: DataFrame, least: int, average: int) -> DataFrame:
    """For each row that may repeat passages: ``inner`` spans, and ``sources``, stretches of earlier texts and the seeds in common.

    ``rows`` has id, packed text and row; ``texts`` row and packed text.
    """
    run, schema = _seeds(least, average)
    seeded = materialise(rows.mapInArrow(_unpacking(run), schema))
    flat = (seeded.select("id", "row", F.explode(F.arrays_zip("keys", "starts")).alias("s"))
            .select("id", "row", F.col("s.keys").alias("key"), F.col("s.starts").alias("start")))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "start")
    often = (flat.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("first"))
             .where("n > 1").select("key", F.col("first.row").alias("row0"), F.col("first.start").alias("start0")))
    text_place = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    originals = (seeded.where("size(keys) > 0").groupBy("digest").agg(F.count("*").alias("n"), F.min(text_place).alias("first"))
                 .where("n > 1").select("digest", F.col("first.row").alias("row0")))
    copies = seeded.select("row", "digest").join(originals, "digest").where("row <> row0").select("row")
    reach = REACH * average
    lines = materialise(
        flat.select("key", "row", "start").join(often, "key").where("row <> row0")
        .groupBy("row", "row0", (F.col("start") - F.col("start0")).alias("shift")).agg(F.sort_array(F.collect_list("start0")).alias("starts0"))
        .join(copies, "row", "left_anti")
        .withColumn("from0", F.greatest(F.element_at("starts0", 1) - reach, F.lit(0)))
        .withColumn("to0", F.element_at("starts0", -1) + least + reach))
    wanted = lines.groupBy("row0").agg(F.collect_set(F.struct("from0", "to0")).alias("wanted"))
    stretches = (texts.join(wanted, texts["row"] == wanted["row0"]).select("row0", "packed", "wanted")
                 .mapInArrow(_stretches, "row0 long, from0 int, to0 int, bytes binary"))
    sources = (lines.join(stretches, ["row0", "from0", "to0"])
               .groupBy("row").agg(F.collect_list(F.struct("shift", "starts0", "from0", "bytes")).alias("sources")))
    return seeded.where("size(inner) > 0").select("row", "inner").join(sources, "row", "full")


def outside(spans: list, taken: list) -> list:
    """Parts of ``spans`` that are in none of ``taken``; both in order and without overlaps."""
    out, k = [], 0
    for a, b in spans:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        m = k
        while m < len(taken) and taken[m][0] < b:
            if taken[m][0] > a:
                out.append((a, taken[m][0]))
            a = taken[m][1]
            m += 1
        if a < b:
            out.append((a, b))
    return out


def _with_passages(raw: bytes, spans: list, inner: list, sources: list, shortest: int) -> list:
    """The removed spans of chunks, and what passages add to them."""
    x = np.frombuffer(raw, np.uint8)
    found = [(s["a"], s["b"]) for s in inner]
    for source in sources:
        hits = [(j + source["shift"], j - source["from0"]) for j in source["starts0"]]
        found += agreements(x, np.frombuffer(source["bytes"], np.uint8), hits, shortest)
    if not found:
        return spans
    a, b = merge_spans(*np.array(found, np.int64).T)
    return sorted(spans + outside(list(zip(a.tolist(), b.tolist(), strict=True)), spans))


# ---------------------------------------------------------------- texts

def _few_rows(batches, rows: int = 1024):
    """The batches in parts, so that a task holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _packing(text_at: int):
    """The text column as zstd bytes, which take less of the disk."""
    def run(batches):
        codec = pa.Codec("zstd")
        for batch in _few_rows(batches):
            columns = batch.columns
            columns[text_at] = pa.array([None if t is None else len(r := t.encode("utf-8")).to_bytes(4, "little") + codec.compress(r, asbytes=True)
                                         for t in columns[text_at].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def unpacked(column: pa.Array) -> list:
    codec = pa.Codec("zstd")
    return [None if z is None else codec.decompress(z[4:], int.from_bytes(z[:4], "little"), asbytes=True).decode("utf-8")
            for z in column.to_pylist()]


def _unpacking(then):
    """``then`` on batches whose second column is packed."""
    def run(batches):
        yield from then(pa.RecordBatch.from_arrays([b.column(0), pa.array(unpacked(b.column(1)), pa.string()), *b.columns[2:]], names=b.schema.names)
                        for b in _few_rows(batches))

    return run


def _replaced(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join(f"`{c}` {kind if c == name else t}" for c, t in df.dtypes)


def _cleaned(text_at: int, shortest: int, size: str):
    """Rows that end with (spans, inner, sources) to the text that is left, all removed spans and their bytes as ``size``."""
    def run(batches):
        for batch in _few_rows(batches):
            n = batch.num_columns - 3
            columns, texts, spans = batch.columns[:n], [], []
            for text, removed, inner, sources in zip(unpacked(columns[text_at]), *(c.to_pylist() for c in batch.columns[n:]), strict=True):
                removed = [(s["a"], s["b"]) for s in removed or []]
                if text and (inner or sources):
                    removed = _with_passages(text.encode("utf-8"), removed, inner or [], sources or [], shortest)
                if removed:
                    text = cut(text.encode("utf-8"), *np.array(removed, np.int64).T).decode("utf-8", "ignore")
                texts.append(text)
                spans.append(removed)
            columns[text_at] = pa.array(texts, pa.string())
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], kind), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64())],
                names=[*batch.schema.names[:n + 1], size])

    return run


def _without_repeats(docs: DataFrame, least: int, average: int, most: int, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the text that is left, ``_spans``, ``_size`` (removed bytes) and the counts of chunks as ``_chunks``; names free in ``docs``."""
    row, spans, size, counts = free_names(docs, "_row", "_spans", "_size", "_chunks")
    at = docs.columns.index(text_col)
    typed = docs.withColumn(text_col, F.col(text_col).cast("string"))
    # stored, so that all uses see the same numbers
    numbered = materialise(typed.mapInArrow(_packing(at), _replaced(typed, text_col, "binary")).withColumn(row, F.monotonically_increasing_id()))
    rows = numbered.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(row).alias("row"))
    texts = numbered.select(F.col(row).alias("row"), F.col(text_col).alias("packed"))
    chunks = repeated_chunks(rows, least, average, most, "id", "text", "row", packed=True).select(
        "row", F.struct("n_bytes", "n_chunks", "n_removed_chunks").alias("chunks"), "spans")
    others = [f"`{c}`" for c in docs.columns if c != text_col]
    rest = numbered.select(F.struct(*others).alias("rest"), F.col(row).alias("row"))
    found = rest.join(chunks, "row").join(passage_sources(rows, texts, least, average), "row", "left")
    # texts are moved once: the stretches come from the same rows in the same places
    joined = texts.join(found, "row").select(
        *[F.col("packed").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns],
        F.col("chunks").alias(counts), F.col("spans").alias(spans), "inner", "sources")
    shown = (f"{_replaced(typed, text_col, 'string')}, `{counts}` struct<n_bytes: long, n_chunks: long, n_removed_chunks: long>, "
             f"`{spans}` {SPANS}, `{size}` long")
    return joined.mapInArrow(_cleaned(at, least + average, size), shown)


def remove_chunks(docs: DataFrame, least: int = LEAST, average: int = AVERAGE, most: int = MOST, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``docs`` without repeated chunks and passages; a character cut in two goes as a whole."""
    return _without_repeats(docs, least, average, most, id_col, text_col).select(*docs.columns)


def chunk_report(docs: DataFrame, least: int = LEAST, average: int = AVERAGE, most: int = MOST, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The report of :func:`repeated_chunks`, with passages in ``spans`` and ``n_removed``, and the text that is left as ``text`` (null stays null)."""
    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    left = _without_repeats(texts, least, average, most, id_col, "text")
    return left.select(id_col, "_chunks.n_bytes", "_chunks.n_chunks", "_chunks.n_removed_chunks", F.col("_size").alias("n_removed"),
                       F.col("_spans").alias("spans"), "text")
