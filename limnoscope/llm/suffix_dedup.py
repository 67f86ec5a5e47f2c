"""Removal of long repeated byte strings by bounded interval expansion on a Burrows-Wheeler transform.

Every ``length``-byte window of every text has an anchor, the smallest k-gram hash
in it, so equal windows have equal anchors at the same place. Windows of one
anchor whose places lie in one quarter of the window form a segment; all of them
hold the segment's core, and the core's digest is the key that brings together
what can be equal. Texts are thus compared wherever they meet, without a global
suffix array:

1. equal whole texts are one class; equal segments are one class too. Whatever
   occurs twice as a whole is a repeat;
2. different segments of one key are joined to blocks of about half a megabyte. A
   block's suffixes are sorted to the needed depth, and common prefixes follow in
   increasing order from breadth-first backward extension on its transform. It
   stops at ``length``: neighbours without a value by then share a whole window;
3. a key with more than ``MAX_GROUP`` different segments (a passage in a large
   share of all texts, at its edges) would not fit one task. Its windows are
   counted one by one by digest, an exact way for the rest.

Only segments whose key occurs twice leave their text, and of those only the
different ones are moved as bytes.

Cases: null and empty texts, and texts shorter than ``length``, lose nothing
(unless they repeat inside a longer window, which they cannot); repeated rows and
equal texts of at least ``length`` bytes lose everything; overlapping repeats
inside one text count; matches never cross texts; null ids keep their rows; other
columns are passed through by ``remove_repeats``. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnoscope.llm.common import (cut, free_names, list_array, materialise, merge_spans, mix, prefix_hash, sha256_hex, signed,
                                   span_hash, text_slices)

#: Bytes of a k-gram that can be an anchor.
GRAM = 16
#: Parts of a window's length in which an anchor can lie; windows of one part share a core.
PARTS = 4
#: Bytes of one block's transform, and different segments of a key that are compared in a block.
BLOCK_BYTES = 1 << 19
MAX_GROUP = 1024


# ---------------------------------------------------------------- segments of a text

def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int):
    """Row, key, digest, first window and number of windows of each segment; starts count from the row's first byte."""
    none = np.zeros(0, np.int64)
    n, gram = len(data), min(GRAM, length)
    width = length - gram + 1
    part = -(-width // PARTS)
    if n < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    running = prefix_hash(data)
    at = np.arange(n - gram + 1)
    low = np.uint64((1 << 32) - 1)
    ranked = (span_hash(running, at, at + gram) & ~low) | at.astype(np.uint64)
    anchor = (_sliding_min(ranked, width) & low).astype(np.int64)
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    total = int(counts.sum())
    row = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][row]
    if not total:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    anchor = anchor[start]
    piece = (anchor - start) // part
    new = np.ones(total, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, total))
    row, start, anchor, piece = row[first], start[first], anchor[first], piece[first]
    core = anchor - piece * part
    key = mix(span_hash(running, core, core - part + 1 + length) + piece.astype(np.uint64), 3)
    digest = mix(span_hash(running, start, start + windows - 1 + length)
                 + windows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (anchor - start).astype(np.uint64), 4)
    return row, key, digest, start - offsets[:-1][row], windows


def _scan(length: int):
    """Batches of (text) to one row per text: digest of the text, its segments, and repeats inside it."""
    def run(batches):
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                rows = len(offsets) - 1
                row, key, digest, start, windows = segments(data, offsets, length)
                order = np.lexsort((start, digest, key, row))
                same = np.zeros(len(order) + 1, bool)
                r, k, d = row[order], key[order], digest[order]
                same[1:-1] = (r[1:] == r[:-1]) & (k[1:] == k[:-1]) & (d[1:] == d[:-1])
                inner = np.zeros(len(order), bool)
                inner[order] = same[:-1] | same[1:]
                keep = np.ones(len(order), bool)
                keep[order] = ~same[:-1]
                a, b = start[inner], (start + windows - 1 + length)[inner]
                base = offsets[:-1]
                a, b = merge_spans(a + base[row[inner]] + row[inner], b + base[row[inner]] + row[inner])  # rows never touch
                of = np.searchsorted(base + np.arange(rows), a, "right") - 1
                kept = np.bincount(row[keep], minlength=rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array([sha256_hex(data[x:y].tobytes()) for x, y in zip(offsets[:-1], offsets[1:], strict=True)], pa.string()),
                    pa.array(np.diff(offsets)),
                    list_array(signed(key[keep]), kept), list_array(signed(digest[keep]), kept),
                    list_array(start[keep].astype(np.int32), kept), list_array(windows[keep].astype(np.int32), kept),
                    list_array((a - base[of] - of).astype(np.int32), np.bincount(of, minlength=rows)),
                    list_array((b - base[of] - of).astype(np.int32), np.bincount(of, minlength=rows))],
                    names=["sha", "n_bytes", "keys", "digests", "starts", "windows", "inner_from", "inner_to"])

    return run, ("sha string, n_bytes long, keys array<long>, digests array<long>, starts array<int>, windows array<int>, "
                 "inner_from array<int>, inner_to array<int>")


# ---------------------------------------------------------------- the transform

def sorted_suffixes(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by at least ``depth`` symbols, and the common prefixes of neighbours up to 7 (7: or more)."""
    n = len(symbols)
    padded = np.concatenate((symbols.astype(np.int64), np.zeros(8, np.int64)))
    packed = np.zeros(n, np.int64)
    for t in range(7):
        packed = (packed << 9) | padded[t:t + n]
    order = np.argsort(packed)
    keys = packed[order]
    apart = keys[1:] ^ keys[:-1]
    common = np.zeros(n, np.int16)
    for t in range(1, 8):
        common[1:] += apart < (1 << (63 - 9 * t))
    new = np.ones(n, bool)
    new[1:] = apart != 0
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    height = 7
    while height < depth:
        tied = ~(new & np.append(new[1:], True))
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        at = order[slots]
        pair = (rank[at] << 32) | (rank[np.minimum(at + height, n)] + 1)
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[slots] = at
        begins = np.ones(len(slots), bool)
        begins[1:] = pair[1:] != pair[:-1]
        new[slots] = begins
        rank[at] = slots[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
        height *= 2
    return order, common


def common_prefixes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes, and for each neighbour pair its common prefix below ``length``; -1: at least ``length``.

    ``symbols`` ends with its only 0. Values up to 6 come from the packed symbols;
    from there on, each round takes the intervals whose right border got its value
    in the round before, extends them backwards by every symbol that precedes one
    of their rows, and gives the round's value to those right borders of the
    extended intervals that have none.
    """
    n = len(symbols)
    order, common = sorted_suffixes(symbols, length)
    before = symbols[order - 1]
    by_symbol = np.argsort(before, kind="stable")
    back = np.empty(n, np.int64)  # row of the suffix that is one symbol longer
    back[by_symbol] = np.arange(n)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    following, preceding = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    preceding[by_symbol[1:][same]] = by_symbol[:-1][same]
    step = min(7, length)
    value = np.where(common < step, common, -1).astype(np.int16)
    value[0] = 0
    borders = np.flatnonzero(value >= 0)
    right = np.flatnonzero(value == step - 1)
    right = right[right > 0]
    left = borders[np.searchsorted(borders, right) - 1]
    for known in range(step, length):
        if not len(right):
            break
        sizes = right - left
        ends = np.cumsum(sizes)
        rows = np.arange(ends[-1]) + np.repeat(left - ends + sizes, sizes)
        last = following[rows] >= np.repeat(right, sizes)
        first = preceding[rows] < np.repeat(left, sizes)
        right = np.sort(back[rows[last]]) + 1
        left = np.sort(back[rows[first]])
        fresh = right < n
        fresh[fresh] = value[right[fresh]] < 0
        left, right = left[fresh], right[fresh]
        value[right] = known
    return order, value


def repeated_windows(texts: list[bytes], windows: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, which of its first ``windows`` starts begin a string of ``length`` that begins at another start too."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    symbols = np.append(data.astype(np.int16) + 1, np.int16(0))
    begins = np.cumsum(sizes) - sizes
    inside = np.arange(len(data)) - np.repeat(begins, sizes) < np.repeat(windows, sizes)
    order, value = common_prefixes(symbols, length)
    group = np.cumsum(value >= 0) - 1
    counted = np.append(inside, False)[order]
    often = np.bincount(group[counted], minlength=group[-1] + 1) > 1
    found = np.zeros(len(symbols), bool)
    found[order] = counted & often[group]
    return [found[b:b + m] for b, m in zip(begins.tolist(), windows.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of true values: first and end."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _compare(length: int):
    """Segments sorted by key to spans: whole keys gathered to blocks, each block transformed once."""
    def block(rows: list) -> pd.DataFrame:
        found = repeated_windows([r[3] for r in rows], np.array([r[4] for r in rows]), length)
        out = [(r[1], r[2] + a, r[2] + b - 1 + length) for r, f in zip(rows, found, strict=True)
               for a, b in zip(*_runs(f), strict=True)]
        return pd.DataFrame(out, columns=["node", "a", "b"], dtype="int64")

    def run(frames):
        rows, size, last = [], 0, None
        for frame in frames:
            for r in zip(frame.key, frame.node, frame.start, frame.bytes, frame.windows, strict=True):
                if size >= BLOCK_BYTES and r[0] != last:
                    yield block(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3]) + 1
                last = r[0]
        if rows:
            yield block(rows)

    return run


def _digests(length: int):
    """Segments to one row per window: digest, node, start."""
    def run(frames):
        for frame in frames:
            for node, start, raw, windows in zip(frame.node, frame.start, frame.bytes, frame.windows, strict=True):
                yield pd.DataFrame({
                    "digest": [hashlib.blake2b(raw[i:i + length], digest_size=16).digest() for i in range(windows)],
                    "node": node, "start": np.arange(start, start + windows)})

    return run


def _bytes_of(length: int):
    """Rows (node, text, list of segments) to one row per segment with its bytes."""
    def run(frames):
        for frame in frames:
            for node, text, wanted in zip(frame.node, frame.text, frame.wanted, strict=True):
                raw = text.encode("utf-8")
                yield pd.DataFrame(
                    [(w["key"], node, w["start"], raw[w["start"]:w["start"] + w["windows"] - 1 + length], w["windows"], w["hot"])
                     for w in wanted], columns=["key", "node", "start", "bytes", "windows", "hot"])

    return run


def _removed(frames):
    """Rows (node, text, spans) to the counts and the digest of what is left."""
    for frame in frames:
        out = []
        for node, text, spans in zip(frame.node, frame.text, frame.spans, strict=True):
            raw = text.encode("utf-8")
            a = np.array([s["a"] for s in spans], np.int64)
            b = np.array([s["b"] for s in spans], np.int64)
            a, b = merge_spans(a, b)
            out.append((node, int((b - a).sum()), len(a), sha256_hex(cut(raw, a, b)),
                        [{"a": int(x), "b": int(y)} for x, y in zip(a, b, strict=True)]))
        yield pd.DataFrame(out, columns=["node", "n_removed", "n_spans", "kept_sha256", "spans"])


SPANS = "array<struct<a: long, b: long>>"


def repeats(docs: DataFrame, length: int = 400, text_col: str = "text") -> DataFrame:
    """One row per different text: ``sha`` (hex SHA-256 of the text), n_bytes, n_removed, n_spans, kept_sha256 and the removed ``spans``."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    scanned = texts.mapInArrow(*_scan(length))
    packed = F.struct(F.size("keys").alias("n"), "keys", "digests", "starts", "windows", "inner_from", "inner_to")
    classes = materialise(
        scanned.groupBy("sha").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first(packed).alias("p"))
        .select(F.monotonically_increasing_id().alias("node"), "sha", "copies", "n_bytes", "p.*"))
    flat = (classes.where("n > 0")
            .select("node", F.explode(F.arrays_zip("keys", "digests", "starts", "windows")).alias("s"))
            .select("node", F.col("s.keys").alias("key"), F.col("s.digests").alias("digest"),
                    F.col("s.starts").alias("start"), F.col("s.windows").alias("windows")))
    twice = (flat.groupBy("key").agg(F.count("*").alias("n"), F.min("digest").alias("d0"), F.max("digest").alias("d1"))
             .where("n > 1").select("key", (F.col("d0") != F.col("d1")).alias("mixed")))
    met = materialise(flat.join(twice, "key"))
    # segments that occur twice as a whole
    kinds = materialise(met.where("mixed").groupBy("key", "digest")
                        .agg(F.count("*").alias("n"), F.min(F.struct("node", "start", "windows")).alias("one")))
    span = [F.col("node"), F.col("start").cast("long").alias("a"), (F.col("start") + F.col("windows") - 1 + length).cast("long").alias("b")]
    whole = (met.where("not mixed").select(*span)
             .union(met.where("mixed").join(kinds.where("n > 1").select("key", "digest"), ["key", "digest"]).select(*span)))
    # different segments of one key
    sizes = kinds.groupBy("key").agg(F.count("*").alias("kinds"))
    wanted = (kinds.join(sizes, "key")
              .select("key", "one.*", (F.col("kinds") > MAX_GROUP).alias("hot"))
              .groupBy("node").agg(F.collect_list(F.struct("key", "start", "windows", "hot")).alias("wanted")))
    touched = met.select("node").union(classes.where("size(inner_from) > 0").select("node")).dropDuplicates()
    held = materialise(
        texts.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
        .join(classes.select("node", "sha").join(touched, "node"), "sha").dropDuplicates(["node"]).select("node", "text"))
    pieces = materialise(
        held.join(wanted, "node").select("node", "text", "wanted")
        .mapInPandas(_bytes_of(length), "key long, node long, start long, bytes binary, windows int, hot boolean"))
    compared = (pieces.where("not hot").drop("hot").repartition("key").sortWithinPartitions("key")
                .select("key", "node", "start", "bytes", "windows").mapInPandas(_compare(length), "node long, a long, b long"))
    windows = pieces.where("hot").mapInPandas(_digests(length), "digest binary, node long, start long")
    common = windows.groupBy("digest").count().where("count > 1").select("digest")
    single = (windows.join(common, "digest").select("node", F.col("start").alias("a"), (F.col("start") + length).alias("b")))
    inner = (classes.select("node", F.explode(F.arrays_zip("inner_from", "inner_to")).alias("s"))
             .select("node", F.col("s.inner_from").cast("long").alias("a"), F.col("s.inner_to").cast("long").alias("b")))
    spans = (whole.union(compared).union(single).union(inner)
             .join(classes.where("copies = 1").select("node"), "node", "left_semi")
             .groupBy("node").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    changed = (held.join(spans, "node").select("node", "text", "spans")
               .mapInPandas(_removed, f"node long, n_removed long, n_spans long, kept_sha256 string, spans {SPANS}"))
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return (classes.select("node", "sha", "copies", "n_bytes").join(changed, "node", "left")
            .select("sha", "n_bytes",
                    F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                    F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                    F.when(all_gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
                    F.when(all_gone, F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n_bytes").alias("b"))))
                    .otherwise(F.coalesce("spans", F.array().cast(SPANS))).alias("spans")))


def removal_report(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans."""
    found = repeats(docs, length, text_col)
    rows = docs.select(F.col(id_col), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256).alias("sha"))
    return rows.join(found, "sha").select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def _cleaned(text_at: int):
    def run(batches):
        for batch in batches:
            texts, spans = batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            out = []
            for text, removed in zip(texts, spans, strict=True):
                if removed:
                    a = np.array([s["a"] for s in removed], np.int64)
                    b = np.array([s["b"] for s in removed], np.int64)
                    text = cut(text.encode("utf-8"), a, b).decode("utf-8", "ignore")
                out.append(text)
            columns = batch.columns[:-1]
            columns[text_at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return run


def remove_repeats(docs: DataFrame, length: int = 400, text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated bytes; other columns and rows stay. A character cut in two goes as a whole."""
    sha, spans = free_names(docs, "_sha", "_spans")
    found = repeats(docs, length, text_col).where("n_removed > 0").select(F.col("sha").alias(sha), F.col("spans").alias(spans))
    keyed = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))
    joined = keyed.join(found, sha, "left").select(*docs.columns, spans)
    return joined.mapInArrow(_cleaned(docs.columns.index(text_col)), docs.schema)
