"""Best-fit packing of token sequences by exact complements.

Texts become token ids; only those longer than a sequence are cut. What is packed
are lengths, and there are no more different lengths than tokens in a sequence, so
the plan is made on the number of pieces of each length (one row per length,
whatever the corpus). For the longest length left, the gap it leaves is filled
exactly: by one length, by two or by three whose sum is the gap, found in indexes
of the available lengths and their pair sums, and the combination is used as
often as all its lengths allow. What no combination completes is packed by best
fit on counts of equal bins. The plan is a list of combinations with
multiplicities; each piece finds its place from its rank among the pieces of its
length. Ranks come from counts per (length, partition), so a length that
a third of all pieces have is numbered by many tasks.

Cases: null and empty texts are the closing id alone; repeated rows are packed
once per row; a null id keeps its pieces; other columns are ignored; an empty
table gives an empty result. Numbers of sequences have no meaning and may have gaps.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnoscope.llm.common import LOWER, list_array, materialise, prefix_hash, span_hash, text_slices, word_spans
from limnoscope.llm.token_counts import byte_letters

#: Words whose ids a worker remembers.
CACHE = 600_000
_words: dict[str, Words] = {}
#: Words of Latin letters only: already in Unicode form C, one piece of text to the vocabulary, lower-cased by letter.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
LETTER = np.zeros(256, bool)
LETTER[list(range(65, 91)) + list(range(97, 123))] = True


class Words:
    """Ids of words under a vocabulary, remembered by a worker.

    The vocabulary's pieces never join words across white space, so words can be
    encoded apart from each other, and each different one once.
    """

    def __init__(self, path: str):
        # tasks are the parallel units; threads inside them only wait for each other
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model)  # without the rules that bring text to words
        self.letters = {b: c for c, b in byte_letters().items()}
        self.stops = np.zeros(256, np.uint32)
        for mark in ".,":
            self.stops[ord(mark)], = self.whole.encode(mark, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, keys: list[int], words: list[str]) -> None:
        plain = [PLAIN.fullmatch(w) is not None for w in words]
        letters = [w.lower().encode().decode("latin-1").translate(self.letters) for w in compress(words, plain)]
        others = [w for w, p in zip(words, plain, strict=True) if not p]
        merged = iter(self.merges.encode_batch_fast(letters, add_special_tokens=False))
        whole = iter(self.whole.encode_batch_fast(others, add_special_tokens=False))
        rows = [next(merged if p else whole).ids for p in plain]
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        self.place.update(zip(keys, range(len(self.size), len(self.size) + len(keys)), strict=True))
        self.begin = np.append(self.begin, len(self.flat) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(rows), np.uint32, int(size.sum())))

    def encode(self, data: np.ndarray, offsets: np.ndarray, closing: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each with the closing id, and the index of each row's first (one more at the end)."""
        if b"<|" not in data.tobytes():  # special pieces are matched before case is dropped
            data = LOWER[data]
        starts, ends, first = word_spans(data, offsets)
        # a full stop or comma after a letter, at a word's end, is a piece of its own
        mark = np.where((ends - starts > 1), self.stops[data[ends - 1]], 0) if len(ends) else np.zeros(0, np.uint32)
        mark = np.where(LETTER[data[np.maximum(ends - 2, 0)]], mark, 0) if len(ends) else mark
        stem = ends - (mark > 0)
        unique, one, back = np.unique(span_hash(prefix_hash(data), starts, stem), return_index=True, return_inverse=True)
        keys = unique.tolist()
        if len(self.place) + len(keys) > CACHE and not self.place.keys() >= set(keys):
            self.clear()
        found = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(found < 0)
        if len(new):
            raw, known = data.tobytes(), len(self.size)
            spans = zip(starts[one[new]].tolist(), stem[one[new]].tolist(), strict=True)
            self.add(unique[new].tolist(), [raw[s:e].decode("utf-8") for s, e in spans])
            found[new] = np.arange(known, known + len(new))
        word = found[back]
        size = self.size[word]
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        ahead = np.cumsum(size) - size  # ids of words before this one
        marks = np.cumsum(mark > 0) - (mark > 0)
        at = ahead + marks + rows
        total = int(size.sum())
        out = np.full(total + int((mark > 0).sum()) + len(offsets) - 1, closing, np.uint32)
        step = np.arange(total) - np.repeat(ahead, size)
        out[np.repeat(at, size) + step] = self.flat[np.repeat(self.begin[word], size) + step]
        out[(at + size)[mark > 0]] = mark[mark > 0]
        upto = np.concatenate(([0], np.cumsum(size + (mark > 0))))
        return out, upto[first] + np.arange(len(first))


def _known(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def _pieces(path: str, limit: int, closing: int, keep_ids: bool):
    def run(batches):
        words = _known(path)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                ids, first = words.encode(data, offsets, closing)
                n = np.diff(first)
                pieces = -(-n // limit)
                row = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * limit
                length = np.minimum(n[row] - start, limit)
                begin = first[:-1][row] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * b:4 * (b + k)]) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
                           pa.array(length), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(list_array(ids.astype(np.int32), length))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    return run, ("doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


# ---------------------------------------------------------------- the plan

def _fill(counts: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths whose sum is ``gap``, preferring few and long ones."""
    if counts[gap]:
        return (gap,)
    pair = _pair(counts, gap, gap - 1)
    if pair:
        return pair
    for a in np.flatnonzero(counts[:gap - 1])[::-1].tolist():
        if 3 * a < gap:
            break
        counts[a] -= 1
        rest = _pair(counts, gap - a, a)
        counts[a] += 1
        if rest:
            return (a, *rest)
    return None


def _pair(counts: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """Two available lengths, at most ``most``, of this sum, the longest first."""
    low, high = -(-total // 2), min(most, total - 1)
    if low > high:
        return None
    first = counts[low:high + 1]
    second = counts[total - high:total - low + 1][::-1]
    both = (first > 0) & (second > 0)
    if total % 2 == 0:
        both[0] = first[0] > 1
    found = np.flatnonzero(both)
    if not len(found):
        return None
    a = low + int(found[-1])
    return a, total - a


def plan(counts: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and how often each is used; ``counts[l]`` pieces have length l."""
    counts = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if counts[limit]:
        out.append(((limit,), int(counts[limit])))
        counts[limit] = 0
    for longest in range(limit - 1, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            rest = _fill(counts, limit - longest)
            counts[longest] += 1
            if rest is None:
                break
            used = (longest, *rest)
            need = np.bincount(used, minlength=limit + 1)
            times = int((counts[need > 0] // need[need > 0]).min())
            counts -= need * times
            out.append((used, times))
    # residuals: the fullest bin with room, longest piece first; equal bins are counted, not listed
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    open_ = np.zeros(limit + 1, np.int64)
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            gaps = np.flatnonzero(open_[length:])
            if not len(gaps):
                per = limit // length
                full, rest = divmod(left, per)
                for size, times in ((per, full), (rest, 1)):
                    if size and times:
                        gap = limit - size * length
                        room[gap].append(((length,) * size, times))
                        open_[gap] += times
                break
            gap = length + int(gaps[0])
            used, times = room[gap].pop()
            now = min(times, left)
            if now < times:
                room[gap].append((used, times - now))
            room[gap - length].append(((*used, length), now))
            open_[gap] -= now
            open_[gap - length] += now
            left -= now
    for bins in room.values():
        out.extend(bins)
    return out


def _places(combinations: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank of each run of places, the run's first sequence, the offset in it."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for used, times in combinations:
        offset = 0
        for length in used:
            runs[length].append((taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


def pack(docs: DataFrame, path: str, limit: int = 4096, closing: int = 1, id_col: str = "doc_id", text_col: str = "text",
         keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with ``keep_ids`` its ``ids``."""
    run, schema = _pieces(path, limit, closing, keep_ids)
    pieces = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
                         .mapInArrow(run, schema))
    # pieces of one length are numbered within each partition of the written table, and partitions one after another
    parted = pieces.withColumn("part", F.spark_partition_id())
    sizes = parted.groupBy("length", "part").agg(F.count("*").alias("n"))
    per_length = sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(limit + 1, np.int64)
    for r in per_length:
        counts[r.length] = r.n
    places = _places(plan(counts, limit))
    # where each part of a length begins: one row for a length and a partition
    begins = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("begin"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = (parted.withColumn("_r", rank).join(begins, ["length", "part"]).withColumn("_r", F.col("_r") + F.col("begin"))
              .drop("part", "begin"))

    def place(batches):
        for batch in batches:
            lengths, ranks = batch.column(3).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            for chunk in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(chunk):
                    first, sequences, offsets = places[int(lengths[chunk[0]])]
                    at = np.searchsorted(first, ranks[chunk], "right") - 1
                    sequence[chunk] = sequences[at] + ranks[chunk] - first[at]
                    offset[chunk] = offsets[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                                             names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "ids": "array<int>"}
    out = ", ".join(f"{n} {kinds[n]}" for n in names)
    return ranked.select(*names, "_r").mapInArrow(place, f"{out}, sequence_id long, offset long")
