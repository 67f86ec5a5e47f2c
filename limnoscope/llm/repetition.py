"""Quality rules on repetition, from suffix arrays of a text's words.

Suffixes of words are sorted by doubling ranks, within each text; the ranks of all
depths give the common prefix of neighbours in the sorted order. A position's
longest repeat is the longer of the prefixes it shares with its two neighbours:
the deepest interval of common prefixes that holds it. Those of at least
``min_words`` words that cannot be extended to the left are the maximal repeats;
their spans are united. A text is kept if the union covers at most
``max_fraction`` of its words and no repeat is longer than ``max_longest`` words,
or shorter than ``min_words``.

Cases: null and empty texts have no words, fail the base rule and are not kept;
a text that is one word over and over is one long repeat; repeated rows are
judged alike (only repeats within a text count); a null id keeps its row; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnoscope.llm.common import list_array, merge_spans, prefix_hash, span_hash, text_slices, word_spans

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def suffix_ranks(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Ranks of the next 1, 2, 4, ... words at each place, until no two are equal; a window that leaves its text equals none."""
    n = len(words)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][rows]
    at = np.arange(n)
    order = np.lexsort((words, rows))
    new = np.ones(n, bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    out, height = [rank], 1
    while not new.all():
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        place = order[tied]
        # a window over the end sorts before all others; its place makes it unlike any
        far = place + height
        inside = far < end[place]
        second = np.where(inside, rank[np.minimum(far, n - 1)] + n, n - 1 - place + first[rows[place]])
        by = np.lexsort((second, rank[place]))
        place, second = place[by], second[by]
        head = rank[place]
        begins = np.ones(len(tied), bool)
        begins[1:] = (head[1:] != head[:-1]) | (second[1:] != second[:-1])
        order, new, rank = order.copy(), new.copy(), rank.copy()
        order[tied] = place
        new[tied] = begins
        rank[place] = tied[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
        out.append(rank)
        height *= 2
    return out if at.size else [rank]


def longest_repeats(ranks: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Longest string at each place that begins at another place of the same text too."""
    n = len(end)
    order = np.empty(n, np.int64)
    order[ranks[-1]] = np.arange(n)
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for depth in range(len(ranks) - 1, -1, -1):
        rank, size = ranks[depth], 1 << depth
        x, y = a + common, b + common
        inside = (x + size <= end[a]) & (y + size <= end[b])
        inside[inside] = rank[x[inside]] == rank[y[inside]]
        common[inside] += size
    longest = np.zeros(n, np.int64)
    longest[b] = common
    longest[a] = np.maximum(longest[a], common)
    return longest


def _union(starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans within each row: row, first word and end, counted from the row's first word."""
    # one place more for each text, so that spans of different texts never touch
    row = rows[starts]
    a, b = merge_spans(starts + row, ends + row)
    base = first[:-1] + np.arange(len(first) - 1)
    row = np.searchsorted(base, a, "right") - 1
    return row, a - base[row], b - base[row]


def _measure(min_words: int, base_window: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                n_rows = hi - lo
                starts, ends, first = word_spans(data, offsets)
                n = np.diff(first)
                running = prefix_hash(data)
                words = span_hash(running, starts, ends)
                rows = np.repeat(np.arange(n_rows), n)
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                chars = np.concatenate(([0], np.cumsum(points[ends] - points[starts])))[first]
                marks = np.concatenate(([0], np.cumsum(SYMBOLS[data])))[offsets]
                # lines: cut at every newline and at every text
                breaks = np.flatnonzero(data == 10)
                line_start = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], breaks + 1)))
                line_start = line_start[line_start < len(data)]
                line_row = np.searchsorted(offsets, line_start, "right") - 1
                line_end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, line_start)], offsets[line_row + 1])
                has = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
                line_start, line_end, line_row = line_start[has], line_end[has], line_row[has]
                line_hash = span_hash(running, line_start, line_end) + (line_end - line_start).astype(np.uint64)
                order = np.lexsort((line_hash, line_row))
                same = np.zeros(len(order), bool)
                h, r = line_hash[order], line_row[order]
                same[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
                dup_lines = np.bincount(r[same], minlength=n_rows)
                counts = [np.zeros(n_rows, np.int64) for _ in range(3)]
                of = a = b = np.zeros(0, np.int64)
                if len(words):
                    repeats = longest_repeats(suffix_ranks(words, first), first[1:][rows])
                    at = np.flatnonzero(repeats >= base_window)
                    of, a, b = _union(at, at + base_window, rows, first)
                    np.add.at(counts[0], of, b - a)
                    # maximal to the left: the place before is not inside a repeat one word longer
                    wide = repeats >= min_words
                    wide[1:] &= ~((repeats[:-1] == repeats[1:] + 1) & (rows[:-1] == rows[1:]))
                    at = np.flatnonzero(wide)
                    of, a, b = _union(at, at + repeats[at], rows, first)
                    np.add.at(counts[1], of, b - a)
                    np.maximum.at(counts[2], rows[at], repeats[at])
                sizes = np.bincount(of, minlength=n_rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n_rows), *[pa.array(c.astype(np.int64)) for c in (
                        n, np.diff(chars), np.diff(marks), dup_lines, *counts)],
                     list_array(a, sizes), list_array(b, sizes)],
                    names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered",
                           "longest_repeat", "span_from", "span_to"])

    return run, ("id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, "
                 "longest_repeat long, span_from array<long>, span_to array<long>")


def repetition_rules(docs: DataFrame, min_words: int = 4, max_fraction: float = 0.3, max_longest: int = 64,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``kept`` and the words ``span_from``, ``span_to`` of repeats.

    The base rule fails below 20 words, or where windows of eight words found
    twice hold more than 30 per cent of the words.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    good = (F.col("n_covered") <= max_fraction * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return (rows.mapInArrow(*_measure(min_words, 8))
            .withColumn("base_failed", base).withColumn("kept", ~base & good).withColumnRenamed("id", id_col))
