"""Word-piece counts by a longest-match automaton that never builds a piece.

The vocabulary is a trie. A node's failure link leads to where matching goes on
when the next symbol has no edge, and its popped count says how many pieces the
greedy longest match has completed on the way. A word is read once, symbol by
symbol, with no step back, so its count takes time in proportion to its bytes.

Pieces are byte strings; one that may only end a word is a symbol string whose
last symbol is the closing form of its byte. Every single byte is a piece in both
forms, so every word can be split. Words are runs of anything but ASCII white
space, in Unicode form C and lower case.

Cases: null and empty texts have no words and no pieces; repeated rows count
alike; a null id keeps its row; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnoscope.llm.common import WORD

#: Words whose counts a task remembers.
CACHE = 1 << 18
CLOSING = 256


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def vocabulary(path: str, suffix: str = "</w>") -> list[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary file as symbols; those with ``suffix`` end a word."""
    with open(path, encoding="utf-8") as file:
        names = json.load(file)["model"]["vocab"]
    letters, out = byte_letters(), []
    for name in names:
        body = name.removesuffix(suffix)
        if body and all(c in letters for c in body):
            symbols = [letters[c] for c in body]
            if body != name:
                symbols[-1] += CLOSING
            out.append(tuple(symbols))
    return out


class Automaton:
    """Trie of the pieces with failure links and popped counts."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        edges: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in [*pieces, *[(b,) for b in range(2 * CLOSING)]]:
            node = 0
            for symbol in piece:
                if symbol not in edges[node]:
                    edges[node][symbol] = len(edges)
                    edges.append({})
                    ends.append(False)
                node = edges[node][symbol]
            ends[node] = True
        fail, pops = [-1] * len(edges), [0] * len(edges)
        level = [0]
        while level:
            following = []
            for parent in level:
                for symbol, node in edges[parent].items():
                    following.append(node)
                    if ends[node]:
                        fail[node], pops[node] = 0, 1
                        continue
                    at, popped = fail[parent], pops[parent]
                    while at >= 0 and symbol not in edges[at]:
                        popped += pops[at]
                        at = fail[at]
                    if at >= 0:
                        fail[node], pops[node] = edges[at][symbol], popped
            level = following
        self.edges, self.fail, self.pops = edges, fail, pops

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest match of one word."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node = total = 0
        for symbol in (*word[:-1], word[-1] + CLOSING) if word else ():
            while symbol not in edges[node]:
                total += pops[node]
                node = fail[node]
            node = edges[node][symbol]
        while node:
            total += pops[node]
            node = fail[node]
        return total


_automata: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _automata:
        _automata[path] = Automaton(vocabulary(path))
    return _automata[path]


def _counts(path: str):
    def run(batches):
        machine = automaton(path)
        cache: dict[str, int] = {}
        for batch in batches:
            n_words, n_tokens = [], []
            for lo in range(0, len(batch.column(1)), 256):
                for text in batch.column(1).slice(lo, 256).to_pylist():
                    words = WORD.findall(unicodedata.normalize("NFC", text).lower()) if text else []
                    total = 0
                    for word in words:
                        n = cache.get(word)
                        if n is None:
                            if len(cache) >= CACHE:
                                cache.clear()
                            n = cache[word] = machine.count(word.encode())
                        total += n
                    n_words.append(len(words))
                    n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(n_words, np.int64)), pa.array(np.array(n_tokens, np.int64))],
                                             names=["id", "n_words", "n_tokens"])

    return run, "id long, n_words long, n_tokens long"


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words and n_tokens under the vocabulary file at ``path``, which tasks read."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(*_counts(path)).withColumnRenamed("id", id_col)
