"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Two words are alike by the subsequences of four characters they share. A
subsequence may have gaps: it weighs ``DECAY`` for each character it spans and
spans seven at most, so insults with inserted or missing characters still match
("idxiot", "id.iot"). Punctuation inside words is dropped and word ends count as
characters. A sentence is as toxic as its worst word, a text as its worst sentences.

Fitting takes a bounded sample of labelled texts (``class_rows`` of each label,
by hash of the id). A sentence stands for its worst word. Every sentence of a clean
text is a counter-example; of a toxic text it is only known that some sentence is
toxic, so the machine finds out which: the first guess of each toxic text are its
words with the largest log-odds, and each round then takes, from all words of all
sentences, those that the last machine finds worst (toxic texts) or nearly toxic
(clean texts). No list of words gates the examples. Examples with a letter put in
are examples too. Landmarks are chosen among the
guesses and among clean words by k-means++ seeding on kernel distances; the kernel
to them, whitened, is the feature space of a squared-hinge machine. Because each
kernel is a sum over subsequences, the machine is one table of a weight per
subsequence (2**20 entries, fixed), which is all that scoring tasks are given. A
logistic curve over a text's worst words, fitted on the sample's texts with the
labels' real shares, gives the score.

Cases: null and empty texts score as texts without words; repeated rows score
alike; labels that are null, or whose id is null, are left out, and an id with
both labels counts as toxic; without labels of both kinds every score is the
share of toxic labels (0 without any). Only the text is an input of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnoscope.llm.common import LOWER, WORD_BYTES, materialise, prefix_hash, release_memory, signed, span_hash, text_slices, word_spans

LENGTH, SPAN, DECAY = 4, 7, 0.6
#: Offsets of a subsequence's later characters, and its weight.
PATTERNS = [(a, b, c, DECAY ** (c + 1)) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]
#: Five-bit character classes: 0 word end, a-z, 27 digits, 28 first and 29-31 further bytes of other characters; 255 is dropped.
CODES = np.full(256, 255, np.uint8)
CODES[97:123] = np.arange(1, 27)
CODES[48:58] = 27
CODES[192:] = 28
CODES[128:192] = 29 + np.arange(64) % 3
STOPS = np.zeros(256, bool)
STOPS[[10, 33, 46, 63]] = True

CLASS_ROWS = 5000
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 160, 64
#: Clean words that the first machine sees: the most frequent ones, and others by hash.
FREQUENT_WORDS, OTHER_WORDS = 1000, 4000
#: Words of a toxic text that are guessed at first.
GUESSES = 4
#: Rounds of choosing examples, and words that a text of the sample gives at most.
ROUNDS, TOXIC_WORDS, CLEAN_WORDS = 3, 8, 4
#: Copies of an example with a letter put in that the machine sees too, and letters such an example has at least.
SPOILT, MIN_SPOILT = 3, 5
#: Words whose features are worked out in one step.
STEP_WORDS = 256
FEATURES = 6


# ---------------------------------------------------------------- words as numbers

def _coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character classes of the words between word-end marks, the word of each entry, entries of each word."""
    sizes = ends - starts
    total = np.cumsum(sizes)
    at = np.arange(total[-1] if len(total) else 0) + np.repeat(starts - total + sizes, sizes)
    codes = CODES[LOWER[data[at]]]
    word = np.repeat(np.arange(len(starts)), sizes)
    keep = codes != 255
    codes, word = codes[keep], word[keep]
    kept = np.bincount(word, minlength=len(starts))
    out = np.zeros(len(codes) + 2 * len(starts), np.int32)
    before = np.cumsum(kept + 2) - kept - 2
    out[np.arange(len(codes)) - (np.cumsum(kept) - kept)[word] + before[word] + 1] = codes
    return out, np.repeat(np.arange(len(starts)), kept + 2), kept + 2


def _lengths_norm(sizes: np.ndarray) -> np.ndarray:
    """Square root of the summed squared weights of a word's subsequences; 1 where there is none."""
    total = np.zeros(len(sizes))
    for _, _, c, weight in PATTERNS:
        total += np.maximum(sizes - c, 0) * weight ** 2
    return np.sqrt(np.where(total > 0, total, 1.0))


def subsequences(word: bytes) -> dict[int, float]:
    """Weight of each subsequence of a word, normalised by the word's length."""
    data = np.frombuffer(word, np.uint8)
    codes, _, sizes = _coded(data, np.zeros(1, np.int64), np.full(1, len(data)))
    norm = _lengths_norm(sizes)[0]
    out: dict[int, float] = {}
    for a, b, c, weight in PATTERNS:
        for i in range(len(codes) - c):
            key = int(codes[i]) << 15 | int(codes[i + a]) << 10 | int(codes[i + b]) << 5 | int(codes[i + c])
            out[key] = out.get(key, 0.0) + weight / norm
    return out


def kernel(x: bytes, y: bytes) -> float:
    u, v = subsequences(x), subsequences(y)
    return sum(w * v.get(k, 0.0) for k, w in u.items())


def word_margins(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's margin of each word."""
    codes, word, sizes = _coded(data, starts, ends)
    n = len(codes)
    total = np.zeros(n, np.float32)
    for a, b, c, weight in PATTERNS:
        m = n - c
        if m <= 0:
            continue
        key = (codes[:m] << 15) | (codes[a:a + m] << 10) | (codes[b:b + m] << 5) | codes[c:]
        total[:m] += np.where(word[:m] == word[c:], table[key] * np.float32(weight), 0)
    sums = np.concatenate(([0.0], np.cumsum(total, dtype=np.float64)))
    last = np.cumsum(sizes)
    return (sums[last] - sums[last - sizes]) / _lengths_norm(sizes) + bias


def text_features(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """Features of each text: its three worst words, the number of sentences over the margin, of words over it, of words."""
    starts, ends, first = word_spans(data, offsets)
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    hashes = span_hash(prefix_hash(LOWER[data]), starts, ends)
    _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
    margin = word_margins(data, starts[one], ends[one], table, bias)[back]
    out = np.zeros((len(n), FEATURES))
    order = np.lexsort((-margin, rows))
    ranked = margin[order]
    for k in range(3):
        out[:, k] = -1.0
        has = n > k
        out[has, k] = np.clip(ranked[first[:-1][has] + k], -1.0, 3.0)
    over = margin > 0
    sentence = np.cumsum(STOPS[data])[starts[over]] if len(starts) else np.zeros(0, np.int64)
    pairs = np.unique(rows[over] * (len(data) + 1) + sentence) // (len(data) + 1)
    out[:, 3] = np.log1p(np.bincount(pairs.astype(np.int64), minlength=len(n)))
    out[:, 4] = np.log1p(np.bincount(rows[over], minlength=len(n)))
    out[:, 5] = np.log1p(n) / 4
    return out


# ---------------------------------------------------------------- fitting

@dataclass
class ToxicityModel:
    """Weights of subsequences, the machine's bias, and the logistic curve; ``share`` alone if there is nothing to learn."""

    share: float
    table: np.ndarray | None = None
    bias: float = 0.0
    curve: np.ndarray | None = None

    def score(self, docs: DataFrame, text_col: str = "text", score_col: str = "score") -> DataFrame:
        """``docs`` with the column ``score_col``, from 0 to 1."""
        if self.table is None:
            return docs.withColumn(score_col, F.lit(float(self.share)))
        table, bias, curve, at = self.table, self.bias, self.curve, docs.columns.index(text_col)

        def run(batches):
            for batch in batches:
                parts = [np.zeros(0)]
                for _, _, data, offsets in text_slices(batch.column(at)):
                    x = text_features(data, offsets, table, bias)
                    parts.append(1 / (1 + np.exp(-np.clip(x @ curve[1:] + curve[0], -30, 30))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts))],
                                                 names=[*batch.schema.names, score_col])

        return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


_DROP = bytes(i for i in range(256) if CODES[LOWER[i]] == 255)


def _plain(raw: bytes) -> str:
    """A lower-cased word without punctuation."""
    return raw.translate(None, _DROP).decode("utf-8", "ignore")


def _words(frames):
    """Texts to their different words."""
    for frame in frames:
        found = []
        for text in frame.text:
            raw = bytes(LOWER[np.frombuffer((text or "").encode("utf-8", "ignore"), np.uint8)])
            found.append(sorted({_plain(w) for w in WORD_BYTES.findall(raw)} - {""}))
        yield pd.DataFrame({"node": frame.node, "toxic": frame.toxic, "words": found})


def _witnesses(table: np.ndarray, bias: float):
    """Texts to examples: the worst words of a toxic text's sentences, those of a clean text that are near the margin."""
    def run(frames):
        for frame in frames:
            out = []
            for text, toxic in zip(frame.text, frame.toxic, strict=True):
                data = LOWER[np.frombuffer((text or "").encode("utf-8", "ignore"), np.uint8)]
                starts, ends, _ = word_spans(data, np.array([0, len(data)]))
                if not len(starts):
                    continue
                _, one, back = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
                margin = word_margins(data, starts[one], ends[one], table, bias)[back]
                sentence = np.cumsum(STOPS[data])[starts]
                order = np.lexsort((-margin, sentence))
                new = np.ones(len(order), bool)
                new[1:] = sentence[order[1:]] != sentence[order[:-1]]
                worst = order[new]
                worst = worst[np.argsort(-margin[worst], kind="stable")]
                near = int((margin[worst] > (0 if toxic else -1)).sum())
                words = {}
                for i in worst[:max(near, int(toxic))].tolist():
                    words.setdefault(_plain(data[starts[i]:ends[i]].tobytes()), margin[i])
                    if len(words) == (TOXIC_WORDS if toxic else CLEAN_WORDS):
                        break
                out += [(int(toxic), w) for w in words if w]
            yield pd.DataFrame(out, columns=["toxic", "word"])

    return run


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the bias of a squared-hinge machine, by Newton steps on its margin violators."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-3)
    for _ in range(30):
        inside = y * (z @ w) < 1
        a = z[inside] * cost[inside, None]
        new = np.linalg.solve(z[inside].T @ a + np.diag(penalty), a.T @ y[inside])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Bias and weights of a logistic regression, by Newton steps."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    penalty = np.append(1e-6, np.full(x.shape[1], ridge)) * weight.sum() / len(weight)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((z * h[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (p - y)) + penalty * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _joined(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of words one after the other, starts and ends."""
    raw = [w.encode() for w in words]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, ends[:-1]).astype(np.int64)[:len(raw)], ends


def _table(word: str) -> np.ndarray:
    """The subsequences of one word as a table of weights."""
    table = np.zeros(1 << 20, np.float32)
    parts = subsequences(word.encode())
    table[list(parts)] = list(parts.values())
    return table


def landmarks(words: list[str], weights: np.ndarray, n: int, seed: int) -> list[str]:
    """``n`` of the words, each drawn by weight times the squared kernel distance to those drawn before."""
    rng = np.random.default_rng(seed)
    data, starts, ends = _joined(words)
    own = np.fromiter((sum(v * v for v in subsequences(w.encode()).values()) for w in words), float, len(words))
    far, chosen = np.full(len(words), np.inf), []
    for _ in range(min(n, len(words))):
        gain = weights * (own if not chosen else far)
        gain[chosen] = 0.0
        if not gain.sum() > 0:
            break
        at = int(rng.choice(len(words), p=gain / gain.sum()))
        chosen.append(at)
        near = word_margins(data, starts, ends, _table(words[at]), 0.0)
        far = np.minimum(far, np.maximum(own + own[at] - 2 * near, 0.0))
    return [words[i] for i in chosen]


class Landmarks:
    """Whitened kernel features of words to a few landmark words."""

    def __init__(self, marks: list[str]):
        parts = [subsequences(w.encode()) for w in marks]
        self.keys = np.unique(np.fromiter((k for p in parts for k in p), np.int64))
        self.grid = np.zeros((len(self.keys), len(marks)), np.float32)
        for j, p in enumerate(parts):
            self.grid[np.searchsorted(self.keys, list(p)), j] = list(p.values())
        spread, turn = np.linalg.eigh((self.grid.T @ self.grid).astype(float))
        good = spread > 1e-5 * spread[-1]
        self.whiten = turn[:, good] / np.sqrt(spread[good])
        self.slot = np.full(1 << 20, -1, np.int32)
        self.slot[self.keys] = np.arange(len(self.keys))

    def features(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.whiten.shape[1]), np.float32)
        for lo in range(0, len(words), STEP_WORDS):
            part = words[lo:lo + STEP_WORDS]
            codes, word, sizes = _coded(*_joined(part))
            rows, of, weights = [], [], []
            for a, b, c, weight in PATTERNS:
                m = max(len(codes) - c, 0)
                key = (codes[:m] << 15) | (codes[a:a + m] << 10) | (codes[b:b + m] << 5) | codes[c:c + m]
                hit = (word[:m] == word[c:c + m]) & (self.slot[key] >= 0)
                rows.append(self.slot[key[hit]])
                of.append(word[:m][hit])
                weights.append(np.full(int(hit.sum()), weight))
            rows, of, weights = np.concatenate(rows), np.concatenate(of), np.concatenate(weights)
            order = np.argsort(of, kind="stable")
            first = np.flatnonzero(np.diff(of[order], prepend=-1))
            if len(first):
                got = np.add.reduceat(self.grid[rows[order]] * weights[order, None].astype(np.float32), first, axis=0)
                out[lo + of[order[first]]] = got @ self.whiten / _lengths_norm(sizes)[of[order[first]], None]
        return out

    def table(self, weights: np.ndarray) -> np.ndarray:
        """Weights of features as weights of subsequences."""
        table = np.zeros(1 << 20, np.float32)
        table[self.keys] = self.grid @ (self.whiten @ weights)
        return table


def _spoilt(words: dict[str, int]) -> dict[str, float]:
    """Words of five letters or more, each with one letter put in at a place of its own, at a quarter of the weight."""
    rng = np.random.default_rng(3)
    out: dict[str, float] = {}
    for word, n in words.items():
        if len(word) >= MIN_SPOILT and n > 1:
            for at in rng.permutation(np.arange(1, len(word)))[:SPOILT].tolist():
                letter = chr(97 + int(rng.integers(26)))
                out[word[:at] + letter + word[at:]] = n / (4.0 * SPOILT)
    return out


def _fit_machine(space: Landmarks, bad: dict[str, int], fine: dict[str, int]) -> tuple[np.ndarray, float]:
    """Table of subsequence weights and bias, from example words and the number of texts that give them."""
    odd = _spoilt(bad)
    words = [*bad, *odd, *fine]
    y = np.repeat([1.0, 1.0, -1.0], [len(bad), len(odd), len(fine)])
    cost = 4.0 * np.log2(1.0 + np.array([*bad.values(), *odd.values(), *fine.values()], float))
    w = _machine(space.features(words), y, cost)
    return space.table(w[:-1]), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, class_rows: int = CLASS_ROWS, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learns from at most ``class_rows`` labelled texts of each label; ``labels`` has ``id_col`` and ``label_col`` (0 or 1)."""
    marked = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic"))
              .where("_id is not null and toxic in (0, 1)").groupBy("_id").agg(F.max("toxic").alias("toxic")))
    counts = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return ToxicityModel(share)
    chosen = None
    for label in (0, 1):
        part = marked.where(F.col("toxic") == label).orderBy(F.xxhash64("_id"), "_id").limit(class_rows)
        chosen = part if chosen is None else chosen.union(part)
    # at most 2 * class_rows short rows; copies of a text count once
    sample = materialise(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
                         .join(F.broadcast(chosen), "_id").groupBy(F.sha2(F.col("text").cast("binary"), 256))
                         .agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
                         .select(F.monotonically_increasing_id().alias("node"), "text", "toxic"))
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return ToxicityModel(share)
    words = materialise(sample.mapInPandas(_words, "node long, toxic int, words array<string>")
                        .select("node", "toxic", F.explode("words").alias("word")))
    counts = materialise(words.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("fine"))
                         .withColumn("odds", F.log((F.col("bad") + 0.5) / (n[1] + 1.0)) - F.log((F.col("fine") + 0.5) / (n[0] + 1.0))))
    best = W.partitionBy("node").orderBy(F.desc("odds"), "word")
    guesses = (words.where("toxic = 1").join(counts, "word").withColumn("place", F.row_number().over(best))
               .where(F.col("place") <= GUESSES).groupBy("word").agg(F.count("*").alias("count"), F.min("place").alias("place"))
               .where("place = 1 or count > 1").orderBy("word").collect())
    bad = {r.word: r["count"] for r in guesses}
    clean = counts.where("fine > 0 and odds < 0.3").select("word", "fine")
    fine = {r.word: r.fine for part in (clean.orderBy(F.desc("fine"), "word").limit(FREQUENT_WORDS),
                                        clean.orderBy(F.xxhash64("word"), "word").limit(OTHER_WORDS))
            for r in part.collect()}
    if not bad or not fine:
        return ToxicityModel(share)
    space = Landmarks(landmarks(list(bad), np.array(list(bad.values()), float), TOXIC_LANDMARKS, 1)
                      + landmarks(list(fine), np.log2(1.0 + np.array(list(fine.values()), float)), CLEAN_LANDMARKS, 2))
    table, bias = _fit_machine(space, bad, fine)
    for _ in range(ROUNDS):
        got = (sample.select("text", "toxic").mapInPandas(_witnesses(table, bias), "toxic int, word string")
               .groupBy("toxic", "word").count().orderBy("toxic", "word").collect())
        bad = {r.word: r["count"] for r in got if r.toxic}
        for r in got:
            if not r.toxic:  # what was a counter-example once stays one
                fine[r.word] = max(fine.get(r.word, 0), r["count"])
        table, bias = _fit_machine(space, bad, fine)
    del space, got
    release_memory()

    def featured(batches):
        for batch in batches:
            parts = [text_features(data, offsets, table, bias) for _, _, data, offsets in text_slices(batch.column(0))]
            x = np.vstack(parts) if parts else np.zeros((0, FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    got = sample.select("text", "toxic").mapInArrow(featured, "x array<double>, toxic int").collect()
    x, y = np.array([r.x for r in got]), np.array([r.toxic for r in got], float)
    real = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    curve = _logistic(x, y, real)
    del got, x
    release_memory()
    return ToxicityModel(share, table, bias, curve)
