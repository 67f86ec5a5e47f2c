"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

The probability of a token is that of its class given the words before it, times
that of the token in its class. The class factor is a maximum-entropy model: the
weights of hashed features (the last word, the last two classes, the words two and
three places back) are summed for each class and normalised. The token factor is
the class's own smoothed unigram, the closed form of a model with one feature per
token. Probabilities of all tokens, an unseen one in each class included, add up
to one.

Counting: one pass gives the count of every token, and how often words of each
ending follow words of each hash; endings that follow alike form a class, and the
most frequent tokens have classes of their own. Training: each task runs through
its share of all training texts in mini-batches, starting from zero, and returns
its weights, which are averaged by how often each was used. Scoring: numpy
batches. Tasks are given the counts of the ``TABLE`` most frequent tokens at most;
the others' are joined by token, exactly.

Cases: null and empty texts are one end token; repeated rows score alike; rows
with a null id are scored, are not held out and teach nothing; without training
texts every token is unknown; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnoscope.llm.common import LOWER, list_array, materialise, mix, prefix_hash, signed, span_hash, text_slices, word_spans

#: Endings (hash of a word's last three bytes) and hashes of the word before, for classes.
ENDINGS, BEFORE = 1024, 64
#: Classes of endings, and of single frequent tokens.
GROUPS, SINGLES = 22, 10
CLASSES = GROUPS + SINGLES
#: Rows of weights: the last word, two classes, the words two and three back.
LAST, SKIP = 1 << 13, 1 << 12
PAIRS = (CLASSES + 1) ** 2
ROWS = LAST + PAIRS + 2 * SKIP + 1
TABLE = 1 << 19
ALPHA = 0.1
BATCH, RATE = 8192, 0.5
CHUNKS = 16
END = np.uint64(0x51ED270B7F4A7C00)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows, each with its end token, and the index of each row's first. The low bits hold the ending."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    running = prefix_hash(data)
    tail = span_hash(running, np.maximum(starts, ends - 3), ends) % np.uint64(ENDINGS)
    words = (span_hash(running, starts, ends) & ~np.uint64(ENDINGS - 1)) | tail
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    out = np.full(len(words) + len(n), END, np.uint64)
    out[np.arange(len(words)) + rows] = words
    return out, first + np.arange(len(first))


def _before(ids: np.ndarray, first: np.ndarray, back: int) -> np.ndarray:
    """The id ``back`` places before each token in its row; 0 before the row."""
    out = np.zeros_like(ids)
    out[back:] = ids[:-back] if len(ids) > back else ids[:0]
    place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
    out[place < back] = 0
    return out


def _count(batches):
    """Texts to counts of tokens (kind 0) and of pairs (word before, ending) (kind 1)."""
    for batch in batches:
        ids, pairs = [np.zeros(0, np.uint64)], np.zeros(ENDINGS * BEFORE, np.int64)
        counts = [np.zeros(0, np.int64)]
        for _, _, data, offsets in text_slices(batch.column(0)):
            t, first = tokens(data, offsets)
            u, c = np.unique(t, return_counts=True)
            ids.append(u)
            counts.append(c)
            cell = (mix(_before(t, first, 1), 9) % np.uint64(BEFORE)) * np.uint64(ENDINGS) + t % np.uint64(ENDINGS)
            pairs += np.bincount(cell[t != END].astype(np.int64), minlength=len(pairs))
        u, back = np.unique(np.concatenate(ids), return_inverse=True)
        c = np.bincount(back, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)
        cells = np.flatnonzero(pairs)
        for kind, key, n in ((0, signed(u), c), (1, cells, pairs[cells])):
            for lo in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key[lo:lo + (1 << 16)]), kind, np.int8)), pa.array(key[lo:lo + (1 << 16)]),
                     pa.array(n[lo:lo + (1 << 16)])], names=["kind", "key", "n"])


def ending_classes(pairs: np.ndarray) -> np.ndarray:
    """Class of each ending by k-means on square roots of what comes before, weighted by frequency."""
    weight = pairs.sum(axis=0)
    x = np.sqrt(pairs.T / np.maximum(weight, 1)[:, None])
    order = np.argsort(-weight, kind="stable")
    centres = [x[order[0]]]
    far = np.full(len(x), np.inf)
    for _ in range(GROUPS - 1):
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
        centres.append(x[np.argmax(far * weight)])
    centre = np.array(centres)
    for _ in range(25):
        label = np.argmin(((x[:, None, :] - centre[None]) ** 2).sum(axis=2), axis=1)
        for g in range(GROUPS):
            w = weight * (label == g)
            if w.sum():
                centre[g] = (x * w[:, None]).sum(axis=0) / w.sum()
    return label.astype(np.int64)


@dataclass
class LanguageModel:
    """What tasks are given: bounded tables, whatever the corpus."""

    total: int
    distinct: int
    frequent: np.ndarray
    frequent_count: np.ndarray
    group: np.ndarray
    singles: np.ndarray
    class_total: np.ndarray
    class_distinct: np.ndarray
    weights: np.ndarray

    def classes(self, ids: np.ndarray) -> np.ndarray:
        out = self.group[(ids % np.uint64(ENDINGS)).astype(np.int64)]
        place = np.minimum(np.searchsorted(self.singles, ids), len(self.singles) - 1)
        single = self.singles[place] == ids
        out[single] = GROUPS + place[single]
        return out

    def rows(self, ids: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Weight rows of each token's features."""
        one, two, three = (_before(ids, first, k) for k in (1, 2, 3))
        c1, c2 = (np.where(w == 0, CLASSES, _shift(classes, k)) for w, k in ((one, 1), (two, 2)))
        out = np.empty((len(ids), 5), np.int32)
        out[:, 0] = mix(one, 31) % np.uint64(LAST)
        out[:, 1] = LAST + c1 * (CLASSES + 1) + c2
        out[:, 2] = LAST + PAIRS + (mix(two, 32) % np.uint64(SKIP)).astype(np.int64)
        out[:, 3] = LAST + PAIRS + SKIP + (mix(three, 33) % np.uint64(SKIP)).astype(np.int64)
        out[:, 4] = ROWS - 1
        return out


def _shift(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[k:] = x[:-k] if len(x) > k else x[:0]
    return out


def _logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights[rows[:, 0]]
    for k in range(1, rows.shape[1] - 1):
        z = z + weights[rows[:, k]]
    z += weights[rows[0, -1]]
    z -= z.max(axis=1, keepdims=True)
    return z


def _train(model: LanguageModel):
    """Texts to this task's weights, in chunks, each with how often its rows were used."""
    def run(batches):
        weights = np.zeros((ROWS, CLASSES), np.float32)
        gathered = np.full(ROWS, 1e-3, np.float32)
        used = np.zeros(ROWS, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                ids, first = tokens(data, offsets)
                classes = model.classes(ids)
                every = model.rows(ids, first, classes)
                for lo in range(0, len(ids), BATCH):
                    rows, target = every[lo:lo + BATCH], classes[lo:lo + BATCH]
                    p = np.exp(_logits(weights, rows))
                    p /= p.sum(axis=1, keepdims=True)
                    p[np.arange(len(p)), target] -= 1
                    for k in range(rows.shape[1]):
                        order = np.argsort(rows[:, k], kind="stable")
                        row = rows[order, k]
                        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                        row, n = row[begin], np.diff(np.append(begin, len(order)))
                        step = np.add.reduceat(p[order], begin, axis=0) / np.sqrt(n)[:, None].astype(np.float32)
                        gathered[row] += (step ** 2).mean(axis=1)
                        weights[row] -= RATE * step / np.sqrt(gathered[row])[:, None] / np.float32(rows.shape[1] ** 0.5)
                        used[row] += n
        if used.any():
            size = -(-ROWS // CHUNKS)
            yield pd.DataFrame({
                "chunk": range(CHUNKS), "weights": [weights[k * size:(k + 1) * size].astype(np.float16).tobytes() for k in range(CHUNKS)],
                "used": [used[k * size:(k + 1) * size].astype(np.int64).tobytes() for k in range(CHUNKS)]})

    def run_arrow(batches):
        for frame in run(batches):
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return run_arrow, "chunk long, weights binary, used binary"


def _average(frames):
    """Tasks' chunks, one after another, to the average of each chunk, weighted by use."""
    sums: dict[int, list[np.ndarray]] = {}
    for frame in frames:
        for chunk, weights, used in zip(frame.chunk, frame.weights, frame.used, strict=True):
            n = np.frombuffer(used, np.int64).astype(np.float64)
            w = np.frombuffer(weights, np.float16).astype(np.float64).reshape(len(n), CLASSES) * n[:, None]
            if chunk in sums:
                sums[chunk][0] += w
                sums[chunk][1] += n
            else:
                sums[chunk] = [w, n]
    yield pd.DataFrame({"chunk": list(sums), "weights": [(w / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes() for w, n in sums.values()]})


def fit(texts: DataFrame) -> tuple[LanguageModel, DataFrame]:
    """The model of a table with one text column, and the counts (token, n) of all its tokens."""
    counted = materialise(texts.mapInArrow(_count, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    counts = counted.where("kind = 0").select(F.col("key").alias("token"), "n")
    per_ending = counts.groupBy(F.pmod("token", F.lit(ENDINGS)).alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    total, distinct = sum(r.n for r in per_ending), sum(r.v for r in per_ending)
    pairs = np.zeros(ENDINGS * BEFORE, np.float64)
    cells = counted.where("kind = 1").select("key", "n").toPandas()  # at most ENDINGS * BEFORE rows
    pairs[cells.key.to_numpy(np.int64)] = cells.n
    group = ending_classes(pairs.reshape(BEFORE, ENDINGS))
    top = counts.orderBy(F.desc("n"), "token").limit(SINGLES).collect()
    singles = np.sort(np.array([r.token for r in top] + [0] * (SINGLES - len(top)), np.int64).view(np.uint64))
    level = F.floor(F.log2("n")).cast("int")
    room, least = TABLE, 63
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r.level
    table = counts.where(level >= least).toPandas()
    token = table.token.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    class_total, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per_ending:
        class_total[group[r.e]] += r.n
        class_distinct[group[r.e]] += r.v
    model = LanguageModel(total, distinct, token[order], table.n.to_numpy(np.int64)[order], group, singles,
                          class_total, class_distinct, np.zeros((ROWS, CLASSES), np.float32))
    for r in top:
        own = np.array([r.token], np.int64).view(np.uint64)
        home, single = group[int(own[0] % np.uint64(ENDINGS))], int(model.classes(own)[0])
        class_total[home] -= r.n
        class_distinct[home] -= 1
        class_total[single] += r.n
        class_distinct[single] += 1
    chunks = (texts.mapInArrow(*_train(model)).repartition(CHUNKS, "chunk")
              .mapInPandas(_average, "chunk long, weights binary").collect())
    size = -(-ROWS // CHUNKS)
    for r in chunks:
        part = np.frombuffer(r.weights, np.float32).reshape(-1, CLASSES)
        model.weights[r.chunk * size:r.chunk * size + len(part)] = part
    return model, counts


def _score(model: LanguageModel, id_type: str):
    """(row, id, text) to sums over known frequent tokens, class factors, and the tokens whose counts are to be joined."""
    base = np.log10(model.total + ALPHA * (model.distinct + 1))
    own = np.log10(np.maximum(model.class_total + ALPHA * (model.class_distinct + 1), ALPHA))
    lift = np.log10(model.frequent_count + ALPHA)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                ids, first = tokens(data, offsets)
                n, rows = np.diff(first), np.repeat(np.arange(hi - lo), np.diff(first))
                unique, back = np.unique(ids, return_inverse=True)
                place = np.minimum(np.searchsorted(model.frequent, unique), max(len(model.frequent) - 1, 0))
                hit = model.frequent[place] == unique if len(model.frequent) else np.zeros(len(unique), bool)
                value = np.where(hit, lift[place], 0.0) if len(lift) else np.zeros(len(unique))
                hit, value = hit[back], value[back]
                classes = model.classes(ids)
                features = model.rows(ids, first, classes)
                factor = np.empty(len(ids))
                for b in range(0, len(ids), BATCH):
                    z = _logits(model.weights, features[b:b + BATCH])
                    target = z[np.arange(len(z)), classes[b:b + BATCH]]
                    factor[b:b + BATCH] = (target - np.log(np.exp(z).sum(axis=1))) / np.log(10)
                add = lambda x: np.bincount(rows, weights=x, minlength=hi - lo)
                rare = np.flatnonzero(~hit)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(add(hit).astype(np.int64)),
                     pa.array(add(value) - n * base), pa.array(add(factor + value - own[classes])),
                     list_array(signed(ids[rare]), np.bincount(rows[rare], minlength=hi - lo))],
                    names=["row", "id", "n_tokens", "n_known", "base_score", "score", "rare"])

    return run, f"row long, id {id_type}, n_tokens long, n_known long, base_score double, score double, rare array<long>"


def score(docs: DataFrame, model: LanguageModel, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score and score (log10 probability).

    Rows are numbered once, with their ids; only the stored numbers are used.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = materialise(numbered.mapInArrow(*_score(model, docs.schema[id_col].dataType.simpleString())))
    # only tokens that are not in the given table move
    rare = scored.select("row", F.explode("rare").alias("token")).groupBy("row", "token").agg(F.count("*").alias("k"))
    joined = (rare.join(counts, "token", "left")
              .groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("lift"),
                                  F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("known")))
    zero = F.lit(0)
    return (scored.drop("rare").join(joined, "row", "left")
            .select(F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("known", zero)).alias("n_known"),
                    F.lit(model.total).cast("long").alias("train_tokens"),
                    (F.col("base_score") + F.coalesce("lift", zero)).alias("base_score"),
                    (F.col("score") + F.coalesce("lift", zero)).alias("score")))
