"""N-gram Jaccard join by prefix filters under several global token orders.

A text's set holds the hashes of its distinct word shingles; two texts of n and m
shingles can reach the similarity t only if they share one of their first
``n - ceil(t n) + 1`` tokens, whatever order all tokens are sorted by, as long as
it is the same order everywhere. That gives one filter for each order, and all of
them must hold:

* order 1 sorts by the number of texts that hold a token, as a level (its
  logarithm), and by hash within a level. So passages that many texts share do
  not join unrelated texts. Its prefixes are the buckets that candidates come from,
  unless what is left of a set from the shared token on is too little;
* orders 2 and 3 sort by the level and by two other hashes, and are tested on
  each candidate pair;
* the pairs left over are verified on the whole sets, in integers; a bound from
  16 bits of each token spares most of them that step.

Texts with equal sets are one class and are compared once. Buckets are not
expanded into all pairs: each member is first compared with the member of one of
its buckets whose own tokens are the most common, the likely original of a group
of near copies. Verified links give components, and only members of one bucket that are
still in different components are compared with each other. A pair left out this
way is already connected, so the components are exact.

Cases: null or empty texts, and texts without words, have no shingles and stay
alone; a text of fewer words than a shingle is one shingle; repeated rows and
equal texts share a component; a null id gets a row and never names a component;
other columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnoscope.llm.common import (connected_components, free_names, gathered, list_array, materialise, mix, signed, text_slices, word_hashes)

#: Counters of texts per token: tokens share a counter by hash, which any order allows. Each task is given one byte
#: for each, 16 MB whatever the input; more counters keep more tokens of large corpora apart.
COUNTERS = 1 << 24
COUNTER_CHUNKS = 64
#: Bits of the filter that picks the texts to verify: 2 MB, given to each task.
FILTER_BITS = 1 << 24
#: Sets of a block in which pairs are compared.
HOME_SETS = 512
#: Pairs, and rows of open buckets, that a task takes.
TASK_PAIRS = 4096
TASK_ROWS = 1 << 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, one row after another, and their number."""
    words, first = word_hashes(data, offsets)
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), np.where(n >= size, n - size + 1, np.minimum(n, 1)))
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(len(n), np.int64)
    begins = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(n)))))[:-1]
    at = first[:-1][rows] + np.arange(len(rows)) - begins[rows]
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    long = n[rows] >= size
    out = np.zeros(len(rows), np.uint64)
    for k in range(size):
        inside = long | (k < n[rows])
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, padded[at + k], np.uint64(0)), k + 1)
    # a row's own number in the key keeps rows apart in one sort
    order = np.lexsort((out, rows))
    out, rows = out[order], rows[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])
    return out[keep], np.bincount(rows[keep], minlength=len(n))


def _fingerprints(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set; -1 and 0 hashes never cancel because each is mixed first."""
    ends = np.cumsum(sizes)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes, 77))))
    other = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes, 78) ^ hashes)))
    a, b = total[ends] - total[ends - sizes], other[ends] - other[ends - sizes]
    return mix(a ^ mix(b + sizes.astype(np.uint64), 5), 6)


def _counters(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes, 31) & np.uint64(COUNTERS - 1)).astype(np.int64)


def _summaries(size: int):
    """Batches of (id, text, row) to (id, row, n_shingles, set_id), and this task's counters in compressed chunks."""
    names = ["_id", "_row", "n_shingles", "set_id", "chunk", "counts"]

    def run(batches):
        counts = np.zeros(COUNTERS, np.uint8)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                hashes, sizes = shingle_sets(data, offsets, size)
                slot, n = np.unique(_counters(hashes), return_counts=True)
                counts[slot] = np.minimum(counts[slot] + n, 255)
                k = hi - lo
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, k), batch.column(2).slice(lo, k), pa.array(sizes.astype(np.int64)),
                    pa.array(signed(_fingerprints(hashes, sizes))), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        parts = counts.reshape(COUNTER_CHUNKS, -1)
        used = [k for k in range(COUNTER_CHUNKS) if parts[k].any()]
        if used:
            none = pa.nulls(len(used), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.array(used, pa.int32()), pa.array([zlib.compress(parts[k].tobytes(), 1) for k in used], pa.binary())],
                names=names)

    return run, "_id long, _row long, n_shingles long, set_id long, chunk int, counts binary"


def _sum_counters(batches):
    """Tasks' chunks, one after another, to the levels of each chunk."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(zlib.decompress(raw), np.uint8)
            if chunk in sums:
                sums[chunk] += counts
            else:
                sums[chunk] = counts.astype(np.int64)
    levels = [np.log2(np.maximum(c, 1)).astype(np.uint8).tobytes() for c in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["chunk", "levels"])


def _levels(summary: DataFrame) -> np.ndarray:
    """The level of each counter: ``COUNTERS`` bytes."""
    out = np.zeros((COUNTER_CHUNKS, COUNTERS // COUNTER_CHUNKS), np.uint8)
    chunks = summary.where("chunk is not null").select("chunk", "counts").repartition(COUNTER_CHUNKS, "chunk")
    for r in chunks.mapInArrow(_sum_counters, "chunk int, levels binary").toLocalIterator():
        out[r.chunk] = np.frombuffer(r.levels, np.uint8)
    return out.ravel()


def prefix_length(n, percent: int):
    """n - ceil(n * percent / 100) + 1, and 0 for an empty set."""
    return np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)


def _first_tokens(rows: np.ndarray, need: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first ``need[row]`` entries of each row in the order of ``keys``, the last key first; their numbers."""
    order = np.lexsort((*keys, rows))
    sizes = np.bincount(rows, minlength=len(need))
    keep = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(need, sizes)
    return order[keep], np.minimum(sizes, need)


def _prefixes(size: int, percent: int, levels: np.ndarray):
    """Prefixes of each set: tokens of order 1 and how rare they are, 16 bits of each token of orders 2 and 3.

    16 bits can only let a pair pass that verification then drops.
    """
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                hashes, sizes = shingle_sets(data, offsets, size)
                rows = np.repeat(np.arange(hi - lo), sizes)
                level = levels[_counters(hashes)]
                need = prefix_length(sizes, percent)
                first, k1 = _first_tokens(rows, need, hashes, level)
                common = np.bincount(rows[first], weights=level[first], minlength=hi - lo)
                parts = [pa.array((-100 * common / np.maximum(k1, 1)).astype(np.int32)), list_array(signed(hashes[first]), k1)]
                for seed in (21, 22):
                    key = mix(hashes, seed)
                    chosen, k = _first_tokens(rows, need, key, level)
                    parts.append(list_array((key[chosen] >> np.uint64(48)).astype(np.uint16).view(np.int16), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(signed(_fingerprints(hashes, sizes))), pa.array(sizes.astype(np.int64)), *parts],
                    names=["id", "set_id", "n", "rarity", "tokens", "second", "third"])

    return run, "id long, set_id long, n long, rarity int, tokens array<long>, second array<short>, third array<short>"


def _id_filter(ids: DataFrame) -> np.ndarray:
    """Bits of the slots of ``_id``: FILTER_BITS of them whatever the number of ids."""
    slot = _slot(F.col("_id")) + 1  # bitmaps count from 1
    parts = (ids.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
             .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        out[(r.bucket - 1) * 4096:r.bucket * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _slot(column):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def _members(size: int, bits: np.ndarray, short: bool):
    """Sets of the rows (text, slot) whose slot is in ``bits``, whole or 16 bits of each token; rows without an id pass."""
    def run(batches):
        for batch in batches:
            slot = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            passed = (slot < 0) | ((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)
            for _, _, data, offsets in text_slices(batch.column(0).filter(pa.array(passed))):
                hashes, sizes = shingle_sets(data, offsets, size)
                tokens = (hashes & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16) if short else signed(hashes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(_fingerprints(hashes, sizes))), pa.array(sizes.astype(np.int64)), list_array(tokens, sizes)],
                    names=["set_id", "n", "shingles"])

    return run, f"set_id long, n long, shingles array<{'short' if short else 'long'}>"


def _sets_of(pairs: DataFrame, tasks: int, sets: DataFrame, rows: DataFrame, size: int, short: bool) -> DataFrame:
    """Sets of all members of ``pairs``, from one text each; so many tasks list them."""
    wanted = materialise(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).dropDuplicates().coalesce(tasks))
    ids = sets.select("set_id", F.col("first_id").alias("_id")).join(wanted, "set_id").where("_id is not null").coalesce(tasks)
    # a filter of fixed size leaves other texts out before anything is moved; the join makes it exact
    return (rows.select("_text", F.when(F.col("_id").isNotNull(), _slot(F.col("_id"))).alias("slot"))
            .mapInArrow(*_members(size, _id_filter(ids), short)).join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"]))


def _in_blocks(pairs: DataFrame, homes: DataFrame, arrays: DataFrame, passes, tasks: int = 1) -> DataFrame:
    """The pairs (a, b) for which ``passes(state, position of a, position of b)`` holds, in at most ``tasks`` tasks.

    Pairs are dealt by the home of their first set: small homes together, about
    ``HOME_SETS`` sets at a time, and large homes by blocks of sets. A set's arrays
    travel once per block, not once per pair.
    """
    placed = materialise(pairs.join(homes.toDF("a", "home"), "a").coalesce(tasks))
    load = (placed.select("home", F.col("a").alias("set_id")).union(placed.select("home", "b")).dropDuplicates()
            .groupBy("home").agg(F.count("*").alias("sets")).coalesce(tasks))
    small = load.where(F.col("sets") * 2 <= HOME_SETS).agg(F.sum("sets")).first()[0] or 0
    batches = -(-small // HOME_SETS) or 1
    # a batch of small homes has a number below ``batches`` and blocks of its own, which no home has
    in_batch = F.col("sets") * 2 <= HOME_SETS
    load = load.select("home", in_batch.alias("batched"), F.ceil(F.col("sets") / F.lit(HOME_SETS)).cast("int").alias("blocks"))
    block = lambda c: F.when(F.col("batched"), -1).otherwise(F.pmod(F.xxhash64(F.lit(9), c), F.col("blocks")).cast("int"))
    key = ["home", "i", "j"]
    home = F.when(F.col("batched"), F.pmod(F.xxhash64(F.lit(10), "home"), F.lit(batches))).otherwise(F.col("home")).alias("home")
    dealt = materialise(placed.join(load, "home").select(home, block("a").alias("i"), block("b").alias("j"), "a", "b").coalesce(tasks))
    uses = dealt.select(*key, F.col("a").alias("set_id")).union(dealt.select(*key, "b")).dropDuplicates().coalesce(tasks)
    columns = arrays.columns[2:]
    held = uses.join(arrays, "set_id").coalesce(tasks).toDF("set_id", "home_", "i_", "j_", "n", *columns)

    def compare(left, right):
        parts = [[np.asarray(t, np.int16).view(np.uint16) for t in right[c]] for c in columns]
        place = {i: k for k, i in enumerate(right.set_id.tolist())}
        n = right.n.tolist()
        ok, last, seen = np.zeros(len(left), bool), None, np.zeros((len(columns), 1 << 16), bool)
        order = np.argsort(left.a.to_numpy(), kind="stable")
        for k, a, b in zip(order.tolist(), left.a.to_numpy()[order].tolist(), left.b.to_numpy()[order].tolist(), strict=True):
            x, y = place[a], place[b]
            if a != last:
                for t, part in enumerate(parts):
                    if last is not None:
                        seen[t, part[place[last]]] = False
                    seen[t, part[x]] = True
                last = a
            ok[k] = passes(seen, [part[y] for part in parts], n[x], n[y])
        return left.loc[ok, ["a", "b"]]

    return dealt.groupBy(*key).cogroup(held.groupBy("home_", "i_", "j_")).applyInPandas(compare, "a long, b long").coalesce(tasks)


def _reachable(pairs: DataFrame, tasks: int, sets: DataFrame, homes: DataFrame, rows: DataFrame, size: int, percent: int) -> tuple[DataFrame, int]:
    """The pairs that pass orders 2 and 3, and then can reach the similarity judging by 16 bits of each token.

    Chance only adds to what two sets seem to share, so no link is lost.
    """
    def share_prefixes(seen, other, n_a, n_b):
        return bool(seen[0, other[0]].any() and seen[1, other[1]].any())

    def can_reach(seen, other, n_a, n_b):
        most = min(n_a, int(np.count_nonzero(seen[0, other[0]])))
        return 100 * most >= percent * (n_a + n_b - most)

    passed, tasks = gathered(_in_blocks(pairs, homes, sets.select("set_id", "n", "second", "third"), share_prefixes, tasks), TASK_PAIRS)
    short = _sets_of(passed, tasks, sets, rows, size, short=True).select("set_id", "n", "shingles")
    return gathered(_in_blocks(passed, homes, short, can_reach, tasks), TASK_PAIRS)


def _verified(pairs: DataFrame, tasks: int, sets: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    whole = _sets_of(pairs, tasks, sets, rows, size, short=False)
    both = pairs.join(whole.toDF("a", "na", "sa"), "a").join(whole.toDF("b", "nb", "sb"), "b").coalesce(tasks)

    def check(frames):
        for f in frames:
            shared = np.fromiter((len(np.intersect1d(x, y, assume_unique=True))
                                  for x, y in zip(f.sa, f.sb, strict=True)), np.int64, len(f))
            ok = 100 * shared >= percent * (f.na.to_numpy() + f.nb.to_numpy() - shared)
            yield f.loc[ok, ["a", "b"]]

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInPandas(check, "a long, b long")


def _possible(n_a, n_b, percent: int):
    """Sizes alone allow the similarity."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def _enough(shared, n_a, n_b, percent: int):
    """``shared`` common tokens reach the similarity."""
    return shared * (100 + percent) >= (n_a + n_b) * percent


def jaccard_classes(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text",
                    row_col: str | None = None) -> DataFrame:
    """One row per document: id, n_shingles, set_id, component_id, ``row`` (of ``row_col``) and whether it stays (``kept``).

    ``component_id`` is the smallest id of the documents connected by links of at
    least ``percent`` per cent, itself included; equal sets are links. ``kept`` is
    true for one row of each component, its smallest id (and row), and for rows
    without shingles.
    """
    row = F.col(row_col) if row_col else F.lit(0)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), row.cast("long").alias("_row"))
    scanned = materialise(rows.mapInArrow(*_summaries(size)))
    summary = scanned.where("chunk is null").drop("chunk", "counts")
    filled = summary.where("n_shingles > 0")
    prefixes = rows.mapInArrow(*_prefixes(size, percent, _levels(scanned))).where("n > 0")
    sets = materialise(
        prefixes.groupBy("set_id").agg(F.min("id").alias("first_id"), F.first("n").alias("n"), F.first("rarity").alias("rarity"), F.first("tokens").alias("tokens"),
                                       F.first("second").alias("second"), F.first("third").alias("third")))
    # ``reach``: tokens of the set from this one on, all that it can share with a set it shares no earlier token with
    prefix = (sets.select("set_id", "n", "rarity", F.posexplode("tokens").alias("place", "token"))
              .select("set_id", "n", "rarity", (F.col("n") - F.col("place")).alias("reach"), "token"))
    # moved once: the members of a bucket are counted where they are joined to it
    prefix = prefix.repartition("token")
    # buckets of two or more sets, with the member that all others are compared with first; two sets have to be able to link
    member = F.struct("rarity", "set_id", "n", "reach")
    two = (_possible(F.col("first.n"), F.col("last.n"), percent)
           & _enough(F.least("first.reach", "last.reach"), F.col("first.n"), F.col("last.n"), percent))
    shared = (prefix.groupBy("token").agg(F.count("*").alias("members"), F.min(member).alias("first"), F.max(member).alias("last"))
              .where((F.col("members") > 2) | (F.col("members") == 2) & two)
              .select("token", F.col("first.set_id").alias("centre"), F.col("first.n").alias("centre_n"), F.col("first.reach").alias("centre_reach")))
    bucket = materialise(prefix.select("set_id", "n", "rarity", "reach", "token").join(shared, "token"))
    # each member is compared with the centre that it shares most buckets with; what that leaves open comes below
    stars = (bucket.where("set_id <> centre").where(_possible(F.col("n"), F.col("centre_n"), percent))
             .where(_enough(F.least("reach", "centre_reach"), F.col("n"), F.col("centre_n"), percent))
             .groupBy("set_id", "centre").agg(F.count("*").alias("k"))
             .groupBy("set_id").agg(F.max(F.struct("k", "centre")).alias("best"))
             .select(F.col("best.centre").alias("a"), F.col("set_id").alias("b")))
    homes = materialise(bucket.groupBy("set_id").agg(F.min("centre").alias("home")))

    def links_among(candidates: DataFrame) -> DataFrame:
        passed, tasks = _reachable(*gathered(candidates, TASK_PAIRS), sets, homes, rows, size, percent)
        return materialise(_verified(passed, tasks, sets, rows, size, percent))

    links = links_among(stars)
    roots = connected_components(links)
    placed = (bucket.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
              .select("token", "set_id", "n", "reach", F.coalesce("root", "set_id").alias("root")).repartition("token"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    open_, _ = gathered(placed.join(mixed.select("token"), "token", "left_semi"), TASK_ROWS)
    groups = open_.groupBy("token", "root").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("reach"))
    x, y = groups.toDF("token", "root", "l0", "m0", "r0"), groups.toDF("token", "root_b", "l1", "m1", "r1")
    across = (x.join(y, "token").where("root < root_b")
              .where((F.col("m0") * 100 >= F.col("l1") * percent) & (F.col("m1") * 100 >= F.col("l0") * percent))
              .where(_enough(F.least("r0", "r1"), F.col("l0"), F.col("l1"), percent))
              .select("token", "root", "root_b"))
    pairs = (across.join(open_.toDF("token", "a", "na", "ra", "root"), ["token", "root"])
             .join(open_.toDF("token", "b", "nb", "rb", "root_b"), ["token", "root_b"])
             .where(_possible(F.col("na"), F.col("nb"), percent) & _enough(F.least("ra", "rb"), F.col("na"), F.col("nb"), percent))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).dropDuplicates())
    final = connected_components(links.union(links_among(pairs)))
    # the smallest row of each component: ids before null, then rows
    key = F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")
    firsts = filled.groupBy("set_id").agg(F.min(key).alias("key"))
    named = (firsts.join(final.withColumnRenamed("node", "set_id"), "set_id", "left")
             .withColumn("root", F.coalesce("root", "set_id")))
    smallest = named.groupBy("root").agg(F.min("key").alias("first"))
    component = named.join(smallest, "root").select("set_id", "first")
    placed = (filled.select("_id", "_row", "n_shingles", "set_id").join(component, "set_id")
              .select("_id", "_row", "n_shingles", "set_id", F.col("first._id").alias("component_id"),
                      (F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("_row") == F.col("first._row"))).alias("kept")))
    bare = summary.where("n_shingles = 0").select("_id", "_row", "n_shingles", F.lit(None).cast("long").alias("set_id"),
                                                  F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    return placed.union(bare).select(F.col("_id").alias(id_col), "n_shingles", "set_id", "component_id", F.col("_row").alias("row"), "kept")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, and every row without shingles; columns stay.

    Rows are told apart by a hash of id and text, which every scan computes alike; of rows equal in both any one stays.
    """
    row, = free_names(docs, "_row")
    numbered = docs.withColumn(row, F.xxhash64(F.col(id_col), F.col(text_col)))
    kept = materialise(
        jaccard_classes(numbered, size, percent, id_col, text_col, row).where("kept").groupBy(F.col("row").alias(row))
        .agg((F.max("n_shingles") > 0).alias("filled"), F.count("*").alias("n")))
    several = kept.where("filled and n > 1").select(row)
    once = numbered.join(kept.where("not filled or n = 1").select(row), row, "left_semi")
    if not several.isEmpty():
        once = once.union(numbered.join(several, row, "left_semi").dropDuplicates([row]))
    return once.select(*docs.columns)
