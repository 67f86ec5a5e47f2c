"""Operators on texts against brute force, on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from limnoscope.llm import chunk_dedup, common, jaccard_join, language_model, packing, repetition, suffix_dedup, token_counts
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


# ---------------------------------------------------------------- components

def test_components_of_a_long_path_a_star_and_pairs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 200)] + [(500, 400), (7, 7)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 300)} | {400: 400, 500: 400}
    assert got == want
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_take_one_task_and_the_rounds_agree(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(300) - 50, rng.randrange(300) - 50) for _ in range(150)] + [(None, 3), (1 << 62, -(1 << 62))]
    table = spark.createDataFrame(edges, "a long, b long").repartition(7)
    once, rounds = common.connected_components(table), common.connected_components(table, few=0)
    assert once.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, rounds.collect()))


def test_gathered_rows_take_as_many_tasks_as_they_need(spark):
    table = spark.range(0, 1000, 1, 40)
    for per_task, want in ((1000, 1), (300, 4), (1, 40)):
        stored, tasks = common.gathered(table, per_task)
        assert stored.rdd.getNumPartitions() == want and tasks == -(-1000 // per_task) and stored.count() == 1000
    assert common.gathered(table.where("id < 0"), 10)[1] == 1


def test_pairs_that_share_a_token_by_chance_are_not_stored(spark, monkeypatch):
    # two texts share their rarest shingle, but one is three times as long: their bucket cannot link
    words = [[f"w{k}x{i}" for i in range(n)] for k, n in enumerate((30, 90))]
    texts = [" ".join(["same", "three", "words", *w]) for w in words]
    rows = [*enumerate(texts), (2, texts[0] + " more"), (3, "other text alone")]
    stored, keep = [], common.materialise
    monkeypatch.setattr(jaccard_join, "materialise", lambda df: stored.append(keep(df)) or stored[-1])
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3}
    buckets = next(t for t in stored if "centre" in t.columns and "token" in t.columns)
    assert buckets.select("set_id").distinct().count() == 2


# ---------------------------------------------------------------- token counts

def greedy(word, pieces, longest):
    symbols = [*word[:-1], word[-1] + 256]
    n = at = 0
    while at < len(symbols):
        size = next(k for k in range(min(longest, len(symbols) - at), 0, -1) if k == 1 or tuple(symbols[at:at + k]) in pieces)
        at, n = at + size, n + 1
    return n


def test_token_counts_equal_greedy_matching(docs, corpus, no_docs):
    import unicodedata

    pieces = set(token_counts.vocabulary(VOCABULARY))
    longest = max(map(len, pieces))
    want = []
    for i, text in corpus:
        words = WORD.findall(unicodedata.normalize("NFC", text or "").lower())
        want.append((i, len(words), sum(greedy(w.encode(), pieces, longest) for w in words)))
    got = [tuple(r) for r in token_counts.token_counts(docs, VOCABULARY).select("doc_id", "n_words", "n_tokens").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts.token_counts(no_docs, VOCABULARY).count() == 0


def test_automaton_follows_failure_links():
    pieces = [(97, 98, 99, 100), (98, 99), (97, 98), (98, 99 + 256), (97, 98, 99, 100, 101 + 256)]
    machine = token_counts.Automaton(pieces)
    for word in (b"abcd", b"abcde", b"abc", b"bc", b"xabcx", b"ababcdabcde"):
        assert machine.count(word) == greedy(word, set(pieces), 5)
    assert machine.count(b"") == 0


# ---------------------------------------------------------------- language model

def test_language_model_base_scores_and_probabilities(docs, corpus, no_docs, monkeypatch):
    monkeypatch.setattr(language_model, "TABLE", 64)  # most tokens go the way of the join
    train = docs.where("doc_id % 4 <> 0").select("text")
    model, counts = language_model.fit(train)
    rows = language_model.score(docs, model, counts).collect()
    count = collections.Counter()
    for i, text in corpus:
        if i is not None and i % 4:
            count.update([*WORD.findall(lower(text)), None])
    total, kinds = sum(count.values()), len(count)
    want = []
    for i, text in corpus:
        words = [*WORD.findall(lower(text)), None]
        base = sum(np.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        want.append((i, len(words), sum(count[w] > 0 for w in words), total, round(base, 6)))
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    # all tokens after one context: classes add to one, and each class's tokens with its unseen one do
    ids = np.array([r.token for r in counts.collect()], np.int64).view(np.uint64)
    n = np.array([r.n for r in counts.collect()])
    classes = model.classes(ids)
    for k in range(language_model.CLASSES):
        assert abs(n[classes == k].sum() - model.class_total[k]) < 1e-9 and (classes == k).sum() == model.class_distinct[k]
    assert all(r.score < 0 and np.isfinite(r.score) for r in rows)
    empty_model, none = language_model.fit(no_docs.select("text"))
    assert language_model.score(no_docs, empty_model, none).count() == 0
    blank = language_model.score(docs, empty_model, none).collect()
    assert len(blank) == len(corpus) and all(r.n_known == 0 and np.isfinite(r.score) for r in blank)


def test_language_model_beats_counts_on_held_out_texts(spark):
    import random

    rng = random.Random(1)
    tongues = [[f"{p}{i}" for i in range(60)] for p in ("al", "ber", "cin")]
    texts = [(i, " ".join(rng.choice(tongues[i % 3]) for _ in range(80))) for i in range(600)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    model, counts = language_model.fit(frame.where("doc_id < 500").select("text"))
    held = language_model.score(frame.where("doc_id >= 500"), model, counts).collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


# ---------------------------------------------------------------- repetition

def test_repetition_counts_equal_brute_force(docs, corpus, no_docs):
    want = []
    for i, text in corpus:
        text = text or ""
        words = WORD.findall(text)
        seen = collections.Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
        mark = [False] * len(words)
        for k in range(len(words) - 7):
            if seen[tuple(words[k:k + 8])] > 1:
                mark[k:k + 8] = [True] * 8
        lines = [x for x in text.split("\n") if WORD.search(x)]
        bad = len(words) < 20 or 100 * sum(mark) > 30 * len(words)
        want.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(mark), bad))
    rows = repetition.repetition_rules(docs).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert not any(r.kept for r in rows if r.base_failed) and any(r.kept for r in rows)
    assert all(sum(b - a for a, b in zip(r.span_from, r.span_to)) == r.n_covered for r in rows)
    assert repetition.repetition_rules(no_docs).count() == 0


def test_longest_repeats_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(100):
        texts = [rng.integers(0, 3, rng.integers(0, 30)) for _ in range(3)]
        first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        words = np.concatenate(texts).astype(np.uint64)
        if not len(words):
            continue
        want = []
        for t in texts:
            for i in range(len(t)):
                best = 0
                for j in range(len(t)):
                    k = 0
                    while i != j and max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best)
        end = np.repeat(first[1:], np.diff(first))
        assert repetition.longest_repeats(repetition.suffix_ranks(words, first), end).tolist() == want


# ---------------------------------------------------------------- packing

def test_packing_is_a_round_trip(docs, corpus, no_docs):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    limit = 128
    want = []
    for i, text in corpus:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), limit):
            part = np.array(ids[p:p + limit], "<u4")
            want.append((i, p // limit, p, len(part), zlib.crc32(part.tobytes()), part.tolist()))
    rows = packing.pack(docs, VOCABULARY, limit=limit, keep_ids=True).collect()
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, list(r.ids)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    assert len(filled) <= -(-sum(r.length for r in rows) // limit) + 2
    assert packing.pack(no_docs, VOCABULARY).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    limit = int(rng.integers(5, 60))
    counts = np.append(0, rng.integers(0, 5, limit) * (rng.random(limit) < 0.5)).astype(np.int64)
    used = np.zeros(limit + 1, np.int64)
    for lengths, times in packing.plan(counts, limit):
        assert sum(lengths) <= limit and times > 0
        for x in lengths:
            used[x] += times
    assert (used == counts).all()


def test_fill_finds_one_two_or_three_lengths():
    counts = np.zeros(101, np.int64)
    counts[[7, 20, 33]] = 1
    assert packing._fill(counts, 20) == (20,) and packing._fill(counts, 53) == (33, 20) and packing._fill(counts, 60) == (33, 20, 7)
    assert packing._fill(counts, 40) == (33, 7) and packing._fill(counts, 66) is None and packing._fill(counts, 14) is None


# ---------------------------------------------------------------- Jaccard join

def shingle_set(text, size):
    words = WORD.findall(lower(text))
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])


def reference_classes(corpus, size, percent):
    sets = [shingle_set(t, size) for _, t in corpus]
    links = []
    for b in range(len(sets)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    root = components(len(corpus), links)
    least = {}
    for (i, _), r in zip(corpus, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sets, root, least


def test_small_homes_are_compared_together(spark):
    calls = spark.sparkContext.accumulator(0)

    def alike(seen, other, n_a, n_b):
        if not seen[0, 65535]:  # no set has this token: the first pair that a task compares in one go
            seen[0, 65535] = True
            calls.add(1)
        return bool(seen[0, other[0]].any())

    # 300 homes of two sets and one of 600, every second pair shares a token
    pairs = [(2 * i, 2 * i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 600)]
    homes = [(s, 2 * (s // 2) if s < 1000 else 1000) for p in pairs for s in p]
    tokens = {s: [s % 30000, 7] if s % 4 < 2 else [s % 30000] for s in sorted({s for s, _ in homes})}
    arrays = spark.createDataFrame([(s, len(t), t) for s, t in tokens.items()], "set_id long, n long, part array<short>")
    got = jaccard_join._in_blocks(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(homes, "set_id long, home long").dropDuplicates(), arrays, alike)
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a, b in pairs if set(tokens[a]) & set(tokens[b]))
    assert 2 <= calls.value < 12


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_jaccard_classes_equal_all_pairs(docs, corpus, no_docs, size, percent):
    sets, root, least = reference_classes(corpus, size, percent)
    want = [(i, len(s), least.get(r)) for (i, _), s, r in zip(corpus, sets, root)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(docs, size, percent).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = jaccard_join.keep_one(docs, size, percent)
    assert kept.columns == docs.columns
    filled = {r for r, s in zip(root, sets) if s}
    assert kept.count() == len(filled) + sum(not s for s in sets)
    assert jaccard_join.jaccard_classes(no_docs).count() == 0 and jaccard_join.keep_one(no_docs).count() == 0


# ---------------------------------------------------------------- chunks

def test_chunks_cover_texts_and_resist_shifts():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 20000).astype(np.uint8)
    h = chunk_dedup.gear_hash(data)
    for i in (0, 3, 40, 19999):
        assert int(h[i]) == sum(int(chunk_dedup.GEAR[data[i - j]]) << j for j in range(min(32, i + 1))) % (1 << 32)

    def chunks(raw):
        raw = np.frombuffer(raw, np.uint8)
        ends, numbers = chunk_dedup.chunk_ends(raw, np.array([0, len(raw)]), 64, 128, 1024)
        assert numbers.tolist() == [len(ends)] and ends[-1] == len(raw)
        sizes = np.diff(np.append(0, ends))
        assert (sizes[:-1] >= 64).all() and (sizes <= 1024 + 64).all()
        return [raw[a:b].tobytes() for a, b in zip(np.append(0, ends), ends)]

    raw = data.tobytes()
    assert b"".join(chunks(raw)) == raw
    same = set(chunks(raw)) & set(chunks(raw[:500] + b"inserted" + raw[500:]))
    assert len(same) > 0.9 * len(chunks(raw))


def test_first_chunk_stays_and_others_go(docs, corpus, no_docs):
    rows = chunk_dedup.repeated_chunks(docs.withColumn("place", docs.doc_id), row_col="place").collect()
    assert len(rows) == len(corpus)
    cleaned = chunk_dedup.remove_chunks(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(corpus)
    text = collections.defaultdict(list)
    for r in cleaned.collect():
        text[r.doc_id].append(r.text)
    original = dict(corpus)
    assert text[9] == [original[9]] and all(len(text[200 + i][0].encode()) < 64 for i in range(8))
    assert sorted(map(len, text[3]))[-1] == len(original[3]) and sorted(map(len, text[3]))[0] < 64
    assert text[400] == [None] and text[401] == [""]
    # the passage goes from all texts but one
    assert sum(len(text[300 + i][0]) < len(original[300 + i]) - 150 for i in range(10)) == 9
    assert chunk_dedup.remove_chunks(no_docs).count() == 0


# ---------------------------------------------------------------- suffix dedup

def removed(corpus, length):
    count = collections.Counter()
    raw = [(t or "").encode() for _, t in corpus]
    for x in raw:
        count.update(x[i:i + length] for i in range(len(x) - length + 1))
    out = []
    for (doc, _), x in zip(corpus, raw):
        mark = np.zeros(len(x) + 2, np.int8)
        for i in range(len(x) - length + 1):
            if count[x[i:i + length]] > 1:
                mark[i + 1:i + 1 + length] = 1
        kept = bytes(b for b, m in zip(x, mark[1:-1]) if not m)
        out.append((doc, len(x), int(mark.sum()), int((np.diff(mark) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,most", [(400, 1024), (60, 1024), (100, 2)])
def test_removed_bytes_equal_brute_force(docs, corpus, no_docs, monkeypatch, length, most):
    monkeypatch.setattr(suffix_dedup, "MAX_GROUP", most)
    got = [tuple(r) for r in suffix_dedup.removal_report(docs, length).drop("spans").collect()]
    assert sorted(got, key=str) == sorted(removed(corpus, length), key=str)
    if length == 400:
        cleaned = suffix_dedup.remove_repeats(docs, length)
        assert cleaned.columns == docs.columns and cleaned.count() == len(corpus)
        assert suffix_dedup.removal_report(no_docs).count() == 0 and suffix_dedup.remove_repeats(no_docs).count() == 0


def test_transform_finds_repeats_across_texts():
    rng = np.random.default_rng(2)
    for _ in range(60):
        length = int(rng.choice([3, 7, 8, 20]))
        texts = [bytes(rng.choice(list(b"ab\0"), rng.integers(length, 80), p=[.5, .48, .02]).astype(np.uint8)) for _ in range(4)]
        windows = np.array([len(t) - length + 1 for t in texts])
        count = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
        for t, found in zip(texts, suffix_dedup.repeated_windows(texts, windows, length)):
            assert found.tolist() == [count[t[i:i + length]] > 1 for i in range(len(t) - length + 1)]


def test_rows_keep_their_ids_when_a_later_scan_is_split_anew(spark, docs):
    """Splits of a scan follow the cores of the moment; here a setting changes them after the operator was planned."""
    setting = "spark.sql.files.minPartitionNum"
    texts = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"])
    model, counts = language_model.fit(texts.select("text"))
    places = lambda: {r.doc_id: r.row for r in docs.select("doc_id", F.monotonically_increasing_id().alias("row")).collect()}
    before = places()
    want = sorted(((r.doc_id, r.n_tokens, round(r.score, 6)) for r in language_model.score(docs, model, counts).collect()), key=str)
    kept_want = sorted((r.doc_id for r in jaccard_join.keep_one(docs).collect()), key=str)
    scored, kept, cleaned = language_model.score(docs, model, counts), jaccard_join.keep_one(docs), chunk_dedup.remove_chunks(docs)
    spark.conf.set(setting, "1")
    try:
        assert places() != before
        # read anew, as a later stage does
        assert sorted(((r.doc_id, r.n_tokens, round(r.score, 6)) for r in scored.select("*").collect()), key=str) == want
        assert sorted((r.doc_id for r in kept.select("*").collect()), key=str) == kept_want
        assert cleaned.select("*").count() == docs.count()
    finally:
        spark.conf.unset(setting)


def test_keep_one_leaves_one_of_rows_equal_in_id_and_text(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "a"), (1, text, "b"), (2, text, "c"), (3, None, "d"), (3, None, "e"), (None, text, "f"), (4, "other words stand here alone", "g")]
    got = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 3, 4]
    assert {r.lang for r in got} - {"a", "b"} == {"d", "e", "g"}


def test_chunk_report_shows_what_is_left(docs, corpus, no_docs):
    got = chunk_dedup.chunk_report(docs).collect()
    assert len(got) == len(corpus) and chunk_dedup.chunk_report(no_docs).count() == 0
    left = {}
    for r in got:
        left.setdefault(r.doc_id, []).append(r)
    for doc_id, text in corpus:
        raw = (text or "").encode("utf-8", "surrogatepass")
        fits = [r for r in left[doc_id] if r.n_bytes == len(raw) and (r.text is None) == (text is None)]
        kept = []
        for r in fits:
            parts, at = [], 0
            for s in r.spans:
                parts, at = [*parts, raw[at:s.a]], s.b
            kept.append(b"".join([*parts, raw[at:]]).decode("utf-8", "ignore") == (r.text or ""))
        assert any(kept), doc_id


def _thue_morse(bits: int) -> tuple[str, str]:
    """A string and its complement that collide under every polynomial modulo 2**64."""
    text = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
    return text, text.translate(str.maketrans("ab", "ba"))


def test_hashes_tell_thue_morse_words_apart(spark):
    one, other = _thue_morse(11)
    hashes = common.word_hashes(*common.text_bytes(pa.array([f"{one} {other} {one}"])))[0]
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]
    docs = spark.createDataFrame([(1, f"x {one} y z"), (2, f"x {other} y z"), (3, f"{one}\n{other}")], "doc_id long, text string")
    assert {r.n_dup_lines for r in repetition.repetition_rules(docs).where("doc_id = 3").collect()} == {0}
    kept = jaccard_join.keep_one(docs, size=3, percent=90)
    assert kept.count() == 3


def test_hash_of_a_span_does_not_depend_on_its_place():
    rng = np.random.default_rng(2)
    part = rng.integers(0, 256, 300).astype(np.uint8)
    data = np.concatenate([part, rng.integers(0, 256, 70000).astype(np.uint8), part])
    running = common.prefix_hash(data)
    got = common.span_hash(running, np.array([0, len(data) - 300, 1]), np.array([300, len(data), 301]))
    assert got[0] == got[1] != got[2]


def test_columns_with_names_used_inside_stay(spark):
    rng = random.Random(3)
    passage = prose(rng, 200)
    rows = [(i, f"{prose(rng, 50)} {passage} {prose(rng, 50)}", i, f"s{i}", [i]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _ROW long, _sha string, _spans array<long>")
    for run in (jaccard_join.keep_one, suffix_dedup.remove_repeats, chunk_dedup.remove_chunks):
        got = run(docs)
        assert got.columns == docs.columns
        assert {(r[0], r[2], r[3], r[4][0]) for r in got.collect()} <= {(i, i, f"s{i}", i) for i in range(6)}


# ---------------------------------------------------------------- passages that hold no whole chunk

def test_repeated_passages_go_from_later_texts(spark):
    rng = random.Random(11)
    rows, passages = [], {}
    for i in range(60):
        passage = prose(rng, 52)
        while len(passage.encode()) < 230:
            passage += " " + prose(rng, 4)
        passages[i] = passage
        rows += [(i, f"{prose(rng, 40 + i)} <{passage}> {prose(rng, 50)}"), (1000 + i, f"{prose(rng, 30)} [{passage}] {prose(rng, 45 + i)}")]
    twice = prose(rng, 60)
    rows += [(2000, f"{prose(rng, 33)} ({twice}) {prose(rng, 44)} {{{twice}}} {prose(rng, 21)}"), (2001, None), (2002, ""), (2003, "ab " * 3000),
             (2004, passages[0]), (2004, None), (None, f"{prose(rng, 20)} ={passages[1]}= {prose(rng, 20)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = chunk_dedup.chunk_report(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 2004}
    for i, passage in passages.items():
        first, later = rows[2 * i][1], rows[2 * i + 1][1]
        assert by[i].text == first and by[i].n_removed == 0
        assert by[1000 + i].text == later.replace(passage, "") and by[1000 + i].n_removed == len(passage.encode())
    assert by[2000].text == rows[120][1].replace("{" + twice + "}", "{}")
    assert by[2001].text is None and by[2002].text == "" and 0 < len(by[2003].text) < 400
    assert sorted((r.text or "", r.text is None) for r in got if r.doc_id == 2004) == [("", False), ("", True)]
    assert by[None].text == rows[-1][1].replace(passages[1], "")
    assert {r.doc_id: r.text for r in chunk_dedup.remove_chunks(docs).collect() if r.doc_id != 2004} == {k: r.text for k, r in by.items()}


def test_each_long_enough_string_has_a_seed_of_its_own():
    rng = np.random.default_rng(3)
    for least, average in ((64, 128), (8, 5)):
        for _ in range(30):
            shared = rng.integers(97, 101, least + average).astype(np.uint8)
            texts = [np.concatenate((rng.integers(97, 101, n).astype(np.uint8), shared, rng.integers(97, 101, m).astype(np.uint8))) for n, m in ((40, 7), (0, 90), (11, 0))]
            offsets = np.cumsum([0] + [len(t) for t in texts])
            row, at, key = chunk_dedup.seeds(np.concatenate(texts), offsets, least, average)
            lead = np.array([40, 0, 11])
            place = at - offsets[row] - lead[row]
            within = (place >= 0) & (place + least <= len(shared))
            found = [set(zip(place[within & (row == r)].tolist(), key[within & (row == r)].tolist())) for r in range(3)]
            assert found[0] & found[1] & found[2]
    assert not len(chunk_dedup.seeds(np.zeros(0, np.uint8), np.zeros(3, np.int64), 64, 128)[0])


def test_parts_outside_of_spans():
    rng = random.Random(4)
    for _ in range(300):
        def some(touching):
            edges = sorted(rng.sample(range(30), 2 * rng.randint(0, 5)))
            spans = list(zip(edges[::2], edges[1::2]))
            return [p for a, b in spans for p in ((a, (a + b) // 2), ((a + b) // 2, b)) if p[0] < p[1]] if touching else spans

        spans, taken = some(False), some(True)
        rest = chunk_dedup.outside(spans, taken)
        assert rest == sorted(rest)
        left = [x for a, b in rest for x in range(a, b)]
        assert left == sorted({x for a, b in spans for x in range(a, b)} - {x for a, b in taken for x in range(a, b)})
