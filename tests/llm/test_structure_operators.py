"""Conversation repair, hard negatives and personal data against brute force, on nulls, ties, hot keys, clashing columns and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnoscope.llm import conversation_repair, hard_negatives, pii, queries

# ---------------------------------------------------------------- conversation repair


def cheapest(rows, entry=0, exits=(0, 3)):
    """Best (cost, audit) by relaxation over all (row, state) nodes."""
    best = {(0, entry): (0, "")}

    def offer(node, found):
        if node not in best or found < best[node]:
            best[node] = found

    for i in range(len(rows) + 1):
        for state in (0, 1, 2, 3) * 3:
            if (i, state) in best:
                cost, audit = best[i, state]
                offer((i, 3 if state == 2 else 2), (cost + 3, audit + "I"))
        if i == len(rows):
            break
        initial, fault = rows[i]
        for state in range(4):
            if (i, state) not in best:
                continue
            cost, audit = best[i, state]
            due, to = ("a", 3) if state == 2 else ("u", 2)
            offer((i + 1, state), (cost + 4, audit + "D"))
            if fault in ("b", "d"):
                continue
            cost += 3 * (fault == "t")
            offer((i + 1, to), (cost + 3, audit + "R"))
            if initial == due:
                offer((i + 1, to), (cost, audit + "K"))
            if initial == "s" and state == 0:
                offer((i + 1, 1), (cost, audit + "K"))
    found = [best[len(rows), e] for e in exits if (len(rows), e) in best]
    return min(found) if found else None


def repaired_by_hand(rows):
    """The contract, one conversation after another."""
    convs, out = {}, []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept = convs.setdefault(conv, [])
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        kept += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in kept:
            solid = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not solid else "d" if (role, text) in seen else "" if solid[-1] in ".!?" else "t")
            seen.add((role, text))
        turns = {t for t, _, _ in kept if t is not None}
        initials = [r[:1] for _, r, _ in kept]
        cost, audit = cheapest(list(zip(initials, faults)))
        lines, at, state = [], 0, 0
        for letter in audit:
            due = "assistant" if state == 2 else "user"
            after = 3 if state == 2 else 2
            if letter == "I":
                lines.append(due + ":")
                state = after
                continue
            _, role, text = kept[at]
            at += 1
            if letter != "D":
                lines.append(f"{role if letter == 'K' else due}:{text}")
                state = 1 if letter == "K" and role[:1] == "s" else after
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def test_search_finds_the_best_edits_between_all_states():
    rng = random.Random(5)
    for n in range(1500):
        rows = [(rng.choice("uuaasx"), rng.choice(["", "", "", "t", "b", "d"])) for _ in range(rng.randint(0, 9))]
        assert conversation_repair.cheapest_edits(rows) == cheapest(rows)
        if n % 10 == 0:
            costs, audits = conversation_repair._table(rows)
            for entry in range(4):
                for end in range(4):
                    got = None if costs[4 * entry + end] is None else (costs[4 * entry + end], audits[4 * entry + end])
                    assert got == cheapest(rows, entry, (end,))


def test_bounds_never_exceed_what_a_suffix_costs():
    rng = random.Random(6)
    for _ in range(300):
        rows = [(rng.choice("uas"), rng.choice(["", "t", "b"])) for _ in range(6)]
        user, assistant = conversation_repair.suffix_bounds(rows, False)
        for i in range(7):
            for state in range(4):
                assert (assistant if state == 2 else user)[i] <= cheapest(rows[i:], state)[0] if cheapest(rows[i:], state) else True


CONVERSATION = "conv_id long, turn long, role string, text string, key string, part int, code int, digest string, present string"


@pytest.fixture(scope="module")
def turns(spark):
    """A conversation with nearly all rows, ties and null turns, unknown roles; a null id; rows of nulls; short legal ones."""
    rng = random.Random(3)
    rows = [(7, rng.choice([None, *range(150)]), rng.choice(["user", "assistant", "system", "tool", "", None]),
             rng.choice(["Hi.", "no end", "", "Yes!", " ", None, "x?", *(f"t{i}." for i in range(40))])) for _ in range(500)]
    rows += [(None, i, "user", "a.") for i in range(5)] + [(9, None, None, None)]
    rows += [(i, t, "user" if t % 2 == 0 else "assistant", f"w{t}.") for i in range(20, 50) for t in range(4)]
    extra = [(*r, "k", 1, 2, "d", "p") for r in rows]
    return rows, spark.createDataFrame(extra, CONVERSATION).repartition(5)


@pytest.mark.parametrize(("longest", "piece"), [(5, 3), (128, 64)])
def test_repair_equals_the_contract_whole_and_in_pieces(spark, turns, longest, piece):
    rows, df = turns
    report, blocks = conversation_repair.repair(queries.damaged(df), present=F.col("present"), keep_turns=True, longest=longest, piece=piece)
    got = sorted(map(tuple, report.collect()), key=str)
    assert got == repaired_by_hand(rows)
    texts = {}
    for conv, _, _, block in sorted(map(tuple, blocks.collect()), key=lambda r: (str(r[0]), r[1], r[2])):
        texts.setdefault(conv, []).extend(f"{t.role}:{t.text}" for t in block)
    hashes = {r[0]: r[-1] for r in got}
    assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in texts.items()} == hashes
    assert max(len(b) for _, _, _, b in map(tuple, blocks.collect())) <= max(2 * longest, 2 * piece) + 2


def test_hot_conversation_is_dealt_over_tasks(spark, turns):
    _, df = turns
    rows = df.where("conv_id = 7").selectExpr("conv_id", "coalesce(turn, 0) AS turn", "coalesce(role, ' ') AS role", "coalesce(text, '') AS text")
    per_task = (rows.repartitionByRange(8, "conv_id", "turn", "role", F.substring("text", 1, 32))
                .groupBy(F.spark_partition_id()).count().collect())
    assert len(per_task) == 8 and max(r["count"] for r in per_task) < 0.3 * rows.count()


def test_registered_repair_and_empty_tables(spark, turns, tmp_path):
    rows, df = turns
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op11_conversation_repair(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == repaired_by_hand(rows)
    report, blocks = conversation_repair.repair(df.where("1 = 0").drop("present"), keep_turns=True)
    assert report.count() == 0 and blocks.count() == 0
    gone, _ = conversation_repair.repair(df.where("conv_id = 20").drop("present"), present=F.lit(False))
    assert [tuple(r) for r in gone.collect()] == [(20, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# ---------------------------------------------------------------- hard negatives

VECTOR = "vec_id long, embedding array<double>, label int, row int, x int, anchor int, score int, rank int, scores string"


def negatives_by_hand(rows):
    """(vec_id, label, vector) in the order of rows."""
    ok = [(i, lab, [int(np.floor(256 * float(c))) for c in v]) for i, v, lab in rows
          if None not in (i, lab) and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    ok = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in ok]

    def score(a, b):
        return sum(p * q for p, q in zip(a[2], b[2]))

    out = []
    for a in ok:
        if a[0] % 50:
            continue
        same = sorted(((score(a, r), r) for r in ok if r is not a and r[1] == a[1]), key=lambda s: (-s[0], s[1][0]))[:5]
        other = sorted(((score(a, r), r) for r in ok if r[1] != a[1]), key=lambda s: (-s[0], s[1][0]))
        for p, positive in same:
            fits = [(s, r) for s, r in other if 50 * p <= 100 * s <= 95 * p][:3]
            out += [(a[0], positive[0], n, r[0], p, s) for n, (s, r) in enumerate(fits, 1)]
    return sorted(out)


def vectors(rng, n, dim=24):
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centres[i % 6] * (0.4 if i % 3 else 1.0) + rng.normal(size=dim) * 0.3
        rows.append((i, v.tolist(), int(rng.integers(0, 3))))
    return rows


@pytest.fixture(scope="module")
def embedded(spark):
    rng = np.random.default_rng(2)
    rows = vectors(rng, 700)
    rows += [(1000 + i, rows[3][1], 1) for i in range(60)]  # ties, a group of copies with an anchor
    rows += [(2000, None, 1), (2001, [1.0, None], 1), (2002, [float("nan")] * 24, 1), (2003, [float("inf")] * 24, 0), (None, rows[0][1], 1),
             (2004, rows[1][1], None), (2050, [], 2), (2100, [0.5, 0.25], 0), (50, rows[50][1], rows[50][2]), (2150, [-0.001] * 30, 1)]
    return rows, spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "s") for r in rows], VECTOR).repartition(4)


def relabelled(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return df.withColumn("label", label)


def test_hard_negatives_equal_brute_force(spark, embedded):
    rows, df = embedded
    got = hard_negatives.hard_negatives(relabelled(df), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == negatives_by_hand(rows)
    assert hard_negatives.hard_negatives(df.where("1 = 0"), F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_tiles_bound_what_a_task_holds(spark, embedded, monkeypatch):
    rows, df = embedded
    monkeypatch.setattr(hard_negatives, "ROWS_A_TILE", 100)
    monkeypatch.setattr(hard_negatives, "ANCHORS_A_TILE", 6)
    got = hard_negatives.hard_negatives(relabelled(df), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == negatives_by_hand(rows)
    same = df.select("vec_id", F.lit(1).alias("label"), "embedding")  # one label holds every row
    numbered = same.withColumn("row", F.monotonically_increasing_id()).select("row", F.col("vec_id").alias("id"), "label", "embedding")
    sizes = hard_negatives._dealt(numbered, numbered.where("id % 50 = 0"), 8, 2)._gd2._df.groupBy("tile_a", "tile_r").count().collect()
    assert max(r["count"] for r in sizes) <= 0.2 * numbered.count()


def test_huge_components_are_limited_and_exact(spark):
    rows = [(50, [1e300, 1.0], 1), (51, [2.0 ** 19, 0.0], 1), (52, [2.0 ** 18, 0.0], 2)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 50)
    assert [tuple(r) for r in got.collect()] == [(50, 51, 1, 52, (1 << 28) * (1 << 27), (1 << 28) * (1 << 26))]


def test_bounds_hold_and_filter(spark):
    rng = np.random.default_rng(0)
    steps = np.repeat(rng.integers(-100, 100, size=(300, 4)), 16, axis=1) + rng.integers(-3, 4, size=(300, 64))
    a, x = hard_negatives.Summaries(steps[:50].astype(float)), hard_negatives.Summaries(steps[50:].astype(float))
    true = a.vectors @ x.vectors.T
    width = []
    for level in range(2):
        low, high = hard_negatives.bounds(a, x, level)
        assert (low <= true).all() and (true <= high).all()
        i, j = map(np.ravel, np.indices(true.shape))
        pair = hard_negatives.pair_bounds(a, x, level, i, j)
        assert np.allclose(pair[0], low.ravel()) and np.allclose(pair[1], high.ravel())
        width.append((high - low).mean())
    assert width[1] < width[0] < 0.1 * true.std()  # smooth segments are settled by their means


# ---------------------------------------------------------------- personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_by_hand(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            luhn = sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
            if (True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")), 14 <= len(digits) <= 19 and luhn,
                    10 <= len(digits) <= 15)[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


PIECES = ["@", ".", "+", "-", " ", "1", "2", "34", "4111 1111 1111 1111", "4111111111111111", "a", "b", "é", "(", ")", "1.2.3.4", "x@y.z", "%",
          "_", "0", "255", "256", "iban", "tel:", "+12345678901", "日", "\n", "007.01.2.3", "://", "(at)", "٣"]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    finder, met = pii.Finder(), 0
    for _ in range(20000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        got = [(s, k, e) for s, k, e, base in finder.spans(text) if base]
        assert got == base_by_hand(text), text
        met += len(got)
    assert met > 5000


def test_added_spans_are_expanded_and_validated():
    cases = {
        "write to joe (at) site (dot) org now": [("email", "joe (at) site (dot) org")],
        "Joe [AT] Mail.example.com": [("email", "Joe [AT] Mail.example.com")],
        "tel: 030 123 4567, fax: 12": [("phone", "030 123 4567")],
        "hotel: 030 123 4567": [],
        "tel: +49 30 1234567": [("phone", "+49 30 1234567")],
        "see (https://ex.example.com:80/x?y). Then": [("url", "https://ex.example.com:80/x?y")],
        "a://b and http://nodots": [],
        "IBAN: DE89 3704 0044 0532 0130 00 here": [("account", "DE89 3704 0044 0532 0130 00")],
        "IBAN: DE88 3704 0044 0532 0130 00 here": [],
        "account no: 12345678, my account is 5": [("account", "12345678")],
        "plain words about a token, a phone and an account.": [],
    }
    finder = pii.Finder()
    for text, want in cases.items():
        assert [(pii.KINDS[k], text[s:e]) for s, k, e, _ in finder.spans(text)] == want


def test_added_spans_never_overlap_their_kind():
    rng, finder = random.Random(2), pii.Finder()
    for _ in range(5000):
        text = "".join(rng.choice([*PIECES, "tel: ", "account: ", " (dot) "]) for _ in range(rng.randint(0, 12)))
        spans = finder.spans(text)
        for kind in range(6):
            mine = [(s, e) for s, k, e, _ in spans if k == kind]
            assert all(a[1] <= b[0] for a, b in zip(mine, mine[1:])), text


def test_hostile_texts_take_linear_time():
    finder = pii.Finder()
    for piece in ("@", "a@", "1", "1.", "1 ", "+1", "a://", "://", "a.", "(at)", "tel:", "iban", " ", "a(at)b(dot)", "account: 1"):
        finder.spans(piece * (300_000 // len(piece)))


def test_registered_query_on_the_corpus(spark, docs, corpus, no_docs, tmp_path):
    rows = [(1, "a@b.cd 1.2.3.4, 4111-1111-1111-1111 +1 (017) 555-7713"), (2, "é" * 70000 + " x@y.zz"), *corpus]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, text in rows:
        base = base_by_hand(text)
        told = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        want.append((i, *(sum(k == n for _, k, _ in base) for n in range(4)), hashlib.sha256(told.encode()).hexdigest(), told))
    got = queries.op13_pii(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    clash = pii.personal_spans(docs.withColumn("pii_spans", F.lit(1)))
    assert clash.columns == [*docs.columns, "pii_spans"] and clash.count() == docs.count()
    assert pii.personal_spans(no_docs).count() == 0
    hidden = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()}
    assert hidden == {1: "[EMAIL] [IP], [CARD] [PHONE]", 2: "é" * 70000 + " [EMAIL]"}
    assert pii.redact(docs).columns == docs.columns
