"""Toxicity, mixing, embeddings and the pipeline."""

import random

import numpy as np
import pytest

from limnoscope.llm import embedding_dedup, mixing, toxicity
from tests.llm.conftest import SCHEMA, prose

INSULTS = ("idiot", "scoundrel", "worthless", "trashbag")


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        text, bad = prose(rng, 80), i % 6 == 0
        if bad:
            words = text.split(" ")
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_kernel_is_the_sum_over_subsequences():
    def brute(x, y):
        def parts(w):
            w = [0, *[int(toxicity.CODES[b]) for b in w], 0]
            out = {}
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, len(w)):
                        for m in range(k + 1, min(i + toxicity.SPAN, len(w))):
                            key = (w[i], w[j], w[k], w[m])
                            out[key] = out.get(key, 0) + toxicity.DECAY ** (m - i + 1)
            return out
        u, v = parts(x), parts(y)
        norm = [np.sqrt(toxicity._lengths_norm(np.array([len(w) + 2])) ** 2)[0] for w in (x, y)]
        return sum(a * v.get(k, 0) for k, a in u.items()) / norm[0] / norm[1]

    for x, y in ((b"idiot", b"idiot"), (b"idiot", b"idxiot"), (b"banana", b"bandana"), (b"a", b"a"), (b"abcd", b"wxyz")):
        assert toxicity.kernel(x, y) == pytest.approx(brute(x, y))
    assert toxicity.kernel(b"idiot", b"idxiot") > 5 * toxicity.kernel(b"idiot", b"radio")
    assert toxicity.kernel(b"idiot", b"id.iot") == toxicity.kernel(b"idiot", b"idiot")


def test_toxic_texts_are_told_apart(spark, labelled, docs, no_docs, corpus):
    rows, labels = labelled
    model = toxicity.fit(rows, labels.where("doc_id < 480"))
    held = {r.doc_id: r.score for r in model.score(rows.where("doc_id >= 480")).collect()}
    assert sum((s >= 0.5) == (i % 6 == 0) for i, s in held.items()) >= 117
    gapped = [(1, "the of sco.undrel and in"), (2, "he is an idixot and an idioot. wortthless"), (3, "the of and to in is that")]
    bad = {r.doc_id: r.score for r in model.score(spark.createDataFrame(gapped, "doc_id long, text string")).collect()}
    assert bad[1] > 0.5 and bad[2] > bad[3] and bad[3] < 0.5
    # held-out insults with a letter or a mark put in
    rng, toxic, altered = random.Random(8), rows.where("doc_id >= 480 and doc_id % 6 = 0").collect(), []
    for r in toxic:
        words = [w if w not in INSULTS else w[:at] + rng.choice("-.*xqz") + w[at:]
                 for w in r.text.split(" ") for at in [rng.randrange(1, max(len(w), 2))]]
        altered.append((r.doc_id, " ".join(words)))
    found = model.score(spark.createDataFrame(altered, "doc_id long, text string")).where("score >= 0.5").count()
    assert found >= 0.9 * len(toxic)
    scored = model.score(docs, score_col="toxicity")
    assert scored.columns == [*docs.columns, "toxicity"]
    got = scored.collect()
    assert len(got) == len(corpus) and all(0 <= r.toxicity <= 1 for r in got)
    assert model.score(no_docs, score_col="toxicity").count() == 0
    # nothing to learn from
    for part, share in ((labels.where("toxic = 0"), 0.0), (labels.where("false"), 0.0), (labels.where("toxic = 1"), 1.0)):
        constant = toxicity.fit(rows, part).score(rows.limit(3))
        assert {r.score for r in constant.collect()} == {share}
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    assert toxicity.fit(rows, odd).share == 0.0


def test_mixing_meets_targets_within_bounds(spark, docs, no_docs, corpus):
    rng = random.Random(2)
    rows = [(i, ("x, y | # " if i % 5 == 0 else "") * 30 + prose(rng, 60)) for i in range(400)] + [(None, None), (7, None), (8, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    domains = spark.createDataFrame([(i, "code" if i % 5 == 0 else "prose") for i in range(0, 400, 3)] + [(None, "code"), (5, None)],
                                    "doc_id long, domain string")
    mix, rates = mixing.fit_mix(table, domains, {"code": 0.6, "prose": 0.4})
    got = rates.collect()
    assert len(got) == len(rows) and all(0 <= r.rate <= 16 for r in got)
    reached = [sum(r.rate * r.n_tokens * r[f"p{k}"] for r in got) for k in range(2)]
    total = sum(r.n_tokens for r in got)
    assert reached == pytest.approx([0.6 * total, 0.4 * total], abs=2e-3 * total)
    assert all(r.p0 + r.p1 == pytest.approx(1) for r in got)
    again = {r.doc_id: r._rate for r in mix.apply(table).collect() if r.doc_id is not None}
    assert all(again[r.doc_id] == pytest.approx(r.rate, abs=1e-9) for r in got if r.doc_id is not None and r.doc_id > 8)
    bounded, _ = mixing.fit_mix(table, domains, {"code": 0.6, "prose": 0.4}, budget=1.25, least=1.0, most=3.0)
    copies = bounded.repeat(table)
    assert copies.columns == table.columns and copies.select("doc_id").distinct().count() == table.select("doc_id").distinct().count()
    with pytest.raises(ValueError):
        mixing.fit_mix(table, domains, {"other": 1.0})
    none, rates = mixing.fit_mix(docs, domains.where("false"))
    assert none.classifier.domains == [""] and rates.count() == len(corpus)
    assert none.repeat(docs).columns == docs.columns
    empty, rates = mixing.fit_mix(no_docs, domains)
    assert rates.count() == 0 and empty.repeat(no_docs).count() == 0


def test_pipeline_mix_asks_for_square_root_shares(spark, tmp_path, monkeypatch):
    import corpus_pipeline as pipeline

    rng = random.Random(3)
    rows = [(i, ("x, y | # " if i % 8 == 0 else "") * 12 + prose(rng, 60)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(i, int(i % 8 != 0)) for i in range(0, 400, 2)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, fit = [], mixing.fit_mix
    monkeypatch.setattr(mixing, "fit_mix", lambda *a, **b: seen.append(fit(*a, **b)) or seen[-1])
    pipeline.mix_domains(spark, table, str(tmp_path))
    (mix, rates), = seen
    got = rates.collect()
    total = sum(r.n_tokens for r in got)
    root = [sum(r.n_tokens * r[f"p{k}"] for r in got) ** 0.5 for k in range(2)]
    assert list(mix.targets.values()) == pytest.approx([1.25 * total * r / sum(root) for r in root])
    # reached against wanted: met, or all that the bound on rates allows
    assert list(mix.reached.values()) == pytest.approx([sum(r.rate * r.n_tokens * r[f"p{k}"] for r in got) for k in range(2)])
    assert list(mix.reached.values()) == pytest.approx(list(mix.targets.values()), abs=0.01 * total)
    assert all(1 <= r.rate <= 4 for r in got)


def test_mixing_uses_no_python_in_its_plans(docs, spark):
    domains = spark.createDataFrame([(i, str(i % 2)) for i in range(40)], "doc_id long, domain string")
    mix, rates = mixing.fit_mix(docs, domains)
    for frame in (rates, mix.repeat(docs)):
        plan = frame._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_repeat_computes_features_once(docs, spark):
    domains = spark.createDataFrame([(i, str(i % 2)) for i in range(40)], "doc_id long, domain string")
    mix, _ = mixing.fit_mix(docs, domains)
    plan = mix.repeat(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") <= 2 * len(mixing.COUNTED)


def reference_links(vectors, threshold):
    ok = [i for i, (_, v) in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0]
    links = []
    for a in ok:
        for b in ok:
            x, y = np.array(vectors[a][1], float), np.array(vectors[b][1], float)
            if a < b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links.append((a, b))
    return links


def test_near_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(200 + i, (base[i] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(40)]
    rows += [(300 + i, (base[3] + 0.28 * rng.standard_normal(16)).tolist()) for i in range(30)]  # some linked, some not
    rows += [(400 + i, base[60].tolist()) for i in range(25)] + [(500, (2 * base[60]).tolist())]
    rows += [(600, None), (601, []), (602, [0.0] * 16), (603, [1.0, None] * 8), (604, [float("nan")] + [1.0] * 15), (605, [float("inf")] * 16),
             (606, base[4][:8].tolist()), (None, base[5].tolist()), (None, None), (1, base[1].tolist())]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string").repartition(4)
    links = reference_links(rows, 0.9)
    degree = np.zeros(len(rows), int)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        degree[a] += 1
        degree[b] += 1
        root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = sorted(((i, int(degree[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)
    got = embedding_dedup.near_vectors(frame).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_vectors(frame.where("false")).count() == 0
    assert embedding_dedup.passes_for(10 ** 9, 0.9) > embedding_dedup.passes_for(10 ** 4, 0.9) > 3


def test_recall_on_pairs_near_the_threshold(spark):
    rng = np.random.default_rng(8)
    a = embedding_dedup.unit(rng.standard_normal((1500, 32)))
    side = rng.standard_normal((1500, 32))
    side = embedding_dedup.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    cosine = rng.uniform(0.9001, 0.95, 1500)[:, None]
    b = cosine * a + np.sqrt(1 - cosine ** 2) * side
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([a, b]))]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in got) >= 0.9 * 3000
    assert all(r.n_links <= 1 for r in got)


def test_pipeline_stages(spark, docs, corpus, labelled, tmp_path):
    import corpus_pipeline as pipeline

    rows, labels = labelled
    folder = str(tmp_path)
    extra = rows.selectExpr("doc_id + 1000 as doc_id", "text", *[f"cast(null as {t.split(' ')[1]}) as {t.split(' ')[0]}" for t in SCHEMA.split(", ")[2:]])
    docs.unionByName(extra).write.parquet(f"{folder}/documents.parquet")
    labels.selectExpr("doc_id + 1000 as doc_id", "1 as quality", "toxic").write.parquet(f"{folder}/labels.parquet")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {"start": {r.doc_id for r in table.collect()}}
    for name, stage in pipeline.STAGES:
        out = stage(spark, table, folder)
        assert name == "packing" or out.columns == table.columns
        out.write.parquet(f"{folder}/{name}")
        table = spark.read.parquet(f"{folder}/{name}")
        ids[name] = {r.doc_id for r in table.select("doc_id").collect()}
    toxic = {i for i in ids["start"] if i is not None and i >= 1000 and i % 6 == 1000 % 6}
    assert len(toxic & ids["toxicity"]) <= 5 and len(ids["start"] - toxic - ids["toxicity"]) <= 5
    near = {7, *range(100, 112)}, {9, *range(200, 208)}
    assert all(len(group & ids["ngram_jaccard"]) == 1 for group in near)
    assert ids["suffix_dedup"] == ids["ngram_jaccard"] == ids["mixing"] == ids["packing"]
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/suffix_dedup").collect()}
    assert all(len(text[300 + i]) < len(dict(corpus)[300 + i]) - 300 for i in range(10) if 300 + i in text)
    # a table without rows passes through
    nothing = docs.where("false")
    for _, stage in pipeline.STAGES:
        nothing.write.parquet(f"{folder}/none-{stage.__name__}")
        nothing = stage(spark, spark.read.parquet(f"{folder}/none-{stage.__name__}"), folder)
    assert nothing.count() == 0


def test_many_domains_and_clashing_names(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 20), i, i, i, "t") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _X0 long, _p0 long, _rate long, _times string")
    domains = spark.createDataFrame([(i, f"d{i % 80}") for i in range(400)] + [(i, "large") for i in range(100)], "doc_id long, domain string")
    model = mixing.fit_classifier(docs, domains)
    assert len(model.domains) == mixing.MOST_DOMAINS and "large" in model.domains and mixing.OTHER in model.domains
    assert "d79" in mixing.fit_classifier(docs, domains, named=("d79",)).domains
    mix, _ = mixing.fit_mix(docs, domains.where("domain in ('d1', 'd2')"), least=1.0, most=3.0, rounds=2)
    again = mix.repeat(docs)
    assert again.columns == docs.columns
    assert {tuple(r) for r in again.collect()} == set(rows)
