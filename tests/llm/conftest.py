import random

import pytest

WORDS = "the of and to in is that for with as by on was are this anther ingtion erst ouble hanti thesh reand ononly".split()


def prose(rng: random.Random, n: int) -> str:
    """Sentences of common and of made-up words."""
    out = []
    for _ in range(n):
        word = rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice(["th", "er", "on", "an", "re", "ti", "sh", "é"]) for _ in range(rng.randint(2, 5)))
        out.append(word + (".\n" if rng.random() < 0.05 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Rows (doc_id, text): copies, near copies, a shared passage, nulls, empty, very long, repeated rows, odd bytes."""
    rng = random.Random(5)
    passage = prose(rng, 90)
    rows = [(i, prose(rng, rng.randint(30, 200))) for i in range(60)]
    for i in range(12):  # near copies of one text, one word changed in each
        words = rows[7][1].split(" ")
        words[rng.randrange(len(words))] = f"changed{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, rows[9][1]) for i in range(8)]
    rows += [(300 + i, prose(rng, 60) + " " + passage + " " + prose(rng, 60)) for i in range(10)]
    rows += [(400, None), (401, ""), (402, "  \n\t "), (403, "one"), (404, "One TWO"), (405, "one two"), (406, "ab " * 5000),
             (407, prose(rng, 9000)), (None, rows[9][1]), (None, None), (408, "İ ǅ\x00 x y \x1c z 日本語 é́"), (409, "# $ | <a> %\n# $ | <a> %\n\nx")]
    return rows + [rows[3], rows[3], (410, rows[11][1] + " "), (411, rows[11][1].upper())]


SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, row int, node string, key string, "
          "_id string, token array<int>, n int, rate string, set_id int, digest string, a int, length string")


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    """The corpus as a stored table, with extra columns whose names operators use inside."""
    rows = [(i, t, None if (i or 0) % 3 == 0 else "en", None, None if t is None else len(t), None, 1, "x", None, "y", [1], 2, "z", 3, None, 4, "w")
            for i, t in corpus]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
