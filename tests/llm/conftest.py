import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, shard string, pos string"


def vocabulary(rng, n=400):
    return ["".join(rng.choice(("th", "er", "on", "an", "re", "é", "ß", "ing")) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def fixture_rows():
    """Copies, near copies with random edits, passages in many texts, repeated lines, odd texts; ids with gaps, a null and a repeat."""
    rng = random.Random(7)
    v = vocabulary(rng)
    prose = lambda n: [rng.choice(v) for _ in range(n)]
    texts = []
    for _ in range(12):
        texts.append(" ".join(prose(rng.randint(5, 120))))
    base = prose(150)
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(v[:20])
        texts.append(" ".join(copy))
    texts += [texts[0]] * 5 + [texts[13].upper()]
    passage = " ".join(prose(60))
    for _ in range(12):
        texts.append(" ".join(prose(20)) + "\n" + passage + "\n" + " ".join(prose(15)))
    few = [" ".join(prose(6)) for _ in range(6)]
    for _ in range(14):
        texts.append("\n".join(rng.choice(few) for _ in range(rng.randint(1, 12))))
    texts += ["", None, " ", "\n\n", "word", "Le " * 200, "x" * 5000, "a\x00b é😀 ▁   tab\there\r\n", "mail me.x@mail.example.com or 10.0.0.1, +49 (30) 1234567 4111 1111 1111 1111 ok", "one two three", "one two three", "<0x0A> lit", "  two  spaces   three "]
    texts.append(" ".join(prose(30_000)))
    rows = [(3 * i + 1, t, ("en", "de", None)[i % 3], "s", None) for i, t in enumerate(texts)]
    rows.append((None, texts[1], "en", None, None))
    rows.append((None, texts[14], "en", None, None))
    rows.append(rows[20])
    rng.shuffle(rows)
    return [(*r, "x", "y", "z", "p") for r in rows]


@pytest.fixture(scope="session")
def docs(spark, fixture_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(fixture_rows, KINDS).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def pairs(docs):
    """Rows as the table gives them: (doc_id, text)."""
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    docs.where("false").write.parquet(path)
    return spark.read.parquet(path)
