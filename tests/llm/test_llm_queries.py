import pytest
from compare import connect, same
from condense.llm.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, name):
    assert same(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE_SQL[name]) == 200


def test_names():
    import re

    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 11))


def test_pipeline(spark):
    """Each stage against a plain form on its own input."""
    import brute
    import corpus_pipeline as C
    from condense.llm import blocks, classifier

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    held = {}
    for name, stage in C.STAGES:
        out = blocks.materialized(stage(spark, docs, FOLDER))
        held[name] = (docs, out)
        docs = out
        if name != "tokens":
            assert out.columns == list(C.COLUMNS)
    rows = lambda df: [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]
    before, after = held["quality"]
    scores = classifier.quality(before, labels).where("predicted = 1")
    assert rows(scores) == rows(after)
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    kept = [i for i, _ in rows(after)]
    assert sum(i in bad for i in kept) <= 0.25 * len(bad) and len(kept) >= 0.7 * len(rows(before))  # under a hundred labels here
    before, after = map(rows, held["lines"])
    want = {i: w[2] for (i, _), w in zip(before, brute.lines(before, 3, C.PASSAGE), strict=True)}
    assert after == [(i, want[i]) for i, t in before if want[i].strip() or want[i] == t]
    before, after = map(rows, held["copies"])
    part = brute.jaccard(before, 5, 80, 100)
    assert [i for i, _ in after] == [i for (i, _), p in zip(before, part, strict=True) if p[1] == i]
    before, after = map(rows, held["benchmark"])
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    assert [i for i, _ in after] == [i for (i, _), w in zip(before, brute.contamination(before, items, 10), strict=True) if not w[4]]
    before, after = held["tokens"]
    assert after.count() == before.count() and not after.where("NOT round_trip").count()
