"""Every corpus operator against its plain form, on a small table with all odd cases."""

import hashlib
import re
from collections import Counter

import brute
import numpy as np
import pytest
from condense.llm import blocks, classifier, decontaminate, jaccard, linedup, perplexity, pieces, pii, sharding, substring, suffixes, textkit
from condense.llm.graph import components
from pyspark.sql import functions as F


def bag(rows):
    return Counter(map(repr, rows))


def test_text_kit():
    texts = ["ab  cd\n", "", "é x", "cd"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    starts, ends, bounds = textkit.spans(buf, offsets, textkit.SPACED)
    assert [buf[s:e].tobytes().decode() for s, e in zip(starts, ends, strict=True)] == ["ab", "cd", "é", "x", "cd"]
    assert bounds.tolist() == [0, 2, 2, 4, 5]
    h = textkit.span_hashes(buf, starts, ends)
    assert h[1] == h[4] and len(set(h.tolist())) == 4
    assert textkit.windows(h, 3)[0] != textkit.windows(h, 3)[1] and textkit.windows(h, 5).size == 1 and textkit.windows(h, 6).size == 0
    s, e, b = textkit.line_spans(buf, offsets)
    assert [buf[i:j].tobytes().decode() for i, j in zip(s, e, strict=True)] == ["ab  cd", "", "", "é x", "cd"] and b.tolist() == [0, 2, 3, 4, 5]


def test_packing():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (blocks.unpack_sorted(blocks.pack_sorted(values)) == values).all()
    assert blocks.unpack_sorted(blocks.pack_sorted(values[:0])).size == 0


@pytest.mark.parametrize("k, num, den, tile", [(4, 85, 100, 1024), (5, 80, 100, 7), (2, 50, 100, 5)])
def test_jaccard(docs, pairs, k, num, den, tile, monkeypatch):
    """Sets, components and links; a small tile cuts components into many pairs of parts."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    got = jaccard.jaccard_components(docs, k=k, num=num, den=den).collect()
    assert bag((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == bag((i, *w) for (i, _), w in zip(pairs, brute.jaccard(pairs, k, num, den), strict=True))


def test_distinct_documents(docs, pairs):
    """One row of each component stays, rows with null ids included, and other columns with it."""
    got = jaccard.distinct_documents(docs)
    assert got.columns == docs.columns
    numbered = [(i if i is not None else 10**6 + at, t) for at, (i, t) in enumerate(pairs)]
    seen, want = set(), []
    numbered.sort(key=lambda x: x[0])
    for (i, t), (n, component, _) in zip(numbered, brute.jaccard(numbered, 5, 80, 100), strict=True):
        if not n or component not in seen:
            want.append((None if i >= 10**6 else i, t))
        seen.add(component)
    assert bag((r.doc_id, r.text) for r in got.collect()) == bag(want)


def test_rows_are_told_apart(spark):
    """Different texts that share a doc_id or have none stay apart; copies among them go together."""
    word = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(None, word("a", 30)), (None, word("b", 30)), (None, word("a", 30)), (7, word("c", 30)), (7, word("d", 30)), (3, word("d", 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = bag((r.doc_id, r.component_id, r.n_links) for r in jaccard.jaccard_components(df).collect())
    assert got == bag([(None, None, 1), (None, None, 0), (None, None, 1), (7, 7, 0), (7, 3, 1), (3, 3, 1)])
    kept = bag((r.doc_id, r.text[0]) for r in jaccard.distinct_documents(df).collect())
    assert kept == bag([(None, "a"), (None, "b"), (7, "c"), (3, "d")])


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {i: 100 for i in range(100, 141)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substrings(docs, pairs):
    got = substring.substring_dedup(docs)
    assert set(docs.columns) < set(got.columns)
    want = brute.substrings(pairs, 20)
    assert sum(w[1] for w in want) > 0
    assert bag((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()) == bag((i, *w) for (i, _), w in zip(pairs, want, strict=True))


def test_suffixes(docs, pairs):
    short = docs.where("text is null or length(text) < 20000")
    rows = [(i, t) for i, t in pairs if t is None or len(t) < 20000]
    want = brute.suffixes(rows, 50)
    got = suffixes.suffix_dedup(short)
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == bag((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_multikey_sort():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (500, 11), dtype=np.uint8)
    order, starts = suffixes.multikey_groups(rows)
    groups = [sorted(g.tolist()) for g in np.split(order, starts[1:])]
    want: dict = {}
    for i, r in enumerate(rows):
        want.setdefault(r.tobytes(), []).append(i)
    assert sorted(groups) == sorted(v for v in want.values() if len(v) > 1)


@pytest.mark.parametrize("k, w, words", [(2, 2, None), (1, 1, None), (1, 3, None), (2, 2, 50)])
def test_lines(docs, pairs, k, w, words):
    got = linedup.line_dedup(docs, k=k, w=w, words=words)
    want = brute.lines(pairs, k + w - 1, words)
    assert sum(x[1] for x in want) > 0
    assert bag((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got.collect()) == bag((i, *x) for (i, _), x in zip(pairs, want, strict=True))
    if words:  # a passage of 60 words alone on a line of 12 texts stays once
        passage = Counter(x for _, t in pairs for x in (t or "").split("\n") if len(brute.words(x)) == 60).most_common(1)[0]
        assert passage[1] == 12 and sum(passage[0] in (x[2] or "") for x in want) == 1


def test_lines_of_rows_that_share_an_id(spark):
    """Rows with one doc_id, or none, lose only lines that repeat."""
    rows = [(1, "a\nb\nc\nd"), (7, "a\nb\nc\nq"), (7, "m1\nm2\nm3\nm4"), (None, "a\nb\nc\nz"), (None, "n1\nn2\nn3\nn4"), (None, "n1\nn2\nn3\nn4"), (7, "m1\nm2\nm3\nm4")]
    got = linedup.line_dedup(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, N_Lines string"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    want = [(1, "a\nb\nc\nd", 4, 0), (7, "q", 4, 3), (None, "z", 4, 3)] + [(7, rows[2][1], 4, 0), (None, rows[4][1], 4, 0)] * 2
    assert bag(map(tuple, got.collect())) == bag(want)


def test_lines_is_native(docs):
    plan = linedup.line_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_decontamination(spark, docs, pairs):
    source = [t for _, t in pairs if t and len(t.split()) > 40][:5]
    items = [(i, " ".join(t.split()[5:30])) for i, t in enumerate(source)] + [(100, "one two three"), (101, ""), (102, None), (11, source[0]), (11, source[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(pairs, items, 10)
    assert any(w[4] for w in want)
    for most in (200_000, 25):
        decontaminate.MAX_PATTERNS, old = most, decontaminate.MAX_PATTERNS
        try:
            got = decontaminate.contamination(docs, bench).collect()
        finally:
            decontaminate.MAX_PATTERNS = old
        assert bag((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == bag((i, *w) for (i, _), w in zip(pairs, want, strict=True))
    assert not decontaminate.contamination(docs, bench.where("false")).where("contaminated").count()


def test_suffix_buckets():
    """Only the patterns of a bucket are compared, however many there are."""
    words = [f"w{i}".encode() for i in range(40)]
    patterns = {tuple(words[(i + j) % 40] for j in range(10)): [i] for i in range(40)}
    search = decontaminate.Search(patterns)
    text = b" ".join(words * 3)
    buf = np.frombuffer(text, np.uint8)
    starts, ends, bounds = textkit.spans(buf, np.array([0, buf.size]), textkit.ALNUM)
    found = search.find(buf, starts, ends, textkit.span_hashes(buf, starts, ends), bounds)
    assert sorted(found) == [(i, i % 40) for i in range(111)]
    assert np.unique(search.keys).size == 40 and (search.shift == 0).sum() == 40


def test_decontamination_null_item(spark):
    """A null item_id hits like others, as in the SQL; only the ids leave it out."""
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x y z"), (3, "c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "b c"), (None, "c d"), (7, "a b")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated, r["items"], r.items_sha256) for r in decontaminate.contamination(docs, bench).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {1: (4, 2, True, ["7"], sha("7")), 2: (0, 0, False, [], sha("")), 3: (2, 1, True, [], sha(""))}


def test_pii(docs, pairs):
    got = {(r.doc_id, r.hash): [tuple(s) for s in r.base] for r in pii.pii_spans(docs).collect()}
    hashes = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    for i, t in pairs:
        assert got[(i, hashes[(i, t)])] == brute.pii(t)


ODD = ["a@b.c..d@e.f", "..a@b.c.d-@q.w", "1.2.3.4.5.6.7.8", "999.1.1.1", "4111-1111-1111-1111 1", "4111  1111 1111 1111", "+1 (555) 123-4567.", "+12", "a@b.c_d@e.f", "x\x01\x02@\x04.\x05z a@b.c", "é😀 a@b.c 😀 +49 1234567", "0001.002.3.255", "a" * 50_000, "1 " * 30_000, "1." * 20_000, "a.b@c." * 3000 + "d"]


def test_pii_odd(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "i int, t string")
    for r in df.select("t", pii.base_spans(F.col("t")).alias("s")).collect():
        assert [(x.kind, x.start, x.end) for x in r.s] == brute.pii(r.t), r.t[:40]


def test_pii_terms(spark):
    """A word that stands by one address alone is marked there; one that is everywhere is not."""
    rows = [(i, f"common words and Zanzibar near bob@corp.example here {i}") for i in range(6)] + [(100 + i, f"common words and near others here {i}") for i in range(200)]
    found = {r.doc_id: [rows[r.doc_id][1][s.start : s.end] for s in r.terms] for r in pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).where("size(terms) > 0").collect()}
    assert set(found) == set(range(6)) and all(v == ["Zanzibar"] for v in found.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitised(docs, pii.pii_spans(docs)).collect()}
    assert clean[3] == "common words and  near <EMAIL> here 3" and clean[105] == rows[11][1]


def test_pii_terms_of_whole_texts(spark):
    """A term far from the value counts, entities are also groups, and each occurrence is marked, without the value too."""
    far = "common words " * 20
    rows = [(i, f"Zanzibar {far} user{i}@corp.example {far} zanzibar once{'abcdefgh'[i]}") for i in range(6)] + [(6, f"{far} zanzibar")] + [(100 + i, f"{far} others") for i in range(400)]
    text = dict(rows)
    found = {r.doc_id: [text[r.doc_id][s.start : s.end] for s in r.terms] for r in pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).where("size(terms) > 0").collect()}
    assert found == {i: ["Zanzibar", "zanzibar"] for i in range(6)} | {6: ["zanzibar"]}


def test_quality_rules(docs, pairs):
    got = perplexity.quality_rules(docs).collect()
    assert bag((r.doc_id, *(r[c] for c in perplexity.STATS), r.base_failed) for r in got) == bag((i, *brute.statistics(t)) for i, t in pairs)
    assert all(not (r.kept and r.base_failed) for r in got)


def test_quality_rules_leave_texts_in_place(spark, docs, monkeypatch, tmp_path):
    """Answers come to the blocks by the one exchange of the job that scores; nothing stays in the catalogue."""
    docs.write.parquet(f"{tmp_path}/docs")
    plans, write = [], blocks.materialized

    def seen(df, *a):
        if "base_failed" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *a)

    monkeypatch.setattr(blocks, "materialized", seen)
    for table in (docs, spark.read.parquet(f"{tmp_path}/docs")):
        assert perplexity.quality_rules(table).count() == docs.count()
    assert [p.count("Exchange ") for p in plans] == [1, 1]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("condense")]


def test_perplexity_of_all_documents(docs):
    """Log-perplexities, bands and kept against a plain model."""
    rows = [(r.text, r.lang) for r in docs.collect()]
    want = brute.kneser_ney(rows, 4)
    got = perplexity.quality_rules(docs).collect()
    assert len(got) == len(rows)
    close = lambda a, b: len(a) == len(b) and all(abs(x - y) < 3e-4 for x, y in zip(a, b))
    for lang in {x for _, x in rows}:
        mine = sorted(list(r.log_perplexities) for r in got if r.lang == lang and r.log_perplexity is not None)
        theirs = sorted([want[t, x][k - 1] for k in (1, 2, 4)] for t, x in rows if x == lang and (t, x) in want)
        assert len(mine) == len(theirs) and all(any(close(a, b) for b in theirs) for a in mine) and all(any(close(a, b) for a in mine) for b in theirs)
    for lang in {x for _, x in rows}:
        mine = [r for r in got if r.lang == lang]
        for k, judged in enumerate((1, 2, 4)):
            good = sorted(want[t, x][judged - 1] for t, x in rows if x == lang and not brute.statistics(t)[-1])
            q = [good[max(0, -(-p * len(good) // 4) - 1)] for p in (1, 2, 3)]
            low, high = q[0] - 10 * max(q[1] - q[0], 0.005), q[2] + 10 * max(q[2] - q[1], 0.005)
            assert all(abs(r.low[k] - low) < 1e-2 and abs(r.high[k] - high) < 1e-2 for r in mine)
        assert all(r.kept == (not r.base_failed and all(a <= x <= z for a, x, z in zip(r.low, r.log_perplexities, r.high))) for r in mine)


def test_kneser_ney_sums_to_one(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["abc abd abe ab b c", "abc abc a", "xyz xa"] * 3)], "doc_id long, text string, lang string")
    counts = blocks.materialized(perplexity.gram_counts(perplexity.sent_grams(blocks.block_table(df), 3, 5), 3))
    probs, backs = perplexity.kneser_ney(counts, 3)
    tables = [{r.gram: np.exp(r.logp) for r in p.collect()} for p in probs]
    weights = [{r.context: np.exp(r.logb) for r in b.collect()} for b in backs]

    def prob(context, byte, k):
        if k == 0:
            return 1 / 256
        gram = ((context & ((1 << 8 * (k - 1)) - 1)) << 8) | byte
        if gram in tables[k - 1]:
            return tables[k - 1][gram]
        return weights[k - 1].get(gram >> 8, 1.0) * prob(context, byte, k - 1)

    for context in (int.from_bytes(b"ab", "big"), int.from_bytes(b"  ", "big"), int.from_bytes(b"zz", "big")):
        assert abs(sum(prob(context, b, 3) for b in range(256)) - 1) < 1e-6


def test_perplexity_rejects_junk(spark):
    """Made junk of three kinds goes, though each kind is learned with the corpus; prose stays."""
    import random

    rng = random.Random(2)
    v = ["".join(rng.choice(("th", "er", "on", "an", "re", "st", "ing")) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    prose = lambda n: [rng.choice(v) for _ in range(n)]
    texts = [" ".join(prose(rng.randint(60, 200))).capitalize() for _ in range(200)]
    junk = [" ".join(prose(100)).upper().replace(" ", "!! ") for _ in range(5)] + [" ".join(w + rng.choice(("&&&", "###")) for w in prose(100)) for _ in range(5)] + ["".join(chr(rng.randint(161, 700)) for _ in range(500)) + " x" * 30]
    got = {r.doc_id: r for r in perplexity.quality_rules(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts + junk)], "doc_id long, text string, lang string")).collect()}
    assert not any(got[200 + i].kept for i in range(len(junk))) and not any(got[200 + i].base_failed for i in range(10))
    assert sum(got[i].kept for i in range(200)) >= 198


def test_classifier(spark, docs):
    import random

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("good fine text is here now".split()) for _ in range(30)) + (" !!" * 8 if i % 4 == 0 else "")) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(400)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = classifier.quality(table, labels).withColumn("held", classifier.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.held]
    assert len(held) > 40 and np.mean([r.predicted == (r.doc_id % 4 > 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    odd = classifier.quality(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in classifier.quality(docs, labels.where("quality = 1")).collect()} == {1.0}


def test_classifier_on_held_out_labels(spark):
    """Accuracy on labels that training never saw, against the share of the commoner label."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).collect()}
    got = [r for r in classifier.quality(docs.withColumn("SCORE", F.lit("x")), labels).withColumn("held", classifier.held_out(F.col("doc_id"))).collect() if r.held and r.doc_id in truth]
    assert len(got) > 50 and "SCORE" not in got[0].asDict()
    right = sum(r.predicted == truth[r.doc_id] for r in got) / len(got)
    assert right > 0.95 and right > max(Counter(truth[r.doc_id] for r in got).values()) / len(got)


def test_held_out_fold(spark):
    import zlib

    got = {r.doc_id: r.h for r in spark.range(500).select(F.col("id").alias("doc_id"), classifier.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(500)}


def test_sharding(docs, pairs):
    got = sharding.shuffled_shards(docs, shards=7, bucket_bytes=4000).collect()
    assert bag((r.doc_id, r.text) for r in got) == bag(pairs)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert all(r["size"] == len((r.text or "").encode()) + 16 for r in got)
    again = sharding.shuffled_shards(docs.repartition(3), shards=7, bucket_bytes=4000).collect()
    assert bag((r.doc_id, r.text, r.shard, r.slot) for r in got) == bag((r.doc_id, r.text, r.shard, r.slot) for r in again)


def test_sharding_by_plain_passes(spark, docs):
    """Both passes in plain Python: scatter by the seeded hash, then the last place changes with a random one before it, and so on."""
    rows = docs.select("doc_id", "text", F.xxhash64(F.lit(2024), "doc_id", "text").alias("h"), F.xxhash64("doc_id", "text", F.lit(1)).alias("o")).collect()
    mass = sum(len((r.text or "").encode()) + 16 for r in rows)
    n = max(1, -(-mass // 4000), 4)
    buckets = [[] for _ in range(n)]
    for r in rows:
        buckets[r.h % n].append(r)
    want, at = Counter(), 0
    for b, bucket in enumerate(buckets):
        bucket.sort(key=lambda r: (r.o, brute.order(r.doc_id)))
        order = sharding.fisher_yates(len(bucket), 2024, b)
        assert sorted(order.tolist()) == list(range(len(bucket)))
        for i in order.tolist():
            want[repr((bucket[i].doc_id, bucket[i].text, at % 7, at // 7))] += 1
            at += 1
    got = sharding.shuffled_shards(docs, shards=7, bucket_bytes=4000).collect()
    assert bag((r.doc_id, r.text, r.shard, r.slot) for r in got) == want


def test_fisher_yates_is_uniform():
    times = Counter(tuple(sharding.fisher_yates(3, 1, b).tolist()) for b in range(6000))
    assert len(times) == 6 and all(850 < n < 1150 for n in times.values())


def test_write_shards(spark, docs, pairs, tmp_path):
    """Each shard is a folder whose rows lie in the order of slots."""
    sharding.write_shards(docs, str(tmp_path / "out"), shards=5, bucket_bytes=4000)
    found = []
    for s in range(5):
        part = spark.read.parquet(str(tmp_path / "out" / f"shard={s}")).collect()
        assert [r.slot for r in part] == list(range(len(part)))
        found += [(r.doc_id, r.text) for r in part]
    assert bag(found) == bag(pairs)


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_pieces(docs, pairs):
    """Ids are the ones of the model's own library, and decode to the text."""
    sp = library()
    encoded = pieces.encode(docs)
    got = encoded.collect()
    assert all(r.round_trip for r in got) and set(docs.columns) < set(encoded.columns)
    plain = [(i, t) for i, t in pairs if pieces.META not in (t or "")]
    sha = lambda ids: hashlib.sha256(str(list(ids)).encode()).hexdigest()
    assert len(plain) == len(pairs) - 1
    assert bag((r.doc_id, sha(r.ids), r.n_tokens) for r in got if pieces.META not in (r.text or "")) == bag((i, sha(x), len(x)) for i, t in plain for x in [sp.encode(t or "")])
    back = pieces.decode(encoded.select("doc_id", "ids")).collect()
    assert bag((r.doc_id, r.text) for r in back) == bag((i, t or "") for i, t in pairs)


def test_every_piece_comes_out_whole(spark):
    """What makes one pass over the ranks exact; and units that are no words: runs, joined pieces, other scripts, long ones."""
    import random

    rng, v, sp = random.Random(5), pieces.Vocabulary(), library()
    texts = [t for _, t, _ in v.rows if pieces.META not in t]
    made = ["".join(rng.choice(texts).strip() for _ in range(rng.randint(2, 40))) for _ in range(2000)] + ["x" * n for n in (61, 62, 63, 64, 125, 126, 127, 10_000)]
    made += [" " * n + "ab" for n in range(70)] + ["".join(rng.choice("abcdefghij0123456789") for _ in range(10_000)), "日本語のテキスト" * 40, "ไทย" * 50, "é" * 500, "0123456789abcdef" * 30, "a\tb\r\nc\x00"]
    rows = list(enumerate([*(t.removeprefix(" ") for t in texts), *made]))
    got = {r.doc_id: r for r in pieces.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = [t for i, t in rows if list(got[i].ids) != sp.encode(t)]
    assert not wrong and all(r.round_trip for r in got.values())
    place = {t: p for t, p in v.table()}
    for t in (rng.choice(made[:2000]) for _ in range(100)):
        assert [x for x in brute.merge(f" {t}", place)] == [p.replace(pieces.META, " ") for p in sp.encode(t, out_type=str) if not p.startswith("<0x")] or any(p.startswith("<0x") for p in sp.encode(t, out_type=str))


def test_viterbi(spark):
    """Where scores are probabilities, the best path of the lattice."""
    import random

    rng = random.Random(8)
    letters = "abcd"
    table = {c: -rng.uniform(3, 6) for c in "abc"} | {"".join(rng.choice(letters[:3]) for _ in range(rng.randint(2, 5))): -rng.uniform(2, 9) for _ in range(60)}
    units = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 140))) for _ in range(80)})
    df = spark.createDataFrame(list(enumerate(units)), "uid long, unit string")
    got = {r.uid: [w * pieces.WORD + b for w, m in enumerate(r.mask) for b in range(pieces.WORD) if m >> b & 1] for r in pieces.segmented(df, list(table.items()), 5, False, 3).collect()}
    for i, u in enumerate(units):
        want = brute.viterbi(u, table, 5, min(table.values()) - 10)
        assert [u[a:z] for a, z in zip(got[i], got[i][1:])] == want


@pytest.mark.parametrize("apply", [
    lambda d, s: jaccard.jaccard_components(d), lambda d, s: substring.substring_dedup(d), lambda d, s: suffixes.suffix_dedup(d), lambda d, s: linedup.line_dedup(d), lambda d, s: pii.pii_spans(d),
    lambda d, s: perplexity.quality_rules(d), lambda d, s: sharding.shuffled_shards(d), lambda d, s: pieces.encode(d), lambda d, s: decontaminate.contamination(d, s.createDataFrame([], "item_id long, text string")),
    lambda d, s: classifier.quality(d, s.createDataFrame([], "doc_id long, quality int")),
])
def test_empty_table(spark, empty, apply):
    assert apply(empty, spark).count() == 0


@pytest.mark.parametrize("apply", [jaccard.jaccard_components, substring.substring_dedup, suffixes.suffix_dedup], ids=["op1", "op5", "op9"])
def test_blocks_survive_other_splits(spark, docs, apply, monkeypatch):
    """Executors that come or go between two jobs change how Spark splits the files; the rows don't change."""
    slim = docs.select("doc_id", "text").where("text is null or length(text) < 20000")
    want = bag(map(tuple, apply(slim).collect()))
    write, splits = blocks.materialized, iter([1, 9, 2, 16, 3, 30] * 20)

    def shifted(*args):
        out = write(*args)
        spark.conf.set("spark.sql.files.minPartitionNum", str(next(splits)))
        return out

    monkeypatch.setattr(blocks, "materialized", shifted)
    monkeypatch.setattr(blocks, "BLOCK", 1 << 12)
    try:
        assert bag(map(tuple, apply(slim).collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_suffixes_split_hot_heads(spark, monkeypatch):
    """Strings of a head that fills many buckets are dealt one by one, and none is lost."""
    rows = [(i, " " * 400 + f"x{i % 3} " * 30 + "-" * 200 + str(i) * 60) for i in range(30)]
    monkeypatch.setattr(suffixes, "EACH", 100_000)
    got = suffixes.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute.suffixes(rows, 50)
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == bag((i, *w) for (i, _), w in zip(rows, want, strict=True))
