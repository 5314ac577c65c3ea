"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A text's lines are its pieces between newlines.  A run of ``t`` consecutive lines that also starts
earlier (smaller doc_id, or same document, earlier line) is deleted, whole runs with all their
overlaps; runs are judged on the input.  With grams of ``k`` lines and windows of ``w`` grams every
match of t = k + w - 1 lines holds a common fingerprint: the least gram hash of each window.

1. fingerprints: for each document, the rightmost minimum of each window of w gram hashes;
2. positions join on equal fingerprints: only those that occur twice or more go on;
3. each such position is extended both ways: all runs of t lines that hold its gram are candidates,
   and the ones with equal lines anywhere else earlier are found by a grouped minimum of
   (doc_id, line) for each run, never by pairs of positions.  A run stands for its lines by two
   hashes of 64 bits, each over its own 64-bit hashes of the lines;
4. rows drop the lines that such runs cover.

Where a number of words is given, runs of fewer than t lines with at least so many words are candidates
as well, all of them, without fingerprints; so a long passage on one line is found like one on three.

Fingerprints are counted and first places found by partial aggregation, and joined back by plain
equi-joins, which split hot keys; so a passage that a third of all documents hold costs as much as
other rows.

Cases: a null text has no lines and stays null; an empty text is one empty line; documents of
fewer than t lines lose only runs with enough words; ties of doc_id and line (repeated rows) remove nothing from each
other; null doc_ids come after all others, as if all were one number; rows that share a doc_id or have none lose only
lines of their own text (rows are known by doc_id and a hash of the text, and equal rows fare alike); an empty table
gives no rows; extra columns stay, columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condense.llm.blocks import materialized

LAST = (1 << 63) - 1


def _lines(text) -> Column:
    return F.split(F.col(text) if isinstance(text, str) else text, "\n", -1)


def _runs(hashes: Column, size: int, seed: int) -> Column:
    """A hash of each run of size values; none for fewer."""
    n = F.size(hashes) - F.lit(size - 1)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(hashes, i, size), F.lit(seed)))).otherwise(F.array().cast("array<bigint>"))


def _run(at: Column, size: int) -> Column:
    """The run of size lines from the 1-based place at: its 0-based place and two hashes."""
    hashes = [F.xxhash64(F.slice(c, at, size), F.lit(seed)) for c, seed in (("h", 2), ("h2", 3))]
    return F.struct((at - 1).alias("at"), hashes[0].alias("a"), hashes[1].alias("b"), F.lit(size).alias("size"))


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """(id, row, x): what a row is known by, and its lines."""
    return docs.where(F.col(text).isNotNull()).select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64(text).alias("row"), _lines(text).alias("x"))


def _hashes() -> tuple[Column, Column]:
    return F.transform("x", lambda x: F.xxhash64(x)).alias("h"), F.transform("x", lambda x: F.xxhash64(x, F.lit(7))).alias("h2")


def _wordy(docs: DataFrame, most: int, words: int, text: str) -> DataFrame:
    """(id, row, at, a, b, size): all runs of 1 .. most lines that hold at least so many words."""
    count = F.transform("x", lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))).alias("c")
    rows = _keyed(docs, text).select("id", "row", *_hashes(), count)

    def runs(size: int) -> Column:
        total = lambda i: F.aggregate(F.slice("c", i, size), F.lit(0), lambda a, x: a + x)
        return F.when(F.size("h") >= size, F.transform(F.filter(F.sequence(F.lit(1), F.size("h") - (size - 1)), lambda i: total(i) >= words), lambda i: _run(i, size))).otherwise(F.array())

    each = [runs(size) for size in range(1, most + 1)]
    return rows.select("id", "row", F.explode(F.concat(*each)).alias("r")).select("id", "row", "r.*")


def repeated_lines(docs: DataFrame, k: int = 2, w: int = 2, text: str = "text", words: int | None = None) -> DataFrame:
    """(id, row, lines): the 0-based lines that later repeated runs cover, for rows that have any.

    words: shorter runs count too, down to single lines, where they hold at least so many words.
    """
    t = k + w - 1
    hashes = _keyed(docs, text).select("id", "row", *_hashes()).where(F.size("h") >= t)
    grams = hashes.select("id", "row", "h", "h2", _runs(F.col("h"), k, 1).alias("g"))
    # windows of w grams: the rightmost least one, as a place
    chosen = F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.size("g") - F.lit(w - 1)),
            lambda i: i + F.lit(w) - F.array_position(F.reverse(F.slice("g", i, w)), F.array_min(F.slice("g", i, w))).cast("int"),
        )
    )
    places = F.transform(chosen, lambda p: F.struct(F.element_at("g", p).alias("f"), p.alias("p")))
    # a run of t lines begins at most w - 1 grams before its fingerprint's gram
    begin = F.sequence(F.greatest(F.lit(1), F.col("m.p") - (w - 1)), F.least(F.col("m.p"), F.size("h") - (t - 1)))
    marks = grams.select("id", "row", "h", "h2", F.explode(places).alias("m")).select("id", "row", F.col("m.f").alias("f"), F.transform(begin, lambda i: _run(i, t)).alias("runs"))
    often = marks.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f")
    runs = marks.join(often, "f", "left_semi").select("id", "row", F.explode("runs").alias("r")).select("id", "row", "r.*")
    if words is not None and t > 1:
        runs = runs.unionByName(_wordy(docs, t - 1, words, text))
    runs = materialized(runs.distinct())
    first = runs.groupBy("a", "b").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = runs.join(first, ["a", "b"]).where(F.struct("id", "at") > F.col("first"))
    covered = F.collect_list(F.sequence("at", F.col("at") + (F.col("size") - 1)))
    return later.groupBy("id", "row").agg(F.array_sort(F.array_distinct(F.flatten(covered))).alias("lines"))


def line_dedup(docs: DataFrame, k: int = 2, w: int = 2, text: str = "text", words: int | None = None) -> DataFrame:
    """docs with repeated runs of lines deleted from the text, and n_lines, n_removed."""
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed", "__lines")]
    found = repeated_lines(docs, k, w, text, words).select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("lines").alias("__lines"))
    same = (F.coalesce(docs["doc_id"], F.lit(LAST)) == F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__row"))
    both = docs.select(*keep).join(found.hint("shuffle_hash"), same, "left")
    lines = _lines(text)
    kept = F.when(
        F.col("__lines").isNotNull(),
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__lines")), lambda i: F.get(lines, i)), "\n"),
    ).otherwise(F.col(text))
    out = [kept.alias(c) if c == text else F.col(c) for c in keep]
    return both.select(*out, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_removed"))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
runs AS (SELECT doc_id, i, x[i:i + 2] AS run FROM l, LATERAL (SELECT unnest(range(1, len(x) - 1)) AS i) WHERE len(x) >= 3),
firsts AS (SELECT *, min(struct_pack(d := doc_id, i := i)) OVER (PARTITION BY run) AS f FROM runs),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM firsts WHERE struct_pack(d := doc_id, i := i) > f) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(l.x), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(CASE WHEN ps IS NULL THEN d.text ELSE array_to_string([l.x[j] FOR j IN range(1, len(l.x) + 1) IF NOT list_contains(ps, j)], chr(10)) END, '')) AS kept_sha256
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
