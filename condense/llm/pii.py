"""Personal data: base patterns, and terms around them that give the protected value away.

Base spans are the leftmost non-overlapping matches of four patterns (email, ip, card, phone),
those that fail the value check dropped.  The value found is a protected entity.  By the
information-theoretic view a term t discloses an entity e as far as their pointwise mutual
information log2(p(e | t) / p(e)) nears the entity's own information -log2 p(e), which it reaches
when t never occurs without e.  Documents are the events, over the whole corpus and whole texts.
Besides the value itself, every mention stands for two wider entities: its group (an email's domain,
an address's first three bytes, a card's first six or a phone's first five digits) and its kind.

Terms are words of at least four letters.  A term is judged by the documents other than the one it
is found in: p(e | t) = (n_both - 1 + prior p(e)) / (n_term - 1 + prior), so what is seen together
in one document only tells nothing, however large the corpus, and there is no other least count.
Terms whose information on any entity is at least ``disclosure`` of the entity's own are telling;
every occurrence of one outside base spans is marked, in every document.
``sanitised`` generalises base spans to their kind and removes terms.

Everything is DataFrame functions.  Matches are found by one replacement with sentinels and one
split, so positions cost no second search; single characters that the patterns allow between others
are marked first, which leaves no repeated groups for Java's regular expressions to recurse on, and
possessive runs with look-behind keep long texts linear.  Sentinels in the input count as another
control character of the same length, which no pattern accepts.

Counts are partial aggregates and equi-joins on entity and term, so an entity or a word in a third
of all documents is no large group anywhere.  Entities and terms of a single document are left out of
the pairs; by the estimate above none of these could be telling.

Cases: null and empty texts have no spans; texts of any length are searched whole; null doc_ids and
repeated rows are documents like others (spans join on id and text hash); an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condense.llm.blocks import materialized

#: Telling terms that one broadcast holds at the most.
BROADCAST = 200_000
KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+\x05-]"
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _located(text: Column, pattern: str) -> Column:
    """Pieces of text: other text and matches in turn, beginning and ending with other text."""
    return F.split(F.regexp_replace(text, pattern, "\x01$0\x02"), "[\x01\x02]", -1)


def _spans(kind: str, pieces: Column, valid) -> Column:
    """Structs of the valid matches."""
    ends = F.aggregate(pieces, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
    both = F.struct(pieces.alias("p"), ends.alias("e"))
    # one evaluation of pieces and ends for all matches
    each = F.flatten(
        F.transform(
            F.array(both),
            lambda b: F.transform(
                F.filter(F.sequence(F.lit(1), F.size(b["p"]) - 2, F.lit(2)), lambda i: valid(F.get(b["p"], i))),
                lambda i: F.struct(F.lit(kind).alias("kind"), F.get(b["e"], i).alias("start"), F.get(b["e"], i + 1).alias("end"), F.get(b["p"], i).alias("value")),
            ),
        )
    )
    return F.when(F.size(pieces) > 2, each).otherwise(F.array().cast(_SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = _digits(value)
    n = F.length(d)

    def step(total: Column, i: Column) -> Column:
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int")
        double = 2 * x
        return total + F.when(i % 2 == 0, double - F.when(double > 9, 9).otherwise(0)).otherwise(x)

    return n.between(16, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0)


def _byte_parts(value: Column) -> Column:
    short = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))


def base_spans(text: Column) -> Column:
    """All base spans of a text in the order of kinds and starts."""
    text = F.coalesce(text, F.lit(""))
    clean = F.when(text.rlike(r"[\x01\x02\x04\x05]"), F.translate(text, "\x01\x02\x04\x05", "\x03\x03\x03\x03")).otherwise(text)
    none = F.array().cast(_SPAN)
    email = _located(F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "\x05"), rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]+\x05[A-Za-z0-9\x05-]+")
    ip = _located(clean, r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
    card = _located(F.regexp_replace(clean, "(?<=[0-9])[ -](?=[0-9])", "\x04"), r"[0-9][0-9\x04]+")
    phone = _located(clean, r"\+[0-9][ ().0-9-]+[0-9]")
    return F.concat(
        F.when(text.contains("@"), _spans("email", email, lambda v: F.lit(True))).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _spans("ip", ip, _byte_parts)).otherwise(none),
        F.when(text.rlike("[0-9](?:[ -]?[0-9]){15}"), _spans("card", card, _luhn)).otherwise(none),
        F.when(text.contains("+"), _spans("phone", phone, lambda v: F.length(_digits(v)).between(8, 15))).otherwise(none),
    )


def _terms(text: Column, telling: Column) -> Column:
    """All words of a text that are in telling, with their places."""
    pieces = _located(F.regexp_replace(text, r"[\x01\x02]", "\x03"), r"\p{L}++")
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x)
        mark = F.struct(F.lit("term").alias("kind"), a["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.array_contains(telling, F.lower(x)), F.concat(a["out"], F.array(mark))).otherwise(a["out"]).alias("out"))

    return F.aggregate(pieces, state, step, lambda a: a["out"])


def words_of(text: str) -> Column:
    """The distinct terms of a text, as counted over the corpus."""
    return F.array_distinct(F.split(F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}]+", " ")), " "))


def _entities(base: Column) -> Column:
    """The distinct values, groups and kinds of a document's spans, hashed."""

    def each(m: Column) -> Column:
        kind, value = m["kind"], m["value"]
        group = F.when(kind == "email", F.lower(F.substring_index(value, "@", -1))).when(kind == "ip", F.substring_index(value, ".", 3)).when(kind == "card", F.left(_digits(value), F.lit(6))).otherwise(F.left(_digits(value), F.lit(5)))
        return F.array(F.xxhash64(F.lit("value"), kind, value), F.xxhash64(F.lit("group"), kind, group), F.xxhash64(F.lit("kind"), kind))

    return F.array_distinct(F.flatten(F.transform(base, each)))


def _small(table: DataFrame) -> DataFrame:
    """A table written once; with a hint to broadcast it where it has few rows."""
    table = materialized(table)
    return F.broadcast(table) if table.count() <= BROADCAST else table


def telling_terms(docs: DataFrame, base: DataFrame, disclosure: float, prior: float) -> DataFrame:
    """The distinct terms that disclose an entity of base's spans."""
    holders = base.where(F.size("base") > 0).select("words", F.explode(_entities(F.col("base"))).alias("entity"))
    known = _small(holders.groupBy("entity").agg(F.count("*").alias("n_entity")).where("n_entity > 1"))
    words = holders.join(known, "entity").select("entity", "n_entity", F.explode("words").alias("term")).where(F.length("term") >= 4)
    pairs = words.groupBy("entity", "n_entity", "term").agg(F.count("*").alias("n_both")).where("n_both > 1")
    every = docs.select(F.explode(words_of("text")).alias("term")).where(F.length("term") >= 4).groupBy("term").agg(F.count("*").alias("n_term"))
    p = F.col("n_entity") / F.lit(float(base.count()))
    given = (F.col("n_both") - 1 + prior * p) / (F.col("n_term") - 1 + prior)
    # both in bits
    information, own = F.log2(given / p), -F.log2(p)
    return every.join(pairs, "term").where((own > 0) & (information >= disclosure * own)).select("term").distinct()


def pii_spans(docs: DataFrame, disclosure: float = 0.9, prior: float = 1.0) -> DataFrame:
    """doc_id, base and terms: arrays of spans (kind, start, end), for every document."""
    docs = docs.select("doc_id", "text")
    base = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text", base_spans(F.col("text")).alias("base"))
    base = materialized(base.select("doc_id", "hash", "base", F.when(F.size("base") > 0, words_of("text")).alias("words")))
    telling = _small(telling_terms(docs, base, disclosure, prior))
    each = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.explode(words_of("text")).alias("term")).where(F.length("term") >= 4)
    held = each.join(telling, "term", "left_semi").groupBy("doc_id", "hash").agg(F.collect_set("term").alias("telling"))
    texts = docs.withColumn("hash", F.xxhash64("text")).alias("d").join(held.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.hash") == F.col("h.hash")))
    found = texts.select(F.col("d.doc_id").alias("i"), F.col("d.hash").alias("h"), _terms(F.col("text"), F.col("telling")).alias("terms")).dropDuplicates(["i", "h"])
    slim = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left")
    free = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return joined.select("doc_id", "hash", slim.alias("base"), F.coalesce(free, F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("terms"))


def sanitised(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """docs with base spans generalised to <KIND> and telling terms removed; overlaps go to the earlier span."""
    cuts = spans.select(F.col("doc_id").alias("__i"), F.col("hash").alias("__h"), F.array_sort(F.transform(F.concat("base", "terms"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("__cuts")).distinct()
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], F.substring(F.col(text), s["end"] + 1, F.lit(0))).alias("out"))).otherwise(
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.when(s["kind"] == "term", "").otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).alias("out"))
    )
    cleaned = F.aggregate("__cuts", state, step, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text))))
    both = docs.join(cuts, docs["doc_id"].eqNullSafe(F.col("__i")) & (F.xxhash64(docs[text]) == F.col("__h")), "left")
    return both.select(*(F.when(F.size("__cuts") > 0, cleaned).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in docs.columns))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10(spark, sf_dir: str) -> DataFrame:
    found = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("base", functools.partial(lambda k, s: s["kind"] == k, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", "terms")).alias("spans"))
