"""Quality rules: base statistics, and n-gram perplexity within bands of the document's language.

The model of each language predicts a text byte by byte from the ``order`` - 1 bytes before, across
words: words follow each other with one blank between, a text begins after blanks and ends with one.
It is a modified Kneser-Ney model with three discounts for each order.  Spark counts the n-grams of
all documents (blocks send the distinct ones with their numbers to hash buckets), derives the
continuation counts of lower orders, the counts of counts behind the discounts, and the interpolated
probabilities by joins of n-grams with their contexts and their endings.

All documents that are scored are counted, so each of their n-grams of the highest order is in the
model; scoring looks it up and never backs off.  A bucket holds its n-grams as sorted arrays of 64-bit
hashes of (language, n-gram) with their probabilities, finds the ones that each block asked for by binary search and
sends the block its answers, to 1 / ``PARTS`` of a nat.  So neither the model nor any part of it is ever whole in one place,
and none of it is left out, however large it is.

Every text has a perplexity under each of the ``judged`` orders of the model: bytes alone, pairs, and the highest.
A language's band of each comes from documents that pass the base rules: its quartiles,
widened below by ``below`` times twice the distance from the lower quartile to the median, above by
``above`` times twice the one from the median to the upper quartile (a distance under ``least`` nats
counts as that).  A document outside any of the bands is rejected.  Low orders are needed because
junk that is common in the corpus is learned like anything else: texts in capitals or full of signs
lie above the band of single bytes and below the ones of pairs, whatever the highest order has seen.

Cases: a null text has no words; texts without words fail the base rule and have no perplexity;
a null language is a language of its own; a language with one document has a band around it;
words and texts of any length are scored whole; an empty table gives no rows; repeated rows count
as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condense.llm import blocks as B
from condense.llm.textkit import SPACED, U64, covered, line_spans, mix, owners, ranges, span_hashes, spans, windows
from condense.shipping import ship

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
REPEAT = 8
#: Smaller than others: a block's arrays hold eight bytes for each byte of its texts, several times.
SIZE = 5 << 20
#: Log-probabilities travel in two bytes, as parts of a nat.
PARTS = 2048


def _lang_hash(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b(b"-" if lang is None else b"+" + lang.encode(), digest_size=8).digest(), "little")


def _keys(langs: list, number: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Hashes of (langs[number], gram)."""
    of = np.array([_lang_hash(x) for x in langs], np.uint64)
    return mix(of[number] ^ mix(grams + U64(0x632BE59BD9B4E019)))


def _split(keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> U64(8 * order)).astype(np.int64), keys & U64((1 << 8 * order) - 1)


class Grams:
    """The n-grams that predict each byte of a block's texts; the distinct ones by (number of the language, gram)."""

    def __init__(self, block: B.Block, order: int):
        if not 1 <= order <= 6:
            raise ValueError("order must be 1 to 6")
        starts, ends, self.bounds = spans(block.buf, block.offsets, SPACED)
        self.h = span_hashes(block.buf, starts, ends)
        size, words = ends - starts, np.diff(self.bounds)
        lead = np.zeros(size.size, np.int64)
        lead[self.bounds[:-1][words > 0]] = order - 1  # blanks before a text; one follows each word
        at = np.cumsum(lead + size + 1) - (size + 1)
        text = np.full(int(at[-1] + size[-1] + 1) if size.size else 0, 32, np.uint8)
        text[ranges(at, size)] = block.buf[ranges(starts, size)]
        whole = text.astype(np.uint64)
        for k in range(1, order):
            whole[k:] |= text[: text.size - k].astype(np.uint64) << U64(8 * k)
        grams = whole[ranges(at, size + 1)]
        del whole
        names = block.table["lang"].to_pylist()
        self.langs = list(dict.fromkeys(names))
        number = {x: i for i, x in enumerate(self.langs)}
        self.steps = np.concatenate([[0], np.cumsum(size + 1)])[self.bounds]
        grams |= np.repeat(np.array([number[x] for x in names], np.uint64) << U64(8 * order), np.diff(self.steps))
        self.keys, back, self.times = np.unique(grams, return_inverse=True, return_counts=True)
        self.back = back.astype(np.int32)
        self.lang, self.grams = _split(self.keys, order)

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each distinct gram, and their order by bucket."""
        bucket = (_keys(self.langs, self.lang, self.grams) >> U64(32)) % U64(n)
        return bucket, np.argsort(bucket, kind="stable")


SENT_SCHEMA = "bucket int, block long, langs array<string>, keys binary, times binary"


def sent_grams(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """For each block and bucket: the block's languages, and rising keys of one's number and a gram, and how often each occurs."""

    def send(block):
        grams = Grams(block, order)
        bucket, rank = grams.buckets(buckets)
        cut = np.searchsorted(bucket[rank], np.arange(buckets + 1, dtype=np.uint64)).tolist()
        rows = [(b, B.pack_sorted(grams.keys[rank[i:j]]), B.pack_array(grams.times[rank[i:j]].astype(np.uint32))) for b, (i, j) in enumerate(itertools.pairwise(cut)) if j > i]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 3
        langs = pa.array([grams.langs] * len(rows), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array([block.name] * len(rows), pa.int64()), langs, *(pa.array(c, pa.binary()) for c in columns[1:])], ["bucket", "block", "langs", "keys", "times"])

    return B.each_block(blocks, send, SENT_SCHEMA)


def _received(table: pa.Table, order: int):
    """(languages, number of the language, grams) for each row of a bucket."""
    for langs, keys in zip(table["langs"].to_pylist(), table["keys"], strict=True):
        yield langs, *_split(B.unpack_sorted(keys.as_py()), order)


def gram_counts(sent: DataFrame, order: int) -> DataFrame:
    """(bucket, lang, gram, n) over all documents; a gram is its bytes as one number."""

    def count(key, table):
        B.trim()
        rows = list(_received(table, order))
        names = list(dict.fromkeys(x for langs, _, _ in rows for x in langs))
        of = {x: i for i, x in enumerate(names)}
        number = np.concatenate([np.array([of[x] for x in langs])[lang] for langs, lang, _ in rows])
        grams, times = np.concatenate([g for _, _, g in rows]), np.concatenate([B.unpack_array(x.as_py()) for x in table["times"]])
        rank = np.lexsort((grams, number))
        number, grams = number[rank], grams[rank]
        fresh = np.ones(grams.size, bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (number[1:] != number[:-1])
        n = np.add.reduceat(times[rank].astype(np.int64), np.flatnonzero(fresh))
        langs = pa.array(names, pa.string()).take(pa.array(number[fresh]))
        return pa.table({"bucket": pa.array(np.full(n.size, key[0].as_py(), np.int32)), "lang": langs, "gram": pa.array(grams[fresh].astype(np.int64)), "n": pa.array(n)})

    return sent.groupBy("bucket").applyInArrow(count, "bucket int, lang string, gram long, n long")


def _discounts(grams: DataFrame) -> DataFrame:
    """The three discounts of each language, from how many n-grams occur once to four times."""
    t = [F.count_if(F.col("n") == i).cast("double") for i in (1, 2, 3, 4)]
    seen = grams.groupBy("lang").agg(*(x.alias(f"t{i}") for i, x in enumerate(t, 1)))
    y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
    raw = [i - (i + 1) * y * F.col(f"t{i + 1}") / F.col(f"t{i}") for i in (1, 2, 3)]
    usable = (F.col("t1") > 0) & (F.col("t2") > 0) & (F.col("t3") > 0)
    plain = (0.5, 1.0, 1.5)  # where a small corpus lacks one of the counts
    return seen.select("lang", *(F.when(usable, F.greatest(F.lit(0.05), F.least(r, F.lit(i - 0.05)))).otherwise(F.lit(p)).alias(f"d{i}") for i, (r, p) in enumerate(zip(raw, plain, strict=True), 1)))


def kneser_ney(counts: DataFrame, order: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """From a written table of (lang, gram, n), for orders 1 .. order: (lang, gram, n, logp, lps: the logp of the gram's ending in this and all lower orders, lowest first), and (lang, context, total, logb) for contexts of 0 .. order - 1 bytes.

    Further columns of counts stay with the highest order.
    """
    extra = [c for c in counts.columns if c not in ("lang", "gram", "n")]
    counted = [counts]
    for k in range(order - 1, 0, -1):
        counted.append(B.materialized(counted[-1].groupBy("lang", F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.count("*").alias("n"))))
    counted.reverse()
    probs, backs, below = [], [], None
    for k, grams in enumerate(counted, 1):
        more = [F.col(f"g.{c}") for c in extra] if k == order else []
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        each = grams.alias("g").join(_discounts(grams).alias("d"), F.col("g.lang").eqNullSafe(F.col("d.lang"))).select("g.*", cut.alias("cut"))
        each = each.withColumn("context", F.shiftright("gram", 8))
        context = B.materialized(each.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("held")))
        met = F.col("g.lang").eqNullSafe(F.col("c.lang")) & (F.col("g.context") == F.col("c.context"))
        joined = each.alias("g").join(context.alias("c"), met).select("g.lang", "g.gram", "g.n", "g.cut", "c.total", "c.held", *more)
        own, share = (F.col("n") - F.col("cut")) / F.col("total"), F.col("held") / F.col("total")
        if below is None:
            found = joined.withColumns({"logp": F.log(own + share / 256), "lower": F.array().cast("array<double>")}).alias("g")
        else:
            low = joined.withColumn("ending", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1)).alias("g")
            met = F.col("g.lang").eqNullSafe(F.col("b.lang")) & (F.col("g.ending") == F.col("b.gram"))
            found = low.join(below.select("lang", "gram", F.col("lps").alias("lower")).alias("b"), met).withColumn("logp", F.log(own + share * F.exp(F.element_at("lower", -1))))
        below = B.materialized(found.select("g.lang", "g.gram", "g.n", "logp", F.concat("lower", F.array("logp")).alias("lps"), *more))
        probs.append(below)
        backs.append(context.select("lang", "context", "total", F.log(F.col("held") / F.col("total")).alias("logb")))
    return probs, backs


def answered(sent: DataFrame, model: DataFrame, order: int, judged: tuple[int, ...]) -> DataFrame:
    """For each block, bucket and judged order (as kind): the log-probabilities of the grams sent, from the bucket's sorted hash arrays."""

    def look_up(key, table, known):
        B.trim()
        code = known["lang"].combine_chunks().dictionary_encode(null_encoding="encode")
        hashes = _keys(code.dictionary.to_pylist(), code.indices.to_numpy(), known["gram"].to_numpy().astype(np.uint64))
        rank = np.argsort(hashes)
        lps = known["lps"].combine_chunks().flatten().to_numpy().reshape(-1, order)
        hashes, values = hashes[rank], np.minimum(np.rint(-PARTS * lps), 65_535).astype(np.uint16)[rank]
        out = []
        for name, (langs, lang, grams) in zip(table["block"].to_pylist(), _received(table, order), strict=True):
            mine = values[np.searchsorted(hashes, _keys(langs, lang, grams))]
            out += [(name, k, key[0].as_py(), B.pack_array(mine[:, k - 1])) for k in judged]
        names, kinds, buckets, replies = zip(*out, strict=True) if out else [()] * 4
        return pa.table({"block": pa.array(names, pa.int64()), "kind": pa.array(kinds, pa.int32()), "bucket": pa.array(buckets, pa.int64()), "reply": pa.array(replies, pa.binary())})

    return sent.groupBy("bucket").cogroup(model.select("bucket", "lang", "gram", "lps").groupBy("bucket")).applyInArrow(look_up, B.REPLY_SCHEMA)


def base_statistics(block: B.Block, bounds: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
    buf, offsets = block.buf, block.offsets
    by_doc = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])
    inside = SPACED[buf]
    out = {"n_words": np.diff(bounds), "word_chars": by_doc(inside & ((buf & 0xC0) != 0x80)), "n_symbols": by_doc(SYMBOLS[buf])}
    starts, ends, line_bounds = line_spans(buf, offsets)
    seen = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    full = np.flatnonzero(seen[ends] > seen[starts])
    docs = owners(line_bounds)[full]
    key = mix(span_hashes(buf, starts[full], ends[full]) + docs.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(docs, minlength=block.rows) - np.bincount(docs[first], minlength=block.rows)
    docs = owners(bounds)
    repeat = np.zeros(h.size, bool)
    if h.size >= REPEAT:
        whole = np.flatnonzero(docs[REPEAT - 1 :] == docs[: h.size - REPEAT + 1])
        key = mix(windows(h, REPEAT)[whole] + docs[whole].astype(np.uint64) * U64(0x9E3779B97F4A7C15))
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        repeat = covered(h.size, whole[times[back] > 1], REPEAT)
    out["n_repeat_words"] = np.diff(np.concatenate([[0], np.cumsum(repeat, dtype=np.int64)])[bounds])
    return out


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(docs: DataFrame, order: int = 4, below: float = 5.0, above: float = 5.0, least: float = 0.005, judged: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """doc_id, lang, the base statistics, base_failed, log_perplexity (of a byte, highest order), and by judged order: log_perplexities, low, high; kept."""
    ship(docs.sparkSession)
    blocks = B.block_table(docs.select("doc_id", "text", "lang"), SIZE, level=9, stay=True)
    buckets = B.n_buckets(blocks)
    sent = B.materialized(sent_grams(blocks, order, buckets))
    probs, _ = kneser_ney(B.materialized(gram_counts(sent, order)), order)
    answers = B.materialized(answered(sent, probs[-1], order, judged))
    B.discard(sent)

    def score(block, table):
        grams = Grams(block, order)
        _, rank = grams.buckets(buckets)
        n = np.diff(grams.steps)
        by_order = []
        for k in judged:
            each = np.zeros(grams.grams.size, np.uint16)
            if each.size:
                each[rank] = B.replies(table, k)
            sums = np.concatenate([[0], np.cumsum(each[grams.back], dtype=np.int64)])[grams.steps]
            by_order.append(pa.array(np.diff(sums) / np.maximum(PARTS * n, 1), mask=n == 0))
        stats = base_statistics(block, grams.bounds, grams.h)
        return pa.table([B.id_array(block.ids), block.table["lang"].combine_chunks(), *(pa.array(stats[c]) for c in STATS), *by_order], names=["doc_id", "lang", *STATS, *names])

    names = [f"s{k}" for k in judged]
    scores = B.with_replies(blocks, answers, score, f"doc_id long, lang string, {', '.join(f'{c} long' for c in STATS)}, {', '.join(f'{c} double' for c in names)}")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scores = B.materialized(scores.withColumn("base_failed", failed))
    B.discard(blocks, answers)
    quartiles = scores.where(~F.col("base_failed")).groupBy("lang").agg(*(F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(c) for c in names))

    def bound(c: str, upper: bool):
        q = [F.col(c)[i] for i in range(3)]
        half = F.greatest((q[2] - q[1]) if upper else (q[1] - q[0]), F.lit(least))
        return q[2] + 2 * above * half if upper else q[0] - 2 * below * half

    bands = quartiles.select("lang", F.array(*(bound(c, False) for c in names)).alias("low"), F.array(*(bound(c, True) for c in names)).alias("high"))
    inside = functools.reduce(lambda a, b: a & b, (F.col(c).between(F.col("low")[i], F.col("high")[i]) for i, c in enumerate(names)))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    joined = scores.alias("s").join(bands.alias("b"), F.col("s.lang").eqNullSafe(F.col("b.lang")), "left")
    return joined.select("doc_id", "s.lang", *STATS, "base_failed", F.col(names[-1]).alias("log_perplexity"), F.array(*names).alias("log_perplexities"), "low", "high", kept.alias("kept"))


def op3(spark, sf_dir: str) -> DataFrame:
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *STATS, "base_failed", "kept", "log_perplexity")
