"""Benchmark decontamination: Wu-Manber search for the word windows of benchmark items.

Symbols are hashed words.  All windows of one length m form one search.  A block is a pair of
neighbouring words; the shift table says how far a window may move when that pair ends it
(m - 1 if no pattern holds the pair).  Pairs that end a pattern have shift 0: their bucket of
patterns is looked up by the hash of that pair, narrowed by the hash of the first pair, and the
words of each pattern in it are then compared one by one, at last by their bytes, so a hash collision
is never reported.  All documents of a block move in step, one array operation for one step of each.

Cases: a null or empty text has no words and is clean; items without words are no patterns;
equal windows of several items count for each of them; repeated item_ids count once; rows
with a null item_id are together one item, which n_items counts and only the ids leave out; an empty
benchmark leaves all documents clean; very long texts are searched whole.

The benchmark is read in the order of its items, ``MAX_PATTERNS`` windows at a time; each such chunk is
broadcast, searched by a job of its own and forgotten before the next is read.  The hits of several
chunks are written tables that meet by two hashes of the text.  So neither the driver nor a task ever
holds more than one chunk, and a benchmark of one chunk takes one pass without a shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condense.llm.blocks import iter_blocks, materialized
from condense.llm.textkit import ALNUM, GROUP, U64, mix, ranges, span_hashes, spans
from condense.shipping import ship

#: Windows in one broadcast: about 50 bytes each and the items' words.
MAX_PATTERNS = 200_000
FOUND = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items")
_TABLE_BITS = 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PAIR = U64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The benchmark's words: A-Z in lower case, runs of ASCII letters, digits and all above ASCII."""
    raw = np.frombuffer((text or "").encode().translate(_LOWER), np.uint8)
    starts, ends, _ = spans(raw, np.array([0, raw.size]), ALNUM)
    return [raw[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]


class Search:
    """Wu-Manber tables for patterns of m words each."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]]):
        keys = list(patterns)
        self.m, self.patterns = len(keys[0]), keys
        self.items = [patterns[k] for k in keys]
        flat = [w for k in keys for w in k]
        buf = np.frombuffer(b"".join(flat), np.uint8)
        ends = np.cumsum([len(w) for w in flat])
        words = span_hashes(buf, ends - [len(w) for w in flat], ends).reshape(len(keys), self.m)
        self.block = min(2, self.m)
        self.shift = np.full(1 << _TABLE_BITS, self.m - self.block + 1, np.int32)
        for j in range(self.block - 1, self.m):
            spot = self.spot(words[:, j], words[:, j - 1] if self.block == 2 else None)
            np.minimum.at(self.shift, spot, self.m - 1 - j)
        self.words = words
        key = self.bucket(words, np.zeros(len(keys), np.int64), np.arange(len(keys)))
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def bucket(self, words: np.ndarray, first: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the last and the first block of the windows from first (of the rows of a matrix, where row is given)."""
        at = lambda k: words[first + k] if row is None else words[row, first + k]
        ends = [at(self.m - 1)] + ([at(self.m - 2)] if self.block == 2 else [])
        begins = [at(0)] + ([at(1)] if self.block == 2 else [])
        h = np.zeros(first.size, np.uint64)
        for x in ends + begins:
            h = mix(h * _PAIR + x)
        return h

    @staticmethod
    def spot(last: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        h = last if before is None else mix(last + before * _PAIR)
        return (h >> U64(64 - _TABLE_BITS)).astype(np.int64)

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """(place of the first word, pattern) of all occurrences; buf is in lower case."""
        out: list[tuple[int, int]] = []
        at, last = bounds[:-1] + self.m - 1, bounds[1:]
        live = at < last
        at, last = at[live], last[live]
        while at.size:
            step = self.shift[self.spot(words[at], words[at - 1] if self.block == 2 else None)]
            hit = at[step == 0]
            if hit.size:
                first = hit - self.m + 1
                key = self.bucket(words, first)
                low = np.searchsorted(self.keys, key)
                n = np.searchsorted(self.keys, key, "right") - low
                place, pattern = np.repeat(first, n), self.order[ranges(low, n)]
                for j in range(self.m):
                    if not place.size:
                        break
                    same = words[place + j] == self.words[pattern, j]
                    place, pattern = place[same], pattern[same]
                for i, p in zip(place.tolist(), pattern.tolist(), strict=True):
                    found = tuple(buf[s:e].tobytes() for s, e in zip(starts[i : i + self.m], ends[i : i + self.m], strict=True))
                    if self.patterns[p] == found:
                        out.append((i, p))
            at = at + np.maximum(step, 1)
            live = at < last
            at, last = at[live], last[live]
        return out


def item_windows(benchmark: DataFrame, k: int, item_id: str, item_text: str) -> Iterator[tuple[str | None, tuple[bytes, ...]]]:
    """(item, window) for all windows, items in order and one row at a time."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).orderBy("i")
    for row in rows.toLocalIterator():
        words = words_of(row.t)
        if words:
            for i in range(max(1, len(words) - k + 1)):
                yield row.i, tuple(words[i : i + k])


def chunks_of(windows: Iterator[tuple[str | None, tuple[bytes, ...]]]) -> Iterator[tuple[list[str | None], list[dict]]]:
    """The items and the patterns, a dict for each length, of MAX_PATTERNS windows at a time."""
    while part := list(itertools.islice(windows, MAX_PATTERNS)):
        labels: list[str | None] = []
        patterns: dict[int, dict] = {}
        for item, window in part:
            if not labels or labels[-1] != item:
                labels.append(item)
            holders = patterns.setdefault(len(window), {}).setdefault(window, [])
            if not holders or holders[-1] != len(labels) - 1:
                holders.append(len(labels) - 1)
        yield labels, list(patterns.values())


def _hits(block, labels: list, searches: list[Search]):
    """The number of words of each row, and {row: (places of hit words, items)}."""
    n_words, out, at = np.zeros(block.rows, np.int64), {}, 0
    while at < block.rows:
        upto = max(at + 1, int(np.searchsorted(block.offsets, block.offsets[at] + 2 * GROUP, "right")) - 1)
        offsets = block.offsets[at : upto + 1] - block.offsets[at]
        buf = np.frombuffer(block.buf[block.offsets[at] : block.offsets[upto]].tobytes().translate(_LOWER), np.uint8)
        starts, ends, bounds = spans(buf, offsets, ALNUM)
        n_words[at:upto] = np.diff(bounds)
        words = span_hashes(buf, starts, ends)
        for search in searches:
            for place, p in search.find(buf, starts, ends, words, bounds):
                doc = int(np.searchsorted(bounds, place, "right")) - 1
                covered, which = out.setdefault(at + doc, (set(), set()))
                covered.update(range(place - int(bounds[doc]), place - int(bounds[doc]) + search.m))
                which.update(labels[i] for i in search.items[p])
        at = upto
    return n_words, out


def _found(block, n_words: np.ndarray, hits: dict, keep: tuple[str, ...]) -> pa.RecordBatch:
    n_hit, n_items, ids = np.zeros(block.rows, np.int64), np.zeros(block.rows, np.int64), [()] * block.rows
    for row, (covered, which) in hits.items():
        n_hit[row], n_items[row], ids[row] = len(covered), len(which), tuple(sorted(which - {None}))
    found = [pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array([hashlib.sha256(",".join(h).encode()).hexdigest() for h in ids]), pa.array(n_hit > 0), pa.array([list(h) for h in ids], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*(block.table[c].combine_chunks() for c in keep), *found], [*keep, *FOUND])


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and n_words, n_hit, n_items, items_sha256, contaminated, items (array of item ids as strings), for every document.

    k: words in a window; an item with fewer words, but not none, is one window.
    """
    spark = docs.sparkSession
    ship(spark)
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType(), T.ArrayType(T.StringType())]
    schema = T.StructType([*docs.select(*keep).schema.fields, *map(T.StructField, FOUND, kinds)])
    docs = docs.select(*dict.fromkeys((*keep, "doc_id", text))).withColumn("text", F.col(text))
    chunks = chunks_of(item_windows(benchmark, k, item_id, item_text))
    chunk, following = next(chunks, ([], [])), next(chunks, None)
    if following is None:
        shared = spark.sparkContext.broadcast(chunk)

        def scan(batches):
            labels, searches = shared.value[0], [Search(p) for p in shared.value[1]]
            for block in iter_blocks(batches):
                yield _found(block, *_hits(block, labels, searches), keep)

        return docs.mapInArrow(scan, schema)

    keyed = docs.withColumns({"__x": F.xxhash64("text"), "__y": F.xxhash64("text", F.lit(1))})
    parts = []
    for labels, patterns in itertools.chain([chunk, following], chunks):
        shared = spark.sparkContext.broadcast((labels, patterns))

        def scan_chunk(batches, shared=shared):
            labels, searches = shared.value[0], [Search(p) for p in shared.value[1]]
            for block in iter_blocks(batches):
                hits = _hits(block, labels, searches)[1]
                rows = block.table.select(["__x", "__y"]).take(pa.array(list(hits), pa.int64())).combine_chunks()
                found = [pa.array([sorted(c) for c, _ in hits.values()], pa.list_(pa.int32())), pa.array([sorted(w, key=lambda x: (x is not None, x)) for _, w in hits.values()], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([rows["__x"].combine_chunks(), rows["__y"].combine_chunks(), *found], ["x", "y", "covered", "which"])

        parts.append(materialized(keyed.select("doc_id", "text", "__x", "__y").mapInArrow(scan_chunk, "x long, y long, covered array<int>, which array<string>").dropDuplicates(["x", "y"])))
        shared.destroy()
    every = functools.reduce(DataFrame.unionAll, parts).groupBy("x", "y").agg(*(F.flatten(F.collect_list(c)).alias(f"__{c}") for c in ("covered", "which")))
    joined = keyed.join(every, (F.col("__x") == F.col("x")) & (F.col("__y") == F.col("y")), "left").drop("x", "y", "__x", "__y")

    def finish(batches):
        for block in iter_blocks(batches):
            both = zip(block.table["__covered"].to_pylist(), block.table["__which"].to_pylist(), strict=True)
            yield _found(block, _hits(block, [], [])[0], {i: (set(c), set(w)) for i, (c, w) in enumerate(both) if c}, keep)

    return joined.mapInArrow(finish, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("items")


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM items, LATERAL (SELECT unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT k FROM pat),
occ AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM words, lens, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k),
hit AS (SELECT o.doc_id, o.i, o.k, p.item_id FROM occ o JOIN pat p ON o.k = p.k AND o.win = p.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(len(w.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
