"""Substring dedup over words with difference-cover anchors.

A window is ``window`` consecutive words of one document; a word goes if a window over it has a
word sequence that also starts earlier (smaller doc_id, or same document, earlier start).

Anchors are hashes of shorter runs of words that begin only where the word's number modulo
``period`` lies in a difference cover.  For any two places some shift below the period brings both
onto the cover, so two equal windows share an aligned anchor inside them, and an anchor that
occurs once proves nothing repeats around it.

1. every block sends its distinct anchors to hash-range buckets, which reply how often each occurs;
2. blocks extend repeated anchors to all whole windows around them and send, for each distinct
   window (128 bits of hash), the block's earliest place; buckets reply whether it is the first of all;
3. blocks mark windows that start after the first place, and drop the words these cover.

A passage in a third of all documents is one entry for each block in 1 and 2.  Blocks are cut and
written once; their rows travel squeezed to meet the replies.

Cases: null and empty texts have no words and become empty; texts shorter than a window lose
nothing; rows that repeat both doc_id and text don't remove each other; null doc_ids come after
all others; very long texts are one block; an empty table gives no rows; other columns stay, those
named n_words or n_removed are replaced.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condense.llm import blocks as B
from condense.llm.textkit import SPACED, covered, owners, span_hashes, spans, windows_at
from condense.shipping import ship

#: A perfect difference set: every number modulo 13 is a difference of two of these.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHORS, FIRSTS = 1, 2
_OTHER = 0xA0761D6478BD642F


class Words:
    """Hashed words of a block, and its anchors."""

    def __init__(self, block: B.Block, window: int):
        self.block, self.window, self.run = block, window, window - PERIOD + 1
        starts, ends, self.bounds = spans(block.buf, block.offsets, SPACED)
        self.h = span_hashes(block.buf, starts, ends)
        docs = owners(self.bounds)
        local = np.arange(self.h.size) - self.bounds[docs]
        size = np.diff(self.bounds)[docs]
        on = np.isin(np.arange(PERIOD), COVER)[local % PERIOD] & (local + self.run <= size) & (size >= window)
        self.docs, self.local, self.size = docs, local, size
        self.at = np.flatnonzero(on)
        self.anchors, self.back, self.times = np.unique(B.filter_hashes(windows_at(self.h, self.at, self.run)), return_inverse=True, return_counts=True)

    def candidates(self, often: np.ndarray | None) -> None:
        """Starts of windows around anchors that occur twice or more, their hashes, and each one's earliest place here."""
        at = self.at[often[self.back] >= 2] if often is not None else self.at[:0]
        low = np.maximum(at - PERIOD + 1, self.bounds[self.docs[at]])
        inside = covered(self.h.size, low, at - low + 1) & (self.local + self.window <= self.size)
        self.starts = np.flatnonzero(inside)
        a, b = windows_at(self.h, self.starts, self.window), windows_at(self.h, self.starts, self.window, _OTHER)
        ids, places = self.block.ids[self.docs[self.starts]], self.local[self.starts]
        order = np.lexsort((places, ids, b, a))
        a, b = a[order], b[order]
        fresh = np.ones(a.size, bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.order, self.group = order, np.cumsum(fresh) - 1
        self.ids, self.places = ids[order], places[order]
        self.first = np.flatnonzero(fresh)
        self.a, self.b = a[self.first], b[self.first]


WINDOW_SCHEMA = "bucket int, block long, a binary, b binary, ids binary, places binary"


def _send_windows(words: Words, buckets: int) -> pa.Table:
    cut = B.split_sorted(words.a, buckets).tolist()
    ids, places = words.ids[words.first], words.places[words.first].astype(np.int32)
    rows = [(k, B.pack_sorted(words.a[i:j]), B.pack_array(words.b[i:j]), B.pack_array(ids[i:j]), B.pack_array(places[i:j])) for k, (i, j) in enumerate(itertools.pairwise(cut)) if j > i]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.table([arrays[0], pa.array([words.block.name] * len(rows), pa.int64()), *arrays[1:]], names=["bucket", "block", "a", "b", "ids", "places"])


def _first_of_all(key, table):
    """For each window sent: 1 if it starts earlier elsewhere."""
    B.trim()
    parts = [[B.unpack_sorted(x.as_py()) for x in table["a"]], *([B.unpack_array(x.as_py()) for x in table[c]] for c in ("b", "ids", "places"))]
    a, b, ids, places = (np.concatenate(p) for p in parts)
    order = np.lexsort((places, ids, b, a))
    a, b, ids, places = a[order], b[order], ids[order], places[order]
    fresh = np.ones(a.size, bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    late = np.empty(a.size, np.uint8)
    late[order] = (ids != ids[first]) | (places != places[first])
    cuts = np.cumsum([x.size for x in parts[0]])[:-1]
    n = table.num_rows
    return pa.table({"block": table["block"], "kind": pa.array([FIRSTS] * n, pa.int32()), "bucket": pa.array([key[0].as_py()] * n, pa.int64()), "reply": pa.array([B.pack_array(x) for x in np.split(late, cuts)], pa.binary())})


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """All columns of docs with the kept words of text joined by one space, and n_words, n_removed."""
    if window < PERIOD + 1:
        raise ValueError(f"window must be over {PERIOD} words")
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("n_words", "n_removed")
    blocks = B.block_table(docs)
    buckets = B.n_buckets(blocks)

    def send_anchors(block):
        words = Words(block, window)
        if words.anchors.size:
            yield B.bucket_rows(block.name, words.anchors, np.minimum(words.times, 2).astype(np.uint8), buckets)

    often = B.materialized(B.tally(B.each_block(blocks, send_anchors, B.BUCKET_SCHEMA), cap=2, kind=ANCHORS))

    def send_windows(block, table):
        words = Words(block, window)
        words.candidates(B.replies(table, ANCHORS))
        return _send_windows(words, buckets)

    sent = B.with_replies(blocks, often, send_windows, WINDOW_SCHEMA)
    late = B.materialized(sent.groupBy("bucket").applyInArrow(_first_of_all, B.REPLY_SCHEMA))

    def cut(block, table):
        words = Words(block, window)
        gone = np.zeros(words.h.size, bool)
        later = B.replies(table, FIRSTS)
        if later is not None:
            words.candidates(B.replies(table, ANCHORS))
            first = words.first[words.group]
            out = (later[words.group] > 0) | (words.ids != words.ids[first]) | (words.places != words.places[first])
            gone = covered(words.h.size, np.sort(words.starts[words.order[out]]), window)
        removed = np.concatenate([[0], np.cumsum(gone)])[words.bounds]
        texts = []
        for i, n in enumerate(np.diff(removed).tolist()):
            all_words = block.buf[block.offsets[i] : block.offsets[i + 1]].tobytes().split()
            texts.append(b" ".join(itertools.compress(all_words, ~gone[words.bounds[i] : words.bounds[i + 1]]) if n else all_words))
        table = block.table
        table = table.set_column(table.column_names.index("text"), "text", pa.array(texts, pa.binary()).cast(pa.string()))
        return table.append_column("n_words", pa.array(np.diff(words.bounds))).append_column("n_removed", pa.array(np.diff(removed)))

    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return B.with_replies(blocks, often.unionByName(late), cut, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS x FROM documents),
runs AS (SELECT doc_id, i, array_to_string(x[i:i + 19], ' ') AS run FROM l, LATERAL (SELECT unnest(range(1, len(x) - 18)) AS i) WHERE len(x) >= 20),
dup AS (SELECT hash(run) AS h FROM runs GROUP BY 1 HAVING count(*) > 1),
cand AS (SELECT * FROM runs WHERE hash(run) IN (SELECT h FROM dup)),
firsts AS (SELECT doc_id, i, min(struct_pack(d := doc_id, i := i)) OVER (PARTITION BY run) AS f FROM cand),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM firsts WHERE struct_pack(d := doc_id, i := i) > f) GROUP BY 1)
SELECT l.doc_id, CAST(len(x) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN x ELSE [x[j] FOR j IN range(1, len(x) + 1) IF NOT list_contains(ps, j)] END, ' ')) AS kept_sha256
FROM l LEFT JOIN gone USING (doc_id)
"""
