"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal.

Tokens are runs of letters and digits, and single other characters that aren't white space.
Features are hashes of single tokens, of pairs of neighbours, and, where a token repeats the one
before it, of that fact alone (a pair with its words left out).  A feature's value is its share of
the document's features, so long and short texts compare.  Scores are sparse dot products.

Training reads labelled rows outside the held-out fold only.  At most about ``max_train`` of
them are used (a hash of doc_id chooses); they pass through one task, which holds
the features of all of them: some 200 numbers a row of prose, bounded by ``max_train``.  The model has 2 ** bits weights whatever the corpus, so it is broadcast.

Cases: null and empty texts get the score of the bias; null doc_ids are scored but never train;
several labels of one doc_id count as the lowest; rows of
documents that share a labelled doc_id all train; without labels of both kinds every score is the
share of label 1 (0.5 without any); whole texts are read, however long; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condense.llm.blocks import id_array, iter_blocks
from condense.llm.textkit import ALNUM, GROUP, SPACED, U64, mix, seeded, span_hashes
from condense.shipping import ship

_ONE = ALNUM.copy()
_ONE[65:91] = True
_REPEAT = 0x5EED


def held_out(doc_id: Column) -> Column:
    """The fold that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all documents in turn, and where each document's begin."""
    word, other = _ONE[buf], SPACED[buf] & ~_ONE[buf]
    begin, end = word.copy(), word.copy()
    if buf.size:
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < buf.size)]
        begin[cut], end[cut - 1] = word[cut], word[cut - 1]
    starts, ends = np.flatnonzero(begin | other), np.flatnonzero(end | other) + 1
    h = span_hashes(buf, starts, ends)
    at = np.searchsorted(starts, offsets)
    first = np.zeros(h.size, bool)
    first[at[:-1][at[:-1] < h.size]] = True
    pair = np.flatnonzero(~first)
    same = pair[h[pair] == h[pair - 1]]
    place = np.concatenate([np.arange(h.size), pair, same])
    value = np.concatenate([h, mix(h[pair - 1] * U64(0x9E3779B97F4A7C15) + h[pair]), np.repeat(seeded(np.array([_REPEAT], np.uint64), 1), same.size)])
    order = np.argsort(place, kind="stable")
    sizes = np.bincount(np.searchsorted(at[1:], place, "right"), minlength=offsets.size - 1)
    return (value[order] >> U64(64 - bits)).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


class Ftrl:
    """Follow-the-regularised-leader, one example at a time, with a bias as the last weight."""

    def __init__(self, bits: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, self.z.size - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


SCALE = 12.0


def train(docs: DataFrame, labels: DataFrame, max_train: int = 12_000, bits: int = 18, epochs: int = 4, label: str = "quality", seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights (the bias last) and the share of label 1 among the rows that train."""
    ship(docs.sparkSession)
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).cast("int").alias("__label"))
    total = marked.count()
    if total > max_train:
        marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_003)) < int(1_000_003 * max_train / total))
    rows = docs.select("doc_id", "text").join(marked, "doc_id").repartition(1)

    def fit(batches):
        model, ones, seen = Ftrl(bits), 0, 0
        kept: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for block in iter_blocks(batches, 1 << 20):
            at, cut = features(block.buf, block.offsets, bits)
            for i, y in enumerate(block.table["__label"].to_pylist()):
                where, count = np.unique(at[cut[i] : cut[i + 1]], return_counts=True)
                kept.append((int(block.ids[i]), where.astype(np.int32), (SCALE * count / max(1, count.sum())).astype(np.float32), y))
                ones, seen = ones + y, seen + 1
        kept.sort(key=lambda r: (r[0], r[1].size))
        rng = np.random.Generator(np.random.PCG64(seed))
        for _ in range(epochs):
            for i in rng.permutation(len(kept)):
                _, where, x, y = kept[i]
                model.learn(where, x, y)
        w = model.weights(slice(None)).astype(np.float32) if 0 < ones < seen else np.zeros((1 << bits) + 1, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([ones / seen if seen else 0.5])], ["weights", "share"])

    found = rows.mapInArrow(fit, "weights binary, share double").collect()
    if not found:
        return np.zeros((1 << bits) + 1, np.float32), 0.5
    return np.frombuffer(found[0].weights, np.float32), found[0].share


def scored(docs: DataFrame, weights: np.ndarray, share: float, cut: float = 0.3) -> DataFrame:
    """doc_id, score, predicted, and all further columns of docs as they were (a column named score or predicted gives way)."""
    spark = docs.sparkSession
    ship(spark)
    bits = int(weights.size - 1).bit_length() - 1
    model = spark.sparkContext.broadcast(weights)
    flat = not weights.any()
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]

    def score(batches):
        w = model.value.astype(np.float64)
        for block in iter_blocks(batches):
            out = np.empty(block.rows)
            at = 0
            while at < block.rows:
                upto = max(at + 1, int(np.searchsorted(block.offsets, block.offsets[at] + 2 * GROUP, "right")) - 1)
                where, cuts = features(block.buf[block.offsets[at] : block.offsets[upto]], block.offsets[at : upto + 1] - block.offsets[at], bits)
                sums = np.concatenate([[0.0], np.cumsum(w[where])])
                n = np.diff(cuts)
                logit = w[-1] + SCALE * (sums[cuts[1:]] - sums[cuts[:-1]]) / np.maximum(n, 1)
                out[at:upto] = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
                at = upto
            if flat:
                out[:] = share
            table = block.table
            table = table.append_column("score", pa.array(out)).append_column("predicted", pa.array((out >= cut).astype(np.int32)))
            yield from table.combine_chunks().to_batches()

    schema = docs.select(*keep).schema.add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return docs.select(*keep).mapInArrow(score, schema)


def quality(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Train on labels, then score all of docs."""
    weights, share = train(docs, labels, **settings)
    return scored(docs, weights, share)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
