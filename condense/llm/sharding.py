"""Sharding by a two-pass external shuffle.

Pass 1 scatters whole rows into buckets by a seeded hash of the row's id and text; there are as
many buckets as the total size asks for, so each fits in memory.  Pass 2 puts each bucket in a
fixed order and Fisher-Yates shuffles it with a generator seeded by (seed, bucket).  Buckets
follow each other: a row's place in the whole is the sizes of the buckets before it plus its
place in its own, its shard is that place modulo the number of shards, its slot the quotient.  So
row counts of shards are at most one apart and slots have no gaps (law ``rows``).

The sizes of buckets are counted in one job and used in the next; an input that isn't a plain scan of
files is written first, so that both see the same rows.

Cases: null and empty texts have only the fixed 16 bytes of overhead; null ids and repeated rows
are rows like any other (equal rows change places among themselves without effect); an empty
table gives no rows; columns named like the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condense.llm.blocks import repeatable
from condense.shipping import ship

OVERHEAD = 16


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation: numpy's shuffle swaps each place with a random one not after it."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)
    return order


def shuffled_shards(docs: DataFrame, shards: int = 40, seed: int = 2024, bucket_bytes: int = 32 << 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of docs, with size, shard and slot.

    The sizes of the buckets (one number for each bucket_bytes of input) come to the driver and go
    back with the task, as offsets.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = repeatable(docs.drop("size", "shard", "slot", "__bucket", "__order"))
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")
    mass = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    buckets = max(1, -(-mass // bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64(F.lit(seed), doc_id, text), F.lit(buckets)).cast("int")
    counts = {r[0]: r[1] for r in docs.groupBy(bucket).count().toLocalIterator()}
    before = np.concatenate([[0], np.cumsum([counts.get(b, 0) for b in range(buckets)])])

    def second_pass(key, table):
        b = key[0].as_py()
        table = table.take(pc.sort_indices(table, sort_keys=[("__order", "ascending"), (doc_id, "ascending")])).take(pa.array(fisher_yates(table.num_rows, seed, b)))
        place = before[b] + np.arange(table.num_rows)
        table = table.drop_columns(["__bucket", "__order"])
        return table.append_column("shard", pa.array((place % shards).astype(np.int32))).append_column("slot", pa.array(place // shards))

    rows = docs.withColumns({"size": size, "__bucket": bucket, "__order": F.xxhash64(doc_id, text, F.lit(1))})
    schema = docs.withColumn("size", size).schema.add("shard", T.IntegerType()).add("slot", T.LongType())
    return rows.groupBy("__bucket").applyInArrow(second_pass, schema)


def write_shards(docs: DataFrame, path: str, **settings) -> None:
    """Write the shards as folders shard=0, shard=1, ..., each file in the order of slots."""
    shuffled_shards(docs, **settings).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shuffled_shards(docs).select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
