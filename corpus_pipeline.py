"""The corpus pipeline: five stages over ``documents``, each written and read again by the next.

1. quality: the classifier trained on ``labels`` rejects documents (predicted 0);
2. lines: later repeats of runs of three lines go, and of one or two lines with 50 words or more; a
   document whose text that empties goes too;
3. copies: one document of each component of near-copies stays (five words, similarity 0.8), the
   one with the smallest doc_id; documents without words are no copies of each other;
4. benchmark: documents with a hit window of a benchmark item go;
5. tokens: ids of the lattice encoding (doc_id, n_tokens, ids, round_trip).

All stages but the last return the columns of documents; n_chars follows the text.  Nulls, empty
texts, ties and repeated rows are as the operators' docstrings say; rows that repeat a doc_id or have
none are documents of their own.  Stages 1, 3, 4 and 5 can't be said in SQL (a trained model, hashes in blocks, a lattice),
so there is no SQL for the whole; the tests compare it with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condense.llm import blocks, classifier, decontaminate, jaccard, linedup, pieces

#: Words that make a repeated passage on one or two lines go like one of three lines.
PASSAGE = 50
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = classifier.quality(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = linedup.line_dedup(docs.select(*COLUMNS), words=PASSAGE)
    emptied = (F.col("n_removed") > 0) & (F.trim("text") == "")
    return cut.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.distinct_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return found.where("NOT contaminated").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids", "round_trip")


STAGES = [("quality", quality), ("lines", lines), ("copies", copies), ("benchmark", benchmark), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each result a table in the shared folder; what a stage wrote besides goes after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written: list[DataFrame] = []
    for _, stage in STAGES:
        kept: list[DataFrame] = []
        with blocks.scratch(kept):
            kept.append(blocks.materialized(stage(spark, docs, sf_dir)))
        blocks.discard(*written)
        written, docs = kept, kept[0]
    return docs
