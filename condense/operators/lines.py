"""The line table: doc_id, pos, line, decision, reason, stage; one hash partitioning by doc_id serves all stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from condense.functions.text import tokens_of_length

KEEP, COMPRESS, PROTECT = "KEEP", "COMPRESS", "PROTECT"
COLUMNS = ("doc_id", "pos", "line", "decision", "reason", "stage")


def by_pos():
    return W.partitionBy("doc_id").orderBy("pos")


def upto():
    return by_pos().rowsBetween(W.unboundedPreceding, W.currentRow)


def split(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", partitions: int | None = None, extra: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """Every text's pieces between newlines as KEEP lines; an empty text is one empty line, a null text has none.

    Rows are dealt out by doc_id here, once, before texts become lines; every stage's windows use that.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *extra)
    if not dealt:
        rows = rows.repartition(partitions, "doc_id") if partitions else rows.repartition("doc_id")
    rows = rows.select("doc_id", *extra, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "line", F.lit(KEEP).alias("decision"), F.lit("").alias("reason"), F.lit("").alias("stage"), *extra)


def shown(decision: Column | str = "decision") -> Column:
    return (F.col(decision) if isinstance(decision, str) else decision) != COMPRESS


def render(lines: DataFrame) -> DataFrame:
    """(doc_id, text): lines that aren't COMPRESS, joined by newlines."""
    return lines.groupBy("doc_id").agg(joined(F.when(shown(), F.struct("pos", "line"))).alias("text"))


def joined(rows: Column) -> Column:
    """Aggregate: the lines of structs (pos, line), in order; nulls are left out."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["line"]), "\n")


def stats(lines: DataFrame) -> DataFrame:
    """(doc_id, total, kept, compressed, protected)."""
    return lines.groupBy("doc_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("decision") == d).alias(n) for d, n in ((KEEP, "kept"), (COMPRESS, "compressed"), (PROTECT, "protected"))))


def rendered_tokens(length: Column, decision: Column) -> Column:
    """Aggregate: the tokens of the rendered text, from line lengths alone."""
    n = F.count_if(decision != COMPRESS)
    return tokens_of_length(F.coalesce(F.sum(F.when(decision != COMPRESS, length)), F.lit(0)) + F.greatest(n - 1, F.lit(0)))


def islands(df: DataFrame, member: Column, name: str = "island", breaks: Column | None = None) -> DataFrame:
    """Number the runs of neighbouring member rows of a document; rows outside have null.  breaks starts a new run too."""
    start = member & ~F.coalesce(F.lag(member).over(by_pos()), F.lit(False))
    if breaks is not None:
        start = start | (member & F.coalesce(breaks, F.lit(True)))
    return df.withColumn("__m", member).withColumn("__s", start.cast("int")).withColumn(name, F.when(F.col("__m"), F.sum("__s").over(upto()))).drop("__m", "__s")


def renumber(df: DataFrame, *order: str) -> DataFrame:
    """Dense positions again after rows came in; no exchange, as rows are dealt by doc_id."""
    w = W.partitionBy("doc_id").orderBy(*order)
    return df.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
