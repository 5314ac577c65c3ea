"""Line documents and other inputs derived from the star-schema tables, in which every operator has work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from condense.operators.lines import KEEP, split


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(df: DataFrame, doc_id: str | Column, line: Column, *order: str | Column) -> DataFrame:
    """Rows as the lines of documents, in an order; the window's exchange serves later stages."""
    w = W.partitionBy("doc_id").orderBy(*order)
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    rows = df.withColumn("doc_id", doc_id).withColumn("line", line)
    return rows.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).select("doc_id", "pos", "line", F.lit(KEEP).alias("decision"), F.lit("").alias("reason"), F.lit("").alias("stage"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(table(spark, sf_dir, "documents"))


def stamp() -> Column:
    return F.date_format("ts", "yyyy-MM-dd HH:mm:ss")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "events"), "user_id", F.concat_ws(" ", stamp(), "event_type"), "ts", "event_id")


def type_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "events"), "user_id", F.col("event_type"), "ts", "event_id")


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "events"), "user_id", F.concat(F.lit("mod"), (F.col("event_id") % 97).cast("string"), F.lit(".py:"), (F.col("event_id") % 31).cast("string"), F.lit(": error: bad "), F.col("event_type")), "ts", "event_id")


def ansi_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_id") % 7 == 0, F.lit("\x1b[0m\x1b[2K")).when(F.col("event_id") % 2 == 0, F.concat(F.lit("\x1b[31m"), "event_type", F.lit("\x1b[0m"))).otherwise(F.col("event_type"))
    return lines_of(table(spark, sf_dir, "events"), "user_id", code, "ts", "event_id")


def part_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return lines_of(rows, "l_suppkey", F.col("l_partkey").cast("string"), "l_partkey")


def part_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "part"), "p_brand", F.concat(F.rpad("p_brand", 14, " "), F.rpad("p_type", 30, " "), F.col("p_size").cast("string")), "p_partkey")


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "pages").where("url is not null"), F.regexp_extract("url", "^[a-z]+://([^/]*)", 1), F.col("url"), "url", "page_id")


def _diff_lines(orders: DataFrame, *more: str) -> DataFrame:
    """Each order as seven lines of a diff; a third of the headers have no line that names the file."""
    path = F.concat(F.lit("src/f"), F.col("o_orderkey").cast("string"), F.lit(".py"))
    parts = F.array(
        F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("old mode 100644")).otherwise(F.concat(F.lit("--- a/"), path)),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("new mode 100755")).otherwise(F.concat(F.lit("+++ b/"), path)),
        *(F.concat(F.lit(f" context line {i} of "), F.col("o_orderpriority")) for i in range(4)),
    )
    return orders.select("o_orderpriority", "o_orderkey", *more, F.posexplode(parts).alias("k", "line"))


def diff_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order priority's orders as a diff."""
    return lines_of(_diff_lines(table(spark, sf_dir, "orders")), "o_orderpriority", F.col("line"), "o_orderkey", "k")


def diff_log_by_parts(spark: SparkSession, sf_dir: str, part: int = 4096) -> DataFrame:
    """The rows of diff_log; orders are counted within ranges of keys and before them become lines, so no task holds a document."""
    o = table(spark, sf_dir, "orders").select(F.struct("o_orderpriority", F.floor(F.col("o_orderkey") / part).alias("part")).alias("p"), "o_orderpriority", "o_orderkey")
    before = F.sum("n").over(W.partitionBy("p.o_orderpriority").orderBy("p.part")) - F.col("n")
    sizes = o.groupBy("p").agg(F.count("*").alias("n")).select("p", before.alias("before"))
    same = W.partitionBy("p", "o_orderkey")
    o = o.withColumn("rank", F.rank().over(W.partitionBy("p").orderBy("o_orderkey")) - 1).withColumn("times", F.count("*").over(same)).withColumn("copy", F.row_number().over(same.orderBy("o_orderkey")) - 1)
    rows = _diff_lines(o.join(sizes, "p"), "before", "rank", "times", "copy")
    # a key that occurs again has its first lines one after another, then its second ones
    pos = 7 * (F.col("before") + F.col("rank")) + F.col("times") * F.col("k") + F.col("copy")
    return rows.select(F.col("o_orderpriority").alias("doc_id"), pos.alias("pos"), "line", F.lit(KEEP).alias("decision"), F.lit("").alias("reason"), F.lit("").alias("stage"))


def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A telemetry table: one row for each event."""
    e = table(spark, sf_dir, "events")
    original = F.floor(F.col("value") * 10).cast("long")
    passed = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("Read: "), "event_type")).otherwise(F.col("event_type")).alias("command"),
        F.concat(F.lit("/Proj/U"), (F.col("user_id") % 7).cast("string"), F.lit("/")).alias("project_path"),
        original.alias("original_tokens"),
        F.when(passed, original).otherwise(F.when(F.col("event_id") % 5 == 0, original + 3).otherwise(F.floor(original / 2))).cast("long").alias("final_tokens"),
        F.when(~passed, F.when(F.col("event_id") % 13 == 0, "repo-search").otherwise(F.col("event_type"))).alias("filter_name"),
        passed.alias("was_passthrough"),
        (F.col("event_id") % 17).cast("double").alias("duration_ms"),
        F.col("ts").alias("recorded_at"),
        F.lit(3).alias("schema_version"),
        F.lit(None).cast("string").alias("project_key_normalized"),
        F.when(F.col("event_type") == "view", (F.col("event_id") % 4).cast("int")).alias("files_changed"),
    )


def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dependency graph: suppliers' files import parts' files (some unresolved)."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber").distinct()  # noqa: E741
    source = F.concat(F.lit("src/s"), F.col("l_suppkey").cast("string"), F.lit(".py"))
    target = F.concat(F.lit("src/s"), (F.col("l_partkey") % 100).cast("string"), F.lit(".py"))
    return l.select(F.lit("import").alias("kind"), source.alias("source_file"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("target_raw"), F.col("l_linenumber").alias("line"), F.when(F.col("l_partkey") % 5 != 0, target).alias("target_file")).where("target_file is null or target_file <> source_file")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(previous, current) fingerprints of parts as files: some modified, some moved, some gone."""
    p = table(spark, sf_dir, "part")
    path = F.concat(F.lit("p/"), F.col("p_partkey").cast("string"))
    old = p.where("p_partkey % 9 <> 0").select(path.alias("path"), F.col("p_size").cast("long").alias("size"), F.md5(F.concat_ws("|", "p_type", F.col("p_partkey") % 50)).alias("content_hash"))
    moved = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("q/"), F.col("p_partkey").cast("string"))).otherwise(path)
    new = p.where("p_partkey % 8 <> 0").select(moved.alias("path"), F.col("p_size").cast("long").alias("size"), F.md5(F.concat_ws("|", F.when(F.col("p_partkey") % 7 == 0, F.lit("changed")).otherwise(F.col("p_type")), F.col("p_partkey") % 50)).alias("content_hash"))
    return old, new
