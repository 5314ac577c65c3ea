"""Repositories, documents and transcripts as tables; stored originals; appended tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from condense.operators.repo import VENDOR, language
from condense.shipping import ship

SKIPPED = (*VENDOR, ".git", ".hg", ".svn", ".tox", ".mypy_cache", ".pytest_cache")


def _unlisted(spark: SparkSession, root: str) -> DataFrame:
    """Files whose names Spark's readers skip (a leading _ or .), such as __init__.py, read by the driver."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found, it = [], fs.listFiles(base, True)
    while it.hasNext():
        status = it.next()
        path = status.getPath()
        if path.getName()[:1] in ("_", ".") or any(p[:1] in ("_", ".") for p in path.toString()[len(base.toString()) :].split("/")[1:-1]):
            if not any(p in SKIPPED for p in path.toString().split("/")):
                stream = fs.open(path)
                found.append((path.toString(), datetime.fromtimestamp(status.getModificationTime() / 1000), status.getLen(), bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
                stream.close()
    return spark.createDataFrame(found, "path string, modificationTime timestamp, length long, content binary")


def walk_repository(spark: SparkSession, root: str, with_text: bool = True) -> DataFrame:
    """path, language, size, mtime_ns, content_hash, text of all files below root, skipped folders left out before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select("path", "modificationTime", "length", "content").unionByName(_unlisted(spark, root))
    path = F.substring_index("path", root.rstrip("/").split("://")[-1] + "/", -1)
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    rows = files.withColumn("__p", path).where(~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED))))
    out = rows.select(F.col("__p").alias("path"), language(F.col("__p")).alias("language"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("text"))
    return out if with_text else out.drop("text")


def extract_documents(files: DataFrame) -> DataFrame:
    """path, text (Markdown) of PDF and DOCX files(path, content); null where no reader is installed or reading fails."""
    ship(files.sparkSession)

    def apply(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [_extracted(p, c) for p, c in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(texts, pa.string())], ["path", "text"])

    return files.select("path", "content").mapInArrow(apply, "path string, text string")


def _extracted(path: str, content: bytes) -> str | None:
    import io

    try:
        if path.lower().endswith(".pdf"):
            import pdfplumber

            with pdfplumber.open(io.BytesIO(content)) as pdf:
                return "\n\n".join(page.extract_text() or "" for page in pdf.pages)
        if path.lower().endswith(".docx"):
            import docx

            out = []
            for p in docx.Document(io.BytesIO(content)).paragraphs:
                style = (p.style.name or "") if p.style else ""
                level = int(style[-1]) if style.startswith("Heading ") and style[-1].isdigit() else 0
                mark = "#" * min(level, 6) + " " if level else "- " if style.startswith("List Bullet") else "1. " if style.startswith("List Number") else ""
                out.append(mark + p.text)
            return "\n".join(out)
    except Exception:  # noqa: BLE001  a broken file has no text
        return None
    return None


#: One line of a transcript.
ENTRY = "cwd string, timestamp string, message struct<role:string, content:string>"
BLOCKS = "array<struct<type:string, id:string, name:string, tool_use_id:string, input:struct<command:string, description:string, raw_text:string>, content:string>>"


def read_transcripts(spark: SparkSession, path: str, cwd: str | None = None, days: int | None = None) -> DataFrame:
    """(session, line, cwd, type, id, name, tool_use_id, command, raw_text, content): blocks of JSON-lines transcripts.

    Bad lines are dropped; with cwd, only sessions whose first 20 lines name it.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("session"), F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"))
    if days is not None:
        raw = raw.where(F.col("at") >= F.current_timestamp() - F.make_interval(days=F.lit(days)))
    line = F.row_number().over(W.partitionBy("session").orderBy("__b", "__i"))
    rows = raw.withColumn("line", line).withColumn("e", F.from_json("value", ENTRY)).where("e.message is not null or e.cwd is not null")
    if cwd is not None:
        mine = rows.where((F.col("line") <= 20) & (F.col("e.cwd") == cwd)).select("session").distinct()
        rows = rows.join(mine, "session", "left_semi")
    blocks = rows.select("session", "line", "e.cwd", F.posexplode(F.from_json("e.message.content", BLOCKS)).alias("k", "b"))
    return blocks.select("session", "line", "k", "cwd", "b.type", "b.id", "b.name", "b.tool_use_id", F.col("b.input.command").alias("command"), F.coalesce("b.input.raw_text", "b.content").alias("raw_text"))


def tool_results(blocks: DataFrame) -> DataFrame:
    """(session, id, name, command, raw_text): each result with the last use of its id before it; a use serves once."""
    use = blocks.where("type = 'tool_use'").select("session", "id", "name", "command", F.struct("line", "k").alias("at"))
    result = blocks.where("type = 'tool_result'").select("session", F.col("tool_use_id").alias("id"), "raw_text", F.struct("line", "k").alias("at"))
    both = use.select("*", F.lit(None).cast("string").alias("raw_text"), F.lit(True).alias("is_use")).unionByName(result.select("*", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("command"), F.lit(False).alias("is_use")))
    w = W.partitionBy("session", "id").orderBy("at")
    paired = both.withColumn("u", F.lag("is_use").over(w)).withColumn("n", F.lag("name").over(w)).withColumn("c", F.lag("command").over(w))
    return paired.where(~F.col("is_use") & F.col("u")).select("session", "id", F.col("n").alias("name"), F.col("c").alias("command"), "raw_text")


def discover(results: DataFrame, compressed: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Where rules would save most: rule, calls, tokens over results(doc_id, command, raw_text) not in compressed(text)."""
    from condense.functions.text import count_tokens
    from condense.plans.detect import with_type
    from condense.plans.routing import rule_name

    rows = results.withColumnRenamed("raw_text", "text")
    if compressed is not None:
        rows = rows.withColumn("h", F.sha2("text", 256)).join(compressed.select(F.sha2("text", 256).alias("h")).distinct(), "h", "left_anti").drop("h")
    named = with_type(rows).withColumn("rule", rule_name(F.col("command"), F.col("content_type")))
    return named.groupBy("rule").agg(F.count("*").alias("calls"), F.sum(count_tokens(F.col("text"))).alias("tokens")).orderBy(F.desc("tokens"), "rule").limit(limit)


def stored_originals(texts: DataFrame, at: str = "at") -> DataFrame:
    """content_hash, content, size_bytes, last_used_at: one row for each distinct text(text, at)."""
    rows = texts.where("text is not null").select(F.sha2("text", 256).alias("content_hash"), "text", F.col(at).alias("at"))
    return rows.groupBy("content_hash").agg(F.first("text").alias("content"), F.max("at").alias("last_used_at")).select("content_hash", "content", F.octet_length("content").cast("long").alias("size_bytes"), "last_used_at")


def upserted(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store with new originals in and used ones refreshed."""
    return store.unionByName(fresh).groupBy("content_hash").agg(F.first("content").alias("content"), F.first("size_bytes").alias("size_bytes"), F.max("last_used_at").alias("last_used_at"))


def append_invocations(rows: DataFrame, path: str) -> None:
    """Append telemetry rows, one folder for each day."""
    rows.withColumn("day", F.to_date("recorded_at")).write.mode("append").partitionBy("day").parquet(path)
