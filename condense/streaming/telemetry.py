"""Telemetry as a stream: the append sink, running totals, and compression in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from condense.plans.pipeline import Pipeline


def tracking_sink(rows: DataFrame, path: str, checkpoint: str, every: str = "250 milliseconds") -> StreamingQuery:
    """Append invocations by day; file sinks with a checkpoint write each row once."""
    return rows.withColumn("day", F.to_date("recorded_at")).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").trigger(processingTime=every).outputMode("append").start()


def running_gain(rows: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tokens saved by window and rule, with late rows up to a watermark."""
    saved = F.col("original_tokens") - F.col("final_tokens")
    return rows.withColumn("recorded_at", F.col("recorded_at").cast("timestamp")).withWatermark("recorded_at", late).groupBy(F.window("recorded_at", window).alias("window"), "filter_name").agg(F.count("*").alias("invocations"), F.sum(saved).alias("tokens_saved")).select(F.col("window.start").alias("start"), "filter_name", "invocations", "tokens_saved")


def compress_stream(docs: DataFrame, pipeline: Pipeline, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of documents through a chain; stages need windows that streams lack, batches don't."""

    def write(batch: DataFrame, number: int) -> None:
        pipeline.run(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
