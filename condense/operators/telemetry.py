"""Reports over the append-only table of invocations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Labels of rows that answer questions about a repository; they compress nothing themselves.
SYNTHESIS_LABELS = ("repo-profile", "repo-symbols", "repo-graph", "repo-dashboard", "repo-explore", "repo-search", "mcp-repo-context")
NO_FILTER = "(no filter matched)"
READ_PREFIX = "Read: "


def project_key(path: Column) -> Column:
    """Forward slashes, no trailing slash, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+$", ""))


def with_key(rows: DataFrame) -> DataFrame:
    """The stored key, or where it is missing the one its path gives."""
    return rows.withColumn("project_key_normalized", F.coalesce("project_key_normalized", project_key(F.col("project_path"))))


def in_project(rows: DataFrame, path: str) -> DataFrame:
    key = path.replace("\\", "/").rstrip("/").lower()
    if not key or key.endswith(":"):
        raise ValueError(f"{path!r} is no project folder")
    k = F.col("project_key_normalized")
    return with_key(rows).where((k == key) | k.startswith(key + "/"))


def within(rows: DataFrame, days: int | None = None, since: datetime | None = None, now: datetime | None = None) -> DataFrame:
    """Rows since a moment, or of the last days before now; real timestamps on both sides."""
    if since is not None:
        return rows.where(F.col("recorded_at") >= F.lit(since))
    if days is None:
        return rows
    moment = F.lit(now) if now is not None else F.current_timestamp()
    return rows.where(F.col("recorded_at") >= moment - F.make_interval(days=F.lit(days)))


def counted(rows: DataFrame) -> DataFrame:
    """Without the service's own rows; rows without a rule stay."""
    return rows.where(F.col("filter_name").isNull() | ~F.col("filter_name").isin(*SYNTHESIS_LABELS))


def gain(rows: DataFrame) -> DataFrame:
    """One row of totals."""
    saved = F.col("original_tokens") - F.col("final_tokens")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = counted(rows).agg(
        F.count("*").alias("invocations"),
        zero(F.sum(saved)).alias("tokens_saved"),
        zero(F.sum("original_tokens")).alias("tokens_before"),
        zero(F.sum("final_tokens")).alias("tokens_after"),
        zero(F.sum(F.when(~F.col("was_passthrough"), F.col("original_tokens")))).alias("eligible_tokens"),
        zero(F.sum(F.greatest(saved, F.lit(0)))).alias("gross_savings"),
        zero(F.sum(F.greatest(-saved, F.lit(0)))).alias("overhead"),
        F.count_if(saved < 0).alias("negative_rows"),
        F.count_if("was_passthrough").alias("passthroughs"),
        F.count_if(F.col("command").startswith(READ_PREFIX)).alias("reads"),
    )
    n = F.col("invocations")
    return out.withColumn("hit_rate", F.when(n > 0, (n - F.col("passthroughs")) / n).otherwise(0.0)).withColumn("low_sample", n < 5)


def top_filters(rows: DataFrame, limit: int = 5) -> DataFrame:
    """Rules by tokens saved; equal ones by name."""
    saved = F.sum(F.col("original_tokens") - F.col("final_tokens"))
    return rows.where("filter_name is not null").groupBy("filter_name").agg(saved.alias("tokens_saved")).orderBy(F.desc("tokens_saved"), "filter_name").limit(limit)


def filter_analytics(rows: DataFrame) -> DataFrame:
    """Use and effect of each rule, rows without one under a label of their own."""
    o, f = F.col("original_tokens"), F.col("final_tokens")
    label = F.coalesce("filter_name", F.lit(NO_FILTER))
    out = rows.groupBy(label.alias("label")).agg(
        F.count("*").alias("invocations"), F.sum("original_tokens").alias("tokens_before"), F.sum("final_tokens").alias("tokens_after"), F.sum(o - f).alias("tokens_saved"),
        F.sum(F.when(o > 0, o).otherwise(0)).alias("eligible_before"), F.count_if("was_passthrough").alias("passthroughs"),
        F.avg("duration_ms").alias("avg_duration_ms"), F.avg(F.when(o > 0, 100.0 * (o - f) / o)).alias("avg_pct"),
    )
    all_rows = F.sum("invocations").over(W.partitionBy(F.lit(0)))
    agg = F.when(F.col("eligible_before") > 0, 100.0 * F.col("tokens_saved") / F.col("eligible_before"))
    return out.withColumn("usage_pct", 100.0 * F.col("invocations") / all_rows).withColumn("aggregate_pct", agg)


def recent(rows: DataFrame, limit: int = 20) -> DataFrame:
    return rows.orderBy(F.desc("recorded_at"), F.desc("id")).limit(limit)


def low_performers(analytics: DataFrame, least_uses: int = 5, below: float = 20.0) -> DataFrame:
    """Rules used often enough whose effect is small, the smaller of both percentages first."""
    worst = F.least("aggregate_pct", "avg_pct")
    return analytics.where((F.col("label") != NO_FILTER) & (F.col("invocations") >= least_uses)).withColumn("worst_pct", worst).where(F.col("worst_pct") < below).orderBy("worst_pct", "label")


def divergence(analytics: DataFrame, benchmark: DataFrame, nominate: float = 15.0) -> DataFrame:
    """Real effect against the benchmark's, by size of the difference; benchmark(filter_name, benchmark_pct)."""
    both = analytics.join(benchmark, analytics["label"] == benchmark["filter_name"]).withColumn("delta_pct", F.col("aggregate_pct") - F.col("benchmark_pct"))
    return both.withColumn("nominated", F.abs("delta_pct") >= nominate).orderBy(F.desc(F.abs("delta_pct")), "label")


def uncovered(analytics: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rules in use that no benchmark case covers."""
    return analytics.where(F.col("label") != NO_FILTER).join(benchmark, analytics["label"] == benchmark["filter_name"], "left_anti")


def usage_growth(history: DataFrame) -> DataFrame:
    """history(snapshot_at, filter_name, invocations): change from the first to the last snapshot that both hold the rule."""
    ends = history.agg(F.min("snapshot_at").alias("lo"), F.max("snapshot_at").alias("hi"))
    marked = history.join(F.broadcast(ends))  # one row
    grouped = marked.groupBy("filter_name").agg(F.max(F.when(F.col("snapshot_at") == F.col("lo"), F.col("invocations"))).alias("first"), F.max(F.when(F.col("snapshot_at") == F.col("hi"), F.col("invocations"))).alias("last"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    return grouped.where("first is not null and last is not null and lo < hi").select("filter_name", "first", "last", (F.col("last") - F.col("first")).alias("growth"))


def trend(ticks: DataFrame, step: float = 0.5) -> DataFrame:
    """ticks(at, pct): up, down or flat against the tick before."""
    change = F.col("pct") - F.lag("pct").over(W.partitionBy(F.lit(0)).orderBy("at"))
    return ticks.withColumn("trend", F.when(change > step, "up").when(change < -step, "down").otherwise("flat"))


def stage_stats(trace: DataFrame) -> DataFrame:
    """Executions, skips and percentages of each stage type from a pipeline's trace."""
    pct = F.when(~F.col("was_skipped") & (F.col("tokens_before") > 0), 100.0 * (F.col("tokens_before") - F.col("tokens_after")) / F.col("tokens_before"))
    return trace.groupBy("stage_type").agg(
        F.count_if(~F.col("was_skipped")).alias("executions"), F.count_if("was_skipped").alias("skipped"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"),
        F.avg(pct).alias("avg_pct"), F.min(pct).alias("min_pct"), F.max(pct).alias("max_pct"),
    )


def compression_summary(trace: DataFrame) -> DataFrame:
    """Tokens saved by each stage type that saved or added any, in the order of first use."""
    saved = F.sum(F.col("tokens_before") - F.col("tokens_after"))
    return trace.groupBy("stage_type").agg(saved.alias("tokens_saved"), F.min("stage_idx").alias("first_idx")).where("tokens_saved <> 0").orderBy("first_idx", "stage_type")


def effectiveness(trace: DataFrame) -> DataFrame:
    """Each stage type's share of all tokens saved, as High (15 % and more), Medium (5 %) or Low."""
    by_type = trace.groupBy("stage_type").agg(F.sum(F.col("tokens_before") - F.col("tokens_after")).alias("tokens_saved"))
    total = F.sum("tokens_saved").over(W.partitionBy(F.lit(0)))
    share = F.when(total > 0, 100.0 * F.col("tokens_saved") / total).otherwise(0.0)
    return by_type.withColumn("share_pct", share).withColumn("rating", F.when(F.col("share_pct") >= 15, "High").when(F.col("share_pct") >= 5, "Medium").otherwise("Low")).orderBy(F.desc("tokens_saved"), "stage_type")


def benchmark_aggregate(cases: DataFrame) -> DataFrame:
    """cases(category, ecosystem, original_tokens, final_tokens): totals by category, by ecosystem and over all."""
    out = cases.groupingSets([["category"], ["ecosystem"], []], "category", "ecosystem").agg(F.count("*").alias("cases"), F.sum("original_tokens").alias("tokens_before"), F.sum("final_tokens").alias("tokens_after"))
    return out.withColumn("pct", F.when(F.col("tokens_before") > 0, 100.0 * (F.col("tokens_before") - F.col("tokens_after")) / F.col("tokens_before")))


def benchmark_rules(cases: DataFrame) -> DataFrame:
    """cases(filter_name, original_tokens, final_tokens): for each rule its cases, their share of all, and the tokens it saves in per cent."""
    named = cases.where("filter_name is not null").groupBy("filter_name").agg(F.count("*").alias("case_count"), F.sum("original_tokens").alias("o"), F.sum("final_tokens").alias("f"))
    all_cases = cases.agg(F.count("*").alias("total"))  # one row
    pct = F.when(F.col("o") > 0, 100.0 * (F.col("o") - F.col("f")) / F.col("o")).otherwise(0.0)
    return named.join(F.broadcast(all_cases)).select("filter_name", "case_count", (100.0 * F.col("case_count") / F.col("total")).alias("usage_pct"), pct.alias("compression_pct"))


def extremes(cases: DataFrame, n: int = 5) -> DataFrame:
    """cases(id, original_tokens, final_tokens): the n best and the n worst by per cent saved, ties by id, as (kind, place, id, pct)."""
    pct = F.when(F.col("original_tokens") > 0, 100.0 * (F.col("original_tokens") - F.col("final_tokens")) / F.col("original_tokens")).otherwise(0.0)
    rows = cases.select("id", pct.alias("pct"))

    def end(kind: str, order) -> DataFrame:
        few = rows.orderBy(order, "id").limit(n)
        return few.select(F.lit(kind).alias("kind"), F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order, "id")).alias("place"), "id", "pct")

    return end("best", F.desc("pct")).unionAll(end("worst", F.asc("pct")))


def append_snapshot(history: DataFrame, analytics: DataFrame, at: datetime) -> DataFrame:
    """history(snapshot_at, filter_name, invocations) with analytics(label, invocations) as one more snapshot; a snapshot of the same moment gives way."""
    fresh = analytics.select(F.lit(at).cast("timestamp").alias("snapshot_at"), F.col("label").alias("filter_name"), F.col("invocations").cast("long").alias("invocations"))
    return history.where(F.col("snapshot_at") != F.lit(at)).select("snapshot_at", "filter_name", "invocations").unionByName(fresh)


def regressions(current: DataFrame, baseline: DataFrame, points: float = 2.0) -> DataFrame:
    """(id, pct) now against before: new, regression, improvement or unchanged."""
    both = current.alias("c").join(baseline.alias("b"), "id", "left").select("id", F.col("c.pct").alias("pct"), F.col("b.pct").alias("before"))
    change = F.col("pct") - F.col("before")
    return both.withColumn("status", F.when(F.col("before").isNull(), "new").when(change < -points, "regression").when(change > points, "improvement").otherwise("unchanged"))


def retained_by_age(rows: DataFrame, at: str, days: int, now: datetime | None = None) -> DataFrame:
    moment = F.lit(now) if now is not None else F.current_timestamp()
    return rows.where(F.col(at) >= moment - F.make_interval(days=F.lit(days)))


def retained_by_size(rows: DataFrame, key: str, size: str, at: str, most: int) -> DataFrame:
    """Evict the oldest (equal ages by key) until the total fits.

    Sums by day come first, so only the day in which the limit falls is ordered row by row.
    """
    days = rows.groupBy(F.to_date(at).alias("__day")).agg(F.sum(size).alias("__size"))
    newer = F.sum("__size").over(W.partitionBy(F.lit(0)).orderBy(F.desc("__day")).rowsBetween(W.unboundedPreceding, -1))
    days = days.select("__day", "__size", F.coalesce(newer, F.lit(0)).alias("__newer"))
    placed = rows.withColumn("__day", F.to_date(at)).join(F.broadcast(days), "__day")
    whole = placed.where(F.col("__newer") + F.col("__size") <= most)
    edge = placed.where((F.col("__newer") + F.col("__size") > most) & (F.col("__newer") < most))
    upto = F.sum(size).over(W.partitionBy("__day").orderBy(F.desc(at), F.desc(key)).rowsBetween(W.unboundedPreceding, W.currentRow))
    # rows are evicted from the old end, so all newer rows than a kept one are kept
    kept = edge.withColumn("__upto", F.col("__newer") + upto).where(F.col("__upto") <= most).drop("__upto")
    return whole.unionByName(kept).drop("__day", "__size", "__newer")
