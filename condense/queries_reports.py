"""Queries of telemetry, trace and retention reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from condense import views
from condense.operators import telemetry as T
from condense.plans.pipeline import Pipeline
from condense.queries_lines import EVENTS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep


INV = """inv AS (SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN 'Read: ' || event_type ELSE event_type END AS command, '/Proj/U' || (user_id % 7) || '/' AS project_path, '/proj/u' || (user_id % 7) AS key,
  CAST(floor(value * 10) AS BIGINT) AS o,
  CASE WHEN event_type = 'error' THEN CAST(floor(value * 10) AS BIGINT) WHEN event_id % 5 = 0 THEN CAST(floor(value * 10) AS BIGINT) + 3 ELSE CAST(floor(value * 10) AS BIGINT) // 2 END AS f,
  CASE WHEN event_type <> 'error' THEN CASE WHEN event_id % 13 = 0 THEN 'repo-search' ELSE event_type END END AS filter_name, event_type = 'error' AS pass, CAST(event_id % 17 AS DOUBLE) AS ms, ts FROM events)"""
GAIN = """count(*) AS invocations, CAST(coalesce(sum(o - f), 0) AS BIGINT) AS tokens_saved, CAST(coalesce(sum(o), 0) AS BIGINT) AS tokens_before, CAST(coalesce(sum(f), 0) AS BIGINT) AS tokens_after,
  CAST(coalesce(sum(CASE WHEN NOT pass THEN o END), 0) AS BIGINT) AS eligible_tokens, CAST(coalesce(sum(greatest(o - f, 0)), 0) AS BIGINT) AS gross_savings, CAST(coalesce(sum(greatest(f - o, 0)), 0) AS BIGINT) AS overhead,
  count(*) FILTER (f > o) AS negative_rows, count(*) FILTER (pass) AS passthroughs, count(*) FILTER (starts_with(command, 'Read: ')) AS reads, CASE WHEN count(*) > 0 THEN (count(*) - count(*) FILTER (pass)) / count(*) ELSE 0 END AS hit_rate, count(*) < 5 AS low_sample"""
OWN = "(filter_name IS NULL OR filter_name <> 'repo-search')"
ANALYTICS = f"""WITH {INV}, a AS (SELECT coalesce(filter_name, '(no filter matched)') AS label, count(*) AS invocations, CAST(sum(o) AS BIGINT) AS tokens_before, CAST(sum(f) AS BIGINT) AS tokens_after, CAST(sum(o - f) AS BIGINT) AS tokens_saved,
  CAST(sum(CASE WHEN o > 0 THEN o ELSE 0 END) AS BIGINT) AS eligible_before, count(*) FILTER (pass) AS passthroughs, avg(ms) AS avg_duration_ms, avg(CASE WHEN o > 0 THEN 100.0 * (o - f) / o END) AS avg_pct FROM inv GROUP BY 1),
an AS (SELECT *, 100.0 * invocations / sum(invocations) OVER () AS usage_pct, CASE WHEN eligible_before > 0 THEN 100.0 * tokens_saved / eligible_before END AS aggregate_pct FROM a)"""
BENCH = "b AS (SELECT * FROM (VALUES ('view', 10.0), ('click', 50.0), ('gone', 1.0)) AS v(filter_name, benchmark_pct))"


def _bench(spark):
    return spark.createDataFrame([("view", 10.0), ("click", 50.0), ("gone", 1.0)], "filter_name string, benchmark_pct double")


def _round(df, *names):
    """Doubles to six places, so sums in another order compare equal."""
    return df.withColumns({n: F.round(n, 6) for n in names})


def _rounded(sql: str, columns: str) -> str:
    names = columns.split()
    return f"{sql} REPLACE ({', '.join(f'round({n}, 6) AS {n}' for n in names)})"


@query("gain", f"WITH {INV} SELECT * REPLACE (round(hit_rate, 6) AS hit_rate) FROM (SELECT {GAIN} FROM inv WHERE {OWN})")
def gain(spark, sf):
    return _round(T.gain(views.invocations(spark, sf)), "hit_rate")


@query("gain_project", f"WITH {INV} SELECT * REPLACE (round(hit_rate, 6) AS hit_rate) FROM (SELECT {GAIN} FROM inv WHERE {OWN} AND (key = '/proj/u3' OR starts_with(key, '/proj/u3/')))")
def gain_project(spark, sf):
    return _round(T.gain(T.in_project(views.invocations(spark, sf), "/Proj/U3/")), "hit_rate")


@query("gain_since", f"WITH {INV}, m AS (SELECT max(ts) - INTERVAL 10 DAY AS since FROM events) SELECT * REPLACE (round(hit_rate, 6) AS hit_rate) FROM (SELECT {GAIN} FROM inv, m WHERE {OWN} AND ts >= since)")
def gain_since(spark, sf):
    rows = views.invocations(spark, sf)
    last = rows.agg(F.max("recorded_at")).first()[0]
    return _round(T.gain(T.within(rows, days=10, now=last)), "hit_rate")


@query("top_filters", f"WITH {INV} SELECT filter_name, CAST(sum(o - f) AS BIGINT) AS tokens_saved FROM inv WHERE filter_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_filters(spark, sf):
    return T.top_filters(views.invocations(spark, sf))


DOUBLES = "avg_duration_ms avg_pct usage_pct aggregate_pct"


@query("filter_analytics", f"{ANALYTICS} {_rounded('SELECT *', DOUBLES)} FROM an")
def filter_analytics(spark, sf):
    return _round(T.filter_analytics(views.invocations(spark, sf)), *DOUBLES.split())


@query("low_performers", f"{ANALYTICS}, w AS (SELECT *, least(aggregate_pct, avg_pct) AS worst_pct FROM an WHERE label <> '(no filter matched)' AND invocations >= 5) {_rounded('SELECT *', DOUBLES + ' worst_pct')} FROM w WHERE worst_pct < 40")
def low_performers(spark, sf):
    return _round(T.low_performers(T.filter_analytics(views.invocations(spark, sf)), below=40.0), *DOUBLES.split(), "worst_pct")


@query("divergence", f"{ANALYTICS}, {BENCH}, d AS (SELECT *, aggregate_pct - benchmark_pct AS delta_pct FROM an JOIN b ON label = filter_name) SELECT label, round(aggregate_pct, 6) AS aggregate_pct, CAST(benchmark_pct AS DOUBLE) AS benchmark_pct, round(delta_pct, 6) AS delta_pct, abs(delta_pct) >= 15 AS nominated FROM d")
def divergence(spark, sf):
    found = T.divergence(T.filter_analytics(views.invocations(spark, sf)), _bench(spark))
    return _round(found.select("label", "aggregate_pct", "benchmark_pct", "delta_pct", "nominated"), "aggregate_pct", "delta_pct")


@query("uncovered", f"{ANALYTICS}, {BENCH} SELECT label, invocations FROM an WHERE label <> '(no filter matched)' AND label NOT IN (SELECT filter_name FROM b)")
def uncovered(spark, sf):
    return T.uncovered(T.filter_analytics(views.invocations(spark, sf)), _bench(spark)).select("label", "invocations")


@query("usage_growth", "WITH h AS (SELECT date_trunc('day', ts) AS tick, event_type, count(*) AS n FROM events GROUP BY ALL), e AS (SELECT min(tick) AS lo, max(tick) AS hi FROM h) SELECT a.event_type AS filter_name, a.n AS \"first\", b.n AS \"last\", b.n - a.n AS growth FROM h a, h b, e WHERE a.event_type = b.event_type AND a.tick = lo AND b.tick = hi AND lo < hi")
def usage_growth(spark, sf):
    history = views.table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").alias("snapshot_at"), F.col("event_type").alias("filter_name")).agg(F.count("*").alias("invocations"))
    return T.usage_growth(history)


@query("trend", "WITH t AS (SELECT date_trunc('day', ts) AS tick, avg(value) AS pct FROM events GROUP BY 1), c AS (SELECT *, pct - lag(pct) OVER (ORDER BY tick) AS d FROM t) SELECT tick, round(pct, 6) AS pct, CASE WHEN d > 0.5 THEN 'up' WHEN d < -0.5 THEN 'down' ELSE 'flat' END AS trend FROM c")
def trend(spark, sf):
    ticks = views.table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").alias("at")).agg(F.avg("value").alias("pct"))
    return _round(T.trend(ticks), "pct").withColumnRenamed("at", "tick")


@query("recent", f"WITH {INV} SELECT id, command, o AS original_tokens, f AS final_tokens, filter_name, ts AS recorded_at FROM inv ORDER BY ts DESC, id DESC LIMIT 20")
def recent(spark, sf):
    return T.recent(views.invocations(spark, sf)).select("id", "command", "original_tokens", "final_tokens", "filter_name", "recorded_at")


_STRIPPED = f"""s1 AS (SELECT *, CASE WHEN regexp_matches(line, ' error$') THEN 'PROTECT' WHEN regexp_matches(line, ' (view|click)$') THEN 'COMPRESS' ELSE 'KEEP' END AS d1 FROM l),
s2 AS (SELECT *, CASE WHEN length(line) > 24 AND d1 = 'KEEP' THEN substr(line, 1, 24) ELSE line END AS line2 FROM s1),
t AS (SELECT doc_id, count(*) AS n, CAST(ceil((sum(length(line)) + count(*) - 1) / 4.0) AS BIGINT) AS t0,
  CAST(ceil((coalesce(sum(length(line)) FILTER (d1 <> 'COMPRESS'), 0) + greatest(count(*) FILTER (d1 <> 'COMPRESS') - 1, 0)) / 4.0) AS BIGINT) AS t1, count(*) FILTER (d1 = 'COMPRESS') AS z1, count(*) FILTER (d1 = 'KEEP') AS k1,
  CAST(ceil((coalesce(sum(length(line2)) FILTER (d1 <> 'COMPRESS'), 0) + greatest(count(*) FILTER (d1 <> 'COMPRESS') - 1, 0)) / 4.0) AS BIGINT) AS t2 FROM s2 GROUP BY 1),
tr AS (SELECT doc_id, 0 AS stage_idx, 'strip_lines' AS stage_type, n AS lines_before, n AS lines_after, z1 AS lines_compressed, t0 AS tokens_before, t1 AS tokens_after, false AS was_skipped FROM t
  UNION ALL SELECT doc_id, 1, 'truncate_lines', n, n, CAST(0 AS BIGINT), t1, t2, k1 = 0 FROM t)"""


def _trace(spark, sf):
    from condense.operators.stages import StripLines, TruncateLines

    chain = [StripLines(patterns=(" (view|click)$",), preserve_patterns=(" error$",)), TruncateLines(max_length=24, marker="x" * 24)]
    return Pipeline(chain).trace(views.event_log(spark, sf))


@query("stage_trace", f"WITH {EVENTS}, {_STRIPPED} SELECT * FROM tr")
def stage_trace(spark, sf):
    return _trace(spark, sf)


_PCT = "CASE WHEN NOT was_skipped AND tokens_before > 0 THEN 100.0 * (tokens_before - tokens_after) / tokens_before END"


@query("stage_stats", f"WITH {EVENTS}, {_STRIPPED} SELECT stage_type, count(*) FILTER (NOT was_skipped) AS executions, count(*) FILTER (was_skipped) AS skipped, CAST(sum(tokens_before) AS BIGINT) AS tokens_before, CAST(sum(tokens_after) AS BIGINT) AS tokens_after, round(avg({_PCT}), 6) AS avg_pct, round(min({_PCT}), 6) AS min_pct, round(max({_PCT}), 6) AS max_pct FROM tr GROUP BY 1")
def stage_stats(spark, sf):
    return _round(T.stage_stats(_trace(spark, sf)), "avg_pct", "min_pct", "max_pct")


@query("compression_summary", f"WITH {EVENTS}, {_STRIPPED} SELECT stage_type, CAST(sum(tokens_before - tokens_after) AS BIGINT) AS tokens_saved, min(stage_idx) AS first_idx FROM tr GROUP BY 1 HAVING sum(tokens_before - tokens_after) <> 0")
def compression_summary(spark, sf):
    return T.compression_summary(_trace(spark, sf))


@query("effectiveness", f"WITH {EVENTS}, {_STRIPPED}, e AS (SELECT stage_type, CAST(sum(tokens_before - tokens_after) AS BIGINT) AS tokens_saved FROM tr GROUP BY 1), p AS (SELECT *, CASE WHEN sum(tokens_saved) OVER () > 0 THEN 100.0 * tokens_saved / sum(tokens_saved) OVER () ELSE 0 END AS share_pct FROM e) SELECT stage_type, tokens_saved, round(share_pct, 6) AS share_pct, CASE WHEN share_pct >= 15 THEN 'High' WHEN share_pct >= 5 THEN 'Medium' ELSE 'Low' END AS rating FROM p")
def effectiveness(spark, sf):
    return _round(T.effectiveness(_trace(spark, sf)), "share_pct")


@query("benchmark_aggregate", f"WITH {INV}, c AS (SELECT command AS category, key AS ecosystem, o, f FROM inv) SELECT category, ecosystem, count(*) AS cases, CAST(sum(o) AS BIGINT) AS tokens_before, CAST(sum(f) AS BIGINT) AS tokens_after, round(CASE WHEN sum(o) > 0 THEN 100.0 * (sum(o) - sum(f)) / sum(o) END, 6) AS pct FROM c GROUP BY GROUPING SETS ((category), (ecosystem), ())")
def benchmark_aggregate(spark, sf):
    cases = T.with_key(views.invocations(spark, sf)).select(F.col("command").alias("category"), F.col("project_key_normalized").alias("ecosystem"), "original_tokens", "final_tokens")
    return _round(T.benchmark_aggregate(cases), "pct")


@query("regressions", "WITH c AS (SELECT o_orderkey AS id, o_totalprice % 90 AS pct FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS id, (o_totalprice + o_custkey % 9 - 4) % 90 AS pct FROM orders WHERE o_orderkey % 4 <> 0) SELECT c.id, CASE WHEN b.pct IS NULL THEN 'new' WHEN c.pct - b.pct < -2 THEN 'regression' WHEN c.pct - b.pct > 2 THEN 'improvement' ELSE 'unchanged' END AS status FROM c LEFT JOIN b USING (id)")
def regressions(spark, sf):
    o = views.table(spark, sf, "orders")
    now = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") % 90).alias("pct"))
    before = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), ((F.col("o_totalprice") + F.col("o_custkey") % 9 - 4) % 90).alias("pct"))
    return T.regressions(now, before).select("id", "status")


@query("retention_age", "WITH m AS (SELECT max(ts) - INTERVAL 90 DAY AS since FROM events) SELECT event_id FROM events, m WHERE ts >= since")
def retention_age(spark, sf):
    rows = views.table(spark, sf, "events")
    return T.retained_by_age(rows, "ts", 90, rows.agg(F.max("ts")).first()[0]).select("event_id")


@query("retention_size", "WITH r AS (SELECT event_id, sum(length(props) + 100) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS upto FROM events) SELECT event_id FROM r WHERE upto <= 50000")
def retention_size(spark, sf):
    rows = views.table(spark, sf, "events").withColumn("size", (F.length("props") + 100).cast("long"))
    return T.retained_by_size(rows, "event_id", "size", "ts", 50_000).select("event_id")


_CASES = """c AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber < 7 THEN l_returnflag END AS filter_name, CAST(l_quantity * 10 AS BIGINT) AS o, CAST(l_quantity * 10 AS BIGINT) - CAST(l_quantity * 100 * l_discount AS BIGINT) AS f FROM lineitem)"""


def _cases(spark, sf):
    quantity = F.col("l_quantity")
    original = (quantity * 10).cast("long")
    return views.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") < 7, F.col("l_returnflag")).alias("filter_name"), original.alias("original_tokens"), (original - F.round(quantity * 100 * F.col("l_discount")).cast("long")).alias("final_tokens"))


@query("benchmark_rules", f"WITH {_CASES} SELECT filter_name, count(*) AS case_count, 100.0 * count(*) / (SELECT count(*) FROM c) AS usage_pct, 100.0 * (sum(o) - sum(f)) / sum(o) AS compression_pct FROM c WHERE filter_name IS NOT NULL GROUP BY 1")
def benchmark_rules(spark, sf):
    return T.benchmark_rules(_cases(spark, sf))


@query("benchmark_extremes", f"""WITH {_CASES}, p AS (SELECT id, CASE WHEN o > 0 THEN 100.0 * (o - f) / o ELSE 0.0 END AS pct FROM c)
SELECT * FROM (SELECT 'best' AS kind, row_number() OVER (ORDER BY pct DESC, id) AS place, id, pct FROM p ORDER BY pct DESC, id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'worst' AS kind, row_number() OVER (ORDER BY pct, id) AS place, id, pct FROM p ORDER BY pct, id LIMIT 5)""")
def benchmark_extremes(spark, sf):
    return T.extremes(_cases(spark, sf))
