"""Queries of the line stages, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from condense import views
from condense.functions.text import count_tokens
from condense.operators import lines as L
from condense.operators import stages as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep


OUT = ("doc_id", "pos", "line", "decision")
DOCS = "l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"
EVENT = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos"
EVENTS = f"l AS (SELECT user_id AS doc_id, {EVENT}, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type AS line FROM events)"
TYPES = f"l AS (SELECT user_id AS doc_id, {EVENT}, event_type AS line FROM events)"
ERRORS = f"l AS (SELECT user_id AS doc_id, {EVENT}, 'mod' || (event_id % 97) || '.py:' || (event_id % 31) || ': error: bad ' || event_type AS line FROM events)"
PARTS = "l AS (SELECT p_brand AS doc_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, rpad(p_brand, 14, ' ') || rpad(p_type, 30, ' ') || p_size AS line FROM part)"
DIFFS = """l AS (SELECT o_orderpriority AS doc_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey, k) - 1 AS pos, line FROM (
  SELECT o_orderpriority, o_orderkey, unnest(range(0, 7)) AS k, unnest(['diff --git a/src/f' || o_orderkey || '.py b/src/f' || o_orderkey || '.py',
    CASE WHEN o_orderkey % 3 = 0 THEN 'old mode 100644' ELSE '--- a/src/f' || o_orderkey || '.py' END,
    CASE WHEN o_orderkey % 3 = 0 THEN 'new mode 100755' ELSE '+++ b/src/f' || o_orderkey || '.py' END,
    ' context line 0 of ' || o_orderpriority, ' context line 1 of ' || o_orderpriority, ' context line 2 of ' || o_orderpriority, ' context line 3 of ' || o_orderpriority]) AS line FROM orders))"""
COST = "greatest(1, CAST(ceil(length({0}) / 4.0) AS BIGINT))"


@query("line_stats", f"WITH {DOCS} SELECT doc_id, count(*) AS total, count(*) AS kept, CAST(0 AS BIGINT) AS compressed, CAST(0 AS BIGINT) AS protected FROM l GROUP BY 1")
def line_stats(spark, sf):
    return L.stats(views.document_lines(spark, sf))


@query("render_round_trip", "SELECT doc_id, text FROM documents")
def render_round_trip(spark, sf):
    return L.render(views.document_lines(spark, sf))


@query("tokens_by_source", "SELECT source, count(*) AS docs, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def tokens_by_source(spark, sf):
    return views.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum(count_tokens(F.col("text"))).alias("tokens"))


@query("strip_lines", f"WITH {EVENTS} SELECT doc_id, pos, line, CASE WHEN regexp_matches(line, ' error$') THEN 'PROTECT' WHEN regexp_matches(line, ' (view|click)$') THEN 'COMPRESS' ELSE 'KEEP' END AS decision FROM l")
def strip_lines(spark, sf):
    return S.StripLines(patterns=(" (view|click)$",), preserve_patterns=(" error$",)).apply(views.event_log(spark, sf)).select(*OUT)


@query("remove_ansi", f"""WITH l AS (SELECT user_id AS doc_id, {EVENT}, event_id, event_type FROM events)
SELECT doc_id, pos, CASE WHEN event_id % 7 = 0 THEN chr(27) || '[0m' || chr(27) || '[2K' ELSE event_type END AS line, CASE WHEN event_id % 7 = 0 THEN 'COMPRESS' ELSE 'KEEP' END AS decision FROM l""")
def remove_ansi(spark, sf):
    return S.RemoveAnsi(strip_inline=True).apply(views.ansi_log(spark, sf)).select(*OUT)


@query("regex_replace", f"WITH {EVENTS} SELECT doc_id, pos, regexp_replace(regexp_replace(line, '\\d+:\\d+:(\\d+)', 'T\\1', 'g'), 'e', 'E', 'g') AS line, 'KEEP' AS decision FROM l")
def regex_replace(spark, sf):
    return S.RegexReplace(rules=((r"\d+:\d+:(\d+)", r"T\1"), ("e", "E"))).apply(views.event_log(spark, sf)).select(*OUT)


@query("truncate_lines", f"WITH {DOCS} SELECT doc_id, pos, CASE WHEN length(line) > 80 THEN substr(line, 1, 80 - length('…[truncated]')) || '…[truncated]' ELSE line END AS line, 'KEEP' AS decision FROM l")
def truncate_lines(spark, sf):
    return S.TruncateLines(max_length=80).apply(views.document_lines(spark, sf)).select(*OUT)


@query("column_padding", f"""WITH {PARTS}, c AS (SELECT *, regexp_replace(regexp_replace(line, '(\\S) {{2,}}(\\S)', '\\1 \\2', 'g'), '(\\S) {{2,}}(\\S)', '\\1 \\2', 'g') AS n FROM l)
SELECT doc_id, pos, CASE WHEN {COST.format('n')} < {COST.format('line')} THEN n ELSE line END AS line, 'KEEP' AS decision FROM c""")
def column_padding(spark, sf):
    return S.ColumnPaddingCompression(patterns=("^Brand",)).apply(views.part_table(spark, sf)).select(*OUT)


@query("column_padding_first_gap", f"""WITH {PARTS}, c AS (SELECT *, regexp_replace(line, '(\\S) {{2,}}(\\S)', '\\1 \\2') AS n FROM l)
SELECT doc_id, pos, CASE WHEN {COST.format('n')} < {COST.format('line')} THEN n ELSE line END AS line, 'KEEP' AS decision FROM c""")
def column_padding_first_gap(spark, sf):
    return S.ColumnPaddingCompression(patterns=("^Brand",), max_gaps=1).apply(views.part_table(spark, sf)).select(*OUT)


ISLAND = "i AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS isl FROM m), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, isl) AS n, row_number() OVER (PARTITION BY doc_id, isl ORDER BY pos) AS rn FROM i)"


@query("dedup_count", f"""WITH {TYPES}, m AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY pos) = line, false) AS same FROM l), {ISLAND}
SELECT doc_id, pos, CASE WHEN rn = 1 AND n > 1 THEN line || ' (×' || n || ')' ELSE line END AS line, CASE WHEN rn > 1 THEN 'COMPRESS' ELSE 'KEEP' END AS decision FROM n""")
def dedup_count(spark, sf):
    return S.DeduplicateConsecutive(show_count=True).apply(views.type_log(spark, sf)).select(*OUT)


@query("group_run", f"""WITH {TYPES}, k AS (SELECT *, line IN ('view', 'click') AS hit FROM l), m AS (SELECT *, hit AND coalesce(lag(hit) OVER (PARTITION BY doc_id ORDER BY pos), false) AS same FROM k), {ISLAND}
SELECT doc_id, pos, CASE WHEN hit AND rn = 1 AND n >= 3 THEN line || ' (×' || n || ')' ELSE line END AS line, CASE WHEN hit AND n >= 3 AND rn > 1 THEN 'COMPRESS' ELSE 'KEEP' END AS decision FROM n""")
def group_run(spark, sf):
    return S.GroupRepeated(patterns=("^(view|click)$",), min_count=3).apply(views.type_log(spark, sf)).select(*OUT)


@query("group_exact", f"""WITH {TYPES}, m AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY pos) = line, false) AS same FROM l), {ISLAND}
SELECT doc_id, pos, CASE WHEN rn = 1 AND n >= 2 THEN line || ' (×' || n || ')' ELSE line END AS line, CASE WHEN n >= 2 AND rn > 1 THEN 'COMPRESS' ELSE 'KEEP' END AS decision FROM n""")
def group_exact(spark, sf):
    return S.GroupRepeated(patterns=(".",), exact_match=True).apply(views.type_log(spark, sf)).select(*OUT)


LOCATION = r"^(.*?): error: "


def _told(n: str, places: str) -> str:
    return f"'(' || ({n} - 1) || ' more with the same message at: ' || array_to_string({places}, ', ') || ')'"


@query("group_global_location", f"""WITH {ERRORS}, k AS (SELECT *, regexp_extract(line, '^(.*?): error: ', 1) AS loc, regexp_replace(line, '^.*?(: error: )', '\\1') AS key FROM l),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS rn, list(loc) OVER (PARTITION BY doc_id, key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ps FROM k),
a AS (SELECT doc_id, pos, 0 AS sub, line, CASE WHEN n >= 3 AND rn > 1 THEN 'COMPRESS' ELSE 'KEEP' END AS decision FROM g
  UNION ALL SELECT doc_id, pos, 1, {_told('n', 'ps[2:]')}, 'KEEP' FROM g WHERE n >= 3 AND rn = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) - 1 AS pos, line, decision FROM a""")
def group_global_location(spark, sf):
    return S.GroupRepeated(patterns=(": error: ",), min_count=3, location_pattern=LOCATION, scope="global").apply(views.error_log(spark, sf)).select(*OUT)


@query("group_run_location", f"""WITH {ERRORS}, k AS (SELECT *, regexp_extract(line, '^(.*?): error: ', 1) AS loc, regexp_replace(line, '^.*?(: error: )', '\\1') AS key FROM l),
m AS (SELECT *, coalesce(lag(key) OVER (PARTITION BY doc_id ORDER BY pos) = key, false) AS same FROM k), i AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS isl FROM m),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, isl) AS n, row_number() OVER (PARTITION BY doc_id, isl ORDER BY pos) AS rn, list(loc) OVER (PARTITION BY doc_id, isl ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ps FROM i),
a AS (SELECT doc_id, pos, 0 AS sub, line, CASE WHEN n >= 2 AND rn > 1 THEN 'COMPRESS' ELSE 'KEEP' END AS decision FROM g
  UNION ALL SELECT doc_id, pos, 1, {_told('n', 'ps[2:]')}, 'KEEP' FROM g WHERE n >= 2 AND rn = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) - 1 AS pos, line, decision FROM a""")
def group_run_location(spark, sf):
    return S.GroupRepeated(patterns=(": error: ",), location_pattern=LOCATION).apply(views.error_log(spark, sf)).select(*OUT)


@query("collapse_context", f"""WITH {EVENTS}, d AS (SELECT *, CASE WHEN line LIKE '% purchase' THEN 'PROTECT' ELSE 'KEEP' END AS decision FROM l),
k AS (SELECT *, decision = 'KEEP' AS hit FROM d), m AS (SELECT *, hit AND coalesce(lag(hit) OVER (PARTITION BY doc_id ORDER BY pos), false) AS same FROM k), {ISLAND},
c AS (SELECT *, hit AND rn > 2 AND rn <= n - 2 AS mid, '... ' || (n - 4) || ' unchanged lines omitted ...' AS told FROM n),
s AS (SELECT *, sum(CASE WHEN mid THEN {COST.format('line')} END) OVER (PARTITION BY doc_id, isl) AS cost FROM c), f AS (SELECT *, mid AND {COST.format('told')} < cost AS fold FROM s)
SELECT doc_id, pos, CASE WHEN fold AND rn = 3 THEN told ELSE line END AS line, CASE WHEN fold AND rn > 3 THEN 'COMPRESS' ELSE decision END AS decision FROM f""")
def collapse_context(spark, sf):
    lines = S.StripLines(patterns=("^$",), preserve_patterns=(" purchase$",)).apply(views.event_log(spark, sf))
    return S.CollapseUnchangedContext(context_lines=2).apply(lines).select(*OUT)


@query("numeric_range", f"""WITH l AS (SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1 AS pos, CAST(l_partkey AS VARCHAR) AS line FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)),
m AS (SELECT *, coalesce(CAST(lag(line) OVER w AS BIGINT) + 1 = CAST(line AS BIGINT) AND length(lag(line) OVER w) = length(line), false) AS same FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), {ISLAND},
r AS (SELECT *, first(line) OVER w || '-' || last(line) OVER w AS t, sum({COST.format('line')}) OVER w AS cost FROM n WINDOW w AS (PARTITION BY doc_id, isl ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, n > 1 AND {COST.format('t')} < cost AS fold FROM r)
SELECT doc_id, pos, CASE WHEN fold AND rn = 1 THEN t ELSE line END AS line, CASE WHEN fold AND rn > 1 THEN 'COMPRESS' ELSE 'KEEP' END AS decision FROM f""")
def numeric_range(spark, sf):
    return S.NumericRangeCompression().apply(views.part_runs(spark, sf)).select(*OUT)


RELATIVE = f"""t AS (SELECT *, CAST(epoch(strptime(substr(line, 1, 19), '%Y-%m-%d %H:%M:%S')) AS BIGINT) AS s FROM l), g AS (SELECT *, s - lag(s) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM t),
x AS (SELECT *, CASE WHEN gap IS NULL THEN line WHEN gap = 0 THEN '+0s' || substr(line, 20) WHEN gap % 3600 = 0 THEN '+' || (gap // 3600) || 'h' || substr(line, 20) WHEN gap % 60 = 0 THEN '+' || (gap // 60) || 'm' || substr(line, 20) ELSE '+' || gap || 's' || substr(line, 20) END AS new FROM g),
y AS (SELECT *, sum({COST.format('line')} - {COST.format('new')}) OVER (PARTITION BY doc_id) AS gain FROM x), z AS (SELECT doc_id, pos, CASE WHEN gain > 0 THEN new ELSE line END AS line FROM y)"""


@query("relative_timestamps", f"WITH {EVENTS}, {RELATIVE} SELECT doc_id, pos, line, 'KEEP' AS decision FROM z")
def relative_timestamps(spark, sf):
    return S.RelativeTimestampCompression().apply(views.event_log(spark, sf)).select(*OUT)


@query("path_prefix_fold", f"""WITH l AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS doc_id, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]*)', 1) ORDER BY url, page_id) - 1 AS pos, url AS line FROM pages WHERE url IS NOT NULL),
b AS (SELECT doc_id, count(*) AS n, min(line) AS lo, max(line) AS hi FROM l GROUP BY 1),
c AS (SELECT *, list_max([k FOR k IN range(0, length(lo) + 1) IF starts_with(hi, substr(lo, 1, k))]) AS k FROM b),
p AS (SELECT doc_id, n, regexp_extract(substr(lo, 1, k), '^(.*/)', 1) AS pre FROM c),
q AS (SELECT l.*, n, pre, substr(line, length(pre) + 1) AS child, pre || ' (' || n || ' entries):' AS head FROM l JOIN p USING (doc_id)),
f AS (SELECT *, n > 1 AND pre <> '' AND {COST.format('head')} < sum({COST.format('line')} - {COST.format('child')}) OVER (PARTITION BY doc_id) AS fold FROM q),
a AS (SELECT doc_id, pos, 1 AS sub, CASE WHEN fold THEN child ELSE line END AS line FROM f UNION ALL SELECT doc_id, pos, 0, head FROM f WHERE fold AND pos = 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) - 1 AS pos, line, 'KEEP' AS decision FROM a""")
def path_prefix_fold(spark, sf):
    return S.PathPrefixFold(patterns=(r"^\S+/\S*$",)).apply(views.url_paths(spark, sf)).select(*OUT)


@query("diff_protect", f"""WITH {DIFFS}, s AS (SELECT *, starts_with(line, 'diff --git ') AS head, sum(CASE WHEN starts_with(line, 'diff --git ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS seg FROM l),
c AS (SELECT *, max(CASE WHEN starts_with(line, '--- a/') OR starts_with(line, '+++ b/') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, seg) AS named FROM s)
SELECT doc_id, pos, line, CASE WHEN head AND named = 0 THEN 'PROTECT' ELSE 'KEEP' END AS decision FROM c""")
def diff_protect(spark, sf):
    return S.ProtectDiffFilenameHeaders().apply(views.diff_log(spark, sf)).select(*OUT)


def _greedy(order: str, limit: int, name: str) -> str:
    """The budget taken line by line, as a recursive query."""
    return f"""{name}_in AS (SELECT doc_id, pos, {COST.format('line')} AS c, row_number() OVER (PARTITION BY doc_id ORDER BY pos {order}) AS rn FROM l),
{name} AS (SELECT doc_id, pos, rn, CASE WHEN c <= {limit} THEN {limit} - c ELSE {limit} END AS budget, c <= {limit} AS kept FROM {name}_in WHERE rn = 1
  UNION ALL SELECT o.doc_id, o.pos, o.rn, CASE WHEN o.c <= p.budget THEN p.budget - o.c ELSE p.budget END, o.c <= p.budget FROM {name} p JOIN {name}_in o ON o.doc_id = p.doc_id AND o.rn = p.rn + 1)"""


_TOTAL = f"tot AS (SELECT doc_id, sum({COST.format('line')}) AS t FROM l GROUP BY 1)"


def _budget(limit: int, strategy: str) -> str:
    if strategy == "both":
        return f"""WITH RECURSIVE {DOCS}, {_TOTAL}, {_greedy('ASC', limit // 2, 'h')}, {_greedy('DESC', limit // 2, 't')}
SELECT l.doc_id, l.pos, l.line, CASE WHEN tot.t > {limit} AND NOT h.kept AND NOT t.kept THEN 'COMPRESS' ELSE 'KEEP' END AS decision FROM l JOIN tot USING (doc_id) JOIN h USING (doc_id, pos) JOIN t USING (doc_id, pos)"""
    return f"""WITH RECURSIVE {DOCS}, {_TOTAL}, {_greedy('ASC' if strategy == 'head' else 'DESC', limit, 'h')}
SELECT l.doc_id, l.pos, l.line, CASE WHEN tot.t > {limit} AND NOT h.kept THEN 'COMPRESS' ELSE 'KEEP' END AS decision FROM l JOIN tot USING (doc_id) JOIN h USING (doc_id, pos)"""


for _strategy in ("head", "tail", "both"):
    QUERIES[f"budget_{_strategy}"] = lambda spark, sf, s=_strategy: S.MaxTokens(limit=300, strategy=s).apply(views.document_lines(spark, sf)).select(*OUT)
    SQL[f"budget_{_strategy}"] = _budget(300, _strategy)


@query("match_output", f"""WITH {TYPES}, d AS (SELECT doc_id, regexp_full_match(string_agg(line, chr(10) ORDER BY pos), '(view|click|purchase|[a-z]+)(\\n(view|click|[a-z]+))*') AND count(*) < 60 AS hit, count(*) AS n FROM l GROUP BY 1)
SELECT doc_id, pos, CASE WHEN hit AND pos = 0 THEN 'short log' ELSE line END AS line, CASE WHEN hit AND pos > 0 THEN 'COMPRESS' ELSE 'KEEP' END AS decision FROM l JOIN d USING (doc_id)""")
def match_output(spark, sf):
    return S.MatchOutput(pattern=r"[a-z]+(\n[a-z]+){0,58}", summary="short log").apply(views.type_log(spark, sf)).select(*OUT)


def slice_chain() -> list[S.Stage]:
    return [S.RelativeTimestampCompression(), S.StripLines(patterns=(" view$",), preserve_patterns=(" error$",)), S.MaxTokens(limit=100, strategy="tail")]


_SLICE = f"""WITH RECURSIVE {EVENTS}, {RELATIVE}, d AS (SELECT *, {COST.format('line')} AS c, CASE WHEN regexp_matches(line, ' error$') THEN 'PROTECT' WHEN regexp_matches(line, ' view$') THEN 'COMPRESS' ELSE 'KEEP' END AS dec FROM z),
tot AS (SELECT doc_id, sum(CASE WHEN dec <> 'COMPRESS' THEN c END) AS t FROM d GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS rn FROM d),
h AS (SELECT doc_id, pos, rn, CASE WHEN dec = 'KEEP' AND c <= 100 THEN 100 - c ELSE 100 END AS budget, dec = 'KEEP' AND c <= 100 AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.doc_id, o.pos, o.rn, CASE WHEN o.dec = 'KEEP' AND o.c <= p.budget THEN p.budget - o.c ELSE p.budget END, o.dec = 'KEEP' AND o.c <= p.budget FROM h p JOIN o ON o.doc_id = p.doc_id AND o.rn = p.rn + 1),
r AS (SELECT d.doc_id, string_agg(d.line, chr(10) ORDER BY d.pos) FILTER (d.dec = 'PROTECT' OR (d.dec = 'KEEP' AND (t <= 100 OR kept))) AS text FROM d JOIN tot USING (doc_id) JOIN h USING (doc_id, pos) GROUP BY 1),
b AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS original FROM l GROUP BY 1)
SELECT doc_id, CAST(ceil(length(original) / 4.0) AS BIGINT) AS original_tokens, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS final_tokens, CAST(ceil(length(original) / 4.0) - ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS saved, coalesce(text, '') AS text FROM r JOIN b USING (doc_id)"""


@query("log_summary", _SLICE)
def log_summary(spark, sf):
    """The flagship: time deltas, stripping with protection, a token budget, and the guards."""
    from condense.plans.pipeline import Pipeline

    found = Pipeline(slice_chain()).run_lines(views.event_log(spark, sf))
    return found.select("doc_id", "original_tokens", "final_tokens", (F.col("original_tokens") - F.col("final_tokens")).alias("saved"), "text")
