"""Queries of whole-text operators: pipelines, content types, projections, scans, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from condense import views
from condense.operators import diffs, outlines, projection, scans, shell
from condense.operators import lines as L
from condense.plans.catalogue import BY_NAME
from condense.plans.routing import compress, routed
from condense.queries_lines import DIFFS, EVENTS
from condense.sources import files
from condense.streaming.sessions import batch_dedup

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep


@query("generic_pipeline")
def generic_pipeline(spark, sf):
    """The longest built-in chain over raw documents; tested against a plain fold."""
    return BY_NAME["generic"].pipeline().run(views.table(spark, sf, "documents"))


@query("compressed_logs")
def compressed_logs(spark, sf):
    """Routing and compression of event logs under their commands."""
    logs = L.render(views.event_log(spark, sf)).withColumn("command", F.when(F.col("doc_id") % 3 == 0, "git log").when(F.col("doc_id") % 3 == 1, "npm install").otherwise("tail -f app.log"))
    return compress(logs, names=["git-log", "npm", "cat"])


_MIXED = """m AS (SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN '{"a": ' || o_custkey || '}' WHEN 1 THEN 'key = ' || o_custkey WHEN 2 THEN 'diff --git a/x b/x' WHEN 3 THEN '=== FAILURES ===' WHEN 4 THEN 'Found ' || o_custkey || ' errors in 3 files' WHEN 5 THEN 'x' || chr(10) || 'Traceback (most recent call last):' WHEN 6 THEN chr(27) || '[1m' || o_orderpriority ELSE o_orderpriority END AS text FROM orders)"""


def _mixed(spark, sf):
    o = views.table(spark, sf, "orders")
    c, p = F.col("o_custkey").cast("string"), F.col("o_orderpriority")
    texts = [F.concat(F.lit('{"a": '), c, F.lit("}")), F.concat(F.lit("key = "), c), F.lit("diff --git a/x b/x"), F.lit("=== FAILURES ==="), F.concat(F.lit("Found "), c, F.lit(" errors in 3 files")), F.lit("x\nTraceback (most recent call last):"), F.concat(F.lit("\x1b[1m"), p), p]
    return o.select(F.col("o_orderkey").alias("k"), F.get(F.array(*texts), (F.col("o_orderkey") % 8).cast("int")).alias("text"))


_TYPES = "CASE k % 8 WHEN 0 THEN 'json' WHEN 1 THEN 'toml' WHEN 2 THEN 'diff' WHEN 3 THEN 'pytest' WHEN 4 THEN 'mypy' WHEN 5 THEN 'traceback' WHEN 6 THEN 'ansi' ELSE 'text' END"


@query("content_types", f"WITH {_MIXED} SELECT k, {_TYPES} AS content_type FROM m")
def content_types(spark, sf):
    from condense.plans.detect import with_type

    return with_type(_mixed(spark, sf)).select("k", "content_type")


@query("routed_rules", f"WITH {_MIXED} SELECT k, CASE k % 8 WHEN 0 THEN 'cat-json' WHEN 1 THEN 'cat-toml' WHEN 2 THEN 'git-diff' WHEN 3 THEN 'pytest' WHEN 4 THEN 'mypy' ELSE 'generic' END AS filter_name FROM m")
def routed_rules(spark, sf):
    return routed(_mixed(spark, sf)).select("k", "filter_name")


@query("never_expand", f"WITH {EVENTS}, r AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS original, string_agg(line || '!', chr(10) ORDER BY pos) AS grown FROM l GROUP BY 1) SELECT doc_id, CAST(ceil(length(original) / 4.0) AS BIGINT) AS original_tokens, CAST(ceil(length(original) / 4.0) AS BIGINT) AS final_tokens, original AS text FROM r")
def never_expand(spark, sf):
    from condense.operators.stages import RegexReplace
    from condense.plans.pipeline import Pipeline

    return Pipeline([RegexReplace(rules=((r"$", "!"),))]).run_lines(views.event_log(spark, sf))


_ITEM = """'  {' || chr(10) || '    "event_id": ' || event_id || ',' || chr(10) || '    "event_type": "' || event_type || '"' || CASE WHEN event_id % 2 = 0 THEN ',' || chr(10) || '    "note": "value"' ELSE '' END || chr(10) || '  }'"""


@query("json_projection", f"""WITH a AS (SELECT user_id, list({_ITEM} ORDER BY event_id, event_type) AS l FROM events GROUP BY 1)
SELECT user_id, '[' || chr(10) || array_to_string(CASE WHEN len(l) > 5 THEN list_concat(l[1:3], ['  {{' || chr(10) || '    "__omitted_items__": "' || (len(l) - 5) || ' items hidden"' || chr(10) || '  }}'], l[len(l) - 1:]) ELSE l END, ',' || chr(10)) || chr(10) || ']' AS text FROM a""")
def json_projection(spark, sf):
    rows = views.table(spark, sf, "events").groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("event_id", "event_type", F.when(F.col("event_id") % 2 == 0, "value").alias("note"))))).alias("text"))
    return projection.project_json(rows)


@query("log_projection", f"""WITH t AS (SELECT user_id AS doc_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
k AS (SELECT *, event_type AS line FROM t WHERE event_id % 7 <> 0), s AS (SELECT *, CASE WHEN lag(line) OVER (PARTITION BY doc_id ORDER BY pos) = line THEN 0 ELSE 1 END AS st FROM k),
i AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY pos) AS isl FROM s), g AS (SELECT doc_id, isl, min(pos) AS pos, first(line) AS line, count(*) AS n FROM i GROUP BY 1, 2),
a AS (SELECT doc_id, string_agg(CASE WHEN n > 1 THEN line || ' (×' || n || ')' ELSE line END, chr(10) ORDER BY pos) AS text FROM g GROUP BY 1)
SELECT d.doc_id, coalesce(a.text, '') AS text FROM (SELECT DISTINCT user_id AS doc_id FROM events) d LEFT JOIN a USING (doc_id)""")
def log_projection(spark, sf):
    return projection.project_log(L.render(views.ansi_log(spark, sf)))


@query("structured_json", """WITH a AS (SELECT user_id AS doc_id, list_sort(list('  {"id": ' || lpad(CAST(event_id AS VARCHAR), 8, '1') || '}')) AS l FROM events GROUP BY 1)
SELECT doc_id, '[' || chr(10) || CASE WHEN len(l) > 6 THEN array_to_string(l[1:3], ',' || chr(10)) || ',' || chr(10) || '... ' || (len(l) - 3) || ' more items omitted (' || len(l) || ' total) ...' ELSE array_to_string(l, ',' || chr(10)) END || chr(10) || ']' AS text FROM a""")
def structured_json(spark, sf):
    """Long arrays of pretty-printed JSON collapse."""
    rows = views.table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('  {"id": '), F.lpad(F.col("event_id").cast("string"), 8, "1"), F.lit("}")))), ",\n").alias("body"))
    docs = rows.select(F.col("user_id").alias("doc_id"), F.concat(F.lit("[\n"), "body", F.lit("\n]")).alias("text"))
    return L.render(outlines.StructuredDataSummarize(format="json").apply(L.split(docs)))


@query("python_outline", """SELECT p_partkey AS doc_id, replace('import os|import sys|import json|from a.b import (c, d, e, f)|||def part_' || p_partkey || '(x):|    \"\"\"doc\"\"\"|', '|', chr(10)) AS text FROM part""")
def python_outline(spark, sf):
    """Sources generated from parts; function bodies and import runs collapse."""
    p = views.table(spark, sf, "part")
    text = F.concat(F.lit("import os\nimport sys\nimport json\nfrom a.b import (c, d, e, f)\n\n\ndef part_"), F.col("p_partkey").cast("string"), F.lit("(x):\n    \"\"\"doc\"\"\"\n    y = x + "), F.col("p_size").cast("string"), F.lit("\n    return y\n"))
    return L.render(outlines.PythonAstSummarize().apply(L.split(p.select(F.col("p_partkey").alias("doc_id"), text.alias("text")))))


@query("code_outline", """SELECT p_partkey AS doc_id, replace('package p||type T' || p_partkey || ' struct {|' || chr(9) || 'n int|}||func (t *T' || p_partkey || ') Size(x int) int {|}|', '|', chr(10)) AS text FROM part""")
def code_outline(spark, sf):
    """Sources in a language with braces, generated from parts; bodies of functions go, types stay."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.lit("package p\n\ntype T"), k, F.lit(" struct {\n\tn int\n}\n\nfunc (t *T"), k, F.lit(") Size(x int) int {\n\tif x > "), n, F.lit(' {\n\t\treturn len("}")\n\t}\n\treturn t.n // {\n}\n'))
    return L.render(outlines.CodeAstSummarize(language="go").apply(L.split(views.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")))))


@query("diff_sections", f"""WITH {DIFFS}, s AS (SELECT doc_id, line, pos, sum(CASE WHEN starts_with(line, 'diff --git ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l)
SELECT doc_id, CAST(section AS INT) AS section, min(regexp_extract(line, '^diff --git a/(.*?) b/(.*)', 1)) FILTER (starts_with(line, 'diff --git ')) AS old_path, count(*) AS n_lines FROM s GROUP BY 1, 2""")
def diff_sections(spark, sf):
    found = diffs.line_sections(views.diff_log_by_parts(spark, sf))
    return found.select("doc_id", F.col("section").cast("int").alias("section"), "old_path", F.size(F.split("body", "\n", -1)).cast("long").alias("n_lines"))


@query("diff_file_counts", "SELECT o_orderpriority AS doc_id, count(*) AS files FROM orders GROUP BY 1")
def diff_file_counts(spark, sf):
    return diffs.file_counts(views.diff_log(spark, sf))


@query("session_dedup", """WITH t AS (SELECT conv_id % 5 AS session, conv_id * 1000 + turn AS o, text, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id * 1000 + turn) AS n FROM conversations),
p AS (SELECT *, max(n) OVER (PARTITION BY session, text ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM t)
SELECT p.session, p.o, p.prev IS NOT NULL AND (SELECT count(DISTINCT q.text) FROM t q WHERE q.session = p.session AND q.n > p.prev AND q.n < p.n) < 20 AS is_hit FROM p""")
def session_dedup(spark, sf):
    turns = views.table(spark, sf, "conversations").select((F.col("conv_id") % 5).alias("session"), (F.col("conv_id") * 1000 + F.col("turn")).alias("o"), "text")
    return batch_dedup(turns, "session", "o")


@query("stored_originals", "SELECT sha256(text) AS content_hash, max(doc_id) AS last_used_at, min(strlen(text)) AS size_bytes FROM documents WHERE text IS NOT NULL GROUP BY 1")
def stored_originals(spark, sf):
    return files.stored_originals(views.table(spark, sf, "documents"), "doc_id").select("content_hash", "last_used_at", "size_bytes")


@query("secret_scan", r"""WITH f AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '\bgh[pousr]_[A-Za-z0-9]{36,}\b') THEN 'github_token' END, CASE WHEN regexp_matches(text, '\b(AKIA|ASIA)[0-9A-Z]{16}\b') THEN 'aws_access_key' END,
 CASE WHEN regexp_matches(text, '-----BEGIN (RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----') THEN 'private_key' END, CASE WHEN regexp_matches(text, '\bxox[abprs]-[A-Za-z0-9-]{10,}') THEN 'slack_token' END, CASE WHEN regexp_matches(text, '\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}') THEN 'jwt' END,
 CASE WHEN regexp_matches(text, '(?i)\b(api[_-]?key|secret|token|passw(or)?d)\b\s*[:=]\s*["'']?[A-Za-z0-9/+_.-]{16,}') THEN 'assigned_secret' END], lambda x: x IS NOT NULL) AS found FROM documents)
SELECT doc_id, array_to_string(found, ',') AS found FROM f WHERE len(found) > 0""")
def secret_scan(spark, sf):
    return scans.secret_scan(views.table(spark, sf, "documents")).select("doc_id", F.array_join("found", ",").alias("found"))


_COMMANDS = (
    ("git status", "condense git status", "rule", "git-status"), ("cd a && npm install", "cd a && condense npm install", "rule", "npm"), ("FOO=1 pytest -q | tail", "FOO=1 condense pytest -q | tail", "rule", "pytest"),
    ("cat <<EOF", None, "heredoc", None), ("git log --format=%H", None, "structured output", None), ("ls -la | xargs rm", None, "no rule", None), ("sudo docker ps", "condense sudo docker ps", "rule", "docker-ps"), ("echo hi", None, "no rule", None),
)
_COMMAND_ROWS = ", ".join(f"({i}, '{c}', {str(w is not None).lower()}, '{w or c}', '{r}', " + (f"'{n}')" if n else "CAST(NULL AS VARCHAR))") for i, (c, w, r, n) in enumerate(_COMMANDS))


@query("command_classes", f"SELECT o_orderkey AS k, command, should_rewrite, rewritten, reason, rule FROM orders JOIN (VALUES {_COMMAND_ROWS}) AS t(m, command, should_rewrite, rewritten, reason, rule) ON o_orderkey % 8 = m")
def command_classes(spark, sf):
    c = F.element_at(F.array(*(F.lit(c[0]) for c in _COMMANDS)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return shell.classified(views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), c.alias("command")))


@query("discover", f"""WITH {EVENTS}, r AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM l GROUP BY 1)
SELECT CASE doc_id % 2 WHEN 0 THEN 'git-log' ELSE 'npm' END AS rule, count(*) AS calls, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS tokens FROM r GROUP BY 1""")
def discover(spark, sf):
    rows = L.render(views.event_log(spark, sf)).select("doc_id", F.when(F.col("doc_id") % 2 == 0, "git log").otherwise("npm ci").alias("command"), F.col("text").alias("raw_text"))
    return files.discover(rows)


@query("query_terms", "SELECT p_partkey AS k, 'load_' || p_partkey || ',ReadFile,a b' AS terms FROM part")
def query_terms(spark, sf):
    text = F.concat(F.lit("where is load_"), F.col("p_partkey").cast("string"), F.lit(" used by ReadFile and readfile in 'a b'?"))
    found = scans.query_terms(text)
    order = F.concat(F.filter(found, lambda x: x.contains("_")), F.filter(found, lambda x: ~x.contains("_") & ~x.contains(" ")), F.filter(found, lambda x: x.contains(" ")))
    return views.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.array_join(order, ",").alias("terms"))
