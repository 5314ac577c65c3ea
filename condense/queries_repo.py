"""Queries of the repository operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from condense import views
from condense.operators import build
from condense.operators import repo as R

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep


EDGES = """e AS (SELECT * FROM (SELECT DISTINCT 'import' AS kind, 'src/s' || l_suppkey || '.py' AS source_file, 's' || l_partkey AS target_raw, l_linenumber AS line, CASE WHEN l_partkey % 5 <> 0 THEN 'src/s' || (l_partkey % 100) || '.py' END AS target_file
  FROM lineitem) WHERE target_file IS NULL OR target_file <> source_file)"""
FILES = "f AS (SELECT DISTINCT path FROM (SELECT source_file AS path FROM e UNION SELECT target_file FROM e WHERE target_file IS NOT NULL))"
DEGREES = "d AS (SELECT path, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT source_file AS path, 1 AS o, 0 AS i FROM e UNION ALL SELECT target_file, 0, 1 FROM e WHERE target_file IS NOT NULL) GROUP BY 1)"


def _files(edges):
    return edges.select(F.col("source_file").alias("path")).union(edges.where("target_file is not null").select("target_file")).distinct()


@query("degrees", f"WITH {EDGES}, {DEGREES} SELECT * FROM d")
def degrees(spark, sf):
    return R.degrees(views.file_edges(spark, sf))


@query("importance_tiers", f"WITH {EDGES}, {DEGREES} SELECT path, out_degree + in_degree AS degree, CASE ntile(3) OVER (ORDER BY out_degree + in_degree DESC, path) WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS importance FROM d")
def importance_tiers(spark, sf):
    edges = views.file_edges(spark, sf)
    return R.importance(edges, _files(edges))


@query("reverse_imports", f"WITH {EDGES} SELECT target_file AS path, array_to_string(list_sort(list(DISTINCT source_file)), ',') AS importers FROM e WHERE target_file IS NOT NULL GROUP BY 1")
def reverse_imports(spark, sf):
    return R.reverse_imports(views.file_edges(spark, sf)).withColumn("importers", F.array_join("importers", ","))


@query("bfs_hops", f"""WITH {EDGES}, u AS (SELECT source_file AS a, target_file AS b FROM e WHERE target_file IS NOT NULL UNION SELECT target_file, source_file FROM e WHERE target_file IS NOT NULL),
h1 AS (SELECT b AS path FROM u WHERE a = 'src/s2.py'), h2 AS (SELECT b AS path FROM u WHERE a IN (SELECT path FROM h1))
SELECT path, min(hop) AS hop FROM (SELECT 'src/s2.py' AS path, 0 AS hop UNION ALL SELECT path, 1 FROM h1 UNION ALL SELECT path, 2 FROM h2) GROUP BY 1""")
def bfs_hops(spark, sf):
    return R.hops(views.file_edges(spark, sf), ["src/s2.py"], 2)


_IMPORTS = """r AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), f AS (SELECT 'a/s' || s_suppkey || '.py' AS path FROM supplier UNION ALL SELECT 'a/__init__.py'),
c AS (SELECT 'a/s' || s || '.py' AS path, p, CASE p % 4 WHEN 0 THEN '.s' || (p % 2000) WHEN 1 THEN '.' WHEN 2 THEN 'a.s' || (p % 2000) ELSE '..b.x' END AS target, CASE p % 4 WHEN 1 THEN 'a/__init__.py' WHEN 3 THEN NULL ELSE 'a/s' || (p % 2000) || '.py' END AS want FROM r)"""


@query("resolved_imports", f"WITH {_IMPORTS} SELECT c.path, c.target, f.path AS target_file, count(*) AS n FROM c LEFT JOIN f ON c.want = f.path GROUP BY 1, 2, 3")
def resolved_imports(spark, sf):
    """Relative and absolute imports of suppliers' files, a quarter of them of a package, a quarter of nothing known."""
    p = F.col("l_partkey")
    name = F.concat(F.lit("s"), (p % 2000).cast("string"))
    target = F.when(p % 4 == 0, F.concat(F.lit("."), name)).when(p % 4 == 1, ".").when(p % 4 == 2, F.concat(F.lit("a."), name)).otherwise("..b.x")
    rows = views.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    none = F.lit(None).cast("string")
    relations = rows.select(F.concat(F.lit("a/s"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("path"), F.lit("Python").alias("language"), p.cast("int").alias("ordinal"), F.lit("import").alias("kind"), none.alias("source"), target.alias("target"), p.cast("int").alias("line"), none.alias("qualifier"), none.alias("origin"))
    files = views.table(spark, sf, "supplier").select(F.concat(F.lit("a/s"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path")).unionAll(spark.createDataFrame([("a/__init__.py",)], "path string"))
    return R.resolved_imports(relations, files).groupBy("path", "target", "target_file").agg(F.count("*").alias("n"))


FACTS = f"""{EDGES}, {DEGREES}, x AS (SELECT path, CASE ntile(3) OVER (ORDER BY out_degree + in_degree DESC, path) WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS r2 FROM d),
im AS (SELECT source_file AS path, count(*) AS n FROM e GROUP BY 1), ib AS (SELECT target_file AS path, count(DISTINCT source_file) AS n FROM e WHERE target_file IS NOT NULL GROUP BY 1),
fa AS (SELECT x.path, r2, regexp_extract(x.path, 's([0-9]+)', 1) AS k, coalesce(im.n, 0) AS imports, coalesce(ib.n, 0) AS imported_by FROM x LEFT JOIN im USING (path) LEFT JOIN ib USING (path))"""


def _facts(spark, sf):
    edges = views.file_edges(spark, sf)
    files = _files(edges)
    k = F.regexp_extract("path", "s([0-9]+)", 1)
    symbols = files.select("path", F.lit("Python").alias("language"), F.explode(F.array(F.concat(F.lit("load_"), k), F.lit("run"))).alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("line"), F.lit(True).alias("is_public"), (k == "2").alias("is_entry_point"))
    return R.file_intelligence(files, symbols, edges)


@query("file_intelligence", f"WITH {FACTS} SELECT path, imports, imported_by, CASE r2 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS importance, k = '2' AS entry_point, 'load_' || k || ',run' AS top_symbols FROM fa")
def file_intelligence(spark, sf):
    return _facts(spark, sf).select("path", "imports", "imported_by", "importance", "entry_point", F.array_join("top_symbols", ",").alias("top_symbols"))


def _search_sql(q: str) -> str:
    return f"""m AS (SELECT *, CASE WHEN 'load_' || k = '{q}' OR 'run' = '{q}' THEN 0 WHEN 's' || k || '.py' = '{q}' OR 's' || k = '{q}' THEN 1 WHEN 'src' = '{q}' THEN 2 WHEN starts_with('load_' || k, '{q}') OR starts_with('run', '{q}') THEN 3
  WHEN contains('s' || k || '.py', '{q}') THEN 4 WHEN contains('load_' || k, '{q}') OR contains('run', '{q}') THEN 5
  WHEN path IN (SELECT source_file FROM e WHERE list_contains(regexp_split_to_array(target_file, '[/._-]+'), '{q}') UNION SELECT target_file FROM e WHERE list_contains(regexp_split_to_array(source_file, '[/._-]+'), '{q}')) THEN 6 END AS tier FROM fa),
o AS (SELECT path, tier, count(*) OVER () AS total_candidates, row_number() OVER (ORDER BY tier, CASE WHEN k = '2' THEN 0 ELSE 1 END, r2, CASE WHEN tier IN (1, 4) THEN abs(length('s' || k || '.py') - {len(q)}) ELSE 0 END, path) AS rn FROM m WHERE tier IS NOT NULL)"""


NAMES = "['exact_symbol', 'exact_filename', 'exact_directory', 'prefix_symbol', 'filename_contains', 'symbol_contains', 'dependency']"


@query("search", f"WITH {FACTS}, {_search_sql('s2')} SELECT path, {NAMES}[tier + 1] AS evidence, tier, total_candidates, total_candidates > 20 AS truncated FROM o WHERE rn <= 20")
def search(spark, sf):
    return R.search(_facts(spark, sf), "s2")


@query("search_symbols", f"WITH {FACTS}, {_search_sql('load_1')} SELECT path, {NAMES}[tier + 1] AS evidence, tier, total_candidates, total_candidates > 20 AS truncated FROM o WHERE rn <= 20")
def search_symbols(spark, sf):
    return R.search(_facts(spark, sf), "load_1")


def _renamed(sql: str, suffix: str) -> str:
    return sql.replace("m AS (", f"m{suffix} AS (").replace("o AS (", f"o{suffix} AS (").replace("FROM m WHERE", f"FROM m{suffix} WHERE")


@query("merged_search", f"WITH {FACTS}, {_renamed(_search_sql('s2'), '1')}, {_renamed(_search_sql('load_4'), '2')}, a AS (SELECT * FROM o1 WHERE rn <= 5 UNION ALL SELECT * FROM o2 WHERE rn <= 5) SELECT path, {NAMES}[min(tier) + 1] AS evidence, min(tier) AS tier, max(total_candidates) AS total_candidates, max(total_candidates) > 5 AS truncated FROM a GROUP BY path ORDER BY min(tier), path LIMIT 20")
def merged_search(spark, sf):
    return R.merged_search(_facts(spark, sf), ["s2", "load_4"], 5)


SNAPSHOTS = """a AS (SELECT 'p/' || p_partkey AS path, md5(p_type || '|' || (p_partkey % 50)) AS h FROM part WHERE p_partkey % 9 <> 0),
b AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'q/' ELSE 'p/' END || p_partkey AS path, md5(CASE WHEN p_partkey % 7 = 0 THEN 'changed' ELSE p_type END || '|' || (p_partkey % 50)) AS h FROM part WHERE p_partkey % 8 <> 0),
j AS (SELECT coalesce(a.path, b.path) AS path, a.h AS ah, b.h AS bh FROM a FULL JOIN b ON a.path = b.path),
g AS (SELECT path, ah AS h, row_number() OVER (PARTITION BY ah ORDER BY path) AS k FROM j WHERE bh IS NULL), c AS (SELECT path, bh AS h, row_number() OVER (PARTITION BY bh ORDER BY path) AS k FROM j WHERE ah IS NULL)"""


@query("snapshot_diff", f"""WITH {SNAPSHOTS} SELECT 'modified' AS status, path, CAST(NULL AS VARCHAR) AS old_path FROM j WHERE ah <> bh
UNION ALL SELECT CASE WHEN c.path IS NULL THEN 'deleted' WHEN g.path IS NULL THEN 'added' ELSE 'renamed' END, coalesce(c.path, g.path), CASE WHEN c.path IS NOT NULL THEN g.path END FROM g FULL JOIN c ON g.h = c.h AND g.k = c.k""")
def snapshot_diff(spark, sf):
    return R.snapshot_diff(*views.snapshots(spark, sf))


@query("stale_files", f"WITH {SNAPSHOTS} SELECT path FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.path = b.path AND a.h = b.h)")
def stale_files(spark, sf):
    return R.stale(*views.snapshots(spark, sf))


@query("rebuild_reasons", f"""WITH {SNAPSHOTS} SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'deleted' WHEN a.path IS NULL THEN 'new' WHEN a.h <> b.h THEN 'changed' ELSE 'kept' END AS reason FROM a FULL JOIN b ON a.path = b.path""")
def rebuild_reasons(spark, sf):
    return build.reasons(*views.snapshots(spark, sf)).select("path", "reason")


@query("language_stats", "WITH f AS (SELECT CASE p_partkey % 5 WHEN 0 THEN 'Python' WHEN 1 THEN 'TypeScript' WHEN 2 THEN 'Go' WHEN 3 THEN 'Python' END AS language FROM part), c AS (SELECT language, count(*) AS files FROM f WHERE language IS NOT NULL GROUP BY 1) SELECT language, files, round(100.0 * files / sum(files) OVER (), 1) AS pct FROM c")
def language_stats(spark, sf):
    suffix = F.element_at(F.array(*map(F.lit, (".py", ".tsx", ".go", ".pyi", ".txt"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return R.language_stats(views.table(spark, sf, "part").select(F.concat(F.lit("a/b/f"), F.col("p_partkey").cast("string"), suffix).alias("path")))


@query("file_kinds", "WITH f AS (SELECT p_partkey AS k, p_partkey % 6 AS m FROM part) SELECT k, CASE m WHEN 0 THEN 'test' WHEN 1 THEN 'generated' WHEN 2 THEN 'configuration' WHEN 3 THEN 'source' WHEN 4 THEN 'test' ELSE 'generated' END AS kind FROM f")
def file_kinds(spark, sf):
    paths = F.array(*map(F.lit, ("tests/a.py", "web/x.min.js", "pyproject.toml", "src/m.py", "src/m_test.go", "vendor/z/a.go")))
    return views.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), R.file_kind(F.element_at(paths, (F.col("p_partkey") % 6 + 1).cast("int"))).alias("kind"))
