"""Repository intelligence as joins: import resolution, degrees, hops, search, snapshot differences.

Tables: symbols(path, language, name, kind, line, is_public, is_entry_point), relationships(path,
language, ordinal, kind, source, target, line, qualifier, origin), edges(kind, source_file,
target_raw, line, source_symbol, qualifier, target_file, target_symbol).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from condense.functions.text import file_name, file_stem, parent

#: File suffixes of each language.
LANGUAGES = {
    ".py": "Python", ".pyi": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript",
    ".go": "Go", ".java": "Java", ".rs": "Rust", ".cs": "C#",
}
#: Folders of code that others wrote.
VENDOR = ("node_modules", "vendor", "third_party", "dist", "build", ".venv", "venv", "__pycache__", "target", "site-packages")
#: Names and endings of configuration files, marks of generated ones, suffixes that imports leave out.
CONFIG_NAMES = ("pyproject.toml", "package.json", "cargo.toml", "go.mod", "pom.xml", "build.gradle", "setup.cfg", "setup.py", "tsconfig.json", "dockerfile", "makefile")
CONFIG_SUFFIXES = (".toml", ".yaml", ".yml", ".json", ".ini", ".cfg", ".env", ".properties", ".xml")
GENERATED_NAME = r"(?i)(\.min\.(js|css)|\.pb\.go|_pb2\.py|\.g\.cs|\.generated\.[a-z]+)$"
GENERATED_MARK = r"(?i)(@generated|do not edit|auto-?generated)"
JS_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), suffix)


def folders(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def is_vendored(path: Column) -> Column:
    return F.arrays_overlap(folders(path), F.array(*map(F.lit, VENDOR)))


def is_test(path: Column) -> Column:
    name = F.lower(file_name(path))
    return F.arrays_overlap(folders(path), F.array(*map(F.lit, ("test", "tests", "__tests__", "spec")))) | name.rlike(r"^test_|_test\.[a-z]+$|\.(test|spec)\.[a-z]+$|^conftest\.py$")


def is_fixture(path: Column) -> Column:
    inner = F.arrays_overlap(folders(path), F.array(*map(F.lit, ("fixtures", "fixture", "testdata", "__fixtures__", "samples"))))
    return inner & F.arrays_overlap(folders(path), F.array(*map(F.lit, ("test", "tests", "__tests__", "spec"))))


def file_kind(path: Column, head: Column | None = None) -> Column:
    """test, generated, configuration or source; head is the text's first 64 KiB."""
    name = F.lower(file_name(path))
    made = name.rlike(GENERATED_NAME) | is_vendored(path)
    if head is not None:
        made = made | F.coalesce(F.substring(head, 1, 65536).rlike(GENERATED_MARK), F.lit(False))
    config = name.isin(*CONFIG_NAMES) | functools.reduce(lambda a, b: a | b, (name.endswith(s) for s in CONFIG_SUFFIXES))
    return F.when(is_test(path), "test").when(made, "generated").when(config, "configuration").otherwise("source")


def language_stats(files: DataFrame) -> DataFrame:
    """language, files, pct of files with a known language."""
    known = files.select(language(F.col("path")).alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("files"))
    return known.withColumn("pct", F.round(100.0 * F.col("files") / F.sum("files").over(W.partitionBy(F.lit(0))), 1)).orderBy(F.desc("files"), "language")


def repository_stats(files: DataFrame) -> DataFrame:
    folder = parent(F.col("path"))
    return files.agg(F.count("*").alias("files"), F.countDistinct(F.when(folder != "", folder)).alias("directories"))


def resolved_imports(relationships: DataFrame, files: DataFrame) -> DataFrame:
    """Import relationships with target_file: the first candidate path that exists, Java by unique suffix."""
    imports = relationships.where("kind = 'import'").withColumn("__id", F.xxhash64("path", "ordinal", "target", "line"))
    target, folder = F.col("target"), parent(F.col("path"))
    dots = F.length(F.regexp_extract(target, r"^(\.*)", 1))
    dotted = F.regexp_replace(F.regexp_replace(target, r"^\.+", ""), r"\.", "/")
    up = F.split(folder, "/")
    base = F.array_join(F.slice(up, 1, F.greatest(F.size(up) - F.greatest(dots - 1, F.lit(0)), F.lit(0))), "/")
    joined = lambda a, b: F.regexp_replace(F.concat_ws("/", F.when(a != "", a), F.when(b != "", b)), "/+", "/")
    module = F.when(dots > 0, joined(base, dotted)).otherwise(dotted)
    package = joined(module, F.lit("__init__.py"))
    python = F.when(dotted == "", F.when(dots > 0, F.array(package)).otherwise(F.array())).otherwise(F.array(F.concat(module, F.lit(".py")), package))
    # a/b/../c/./d: a fold over the parts
    norm = lambda p: F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), lambda a, x: F.when((x == ".") | (x == ""), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))), "/")
    near = norm(F.concat_ws("/", folder, target))
    probes = F.array(*(F.concat(near, F.lit(s)) for s in JS_SUFFIXES), *(F.concat(near, F.lit("/index" + s)) for s in JS_SUFFIXES))
    script = F.when(near.rlike(r"[^/.][^/]*\.[^/.]*$"), F.concat(F.array(near), probes)).otherwise(probes)
    # the last part of a path names an item of the module before it
    crate = F.regexp_replace(F.regexp_replace(target, "^crate::", ""), "(::)?[^:]*$", "")
    inner = F.concat(F.lit("src/"), F.regexp_replace(crate, "::", "/"))
    rust = F.when(crate == "", F.array(F.lit("src/lib.rs"), F.lit("src/main.rs"))).otherwise(F.array(F.concat(inner, F.lit(".rs")), F.concat(inner, F.lit("/mod.rs"))))
    none = F.array().cast("array<string>")
    lang = F.col("language")
    candidates = F.when(lang == "Python", python).when(lang.isin("JavaScript", "TypeScript") & target.startswith("."), script).when((lang == "Rust") & target.startswith("crate::"), rust).otherwise(none)
    tried = imports.select("__id", F.posexplode(candidates).alias("rank", "candidate"))
    hits = tried.join(files.select(F.col("path").alias("candidate")), "candidate").groupBy("__id").agg(F.min_by("candidate", "rank").alias("target_file"))
    suffix = F.concat(F.lit("/"), F.regexp_replace(target, r"\.", "/"), F.lit(".java"))
    java = imports.where("language = 'Java'").select("__id", suffix.alias("suffix"), file_name(suffix).alias("name"))
    named = files.where(F.col("path").endswith(".java")).select("path", file_name(F.col("path")).alias("name"))
    unique = java.join(named, "name").where(F.concat(F.lit("/"), "path").endswith(F.col("suffix"))).groupBy("__id").agg(F.count("*").alias("n"), F.first("path").alias("target_file")).where("n = 1").drop("n")
    return imports.join(hits.unionByName(unique), "__id", "left").drop("__id")


def resolved_edges(relationships: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """All relationships as edges: types and calls by declarations in the file, else by the import that binds the name."""
    imports = resolved_imports(relationships, files)
    bind = imports.where("target_file is not null").groupBy("path", F.coalesce("qualifier", "target").alias("bound")).agg(F.max_by("target_file", "ordinal").alias("bound_file"))
    counts = symbols.groupBy("path", "name").agg(F.count("*").alias("n"))
    rest = relationships.where("kind not in ('import', 'export')")
    first, last = F.element_at(F.split("target", r"\."), 1), F.element_at(F.split("target", r"\."), -1)
    own_call = F.col("kind").isin("calls") & (F.col("qualifier").isNull() | F.col("qualifier").isin("self", "this", "super", "base"))
    handle = F.when(F.col("kind") == "calls", F.coalesce("qualifier", "target")).when(F.col("kind") == "overrides", F.col("qualifier")).otherwise(first)
    rest = rest.withColumn("__handle", handle).withColumn("__name", F.when(F.col("kind").isin("calls", "overrides"), F.col("target")).otherwise(last)).withColumn("__own", own_call)
    here = counts.select(F.col("path"), F.col("name").alias("__name"), F.col("n").alias("__here"))
    there = counts.select(F.col("path").alias("bound_file"), F.col("name").alias("__name"), F.col("n").alias("__there"))
    found = rest.join(here, ["path", "__name"], "left").join(bind.withColumnRenamed("bound", "__handle"), ["path", "__handle"], "left").join(there, ["bound_file", "__name"], "left")
    local = F.when(F.col("kind") == "calls", F.col("__own") & (F.col("__here") == 1)).when(F.col("kind") == "overrides", F.lit(False)).otherwise(~F.col("target").contains(".") & (F.col("__here") >= 1))
    away = F.col("bound_file").isNotNull() & (F.col("__there") >= 1)
    target = F.when(F.coalesce(local, F.lit(False)), F.col("path")).when(F.coalesce(away, F.lit(False)), F.col("bound_file"))
    edges = found.select("kind", F.col("path").alias("source_file"), F.col("target").alias("target_raw"), "line", F.col("source").alias("source_symbol"), "qualifier", target.alias("target_file"), F.when(target.isNotNull(), F.col("__name")).alias("target_symbol"))
    own = imports.select("kind", F.col("path").alias("source_file"), F.col("target").alias("target_raw"), "line", F.col("source").alias("source_symbol"), "qualifier", "target_file", F.lit(None).cast("string").alias("target_symbol"))
    out = relationships.where("kind = 'export'").select("kind", F.col("path").alias("source_file"), F.col("target").alias("target_raw"), "line", F.col("source").alias("source_symbol"), "qualifier", F.lit(None).cast("string").alias("target_file"), F.lit(None).cast("string").alias("target_symbol"))
    return own.unionByName(edges).unionByName(out)


def ordered_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("source_file", "line", "kind", "target_raw")


def degrees(edges: DataFrame) -> DataFrame:
    """path, out_degree, in_degree over edges of all kinds."""
    out = edges.select(F.col("source_file").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = edges.where("target_file is not null").select(F.col("target_file").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionAll(into).groupBy("path").agg(F.sum("o").cast("long").alias("out_degree"), F.sum("i").cast("long").alias("in_degree"))


def importance(edges: DataFrame, files: DataFrame) -> DataFrame:
    """High, Medium or Low: thirds of all files by total degree, ties by path.

    The files of a degree are counted first, so only places within one degree are ordered by path;
    the files of one degree, all of them if no edge is known, share a task.
    """
    d = files.select("path").distinct().join(degrees(edges), "path", "left").select("path", F.coalesce(F.col("out_degree") + F.col("in_degree"), F.lit(0)).alias("degree"))
    sizes = d.groupBy("degree").agg(F.count("*").alias("n"))
    w = W.partitionBy(F.lit(0))
    sizes = sizes.select("degree", F.coalesce(F.sum("n").over(w.orderBy(F.desc("degree")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(w).alias("total"))
    placed = d.join(sizes, "degree").withColumn("at", F.col("before") + F.row_number().over(W.partitionBy("degree").orderBy("path")) - 1)
    return placed.select("path", "degree", F.when(3 * F.col("at") < F.col("total"), "High").when(3 * F.col("at") < 2 * F.col("total"), "Medium").otherwise("Low").alias("importance"))


def reverse_imports(edges: DataFrame) -> DataFrame:
    """path, importers: distinct and sorted."""
    return edges.where("kind = 'import' and target_file is not null").groupBy(F.col("target_file").alias("path")).agg(F.array_sort(F.collect_set("source_file")).alias("importers"))


def hops(edges: DataFrame, start: list[str] | DataFrame, most: int = 2) -> DataFrame:
    """path, hop: undirected distance from the start files, up to most; start files count even if unknown."""
    spark = edges.sparkSession
    both = edges.where("target_file is not null").select(F.col("source_file").alias("a"), F.col("target_file").alias("b"))
    both = both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = (spark.createDataFrame([(s,) for s in start], "path string") if isinstance(start, list) else start.select("path")).distinct().withColumn("hop", F.lit(0))
    for k in range(1, most + 1):
        edge = seen.where(F.col("hop") == k - 1).join(both, F.col("path") == F.col("a")).select(F.col("b").alias("path"), F.lit(k).alias("hop"))
        seen = seen.unionAll(edge).groupBy("path").agg(F.min("hop").alias("hop"))
    return seen


def file_intelligence(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of facts for each file(path, size, mtime_ns); imports count edges whether resolved or not."""
    imports = edges.where("kind = 'import'")
    out = imports.groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("imports"), F.array_sort(F.collect_set("target_file")).alias("imported_files"))
    into = imports.where("target_file is not null").groupBy(F.col("target_file").alias("path")).agg(F.countDistinct("source_file").alias("imported_by"))
    first = symbols.groupBy("path", "name").agg(F.min("line").alias("line"))
    top = first.groupBy("path").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("line", "name"))), 1, 5), lambda x: x["name"]).alias("top_symbols"))
    entry = symbols.groupBy("path").agg(F.max("is_entry_point").alias("entry_point"))
    none = F.array().cast("array<string>")
    joined = files.join(out, "path", "left").join(into, "path", "left").join(top, "path", "left").join(entry, "path", "left").join(importance(edges, files).select("path", "importance"), "path", "left")
    return joined.select(
        "path", language(F.col("path")).alias("language"), file_kind(F.col("path")).alias("kind"), "importance", F.coalesce("imports", F.lit(0)).alias("imports"), F.coalesce("imported_by", F.lit(0)).alias("imported_by"),
        F.coalesce("entry_point", F.lit(False)).alias("entry_point"), F.coalesce("top_symbols", none).alias("top_symbols"), F.coalesce("imported_files", none).alias("imported_files"), *(c for c in ("size", "mtime_ns") if c in files.columns),
    )


TIERS = ("exact_symbol", "exact_filename", "exact_directory", "prefix_symbol", "filename_contains", "symbol_contains", "dependency")


def _path_tokens(path: Column) -> Column:
    return F.split(F.lower(path), r"[/._\-]+")


def search(facts: DataFrame, query: str, limit: int = 20, exclude: list[str] | None = None) -> DataFrame:
    """Ranked files with the first of seven kinds of evidence; total_candidates and truncated on every row."""
    return merged_search(facts, [query], limit, limit, exclude, single=True)


def ranked(facts: DataFrame, query: str) -> DataFrame:
    """All matches with tier (0 .. 6) and the columns of their order."""
    q = query.lower()
    name, stem = F.lower(file_name(F.col("path"))), F.lower(file_stem(F.col("path")))
    low = F.transform("top_symbols", lambda s: F.lower(s))
    tests = [F.array_contains(low, q), (name == q) | (stem == q), F.array_contains(folders(F.col("path")), q), F.exists(low, lambda s: s.startswith(q)), name.contains(q), F.exists(low, lambda s: s.contains(q))]
    tier = functools.reduce(lambda a, kv: a.when(kv[1], kv[0]), list(enumerate(tests))[1:], F.when(tests[0], 0))
    rows = facts.withColumn("tier", tier)
    # neighbours whose path holds the query as a token, both ways along imports
    links = facts.select("path", F.explode("imported_files").alias("other"))
    links = links.unionAll(links.select(F.col("other").alias("path"), F.col("path").alias("other")))
    near = links.where(F.array_contains(_path_tokens(F.col("other")), q)).select("path").distinct().withColumn("__near", F.lit(True))
    rows = rows.join(near, "path", "left").withColumn("tier", F.coalesce("tier", F.when(F.col("__near"), 6))).where("tier is not null").drop("__near")
    rank = F.when(F.col("importance") == "High", 0).when(F.col("importance") == "Medium", 1).otherwise(2)
    off = F.when(F.col("tier").isin(1, 4), F.abs(F.length(name) - len(query))).otherwise(0)
    return rows.select("path", "tier", F.when(F.col("entry_point"), 0).otherwise(1).alias("r1"), rank.alias("r2"), off.alias("r3"), (-(F.col("imports") + F.col("imported_by"))).alias("r4"))


ORDER = ("tier", "r1", "r2", "r3", "path", "r4")


#: Groups that find their own first rows before the first of all are chosen.
GROUPS = 32


def first_of(found: DataFrame, n: int) -> DataFrame:
    """The first n rows in the order of search, with the number of all: one pass, and no task orders more than a group's share."""
    group = W.partitionBy("__g")
    top = found.withColumn("__g", F.pmod(F.xxhash64("path"), F.lit(GROUPS))).withColumns({"__k": F.row_number().over(group.orderBy(*ORDER)), "__n": F.count("*").over(group)}).where(F.col("__k") <= n)
    few = W.partitionBy(F.lit(0))  # at most GROUPS * n rows
    total = F.sum(F.when(F.col("__k") == 1, F.col("__n")).otherwise(0)).over(few)
    return top.withColumns({"total_candidates": total, "__r": F.row_number().over(few.orderBy(*ORDER))}).where(F.col("__r") <= n).orderBy(*ORDER).drop("__g", "__k", "__n", "__r")


def merged_search(facts: DataFrame, queries: list[str], per_query: int, limit: int = 20, exclude: list[str] | None = None, single: bool = False) -> DataFrame:
    """The best tier of each path over several queries, each cut to its first per_query."""
    parts = []
    for q in queries:
        found = ranked(facts, q)
        if exclude:
            found = found.where(~F.col("path").isin(*exclude))
        parts.append(first_of(found, per_query))
    out = functools.reduce(DataFrame.unionAll, parts)
    if not single:
        out = out.groupBy("path").agg(F.min("tier").alias("tier"), F.max("total_candidates").alias("total_candidates")).orderBy("tier", "path").limit(limit)
    names = F.array(*map(F.lit, TIERS))
    return out.select("path", F.get(names, F.col("tier")).alias("evidence"), "tier", "total_candidates", (F.col("total_candidates") > (limit if single else per_query)).alias("truncated"))


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(status, path, old_path): added, modified, deleted, renamed; files moved unchanged pair by hash and rank of path."""
    both = previous.select("path", F.col("content_hash").alias("before")).join(current.select("path", F.col("content_hash").alias("after")), "path", "full_outer")
    modified = both.where("before <> after").select(F.lit("modified").alias("status"), "path", F.lit(None).cast("string").alias("old_path"))
    rank = lambda h: F.row_number().over(W.partitionBy(h).orderBy("path"))
    gone = both.where("after is null").select(F.col("before").alias("h"), F.col("path").alias("old_path"), rank("before").alias("k"))
    come = both.where("before is null").select(F.col("after").alias("h"), "path", rank("after").alias("k"))
    paired = gone.join(come, ["h", "k"], "full_outer")
    status = F.when(F.col("path").isNull(), "deleted").when(F.col("old_path").isNull(), "added").otherwise("renamed")
    moved = paired.select(status.alias("status"), F.coalesce("path", "old_path").alias("path"), F.when(F.col("path").isNotNull(), F.col("old_path")).alias("old_path"))
    return modified.unionByName(moved)


def stale(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Paths whose facts must be made anew: no equal fingerprint (size and mtime, else hash) before."""
    return current.join(previous.select("path", "content_hash"), ["path", "content_hash"], "left_anti").select("path")


def find_symbol(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name).orderBy("path", "line")


def dependencies(edges: DataFrame, path: str) -> DataFrame:
    return edges.where((F.col("kind") == "import") & (F.col("source_file") == path) & F.col("target_file").isNotNull()).select(F.col("target_file").alias("path")).distinct().orderBy("path")


def used_by(edges: DataFrame, path: str) -> DataFrame:
    return edges.where((F.col("kind") == "import") & (F.col("target_file") == path)).select(F.col("source_file").alias("path")).distinct().orderBy("path")


def dashboard(symbols: DataFrame, edges: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """Symbols by language, largest modules, most connected files, relationship counts."""
    return {
        "symbols_by_language": symbols.groupBy("language").count().orderBy(F.desc("count"), "language"),
        "largest_modules": symbols.groupBy("path").count().orderBy(F.desc("count"), "path").limit(top),
        "most_connected": degrees(edges).withColumn("degree", F.col("out_degree") + F.col("in_degree")).orderBy(F.desc("degree"), "path").limit(top),
        "relationships": edges.groupBy("kind").count().orderBy(F.desc("count"), "kind"),
    }


def extremes(files: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Most imported file, most referenced symbol, largest file; equal ones by name."""
    imported = edges.where("kind = 'import' and target_file is not null").groupBy("target_file").count().orderBy(F.desc("count"), "target_file").limit(1)
    symbol = edges.where("target_symbol is not null").groupBy("target_symbol").count().orderBy(F.desc("count"), "target_symbol").limit(1)
    return {"most_imported": imported, "most_referenced": symbol, "largest": files.orderBy(F.desc("size"), "path").limit(1)}
