from condense.operators import build
from condense.operators import telemetry as T
from pyspark.sql import functions as F


def walk(spark, files):
    rows = [(p, "Python" if p.endswith(".py") else "Go", t, str(hash(t))) for p, t in files.items()]
    return spark.createDataFrame(rows, "path string, language string, text string, content_hash string")


def facts(built):
    symbols = {(r.path, r.name) for r in built["symbols"].collect()}
    edges = {(r.source_file, r.target_raw, r.target_file) for r in built["edges"].collect()}
    return symbols, edges


def test_a_second_build_equals_a_whole_one(spark):
    """Only changed files are parsed again, and the result is that of a build from nothing."""
    old = {"a.py": "import b\n\ndef f():\n    b.g()\n", "b.py": "def g():\n    pass\n", "c.go": "package c\n\nfunc Run() {\n}\n", "gone.py": "def x():\n    pass\n"}
    new = {"a.py": old["a.py"], "b.py": "def g():\n    pass\n\n\ndef h():\n    g()\n", "c.go": old["c.go"], "d.py": "from b import h\n"}
    first = build.build(walk(spark, old))
    assert facts(first)[0] == {("a.py", "f"), ("b.py", "g"), ("c.go", "Run"), ("gone.py", "x")}
    second = build.build(walk(spark, new), first)
    assert {r.path: r.reason for r in second["reasons"].collect()} == {"a.py": "kept", "b.py": "changed", "c.go": "kept", "d.py": "new", "gone.py": "deleted"}
    assert facts(second) == facts(build.build(walk(spark, new)))
    assert ("d.py", "b", "b.py") in facts(second)[1]
    assert {r.path: r.imports for r in second["facts"].select("path", "imports").collect()} == {"a.py": 1, "b.py": 0, "c.go": 0, "d.py": 1}


def test_other_versions_are_made_anew(spark):
    files = walk(spark, {"a.py": "x = 1"})
    old = files.withColumn("version", F.lit(build.VERSION - 1))
    assert [r.reason for r in build.reasons(old, files).collect()] == ["version"]


def test_snapshots_append(spark):
    from datetime import datetime

    at = datetime(2024, 1, 2)
    history = spark.createDataFrame([(datetime(2024, 1, 1), "npm", 3), (at, "npm", 4)], "snapshot_at timestamp, filter_name string, invocations long")
    grown = T.append_snapshot(history, spark.createDataFrame([("npm", 9)], "label string, invocations long"), at)
    assert sorted((r.snapshot_at.day, r.invocations) for r in grown.collect()) == [(1, 3), (2, 9)]
    assert T.usage_growth(grown).first().growth == 6


def test_context_of_a_file_and_a_query(spark):
    files = {"a.py": "import b\n\ndef load_user():\n    b.g()\n", "b.py": "class G:\n    def g(self):\n        pass\n", "c.py": "def load_user_twice():\n    pass\n"}
    built = build.build(walk(spark, files))
    found = build.context(built, "b.py", "where is load_user used?")
    assert found["file"].first().imported_by == 1
    assert [(r.name, r.kind) for r in found["symbols"].collect()] == [("G", "class"), ("g", "method")]
    assert [(r.path, r.evidence, r.hop) for r in found["relevant"].collect()] == [("a.py", "exact_symbol", 1), ("c.py", "prefix_symbol", None)]
    assert build.context(built) == {}


def test_enriched_diffs(spark):
    """Hunks of a Python file become its structural changes; all else stays byte for byte."""
    from condense.operators.diffs import enriched

    old = "def f(a):\n    b = a\n    c = b\n    return c\n\n\ndef g():\n    return 1\n"
    new = old.replace("def f", "def h").replace("return 1", "return 2")
    hunk = "@@ -1,8 +1,8 @@\n" + "\n".join(f"-{x}" for x in old.split("\n")) + "\n" + "\n".join(f"+{x}" for x in new.split("\n"))
    diff = "commit 1\n\ndiff --git a/m.py b/m.py\n--- a/m.py\n+++ b/m.py\n" + hunk + "\ndiff --git a/x.txt b/x.txt\n--- a/x.txt\n+++ b/x.txt\n@@ -1 +1 @@\n-a\n+b"
    docs = spark.createDataFrame([(1, diff), (2, diff), (3, "no diff\n")], "doc_id long, text string")
    contents = spark.createDataFrame([(1, "m.py", "m.py", old, new), (1, "x.txt", "x.txt", "a", "b"), (2, "m.py", "m.py", "def (", new)], "doc_id long, old_path string, new_path string, old_text string, new_text string")
    out = {r.doc_id: r.text for r in enriched(docs, contents).collect()}
    assert out[2] == diff and out[3] == "no diff\n"
    assert out[1] == "commit 1\n\ndiff --git a/m.py b/m.py\n--- a/m.py\n+++ b/m.py\n[structural]\n  modified: g\n  renamed: f -> h" + diff[diff.index("\ndiff --git a/x.txt") :]
