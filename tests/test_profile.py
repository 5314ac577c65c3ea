import pytest
from condense.operators import profile, tiers
from condense.plans.plugins import Hook, StopChain, ordered, run_hooks

FILES = [
    ("pyproject.toml", '[project]\nname = "x"\ndependencies = ["flask", "pytest"]\n[project.scripts]\nrun = "a:b"\n[build-system]\nrequires = ["setuptools"]\n'),
    ("package.json", '{"main": "i.js", "bin": {"tool": "t.js"}, "dependencies": {"react": "1"}}'),
    ("Dockerfile", "FROM x"), (".github/workflows/ci.yml", "on: push"), ("src/a.py", "x"), ("run.py", "if __name__ == '__main__':\n    pass\n"), ("svc/go.mod", "module x"), ("svc/main.go", "package main\nfunc main() {}\n"),
    ("tests/fixtures/package-lock.json", "{}"), ("broken/package.json", "{"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, text string")


def test_detections(files):
    found = {(r.category, r.name): r.evidence for r in profile.detections(files).collect()}
    for key in (("framework", "Flask"), ("framework", "React"), ("container", "Docker"), ("ci", "GitHub Actions"), ("build system", "setuptools"), ("test", "pytest"), ("build system", "go modules")):
        assert key in found
    assert ("package manager", "npm") not in found and found[("build system", "go modules")] == "svc/go.mod"


def test_entry_points(files):
    found = {(r.path, r.kind, r.name) for r in profile.entry_points(files).collect()}
    assert found == {("pyproject.toml", "script", "run"), ("package.json", "main", "i.js"), ("package.json", "bin", "tool"), ("run.py", "module", "run.py"), ("svc/main.go", "main", "svc/main.go")}


def test_parts(files):
    parts = profile.profile(files)
    assert [tuple(r) for r in parts["services"].collect()] == [("broken", "broken/package.json"), ("svc", "svc/go.mod")]
    assert {r.folder for r in parts["folders"].collect()} == {"src", "tests"} and parts["statistics"].first().files == 10


def test_tiers(spark):
    rows = [("a.py", "Python", "import b\n"), ("b.py", "Python", "def f(x: K):\n    y = x\n    return y\n"), ("c.py", "Python", "class K:\n    def m(self):\n        return 1\n\n\nclass L:\n    def n(self):\n        return 1\n"), ("d.rb", "Ruby", "package x"), ("e.py", "Python", "z")]
    edges = [("import", "a.py", "b.py"), ("import", "b.py", "c.py"), ("import", "d.rb", "a.py"), ("import", "e.py", "c.py")]
    out = {r.path: (r.hop, r.tier, r.content, r.fallback) for r in tiers.tiered_context(spark.createDataFrame(rows, "path string, language string, text string"), spark.createDataFrame(edges, "kind string, source_file string, target_file string"), "a.py").collect()}
    assert out == {"a.py": (0, "full", "import b\n", None), "b.py": (1, "signatures", "def f(x: K):\n", None), "c.py": (2, "outline", "class K\n    def m(...): ...\nclass L", None), "d.rb": (1, "signatures", "package x", "no parser")}


def test_hooks(spark):
    def stop(df):
        raise StopChain

    def fail(df):
        raise RuntimeError("no")

    hooks = [Hook("late", "PRE_FILTER", lambda d: d.withColumn("late", d.x), 200), Hook("stop", "PRE_FILTER", stop, 150), Hook("one", "PRE_FILTER", lambda d: d.withColumn("one", d.x)), Hook("bad", "PRE_FILTER", fail, 1), Hook("p", "POST_FILTER", lambda d: d, tier="project")]
    assert [h.name for h in ordered(hooks)] == ["bad", "one", "stop", "late", "p"]
    with pytest.warns(UserWarning):
        assert run_hooks(spark.range(1).toDF("x"), hooks, "PRE_FILTER").columns == ["x", "one"]
