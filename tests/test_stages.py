import random

import fold
import pytest
from condense.operators import stages as S
from condense.operators.lines import render, split, stats
from condense.plans.pipeline import Pipeline
from pyspark.sql import functions as F

FIRST = S.StripLines(patterns=(r"^drop",), preserve_patterns=(r"^hold",))
WORDS = ["a", "a", "drop x", "hold y", "12", "13", "14", "99", "100", "007", "008", "2024-05-01 10:00:00 up", "2024-05-01 10:00:30 go", "2024-05-01 09:00:00 back", "2024-02-30 10:00:00 no", "25:00:00 no", "10:00:00 t", "11:00:00 t",
         "src/long/path/one.py", "src/long/path/two.py", "src/long/other.py", "x  y   z", "wide      column     here", "f.py:1: error: bad", "g.py:22: error: bad", "g.py:3: error: worse", "", "é😀 unicode line of text", "a rather long line that costs many tokens, more than others do", "tab\there", "cr\r"]
CASES = [
    (S.DeduplicateConsecutive(), lambda x: fold.dedup(x)),
    (S.DeduplicateConsecutive(show_count=True), lambda x: fold.dedup(x, True)),
    (S.GroupRepeated(patterns=("^a",)), lambda x: fold.group_run(x, "^a")),
    (S.GroupRepeated(patterns=(".",), exact_match=True), lambda x: fold.group_run(x, ".", exact=True)),
    (S.GroupRepeated(patterns=("error",), location_pattern=r"^(.*?): error"), lambda x: fold.group_location(x, "error", r"^(.*?): error")),
    (S.GroupRepeated(patterns=("error|^a",), location_pattern=r"^(.*?): error", scope="global"), lambda x: fold.group_location(x, "error|^a", r"^(.*?): error", everywhere=True)),
    (S.CollapseUnchangedContext(context_lines=1), lambda x: fold.collapse(x, 1)),
    (S.CollapseUnchangedContext(context_lines=0), lambda x: fold.collapse(x, 0)),
    (S.MaxTokens(limit=12, strategy="head"), lambda x: fold.budget(x, 12, "head")),
    (S.MaxTokens(limit=12, strategy="tail"), lambda x: fold.budget(x, 12, "tail")),
    (S.MaxTokens(limit=13, strategy="both"), lambda x: fold.budget(x, 13, "both")),
    (S.MaxTokens(limit=1, strategy="both"), lambda x: fold.budget(x, 1, "both")),
    (S.NumericRangeCompression(), fold.numbers),
    (S.RelativeTimestampCompression(), fold.deltas),
    (S.PathPrefixFold(patterns=(r"^\S+/\S*$",)), lambda x: fold.paths(x, r"^\S+/\S*$")),
    (S.ColumnPaddingCompression(patterns=(".",)), lambda x: fold.padding(x, ".")),
    (S.ColumnPaddingCompression(patterns=(".",), max_gaps=1), lambda x: fold.padding(x, ".", 1)),
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    docs = [("empty", ""), ("newline", "\n"), ("newlines", "\n\n\n"), ("one", "a"), ("trail", "a\n"), ("numbers", "\n".join(map(str, range(95, 130)))), ("wide", "\n".join(["1" * 40, "1" * 39 + "2"]))]
    for i in range(60):
        picked = []
        while len(picked) < rng.randint(1, 40):
            picked += [rng.choice(WORDS)] * rng.choice((1, 1, 2, 4))
        docs.append((f"r{i}", "\n".join(picked)))
    return docs


@pytest.fixture(scope="module")
def lines(spark, texts):
    return split(spark.createDataFrame(texts, "doc_id string, text string")).cache()


@pytest.mark.parametrize("number", range(len(CASES)))
def test_equals_fold(lines, texts, number):
    stage, plain = CASES[number]
    got = {}
    for r in stage.apply(FIRST.apply(lines)).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append([r.line, r.decision])
    for name, text in texts:
        start = fold.strip_lines([[x, "KEEP"] for x in text.split("\n")], [r"^drop"], [r"^hold"])
        assert got[name] == plain(start), (name, text)


def test_round_trip(lines, texts):
    assert dict(map(tuple, render(lines).collect())) == dict(texts)


def test_one_exchange(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    chain = [FIRST, S.DeduplicateConsecutive(show_count=True), S.RelativeTimestampCompression(), S.PathPrefixFold(patterns=("/",)), S.NumericRangeCompression(), S.MaxTokens(limit=50)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = render(Pipeline(chain).transform(split(docs)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 1, plan


@pytest.mark.parametrize("stage, turns", [(S.RemoveAnsi, True), (S.GroupRepeated, True), (S.MaxTokens, True), (S.PathPrefixFold, True), (S.NumericRangeCompression, True), (S.StripLines, False), (S.TruncateLines, False), (S.RegexReplace, False), (S.DeduplicateConsecutive, False)])
def test_preserve_on_compressed_lines(lines, stage, turns):
    extra = {"patterns": ("never",)} if "patterns" in stage.__dataclass_fields__ else {}
    out = stage(preserve_patterns=(r"^drop",), **extra).apply(FIRST.apply(lines))
    wanted = "PROTECT" if turns else "COMPRESS"
    assert {r.decision for r in out.where(F.col("line").startswith("drop")).collect()} == {wanted}


def test_protect_is_never_dropped(lines):
    out = FIRST.apply(lines)
    before = stats(out).groupBy().sum("protected").first()[0]
    for stage, _ in CASES:
        out = stage.apply(out)
    assert stats(out).groupBy().sum("protected").first()[0] == before


def _run(spark, stage, *texts):
    df = stage.apply(split(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")))
    return [r.text for r in render(df).orderBy("doc_id").collect()]


def test_truncate(spark):
    assert _run(spark, S.TruncateLines(max_length=5, marker="…"), "abcdefgh", "abc", "😀" * 7) == ["abcd…", "abc", "😀" * 4 + "…"]
    assert _run(spark, S.TruncateLines(max_length=3, marker="......"), "abcdefgh") == ["abc"]


def test_regex_replace(spark):
    assert _run(spark, S.RegexReplace(rules=((r"(?P<k>\w+)=(\d+)", r"\g<2>=\g<k>$"), ("x", "y"))), "x=12 ab=3") == ["12=y$ 3=ab$"]


def test_ansi(spark):
    assert _run(spark, S.RemoveAnsi(strip_inline=True), "\x1b[1mhi\x1b[0m\n\x1b[2K\nplain") == ["hi\nplain"]
    assert _run(spark, S.RemoveAnsi(), "\x1b[1mhi\n\x1b[2K") == ["\x1b[1mhi"]


def test_match_output(spark):
    stage = S.MatchOutput(pattern=r"ok\n(done )+end", summary="fine")
    assert _run(spark, stage, "ok\ndone done end", "ok\ndone end!", "ok") == ["fine", "ok\ndone end!", "ok"]


def test_time_formats(spark):
    stage = S.RelativeTimestampCompression()
    text = "2024-01-01T10:00:00.250+02:00 a\n2024-01-01T08:00:00.500+00:00 b\n2024-01-01T08:00:02.500+00:00 c"
    assert _run(spark, stage, text) == ["2024-01-01T10:00:00.250+02:00 a\n+250ms b\n+2s c"]
    far = "0001-01-01 00:00:00 a\n2024-01-01 00:00:00 b"
    assert _run(spark, stage, far)[0].startswith("0001-01-01 00:00:00 a\n+")
    assert _run(spark, stage, "10:00:00.1 a\n10:00:00.12 b") == ["10:00:00.1 a\n10:00:00.12 b"]


def test_guards(spark):
    docs = spark.createDataFrame([(1, "noise\nnoise"), (2, "keep me"), (3, None), (4, "noise but needed")], "doc_id int, text string")
    out = {r.doc_id: r.text for r in Pipeline([S.StripLines(patterns=("noise",))], on_empty="(none)", abort_if=("needed",)).run(docs).collect()}
    assert out == {1: "(none)", 2: "keep me", 3: None, 4: "noise but needed"}
