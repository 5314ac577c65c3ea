"""Diffs told from the line table, without whole texts."""

import re

import pytest
from condense import queries_texts, views
from condense.operators import diffs
from condense.operators.lines import COLUMNS, render
from pyspark.sql import functions as F

TABLES = "/root/testdata/sf0.001"


def table(spark, docs):
    """docs: doc_id to (line, decision) pairs."""
    rows = [(d, i, line, decision, "", "") for d, lines in docs.items() for i, (line, decision) in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id long, pos long, line string, decision string, reason string, stage string").select(*COLUMNS)


HEAD = "diff --git a/x b/x"
DOCS = {
    1: [("intro", "KEEP"), (HEAD, "KEEP"), ("-a", "KEEP"), (HEAD, "COMPRESS"), (f"told\n{HEAD}\n+b", "PROTECT"), (" " + HEAD, "KEEP")],
    2: [(HEAD, "COMPRESS")],
    3: [("", "KEEP"), (None, "KEEP"), (HEAD, "KEEP")],
}


def test_file_counts_equal_the_ones_of_rendered_texts(spark):
    lines = table(spark, DOCS)
    got = {r["doc_id"]: r["files"] for r in diffs.file_counts(lines).collect()}
    assert got == {r["doc_id"]: r["files"] for r in render(lines).select("doc_id", diffs.count_files(F.col("text")).alias("files")).collect()} == {1: 2, 2: 0, 3: 1}


def test_diff_file_counts_collects_no_lines(spark):
    """One text for each of five priorities doesn't fit an executor at 60 times sf0.1."""
    plan = queries_texts.diff_file_counts(spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan


@pytest.mark.parametrize("chunk", [1, 2, 3, 4096])
def test_line_sections_equal_the_ones_of_rendered_texts(spark, chunk):
    docs = DOCS | {
        None: [(HEAD, "KEEP"), ("", "KEEP"), ("", "KEEP"), ("@@ -1 +1 @@", "KEEP"), ("-a", "COMPRESS"), ("+b", "KEEP"), ("", "KEEP"), (HEAD, "KEEP"), ("", "KEEP")],
        4: [("", "KEEP"), ("no diff", "KEEP")],
        5: [(line, "KEEP") for i in range(7) for line in ("diff --git a/f.py b/g.py", f"rename from f{i}.py", "@@ -1 +1 @@", *["+x"] * i)],
    }
    lines = table(spark, docs)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    got = rows(diffs.line_sections(lines, chunk))
    assert len(got) == 2 + 1 + 2 + 7 and got == rows(diffs.diff_sections(render(lines)))


def test_diff_log_by_parts_equals_diff_log(spark, tmp_path):
    rows = [(k * 37 % 101 - 20, f"{k % 3}-P") for k in range(90)] + [(5, "1-P"), (5, "1-P"), (5, None), (None, "1-P"), (None, "1-P"), (-3, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    want = sorted(map(tuple, views.diff_log(spark, str(tmp_path)).collect()), key=repr)
    assert len(want) == 7 * len(rows)
    assert want == sorted(map(tuple, views.diff_log_by_parts(spark, str(tmp_path), 8).collect()), key=repr)


def test_diff_sections_holds_no_document_in_a_task(spark):
    plan = queries_texts.diff_sections(spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\], \[doc_id#\d+\], \[", plan)  # windows
    assert "collect_list" in plan and not re.search(r"Aggregate \[doc_id#\d+\],", plan)
