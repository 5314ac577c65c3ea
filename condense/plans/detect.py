"""Content types of texts."""

from __future__ import annotations

import functools
import json
import tomllib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condense.functions.text import strip
from condense.shipping import ship

#: The content types and the marks they are known by.
TYPES = ("json", "toml", "diff", "pytest", "mypy", "traceback", "ansi", "text")
_FIRST = r"(?s)^(?:[ \t\r]*(?:#[^\n]*)?\n)*([^\n]*)"


def looks_json(text: Column) -> Column:
    return text.rlike(r"(?U)^\s*[\[{]")


def looks_toml(text: Column) -> Column:
    """Whether the first line that is neither blank nor a comment could open a table or set a key."""
    return F.regexp_extract(text, _FIRST, 1).rlike(r"^[ \t]*(\[|[A-Za-z0-9_-]+\s*=)")


def plain_type(text: Column) -> Column:
    """The type of a text that is neither JSON nor TOML."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x != "")
    coded = F.size(F.filter(lines, lambda x: x.rlike("\x1b\\[[0-9;]*[A-Za-z]")))
    return (
        F.when(strip(text) == "", "text")
        .when(text.rlike(r"(?md)^(diff --git |--- a/|\+\+\+ b/|@@ )"), "diff")
        .when(text.rlike(r"(?md)^=+\s*(FAILURES|short test summary info)\s*=+"), "pytest")
        .when(text.rlike(r"(?md)^Found [0-9]+ errors? in [0-9]+ files?\b"), "mypy")
        .when(text.contains("Traceback (most recent call last):"), "traceback")
        .when((F.size(lines) > 0) & (5 * coded > F.size(lines)), "ansi")
        .otherwise("text")
    )


def _parses(text: str, load) -> bool:
    try:
        load(text)
        return True
    except (ValueError, RecursionError):
        return False


@functools.cache
def _parser():
    """A function of Arrow arrays: json, toml or null; made where a session runs."""

    @F.arrow_udf("string")
    def parse(texts: pa.Array) -> pa.Array:
        kind = lambda x: None if x is None else "json" if x.strip()[:1] in ("{", "[") and _parses(x, json.loads) else "toml" if _parses(x, tomllib.loads) else None
        return pa.array([kind(x) for x in texts.to_pylist()], pa.string())

    return parse


def with_type(df: DataFrame, text: str = "text", name: str = "content_type") -> DataFrame:
    """df with the content type, in one pass; only texts that could be JSON or TOML reach Python's strict parsers."""
    ship(df.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    maybe = F.when(looks_json(t) | looks_toml(t), t)
    return df.withColumn(name, F.coalesce(_parser()(maybe), plain_type(t)))
