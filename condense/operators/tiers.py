"""Context around a file: the file whole, its neighbours as signatures, files further away as outlines."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condense.functions.text import count_tokens
from condense.operators.outlines import PARSERS, open_
from condense.operators.repo import hops
from condense.shipping import ship


def signatures(text: str, language: str | None) -> str | None:
    """The text without function bodies; null where the language has no parser or the text doesn't parse."""
    parser = PARSERS.get((language or "").lower())
    hidden = open_(parser.body_lines, text, None) if parser else None
    return None if hidden is None else "\n".join(x for i, x in enumerate(text.split("\n"), 1) if i not in hidden)


def outline(text: str, language: str | None, named: set[str]) -> str | None:
    """One line for each symbol; classes in named keep their method signatures."""
    parser = PARSERS.get((language or "").lower())
    found = open_(parser.symbols, text, None) if parser else None
    if found is None:
        return None
    lines, inside = [], False
    for s in found:
        if s["kind"] == "class":
            inside = s["name"] in named
        if s["kind"] != "method" or inside:
            lines.append(("    def " if s["kind"] == "method" else s["kind"] + " ") + s["name"] + ("(...): ..." if s["kind"] == "method" else ""))
    return "\n".join(lines)


def annotation_names(text: str) -> list[str]:
    """Names in the annotations of a Python text."""
    def names(source: str) -> set[str]:
        found: set[str] = set()
        for node in ast.walk(ast.parse(source)):
            for a in (getattr(node, "annotation", None), getattr(node, "returns", None)):
                if isinstance(a, ast.AST):
                    found |= {n.id for n in ast.walk(a) if isinstance(n, ast.Name)}
        return found

    return sorted(open_(names, text, set()))


def tiered_context(files: DataFrame, edges: DataFrame, focal: str, most_hops: int = 2) -> DataFrame:
    """(path, hop, tier, content, tokens, fallback): files(path, language, text) near a focal file.

    The names in the annotations of hop-1 files are few and collected between both passes.
    """
    spark = files.sparkSession
    ship(spark)
    near = files.join(hops(edges, [focal], most_hops), "path").select("path", "language", "text", "hop")

    def names(batches):
        for batch in batches:
            found = sorted({n for t in batch["text"].to_pylist() for n in annotation_names(t or "")})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["name"])

    named = {r.name for r in near.where("hop = 1 and language = 'Python'").select("text").mapInArrow(names, "name string").distinct().collect()}

    def show(batches):
        for batch in batches:
            tiers, contents, reasons = [], [], []
            for lang, text, hop in zip(*(batch[c].to_pylist() for c in ("language", "text", "hop")), strict=True):
                text = text or ""
                made = text if hop == 0 else signatures(text, lang) if hop == 1 else outline(text, lang, named)
                tiers.append("full" if hop == 0 else "signatures" if hop == 1 else "outline")
                reasons.append("no parser" if made is None else None)
                contents.append(text if made is None else made)
            yield pa.RecordBatch.from_arrays([batch["path"], batch["hop"], pa.array(tiers), pa.array(contents, pa.string()), pa.array(reasons, pa.string())], ["path", "hop", "tier", "content", "fallback"])

    out = near.mapInArrow(show, "path string, hop int, tier string, content string, fallback string")
    return out.withColumn("tokens", count_tokens(F.col("content"))).orderBy("hop", "path")
