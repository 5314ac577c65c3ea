"""Repository facts in one build: walk, extract, resolve, rank; made anew only for files that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condense.operators.outlines import extract_facts
from condense.operators.profile import profile
from condense.operators.repo import file_intelligence, hops, merged_search, resolved_edges
from condense.operators.scans import query_terms

#: A build of another version is made anew as a whole.
VERSION = 1


def reasons(previous: DataFrame, current: DataFrame, version: int = VERSION) -> DataFrame:
    """(path, reason, content_hash) of all files of two walks: new, changed, deleted, version or kept.

    Walks are (path, content_hash); previous may have a column version, of the build that made its facts.
    """
    made = F.col("version") if "version" in previous.columns else F.lit(version)
    before = previous.select("path", F.col("content_hash").alias("__was"), made.alias("__version"))
    both = current.select("path", "content_hash").join(before, "path", "full_outer")
    reason = F.when(F.col("content_hash").isNull(), "deleted").when(F.col("__was").isNull(), "new").when(F.col("content_hash") != F.col("__was"), "changed").when(F.col("__version") != version, "version").otherwise("kept")
    return both.select("path", reason.alias("reason"), "content_hash")


def merged(kept: DataFrame, fresh: DataFrame, why: DataFrame) -> DataFrame:
    """Facts of kept files as they were, and the ones made anew."""
    return kept.join(why.where("reason = 'kept'").select("path"), "path", "left_semi").unionByName(fresh)


def build(files: DataFrame, previous: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables of a repository: files, reasons, symbols, relationships, edges, facts, and the parts of its profile.

    files: (path, language, text, content_hash, ...), as a walk gives them.  previous: an earlier result
    (its files, symbols and relationships); only new and changed files are parsed.  Edges and facts are joins
    over all files, as a change in one file can move the edges of others.
    """
    out = {"files": files}
    nothing = files.where("false").select("path", "content_hash")
    why = reasons(previous["files"] if previous else nothing, files)
    stale = files.join(why.where("reason in ('new', 'changed', 'version')").select("path"), "path", "left_semi")
    symbols, relationships = extract_facts(stale)
    if previous:
        symbols, relationships = merged(previous["symbols"], symbols, why), merged(previous["relationships"], relationships, why)
    edges = resolved_edges(relationships, files, symbols)
    return out | {"reasons": why, "symbols": symbols, "relationships": relationships, "edges": edges, "facts": file_intelligence(files, symbols, edges)} | profile(files)


def context(built: dict[str, DataFrame], path: str | None = None, query: str | None = None, most: int = 5) -> dict[str, DataFrame]:
    """What a build knows of a file (file, symbols) and the files that matter to a query (relevant, with hops from the file if one is named)."""
    facts, out = built["facts"], {}
    if path:
        first = built["symbols"].where(F.col("path") == path).groupBy("name").agg(F.min(F.struct("line", "kind", "is_public")).alias("s"))
        out |= {"file": facts.where(F.col("path") == path), "symbols": first.select("name", "s.*").orderBy("line", "name")}
    if query:
        terms = facts.sparkSession.range(1).select(query_terms(F.lit(query))).first()[0]
        if terms:
            found = merged_search(facts, terms, most, most, [path] if path else None)
            out["relevant"] = found.join(hops(built["edges"], [path]), "path", "left").orderBy("tier", "path") if path else found
    return out
