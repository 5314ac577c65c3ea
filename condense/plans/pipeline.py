"""A chain of stages over texts, with its guards and its trace.

Texts are dealt out by doc_id once; stages add windows and folds on that partitioning.  The trace
needs no stage to run twice: each stage leaves a column with every line's decision and length, and
one grouping at the end sums them all.  Originals travel with the lines as further columns, so one
grouping gives the result and its original together, without a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condense.functions.text import count_tokens, strip
from condense.operators.lines import COMPRESS, KEEP, joined, rendered_tokens, shown, split
from condense.operators.stages import Stage


def guarded(original: Column, text: Column, on_empty: str | None, aborted: Column) -> Column:
    """The final text: the original if aborted; on_empty for a blank result; the original again if the result is no cheaper."""
    grown = (count_tokens(text) > count_tokens(original)) | ((count_tokens(text) == count_tokens(original)) & (F.length(text) >= F.length(original)))
    out = F.when(grown, original).otherwise(text)
    if on_empty is not None:
        out = F.when(strip(text) == "", F.lit(on_empty)).otherwise(out)
    return F.when(aborted, original).otherwise(out)


def rendered(lines: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, __r, more): as render, with further aggregates of the same grouping."""
    return lines.groupBy("doc_id").agg(joined(F.when(shown(), F.struct("pos", "line"))).alias("__r"), *more)


@dataclass
class Pipeline:
    stages: list[Stage] = field(default_factory=list)
    abort_unless: tuple[str, ...] = ()
    abort_if: tuple[str, ...] = ()
    on_empty: str | None = None

    def transform(self, lines: DataFrame) -> DataFrame:
        for stage in self.stages:
            lines = stage.apply(lines)
        return lines

    def aborts(self, text: Column) -> Column:
        """No needed substring is there, or an unwanted one is."""
        out = F.lit(False)
        if self.abort_unless:
            needed = F.lit(False)
            for s in self.abort_unless:
                needed = needed | text.contains(s)
            out = ~needed
        for s in self.abort_if:
            out = out | text.contains(s)
        return out

    def _results(self, grouped: DataFrame) -> DataFrame:
        """The guarded results of rows (doc_id, original, __r)."""
        final = guarded(F.col("original"), F.col("__r"), self.on_empty, self.aborts(F.col("original")))
        both = grouped.withColumn("text", F.when(F.col("original").isNotNull(), final))
        return both.select("doc_id", count_tokens(F.col("original")).alias("original_tokens"), count_tokens(F.col("text")).alias("final_tokens"), "text")

    def run(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", dealt: bool = False) -> DataFrame:
        """doc_id, original_tokens, final_tokens, text for each document; a null text stays null.

        Documents must have ids of their own: rows that share one are lines of one text.  dealt: docs are dealt by doc_id.
        """
        docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("original"))
        first = F.when(F.col("pos") == 0, F.col("original"))
        lines = split(docs.withColumn("text", F.coalesce("original", F.lit(""))), extra=("original",), dealt=dealt).withColumn("original", first)
        return self._results(rendered(self.transform(lines), F.first("original", ignorenulls=True).alias("original")))

    def run_lines(self, lines: DataFrame) -> DataFrame:
        """As run, for lines that a source has split already."""
        lines = lines.withColumn("original", F.when(shown(), F.struct("pos", "line")))
        return self._results(rendered(self.transform(lines), joined(F.col("original")).alias("original")))

    def trace(self, lines: DataFrame) -> DataFrame:
        """(doc_id, stage_idx, stage_type, lines_before, lines_after, lines_compressed, tokens_before, tokens_after, was_skipped)."""
        keep = lambda df, k: df.withColumn(f"d{k}", F.col("decision")).withColumn(f"n{k}", F.length("line"))
        lines = keep(lines, 0)
        for k, stage in enumerate(self.stages, 1):
            lines = keep(stage.apply(lines), k)
        steps = range(len(self.stages) + 1)
        # lines that came in later have no decision before
        sums = [x for k in steps for x in (rendered_tokens(F.col(f"n{k}"), F.coalesce(f"d{k}", F.lit(COMPRESS))).alias(f"t{k}"), F.count(f"d{k}").alias(f"c{k}"), F.count_if(F.col(f"d{k}") == COMPRESS).alias(f"z{k}"), F.count_if(F.col(f"d{k}") == KEEP).alias(f"k{k}"))]
        rows = [
            F.struct(F.lit(k - 1).alias("stage_idx"), F.lit(s.type).alias("stage_type"), F.col(f"c{k - 1}").alias("lines_before"), F.col(f"c{k}").alias("lines_after"), (F.col(f"z{k}") - F.col(f"z{k - 1}")).alias("lines_compressed"), F.col(f"t{k - 1}").alias("tokens_before"), F.col(f"t{k}").alias("tokens_after"), (F.col(f"k{k - 1}") == 0).alias("was_skipped"))
            for k, s in enumerate(self.stages, 1)
        ]
        return lines.groupBy("doc_id").agg(*sums).select("doc_id", F.inline(F.array(*rows)))
