"""Projections of whole texts: JSON cleaning and log folding."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condense.operators.lines import render, split
from condense.operators.stages import DeduplicateConsecutive, RemoveAnsi
from condense.shipping import ship

HEAD, TAIL = 3, 2


def project_value(value, drop_pairs: dict | None = None, head: int = HEAD, tail: int = TAIL):
    """Without null and "" fields of objects; long arrays keep both ends around a note."""
    if isinstance(value, dict):
        wanted = lambda k, v: not (v is None or v == "" or (drop_pairs and k in drop_pairs and v == drop_pairs[k]))
        return {k: project_value(v, drop_pairs, head, tail) for k, v in value.items() if wanted(k, v)}
    if isinstance(value, list):
        items = [project_value(v, drop_pairs, head, tail) for v in value]
        hidden = len(items) - head - tail
        return items if hidden <= 0 else [*items[:head], {"__omitted_items__": f"{hidden} items hidden"}, *items[len(items) - tail :]]
    return value


def project_text(text: str | None, **settings) -> str | None:
    """A JSON object or array cleaned and indented by 2; any other text as it is."""
    if text is None or text.lstrip()[:1] not in ("{", "["):
        return text
    try:
        return json.dumps(project_value(json.loads(text), **settings), indent=2, ensure_ascii=False)
    except (ValueError, RecursionError):
        return text


def project_json(df: DataFrame, text: str = "text", **settings) -> DataFrame:
    """df with its text column projected; only rows that begin like JSON go to Python."""
    ship(df.sparkSession)
    like = F.col(text).rlike(r"^\s*[\[{]")

    def apply(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, text, pa.array([project_text(t, **settings) for t in batch[text].to_pylist()], pa.string()))

    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in df.schema])
    return df.where(like).mapInArrow(apply, schema).unionByName(df.where(~F.coalesce(like, F.lit(False))))


def project_log(docs: DataFrame) -> DataFrame:
    """(doc_id, text) without escape codes and with repeats counted."""
    return render(DeduplicateConsecutive(show_count=True).apply(RemoveAnsi(strip_inline=True).apply(split(docs))))
