"""Detection of secrets, terms of queries, tool schemas."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condense.shipping import ship

#: Fixed forms of well-known credentials; found ones are told, never changed.
SECRETS = {
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "aws_access_key": r"\b(AKIA|ASIA)[0-9A-Z]{16}\b",
    "private_key": r"-----BEGIN (RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "assigned_secret": r"(?i)\b(api[_-]?key|secret|token|passw(or)?d)\b\s*[:=]\s*[\"']?[A-Za-z0-9/+_.-]{16,}",
}


def secrets(text: Column) -> Column:
    """Names of the secret forms in a text."""
    found = F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in SECRETS.items()))
    return F.array_compact(found)


def secret_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", secrets(F.col(text)).alias("found")).where(F.size("found") > 0)


def query_terms(text: Column, most: int = 4) -> Column:
    """Up to four terms: quoted spans or identifier-like words, in order, without repeats of another case."""
    quoted = F.regexp_extract_all(text, F.lit(r"[\"'`]([^\"'`]{2,})[\"'`]"), F.lit(1))
    rest = F.regexp_replace(text, r"[\"'`][^\"'`]{2,}[\"'`]", " ")
    shaped = F.regexp_extract_all(rest, F.lit(r"\b([A-Za-z_][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)+|[a-z]+(?:[A-Z][a-z0-9]+)+|(?:[A-Z][a-z0-9]+){2,})\b"), F.lit(1))
    both = F.concat(quoted, shaped)
    fresh = F.filter(F.transform(both, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_position(F.transform(both, lambda y: F.lower(y)), F.lower(s["x"])) == s["i"] + 1)
    return F.slice(F.transform(fresh, lambda s: s["x"]), 1, most)


def pruned_schema(value, limit: int = 160, inner: int = 80, depth: int = 0):
    """A tool schema whose descriptions are first sentences, shorter inside."""
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            if k == "description" and isinstance(v, str):
                flat = " ".join(v.split())
                cut = min((flat.find(e) + 1 for e in (". ", "! ", "? ") if e in flat), default=len(flat))
                most = limit if depth == 0 else inner
                first = flat[:cut]
                out[k] = first if len(first) <= most else first[: most - 1].rstrip() + "…"
            else:
                out[k] = pruned_schema(v, limit, inner, depth + 1)
        return out
    return [pruned_schema(v, limit, inner, depth + 1) for v in value] if isinstance(value, list) else value


def prune_schemas(df: DataFrame, column: str = "schema") -> DataFrame:
    ship(df.sparkSession)

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(pruned_schema(json.loads(text)), ensure_ascii=False) if text else text
        except ValueError:
            return text

    def apply(batches):
        for batch in batches:
            yield batch.set_column(batch.schema.get_field_index(column), column, pa.array([one(t) for t in batch[column].to_pylist()], pa.string()))

    return df.mapInArrow(apply, df.schema)
