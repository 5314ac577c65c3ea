"""Token estimates and small string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Estimated price of a million tokens, in dollars.
DOLLARS_PER_MILLION = 3.0


def count_tokens(text: Column) -> Column:
    """A quarter of the code points, rounded up; 0 for an empty text."""
    return F.ceil(F.length(text) / 4).cast("long")


def line_tokens(line: Column) -> Column:
    """The cost of a line: as count_tokens, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(line) / 4)).cast("long")


def tokens_of_length(length: Column) -> Column:
    return F.ceil(length / 4).cast("long")


def strip(text: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix; of a sorted run, that of its least and greatest line is that of all."""
    n = F.least(F.length(a), F.length(b))
    # the first place that differs, by bisection: 24 halvings reach 16 million characters
    low = F.aggregate(
        F.sequence(F.lit(1), F.lit(24)),
        F.struct(F.lit(0).alias("low"), n.alias("high")),
        lambda s, _: F.when(
            s["low"] < s["high"],
            F.when(
                F.substring(a, F.lit(1), F.floor((s["low"] + s["high"] + 1) / 2).cast("int")) == F.substring(b, F.lit(1), F.floor((s["low"] + s["high"] + 1) / 2).cast("int")),
                F.struct(F.floor((s["low"] + s["high"] + 1) / 2).cast("int").alias("low"), s["high"].alias("high")),
            ).otherwise(F.struct(s["low"].alias("low"), (F.floor((s["low"] + s["high"] + 1) / 2) - 1).cast("int").alias("high"))),
        ).otherwise(s),
    )
    return F.substring(a, F.lit(1), low["low"])


def condense_sentence(text: Column, limit: int) -> Column:
    """The first sentence, cut to limit characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    first = F.regexp_extract(flat, r"^(.*?[.!?])(?: |$)", 1)
    first = F.when(first == "", flat).otherwise(first)
    return F.when(F.length(first) <= limit, first).otherwise(F.concat(F.rtrim(F.substring(first, 1, limit - 1)), F.lit("…")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """The name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def dollars(tokens: Column) -> Column:
    return tokens / 1_000_000 * DOLLARS_PER_MILLION


def human_count(n: Column) -> Column:
    """1234 as 1.2K, 1234567 as 1.2M."""
    return F.when(n >= 1_000_000, F.concat(F.format_number(n / 1e6, 1), F.lit("M"))).when(n >= 1000, F.concat(F.format_number(n / 1e3, 1), F.lit("K"))).otherwise(n.cast("string"))


def human_duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(F.format_number(ms, 0), F.lit("ms"))).when(ms < 60_000, F.concat(F.format_number(ms / 1000, 1), F.lit("s"))).otherwise(F.concat(F.format_number(F.floor(ms / 60_000), 0), F.lit("m "), F.format_number(F.floor(ms % 60_000 / 1000), 0), F.lit("s")))
