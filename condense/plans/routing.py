"""Which rule takes a text, and the compression of a whole table of texts."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condense.functions.regex import any_match
from condense.functions.text import count_tokens
from condense.plans.catalogue import RULES, Rule
from condense.plans.detect import with_type

TIER_ORDER = {"project": 0, "user": 1, "builtin": 2}


def ordered(rules: tuple[Rule, ...] | list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: TIER_ORDER[r.tier])


def rule_name(command: Column, content_type: Column, rules=RULES) -> Column:
    """The first rule that takes the content type, else the first whose command pattern is found; null for none."""
    rules = ordered(rules)
    out = F.lit(None).cast("string")
    for rule in reversed([r for r in rules if r.match_command]):
        out = F.when(any_match(command, rule.match_command), rule.name).otherwise(out)
    for rule in reversed([r for r in rules if r.match_content_types]):
        out = F.when(content_type.isin(*rule.match_content_types), rule.name).otherwise(out)
    return out


def routed(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """docs with content_type and filter_name; without a command column the text itself is matched."""
    command = F.col("command") if "command" in docs.columns else F.coalesce(F.col(text), F.lit(""))
    return with_type(docs, text).withColumn("filter_name", rule_name(command, F.col("content_type"), rules))


def compress(docs: DataFrame, rules=RULES, text: str = "text", names: list[str] | None = None) -> DataFrame:
    """doc_id, filter_name, original_tokens, final_tokens, text.

    Texts are read, typed and routed once and dealt out by doc_id; all rules' chains read that one exchange and take
    their own rows (texts without a rule are read once more).  names limits the chains to rules that are known to occur (``rules_present`` tells which).
    Texts without a rule, or with a failed guard, pass unchanged.
    """
    known = {r.name: r for r in rules}
    names = list(names or known)
    listed = F.coalesce(F.col("filter_name").isin(*names), F.lit(False))
    rows = routed(docs, rules, text).withColumnRenamed(text, "text").select("doc_id", "text", F.when(listed, F.col("filter_name")).alias("filter_name")).repartition("doc_id")
    # a condition that isn't deterministic stays above the exchange, so all chains share it
    mine = lambda name: rows.where(F.when(F.spark_partition_id() >= 0, F.col("filter_name").eqNullSafe(name))).select("doc_id", "text")
    parts = [known[name].pipeline().run(mine(name), dealt=True).withColumn("filter_name", F.lit(name)) for name in names]
    same = count_tokens(F.col("text"))
    rest = mine(None).select("doc_id", same.alias("original_tokens"), same.alias("final_tokens"), "text", F.lit(None).cast("string").alias("filter_name"))
    out = functools.reduce(DataFrame.unionByName, parts, rest)
    return out.select("doc_id", "filter_name", "original_tokens", "final_tokens", "text")


def rules_present(docs: DataFrame, rules=RULES, text: str = "text") -> list[str]:
    """Names of the rules that some text takes: at most as many as there are rules."""
    return sorted(r[0] for r in routed(docs, rules, text).where("filter_name is not null").select("filter_name").distinct().collect())


def run_tests(spark, rules=RULES) -> list[str]:
    """Failures of the rules' own tests: lines that must or mustn't be in the result, and a share of characters saved."""
    failures = []
    for rule in (r for r in rules if r.tests):
        docs = spark.createDataFrame([(i, t["input"]) for i, t in enumerate(rule.tests)], "doc_id int, text string")
        results = {r.doc_id: r.text for r in rule.pipeline().run(docs.coalesce(1)).collect()}
        for i, test in enumerate(rule.tests):
            label, text = f"{rule.name}/{i}", results[i]
            failures += [f"{label}: lacks {w!r}" for w in test.get("must_contain", ()) if w not in text]
            failures += [f"{label}: holds {w!r}" for w in test.get("must_not_contain", ()) if w in text]
            least = test.get("compression_target")
            if least is not None and 1 - len(text) / max(1, len(test["input"])) < least:
                failures.append(f"{label}: saves less than {least}")
    return failures
