"""The stages.  Each is a frozen configuration with ``apply(lines) -> lines``; PROTECT lines are never changed."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from condense.functions.regex import any_match, java, java_replacement
from condense.functions.text import common_prefix, line_tokens, strip
from condense.operators.lines import COMPRESS, KEEP, PROTECT, by_pos, islands, render, renumber, shown, upto

STAGES: dict[str, type] = {}
TIMES = "×"


def register_stage(name: str):
    """Make a stage available to rules by name."""

    def keep(cls):
        cls.type = name
        STAGES[name] = cls
        return cls

    return keep


@dataclass(frozen=True)
class Stage:
    preserve_patterns: tuple[str, ...] = field(default=(), kw_only=True)
    #: whether preserve_patterns also turn COMPRESS lines to PROTECT
    resurrects = True

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            if isinstance(value, list):
                object.__setattr__(self, name, tuple(value))

    def preserve(self, df: DataFrame) -> DataFrame:
        if not self.preserve_patterns:
            return df
        open_ = F.col("decision") != PROTECT if self.resurrects else F.col("decision") == KEEP
        return decide(df, open_ & any_match(F.col("line"), self.preserve_patterns), PROTECT, "matches a preserve pattern", self.type)

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


def decide(df: DataFrame, where: Column, decision: str, reason: str | Column, stage: str, line: Column | None = None) -> DataFrame:
    """Set decision, reason, stage and perhaps the line of the rows where a condition holds."""
    reason = F.lit(reason) if isinstance(reason, str) else reason
    new = {"decision": F.lit(decision), "reason": reason, "stage": F.lit(stage)} | ({} if line is None else {"line": line})
    return df.withColumn("__w", F.coalesce(where, F.lit(False))).withColumns({c: F.when(F.col("__w"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("__w")


def is_keep() -> Column:
    return F.col("decision") == KEEP


@register_stage("strip_lines")
@dataclass(frozen=True)
class StripLines(Stage):
    patterns: tuple[str, ...] = ()
    resurrects = False

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.patterns:
            return self.preserve(df)
        df = self.preserve(df)
        return decide(df, is_keep() & any_match(F.col("line"), self.patterns), COMPRESS, "matches a strip pattern", self.type)


_ANSI = "\x1b\\[[0-9;]*[A-Za-z]"


@register_stage("remove_ansi")
@dataclass(frozen=True)
class RemoveAnsi(Stage):
    strip_inline: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        df = self.preserve(df)
        coded = (F.col("decision") != PROTECT) & F.col("line").rlike(_ANSI)
        bare = F.regexp_replace("line", _ANSI, "")
        only = coded & (strip(bare) == "")
        df = decide(df, only, COMPRESS, "escape codes only", self.type)
        if self.strip_inline:
            df = decide(df, coded & ~(strip(bare) == ""), KEEP, "escape codes removed", self.type, bare)
        return df


@register_stage("deduplicate_consecutive")
@dataclass(frozen=True)
class DeduplicateConsecutive(Stage):
    show_count: bool = False
    resurrects = False

    def apply(self, df: DataFrame) -> DataFrame:
        df = self.preserve(df)
        # COMPRESS rows are looked through: the other rows of a document in a window of their own
        w = W.partitionBy("doc_id", "__in").orderBy("pos")
        df = df.withColumn("__in", shown()).withColumn("__same", is_keep() & F.col("__in") & (F.lag("line").over(w) == F.col("line")))
        df = df.withColumn("__same", F.coalesce("__same", F.lit(False)))
        if self.show_count:
            df = df.withColumn("__island", F.sum((~F.col("__same")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
            df = df.withColumn("__n", F.count("*").over(W.partitionBy("doc_id", "__in", "__island")))
            df = decide(df, is_keep() & ~F.col("__same") & (F.col("__n") > 1), KEEP, F.concat(F.lit("one of "), F.col("__n").cast("string"), F.lit(" equal lines")), self.type, F.concat("line", F.lit(f" ({TIMES}"), F.col("__n").cast("string"), F.lit(")")))
        return decide(df, F.col("__same"), COMPRESS, "equals the line before", self.type).drop("__in", "__same", "__island", "__n")


def located(line: Column, pattern: str | None) -> tuple[Column, Column]:
    """(key, location): line without the first capture of pattern, and the capture; (line, null) without a match."""
    if pattern is None:
        return line, F.lit(None).cast("string")
    p = java(pattern)
    found = line.rlike(p)
    part = F.regexp_extract(line, p, 1)
    whole = F.regexp_extract(line, p, 0)
    at = F.instr(line, whole)
    begin = at + F.position(part, whole) - 1
    key = F.concat(F.substring(line, F.lit(1), begin - 1), F.substring(line, begin + F.length(part), F.length(line)))
    return F.when(found, key).otherwise(line), F.when(found, part)


@register_stage("group_repeated")
@dataclass(frozen=True)
class GroupRepeated(Stage):
    """Runs (or, with scope global, all) of matching lines as one; location_pattern's capture must come at its text's first place in the match."""

    patterns: tuple[str, ...] = ()
    min_count: int = 2
    exact_match: bool = False
    location_pattern: str | None = None
    scope: str = "run"

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.patterns:
            return df
        df = self.preserve(df)
        for pattern in self.patterns:
            df = self._whole(df, pattern) if self.scope == "global" else self._runs(df, pattern)
        return df

    def _runs(self, df: DataFrame, pattern: str) -> DataFrame:
        key, location = located(F.col("line"), self.location_pattern)
        df = df.withColumn("__key", key).withColumn("__loc", location)
        member = is_keep() & F.col("line").rlike(java(pattern))
        breaks = None
        if self.exact_match:
            breaks = F.lag("line").over(by_pos()) != F.col("line")
        if self.location_pattern is not None:
            other = F.lag("__key").over(by_pos()) != F.col("__key")
            breaks = other if breaks is None else breaks | other
        df = islands(df, member, "__island", F.lit(False) if breaks is None else breaks)
        return self._fold(df, W.partitionBy("doc_id", "__island"), F.col("__island").isNotNull()).drop("__island")

    def _whole(self, df: DataFrame, pattern: str) -> DataFrame:
        key, location = located(F.col("line"), self.location_pattern)
        member = is_keep() & F.col("line").rlike(java(pattern))
        df = df.withColumn("__loc", location).withColumn("__member", member).withColumn("__key", F.when(F.col("__member"), key))
        return self._fold(df, W.partitionBy("doc_id", "__member", "__key"), F.col("__member")).drop("__member")

    def _fold(self, df: DataFrame, group: W, member: Column) -> DataFrame:
        df = df.withColumn("__n", F.count("*").over(group)).withColumn("__rn", F.row_number().over(group.orderBy("pos")))
        hit = member & (F.col("__n") >= self.min_count)
        # a group of one has no repeats to tell
        first, rest = hit & (F.col("__rn") == 1), hit & (F.col("__rn") > 1)
        if self.location_pattern is None and self.scope == "run":
            df = decide(df, first, KEEP, F.concat(F.lit("stands for "), F.col("__n").cast("string"), F.lit(" lines")), self.type, F.concat("line", F.lit(f" ({TIMES}"), F.col("__n").cast("string"), F.lit(")")))
            return decide(df, rest, COMPRESS, "repeats a grouped line", self.type).drop("__n", "__rn", "__key", "__loc")
        places = F.collect_list(F.struct("pos", F.coalesce("__loc", "line").alias("at"))).over(group)
        # only the first row of a group carries the list
        df = df.withColumn("__first", first).withColumn("__places", F.when(F.col("__first"), places))
        listed = F.array_join(F.transform(F.slice(F.array_sort("__places"), 2, 2147483646), lambda x: x["at"]), ", ")
        told = F.concat(F.lit("("), (F.col("__n") - 1).cast("string"), F.lit(" more with the same message at: "), listed, F.lit(")"))
        df = decide(df, rest, COMPRESS, "repeats a grouped line elsewhere", self.type)
        # doc_id stays outside the structs, so the partitioning by it is known to hold
        names = [c for c in df.columns if not c.startswith("__") and c != "doc_id"]
        same = F.struct(*names, F.lit(0).alias("__sub"))
        summary = {"line": told, "decision": F.lit(KEEP), "reason": F.lit("tells the places of repeats"), "stage": F.lit(self.type)}
        extra = F.struct(*(summary[c].alias(c) if c in summary else F.when(F.lit(c == "pos"), F.col(c)).alias(c) for c in names), F.lit(1).alias("__sub"))
        df = df.select("doc_id", F.explode(F.when(F.col("__first"), F.array(same, extra)).otherwise(F.array(same))).alias("r")).select("doc_id", "r.*")
        return renumber(df, "pos", "__sub").drop("__sub")


@register_stage("collapse_unchanged_context")
@dataclass(frozen=True)
class CollapseUnchangedContext(Stage):
    context_lines: int = 3

    def apply(self, df: DataFrame) -> DataFrame:
        df = islands(df, is_keep(), "__island")
        run = W.partitionBy("doc_id", "__island")
        df = df.withColumn("__rn", F.row_number().over(run.orderBy("pos"))).withColumn("__n", F.count("*").over(run))
        middle = F.col("__island").isNotNull() & (F.col("__rn") > self.context_lines) & (F.col("__rn") <= F.col("__n") - self.context_lines)
        df = df.withColumn("__mid", middle).withColumn("__cost", F.sum(F.when(F.col("__mid"), line_tokens(F.col("line")))).over(run))
        told = F.concat(F.lit("... "), (F.col("__n") - 2 * self.context_lines).cast("string"), F.lit(" unchanged lines omitted ..."))
        df = df.withColumn("__told", told).withColumn("__mid", F.col("__mid") & (line_tokens(F.col("__told")) < F.col("__cost")))
        df = decide(df, F.col("__mid") & (F.col("__rn") > self.context_lines + 1), COMPRESS, "unchanged context", self.type)
        df = decide(df, F.col("__mid") & (F.col("__rn") == self.context_lines + 1), KEEP, "stands for unchanged context", self.type, F.col("__told"))
        return df.drop("__island", "__rn", "__n", "__mid", "__cost", "__told")


#: Flags of lines in one piece of a string.
FLAGS = 512


@register_stage("max_tokens")
@dataclass(frozen=True)
class MaxTokens(Stage):
    """A greedy budget that skips a line too dear and goes on: a fold in order, not a running sum."""

    limit: int = 1000
    strategy: str = "tail"

    def apply(self, df: DataFrame) -> DataFrame:
        df = self.preserve(df)
        columns = df.columns
        rows = F.array_sort(F.collect_list(F.struct("pos", *(c for c in columns if c not in ("doc_id", "pos")), line_tokens(F.col("line")).alias("__cost"))))
        docs = df.groupBy("doc_id").agg(rows.alias("rows"))
        total = F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + F.when(r["decision"] != COMPRESS, r["__cost"]).otherwise(0))

        def kept(rows: Column, budget: int) -> Column:
            """One character for each row in order: 1 if the budget takes it."""
            start = F.struct(F.lit(budget).cast("long").alias("left"), F.lit("").alias("flags"), F.array().cast("array<string>").alias("done"))

            def step(a: Column, r: Column) -> Column:
                # full pieces go to a list of their own, so that a long document's flags aren't copied for each line
                full = F.length(a["flags"]) >= FLAGS
                take = (r["decision"] == KEEP) & (a["left"] >= r["__cost"])
                flag = F.when(take, "1").otherwise("0")
                return F.struct(
                    F.when(take, a["left"] - r["__cost"]).otherwise(a["left"]).alias("left"), F.when(full, flag).otherwise(F.concat(a["flags"], flag)).alias("flags"),
                    F.when(full, F.concat(a["done"], F.array(a["flags"]))).otherwise(a["done"]).alias("done"),
                )

            return F.aggregate(rows, start, step, lambda a: F.concat(F.array_join(a["done"], ""), a["flags"]))

        half = max(1, self.limit // 2)
        flags = {"head": [kept(F.col("rows"), self.limit)], "tail": [F.reverse(kept(F.reverse("rows"), self.limit))], "both": [kept(F.col("rows"), half), F.reverse(kept(F.reverse("rows"), half))]}[self.strategy]
        # under budget no fold runs
        docs = docs.withColumn("over", total > self.limit).withColumn("flags", F.array(*(F.when(F.col("over"), F.split(f, "")) for f in flags)))

        def judged(r: Column, i: Column) -> Column:
            drop = functools.reduce(lambda a, b: a & b, (F.get(F.get("flags", F.lit(k)), i) == "0" for k in range(len(flags))))
            cut = F.col("over") & (r["decision"] == KEEP) & drop
            new = {"decision": F.lit(COMPRESS), "reason": F.lit("over the token budget"), "stage": F.lit(self.type)}
            return F.struct(*(F.when(cut, new[c]).otherwise(r[c]).alias(c) if c in new else r[c].alias(c) for c in columns if c != "doc_id"))

        return docs.select("doc_id", F.inline(F.transform("rows", judged))).select(*columns)


@register_stage("truncate_lines")
@dataclass(frozen=True)
class TruncateLines(Stage):
    max_length: int = 2000
    marker: str = "…[truncated]"
    resurrects = False

    def apply(self, df: DataFrame) -> DataFrame:
        df = self.preserve(df)
        if len(self.marker) >= self.max_length:
            cut = F.substring("line", 1, self.max_length)
        else:
            cut = F.concat(F.substring("line", 1, self.max_length - len(self.marker)), F.lit(self.marker))
        return decide(df, is_keep() & (F.length("line") > self.max_length), KEEP, f"cut to {self.max_length} characters", self.type, cut)


@register_stage("regex_replace")
@dataclass(frozen=True)
class RegexReplace(Stage):
    rules: tuple = ()
    resurrects = False

    def apply(self, df: DataFrame) -> DataFrame:
        df = self.preserve(df)
        line = F.col("line")
        for rule in self.rules:
            pattern, replacement = (rule["pattern"], rule["replacement"]) if isinstance(rule, dict) else rule
            line = F.regexp_replace(line, java(pattern), F.lit(java_replacement(replacement)))
        df = df.withColumn("__new", line)
        return decide(df, is_keep() & (F.col("__new") != F.col("line")), KEEP, "rewritten by a rule", self.type, F.col("__new")).drop("__new")


@register_stage("match_output")
@dataclass(frozen=True)
class MatchOutput(Stage):
    pattern: str = ""
    summary: str = ""

    def apply(self, df: DataFrame) -> DataFrame:
        whole = render(df).select("doc_id", F.col("text").rlike("(?d)^(?:" + java(self.pattern).removeprefix("(?d)") + r")\z").alias("__hit"))
        guarded = df.groupBy("doc_id").agg(F.max((F.col("decision") == PROTECT).cast("int")).alias("__p"))
        hit = whole.join(guarded, "doc_id").select("doc_id", (F.col("__hit") & (F.col("__p") == 0)).alias("__hit"))
        df = df.join(hit, "doc_id")
        df = decide(df, F.col("__hit") & (F.col("pos") > 0), COMPRESS, "the whole output matched", self.type)
        df = decide(df, F.col("__hit") & (F.col("pos") == 0), KEEP, "the whole output matched", self.type, F.lit(self.summary))
        return df.drop("__hit")


@register_stage("path_prefix_fold")
@dataclass(frozen=True)
class PathPrefixFold(Stage):
    patterns: tuple[str, ...] = ()
    separator: str = "/"

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.patterns or not self.separator:
            return df
        df = islands(self.preserve(df), is_keep() & any_match(F.col("line"), self.patterns), "__island")
        run = W.partitionBy("doc_id", "__island")
        df = df.withColumn("__n", F.count("*").over(run)).withColumn("__lo", F.min("line").over(run)).withColumn("__hi", F.max("line").over(run)).withColumn("__rn", F.row_number().over(run.orderBy("pos")))
        shared = common_prefix(F.col("__lo"), F.col("__hi"))
        cut = F.length(shared) - F.position(F.reverse(F.lit(self.separator)), F.reverse(shared)) + 1
        prefix = F.when(F.col("__island").isNotNull() & (F.col("__n") > 1) & shared.contains(self.separator), F.substring(shared, F.lit(1), cut))
        df = df.withColumn("__prefix", prefix)
        child = F.substring("line", F.length("__prefix") + 1, F.length("line"))
        head = F.concat("__prefix", F.lit(" ("), F.col("__n").cast("string"), F.lit(" entries):"))
        df = df.withColumn("__head", head).withColumn("__child", child)
        gain = F.sum(line_tokens(F.col("line")) - line_tokens(F.col("__child"))).over(run)
        df = df.withColumn("__fold", F.coalesce(F.col("__prefix").isNotNull() & (line_tokens(F.col("__head")) < gain), F.lit(False)))
        df = df.withColumn("__first", F.col("__fold") & (F.col("__rn") == 1))
        df = decide(df, F.col("__fold"), KEEP, "path prefix folded", self.type, F.col("__child"))
        names = [c for c in df.columns if not c.startswith("__") and c != "doc_id"]
        header = {"line": F.col("__head"), "decision": F.lit(KEEP), "reason": F.lit("holds a shared path prefix"), "stage": F.lit(self.type)}
        top = F.struct(*(header[c].alias(c) if c in header else F.when(F.lit(c == "pos"), F.col(c)).alias(c) for c in names), F.lit(0).alias("__sub"))
        own = F.struct(*names, F.lit(1).alias("__sub"))
        df = df.select("doc_id", F.explode(F.when(F.col("__first"), F.array(top, own)).otherwise(F.array(own))).alias("r")).select("doc_id", "r.*")
        return renumber(df, "pos", "__sub").drop("__sub")


@register_stage("numeric_range_compression")
@dataclass(frozen=True)
class NumericRangeCompression(Stage):
    """Runs of numbers of equal width, each one more than the one before, as first-last; numbers of any length."""

    def apply(self, df: DataFrame) -> DataFrame:
        df = self.preserve(df)
        df = df.withColumn("__v", F.when(is_keep() & F.col("line").rlike(r"^[0-9]+\z"), F.col("line")))
        df = df.withColumn("__was", F.lag("__v").over(by_pos()))
        # one more in digits of the same width: nines at the end turn to noughts, the digit before them rises
        stem = F.rtrim("__was", F.lit("9"))
        digit = (F.ascii(F.right(stem, F.lit(1))) + 1).cast("int")
        following = F.concat(F.left(stem, F.length(stem) - 1), F.chr(digit), F.repeat(F.lit("0"), F.length("__was") - F.length(stem)))
        breaks = F.col("__was").isNotNull() & ((stem == "") | (following != F.col("line")))
        df = islands(df, F.col("__v").isNotNull(), "__island", breaks)
        run = W.partitionBy("doc_id", "__island")
        df = df.withColumn("__n", F.count("*").over(run)).withColumn("__rn", F.row_number().over(run.orderBy("pos")))
        df = df.withColumn("__text", F.concat(F.min("line").over(run), F.lit("-"), F.max("line").over(run)))
        fold = F.col("__island").isNotNull() & (F.col("__n") > 1) & (line_tokens(F.col("__text")) < F.col("__n") * line_tokens(F.col("line")))
        df = df.withColumn("__fold", fold)
        df = decide(df, F.col("__fold") & (F.col("__rn") > 1), COMPRESS, "inside a number range", self.type)
        df = decide(df, F.col("__fold") & (F.col("__rn") == 1), KEEP, "stands for a number range", self.type, F.col("__text"))
        return df.drop("__v", "__was", "__island", "__n", "__rn", "__text", "__fold")


#: The forms of times that a line may begin with, by (date and its separator, has a fraction, zone).
FORMATS = {
    ("T", True, "offset"): "iso_frac_offset",
    ("T", False, "offset"): "iso_offset",
    ("T", True, "Z"): "iso_frac_z",
    ("T", False, "Z"): "iso_z",
    (" ", False, ""): "space_datetime",
    ("", True, ""): "time_frac",
    ("", False, ""): "time_only",
}
_DATED, _TIMED = r"(?d)^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", r"(?d)^\d{2}:\d{2}:\d{2}"
_TAIL = r"(?d)^(\.\d{1,9})?(Z|[+-]\d{2}:?\d{2})?(?=[ \t]|$)"
_DAY = 86_400 * 10**9


def with_time(df: DataFrame, where: Column, name: str) -> DataFrame:
    """df with struct(kind, size, width, days, ns) of the timestamp that begins a line; null for none, an impossible one or elsewhere.

    Instants are whole days and nanoseconds of the day (which offsets may take out of 0 .. one day).
    Fields lie at fixed places, so a line is matched once for its head and once for what follows it.
    """
    line = F.col("line")
    digit = line.between("0", ":") & where
    df = df.withColumn("__size", F.when(digit, F.when(line.rlike(_DATED), 19).when(line.rlike(_TIMED), 8)))
    rest = F.substring(line, F.col("__size") + 1, F.lit(20))
    df = df.withColumn("__tail", F.when(F.col("__size").isNotNull() & rest.rlike(_TAIL), F.regexp_extract(rest, _TAIL, 0)))
    tail, dated = F.col("__tail"), F.col("__size") == 19
    zone = F.when(tail.endswith("Z"), "Z").when(tail.rlike("[+-]"), "offset").otherwise("")
    df = df.withColumn("__zone", zone).withColumn("__at", F.when(dated, 12).otherwise(1))
    part = lambda begin, n: F.substring(line, F.lit(begin) if isinstance(begin, int) else begin, F.lit(n)).try_cast("long")
    hour, minute, second = (part(F.col("__at") + k, 2) for k in (0, 3, 6))
    digits = F.regexp_extract(tail, r"^\.(\d+)", 1)
    ahead = F.col("__zone") == "offset"
    offset = F.right(F.regexp_replace(tail, ":", ""), F.lit(5))
    o_hour, o_minute = (F.substring(offset, k, 2).try_cast("long") for k in (2, 4))
    date = F.try_to_date(F.substring(line, 1, 10), "yyyy-MM-dd")
    kind = functools.reduce(lambda a, kv: a.when((F.when(dated, F.substring(line, 11, 1)).otherwise("") == kv[0][0]) & (tail.startswith(".") == kv[0][1]) & (F.col("__zone") == kv[0][2]), kv[1]), FORMATS.items(), F.when(F.lit(False), ""))
    ns = (hour * 3600 + minute * 60 + second) * 10**9 + F.when(digits != "", F.rpad(digits, 9, "0").try_cast("long")).otherwise(0)
    ns = ns - F.when(ahead, F.when(offset.startswith("+"), 1).otherwise(-1) * (o_hour * 3600 + o_minute * 60) * 10**9).otherwise(0)
    fine = (hour <= 23) & (minute <= 59) & (second <= 59) & (~dated | (date.isNotNull() & (part(1, 4) >= 1))) & (~ahead | ((o_hour <= 23) & (o_minute <= 59)))
    found = F.struct(
        kind.alias("kind"), (F.col("__size") + F.length(tail)).cast("int").alias("size"), F.length(digits).cast("int").alias("width"),
        F.when(dated, F.datediff(date, F.lit("1970-01-01").cast("date"))).otherwise(0).cast("long").alias("days"), ns.alias("ns"),
    )
    return df.withColumn(name, F.when(tail.isNotNull() & fine & kind.isNotNull(), found)).drop("__size", "__tail", "__zone", "__at")


def delta_text(ns: Column) -> Column:
    """The largest unit that divides a difference evenly."""
    ns = ns.cast("decimal(30,0)")
    out = F.concat(ns.cast("string"), F.lit("ns"))
    for name, unit in (("us", 10**3), ("ms", 10**6), ("s", 10**9), ("m", 60 * 10**9), ("h", 3600 * 10**9)):
        out = F.when(ns % unit == 0, F.concat(((ns - ns % F.lit(unit)) / F.lit(unit)).cast("decimal(30,0)").cast("string"), F.lit(name))).otherwise(out)
    return F.concat(F.lit("+"), F.when(ns == 0, F.lit("0s")).otherwise(out))


@register_stage("relative_timestamp_compression")
@dataclass(frozen=True)
class RelativeTimestampCompression(Stage):
    def apply(self, df: DataFrame) -> DataFrame:
        df = with_time(self.preserve(df), is_keep(), "__t").withColumn("__was", F.lag("__t").over(by_pos()))
        before = F.col("__was")
        # decimals, as centuries of nanoseconds leave 64 bits
        days = (F.col("__t.days") - before["days"]).cast("decimal(10,0)")
        df = df.withColumn("__gap", days * F.lit(_DAY).cast("decimal(15,0)") + (F.col("__t.ns") - before["ns"]).cast("decimal(20,0)"))
        breaks = (before["kind"] != F.col("__t.kind")) | (before["width"] != F.col("__t.width")) | (F.col("__gap") < 0)
        df = islands(df, F.col("__t").isNotNull(), "__island", breaks)
        run = W.partitionBy("doc_id", "__island")
        df = df.withColumn("__rn", F.row_number().over(run.orderBy("pos")))
        rest = F.col("__island").isNotNull() & (F.col("__rn") > 1)
        df = df.withColumn("__new", F.when(rest, F.concat(delta_text(F.col("__gap")), F.substring("line", F.col("__t.size") + 1, F.length("line")))))
        gain = F.sum(F.when(F.col("__new").isNotNull(), line_tokens(F.col("line")) - line_tokens(F.col("__new"))).otherwise(0)).over(run)
        df = df.withColumn("__gain", gain)
        return decide(df, F.col("__new").isNotNull() & (F.col("__gain") > 0), KEEP, "time since the line before", self.type, F.col("__new")).drop("__t", "__was", "__gap", "__island", "__rn", "__new", "__gain")


@register_stage("column_padding_compression")
@dataclass(frozen=True)
class ColumnPaddingCompression(Stage):
    patterns: tuple[str, ...] = ()
    max_gaps: int | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.patterns:
            return df
        df = self.preserve(df)
        gap = r"(?U)(?<=\S) {2,}(?=\S)"
        if self.max_gaps is None:
            line = F.regexp_replace("line", gap, " ")
        else:
            # pieces around gaps; the first max_gaps gaps become one space, later ones return
            pieces, gaps = F.split("line", gap), F.regexp_extract_all("line", F.lit(gap), F.lit(0))
            line = F.array_join(F.transform(pieces, lambda x, i: F.concat(x, F.when(i < self.max_gaps, F.when(i < F.size(gaps), " ").otherwise("")).otherwise(F.coalesce(F.get(gaps, i), F.lit(""))))), "")
        df = df.withColumn("__new", line)
        cheaper = (F.col("__new") != F.col("line")) & (line_tokens(F.col("__new")) < line_tokens(F.col("line")))
        return decide(df, is_keep() & any_match(F.col("line"), self.patterns) & cheaper, KEEP, "column padding reduced", self.type, F.col("__new")).drop("__new")


@register_stage("protect_diff_filename_headers")
@dataclass(frozen=True)
class ProtectDiffFilenameHeaders(Stage):
    def apply(self, df: DataFrame) -> DataFrame:
        head = F.col("line").startswith("diff --git ")
        names = ("--- a/", "+++ b/", "rename from ", "rename to ", "Binary files ")
        carrier = functools.reduce(lambda a, b: a | b, (F.col("line").startswith(n) for n in names)) & ~head
        df = df.withColumn("__head", head).withColumn("__seg", F.sum(F.col("__head").cast("int")).over(upto()))
        df = df.withColumn("__named", F.max(carrier.cast("int")).over(W.partitionBy("doc_id", "__seg")))
        return decide(df, F.col("__head") & is_keep() & (F.col("__named") == 0), PROTECT, "only line that names this file", self.type).drop("__head", "__seg", "__named")
