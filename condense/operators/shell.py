"""Shell command lines: tokens, and whether output of a command can go through the rules."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from condense.plans.catalogue import RULES
from condense.shipping import ship

_TOKEN = re.compile(r"""\s+|(?P<heredoc><<-?\s*['"]?\w+)|(?P<redirect>\d*>>?&?\d*|<)|(?P<op>&&|\|\||;|\||&)|(?P<word>(?:'[^']*'|"(?:\\.|[^"\\])*"|\\.|\$\([^)]*\)|[^\s;&|<>'"\\])+)|(?P<open>.)""", re.S)
_ASSIGN = re.compile(r"^[A-Za-z_]\w*=")
#: Commands that only pass on another; with the number of words that follow them before it.
TRANSPARENT = {"sudo": 0, "env": 0, "time": 0, "nice": 0, "nohup": 0, "command": 0, "stdbuf": 1, "timeout": 1}
#: What reads a pipe by the structure of its text.
CONSUMERS = ("xargs", "awk", "sed", "perl", "python", "python3", "jq", "fx", "yq")
STRUCTURED = re.compile(r"(^|\s)(--json\b|-o\s*(json|yaml|jsonpath)|--output[= ](json|yaml)|--format[= ]\S+|--porcelain\b|-z\b|--template\b)")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str


def tokens(command: str) -> list[Token]:
    """Words (with their quotes), assignments before them, operators, redirects, heredoc openings."""
    out: list[Token] = []
    fresh = True
    for m in _TOKEN.finditer(command):
        kind = m.lastgroup
        if kind is None:
            continue
        if kind == "word" and fresh and _ASSIGN.match(m[0]):
            kind = "assign"
        elif kind in ("word", "op"):
            fresh = kind == "op"
        out.append(Token(kind, m[0]))
    return out


def segments(found: list[Token]) -> list[tuple[list[Token], str]]:
    """Simple commands and the operator after each."""
    out: list[tuple[list[Token], str]] = [([], "")]
    for t in found:
        if t.kind == "op":
            out[-1] = (out[-1][0], t.text)
            out.append(([], ""))
        else:
            out[-1][0].append(t)
    return [s for s in out if s[0]]


def bare(segment: list[Token]) -> str:
    """A simple command without assignments, redirects and passing prefixes."""
    words = [t.text for t in segment if t.kind == "word"]
    while words and words[0] in TRANSPARENT:
        skip = 1 + TRANSPARENT[words[0]]
        words = words[skip:]
        while words and (words[0].startswith("-") or _ASSIGN.match(words[0])):
            words = words[1:]
    if words[:2] == ["docker", "exec"]:
        rest = [w for w in words[2:] if not w.startswith("-")]
        words = rest[1:]
    return " ".join(words)


def classify(command: str | None, rules=RULES) -> dict:
    """should_rewrite, rewritten, reason, rule."""
    no = lambda reason: {"should_rewrite": False, "rewritten": command, "reason": reason, "rule": None}
    if not command or not command.strip():
        return no("empty")
    found = tokens(command)
    if any(t.kind == "heredoc" for t in found):
        return no("heredoc")
    if any(t.kind == "open" for t in found):
        return no("unbalanced quotes")
    parts, hit = [], None
    groups = segments(found)
    piped = False
    for i, (segment, op) in enumerate(groups):
        text = " ".join(t.text for t in segment)
        plain = bare(segment)
        rule = next((r.name for r in rules if r.name != "generic" and any(re.search(p, plain) for p in r.match_command)), None)
        readers = [bare(s).split(" ")[0] for s, _ in groups[i + 1 : i + 2]] if op == "|" else []
        fine = rule and not piped and not STRUCTURED.search(plain) and not any(r in CONSUMERS for r in readers) and not any(t.kind == "redirect" for t in segment)
        if fine:
            hit = hit or rule
            lead = [t.text for t in segment if t.kind == "assign"]
            text = " ".join([*lead, "condense", *(t.text for t in segment if t.kind != "assign")])
        parts.append(text + (f" {op}" if op and op != ";" else op))
        piped = op == "|"
    if hit is None:
        return no("structured output" if STRUCTURED.search(command) else "no rule")
    return {"should_rewrite": True, "rewritten": " ".join(parts), "reason": "rule", "rule": hit}


def classified(commands: DataFrame, column: str = "command") -> DataFrame:
    """commands with struct columns' fields of classify."""
    ship(commands.sparkSession)

    def apply(batches):
        for batch in batches:
            rows = [classify(c) for c in batch[column].to_pylist()]
            kinds = {"should_rewrite": pa.bool_(), "rewritten": pa.string(), "reason": pa.string(), "rule": pa.string()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[k] for r in rows], t) for k, t in kinds.items())], [*batch.schema.names, *kinds])

    schema = commands.schema
    for name, kind in (("should_rewrite", "boolean"), ("rewritten", "string"), ("reason", "string"), ("rule", "string")):
        schema = _with(schema, name, kind)
    return commands.mapInArrow(apply, schema)


def _with(schema, name: str, kind: str):
    from pyspark.sql import types as T

    return T.StructType([*schema.fields, T.StructField(name, T.BooleanType() if kind == "boolean" else T.StringType())])
