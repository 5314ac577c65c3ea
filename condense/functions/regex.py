"""Python-style patterns as Java patterns with the same matches on lines.

``(?d)`` keeps ``.`` and ``$`` to newlines alone; ``(?U)`` gives ``\\d \\w \\s \\b`` their Unicode meaning.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLASSES = re.compile(r"(?<!\\)(?:\\\\)*\\[dDwWsSbB]")


class UnsupportedPattern(ValueError):
    """A construct that Java can't run with the same meaning."""


def java(pattern: str) -> str:
    """The Java form of a pattern; raises UnsupportedPattern for what has none."""
    if re.search(r"\(\?\((?!\?)|\(\?R\)|\(\?&|\\p\{[^}]*=|\(\?\|", pattern):
        raise UnsupportedPattern(pattern)
    out = re.sub(r"\(\?P<", "(?<", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)
    return ("(?dU)" if _CLASSES.search(pattern) else "(?d)") + out


def java_replacement(text: str) -> str:
    r"""``\1`` and ``\g<1>`` as ``$1``; dollar signs are literal."""
    out = text.replace("$", r"\$")
    out = re.sub(r"\\g<(\w+)>", lambda m: f"${m[1]}" if m[1].isdigit() else f"${{{m[1]}}}", out)
    return re.sub(r"\\(\d)", r"$\1", out)


def any_match(line: Column, patterns: Iterable[str]) -> Column:
    """Whether any pattern is found in line."""
    return functools.reduce(operator.or_, (line.rlike(java(p)) for p in patterns), F.lit(False))
