"""Hooks before, in place of, and after the rules: ordered, open to failure, able to stop the chain."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

CATEGORIES = ("PRE_FILTER", "FILTER", "POST_FILTER")
_TIERS = {"project": 0, "user": 1, "builtin": 2}


class StopChain(Exception):  # noqa: N818
    """Raised by a hook to skip those after it."""


@dataclass(frozen=True)
class Hook:
    name: str
    category: str
    #: from DataFrame to DataFrame, at plan time; work on rows belongs into its expressions
    function: Callable[[DataFrame], DataFrame]
    priority: int = 100
    tier: str = "user"


def ordered(hooks: list[Hook]) -> list[Hook]:
    """By category, tier, priority, then registration."""
    return sorted(hooks, key=lambda h: (CATEGORIES.index(h.category), _TIERS[h.tier], h.priority))


def run_hooks(df: DataFrame, hooks: list[Hook], category: str) -> DataFrame:
    """df through the hooks of a category; one that fails is told and left out."""
    for hook in ordered([h for h in hooks if h.category == category]):
        try:
            df = hook.function(df)
        except StopChain:
            break
        except Exception as e:  # noqa: BLE001  hooks are others' code
            warnings.warn(f"hook {hook.name} failed: {e}", stacklevel=2)
    return df
