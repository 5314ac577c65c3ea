"""Rules from TOML files: project files before a user's, both before the built-in ones."""

from __future__ import annotations

import tomllib
import warnings
from pathlib import Path

from condense.operators.stages import STAGES
from condense.plans.catalogue import RULES, Rule


def load_rules(path: str | Path, tier: str = "user") -> list[Rule]:
    """The [[filters]] of a file; an unknown stage or a bad setting is told and left out."""
    data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    out = []
    for entry in data.get("filters", []):
        chain = []
        for settings in entry.get("stages", []):
            kind = settings.get("type")
            if kind not in STAGES:
                warnings.warn(f"{path}: unknown stage {kind!r} in {entry.get('name')!r}", stacklevel=2)
                continue
            try:
                chain.append(STAGES[kind](**{k: tuple(map(_frozen, v)) if isinstance(v, list) else v for k, v in settings.items() if k != "type"}))
            except TypeError as e:
                warnings.warn(f"{path}: {e} in {entry.get('name')!r}", stacklevel=2)
        command = entry.get("match_command", ())
        lists = {k: tuple(entry.get(k, ())) for k in ("match_content_types", "abort_unless", "abort_if", "tests")}
        out.append(Rule(entry["name"], (command,) if isinstance(command, str) else tuple(command), stages=tuple(chain), on_empty=entry.get("on_empty"), tier=tier, **lists))
    return out


def _frozen(value):
    return (value["pattern"], value["replacement"]) if isinstance(value, dict) else value


def all_rules(project: list[str] = (), user: list[str] = ()) -> list[Rule]:
    """In the order of lookup; within a tier by file name."""
    found = [r for p in sorted(project) for r in load_rules(p, "project")] + [r for p in sorted(user) for r in load_rules(p, "user")]
    return [*found, *RULES]
