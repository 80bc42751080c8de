"""Plans, rules and shapes as files: JSON, and YAML where a reader for it is installed."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

try:
    import yaml
except ImportError:  # JSON only
    yaml = None


def load(path: str) -> object:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yml", ".yaml")):
        if yaml is None:
            raise ValueError(f"no YAML reader for {path}")
        return yaml.safe_load(text)
    return json.loads(text)


def documents(folder: str) -> list[Mapping]:
    """Report plans below a folder by name; a later file of a name replaces an earlier one."""
    found: dict[str, Mapping] = {}
    for path in sorted(p for e in ("json", "yml", "yaml") for p in Path(folder).glob(f"**/*.{e}")):
        plan = load(str(path))
        if isinstance(plan, Mapping):
            found[str(plan.get("name") or path.stem)] = plan
    return [found[k] for k in sorted(found)]


def merged_rules(files: Sequence[str]) -> dict:
    """Rule files laid over one another: lists are joined, mappings are merged, other values replaced."""
    out: dict = {}
    for path in files:
        for key, value in dict(load(path) or {}).items():  # type: ignore[call-overload]
            if isinstance(value, list):
                out[key] = [*out.get(key, []), *value]
            elif isinstance(value, Mapping):
                out[key] = {**out.get(key, {}), **value}
            else:
                out[key] = value
    return out
