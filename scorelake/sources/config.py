"""Configurations: TOML, JSON or (where PyYAML is installed) YAML files with dotted overrides."""

from __future__ import annotations

import importlib
import json
import tomllib
from pathlib import Path
from typing import Any


def load(path: str) -> dict[str, Any]:
    """The configuration of a file; relative paths under keys named path are taken from the file's folder."""
    file = Path(path)
    raw = file.read_text()
    if file.suffix == ".toml":
        found = tomllib.loads(raw)
    elif file.suffix == ".json":
        found = json.loads(raw)
    elif file.suffix in (".yaml", ".yml"):
        try:
            yaml = importlib.import_module("yaml")
        except ImportError as error:
            raise RuntimeError("YAML configurations need PyYAML; use TOML or JSON") from error
        found = yaml.safe_load(raw)
    else:
        raise ValueError(f"unknown kind of configuration: {file.suffix}")
    if not isinstance(found, dict):
        raise ValueError("a configuration must be a mapping")
    return _resolved(found, file.parent)


def _resolved(value: Any, folder: Path) -> Any:
    if isinstance(value, dict):
        return {k: str(folder / v) if k == "path" and isinstance(v, str) and "://" not in v and not Path(v).is_absolute() else _resolved(v, folder) for k, v in value.items()}
    return [_resolved(v, folder) for v in value] if isinstance(value, list) else value


def overridden(config: dict[str, Any], changes: list[str]) -> dict[str, Any]:
    """``config`` with ``a.b=value`` changes; values are JSON where they parse, else text."""
    made = json.loads(json.dumps(config))
    for change in changes:
        name, sign, raw = change.partition("=")
        if not sign:
            raise ValueError(f"an override is name=value: {change}")
        try:
            value = json.loads(raw)
        except ValueError:
            value = raw
        *parents, last = name.split(".")
        at = made
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = value
    return made


def symbol(name: str) -> Any:
    """What ``module:name`` names."""
    module, sign, attribute = name.partition(":")
    if not sign:
        raise ValueError(f"a symbol is module:name: {name}")
    return getattr(importlib.import_module(module), attribute)
