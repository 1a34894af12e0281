"""Settings from YAML or JSON files, with required keys, and parameters of pipelines."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any


class SettingsError(ValueError):
    """Settings that can't be used."""


class DataError(ValueError):
    """Data that can't be used."""


def read_settings(path: str, required: Sequence[str] = ()) -> dict[str, Any]:
    """The settings of a file; dotted names of required keys must be there."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        settings = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as error:
            raise SettingsError("reading YAML needs PyYAML") from error
        settings = yaml.safe_load(text) or {}
    for name in required:
        at: Any = settings
        for key in name.split("."):
            if not isinstance(at, Mapping) or key not in at:
                raise SettingsError(f"{name} is missing")
            at = at[key]
    return settings


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: type
    default: Any = None
    required: bool = False


def parameters(given: Mapping[str, Any], known: Sequence[Parameter]) -> dict[str, Any]:
    """given with defaults; raises for unknown names, lacking ones, and values of another type."""
    if unknown := set(given) - {p.name for p in known}:
        raise SettingsError(f"unknown parameters: {sorted(unknown)}")
    out = {}
    for p in known:
        if p.required and p.name not in given:
            raise SettingsError(f"{p.name} is required")
        value = given.get(p.name, p.default)
        if value is not None and type(value) is not p.kind:
            raise SettingsError(f"{p.name} must be of type {p.kind.__name__}")
        out[p.name] = value
    return out


def merged_rules(default: Mapping[str, Any], own: Mapping[str, Any]) -> dict[str, Any]:
    """Rule sets merge by block: a block that is given replaces the whole default block."""
    return {**default, **own}
