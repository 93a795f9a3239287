"""Run configuration: presets of model vendors, the independent judge, switches from the environment."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Preset:
    name: str
    key_variable: str
    default_model: str


@dataclass(frozen=True)
class Choice:
    preset: Preset
    model: str


def pick(presets: list[Preset], env: Mapping[str, str], name: str | None = None, model: str | None = None) -> Choice:
    """The named preset, whose key must be set, else the first whose key is set; the model is the one asked for, else <NAME>_MODEL's, else the default."""
    if name:
        found = next((p for p in presets if p.name == name), None)
        if not found:
            raise ValueError(f"unknown provider: {name}")
        if not env.get(found.key_variable):
            raise ValueError(f"{found.key_variable} is not set")
    else:
        found = next((p for p in presets if env.get(p.key_variable)), None)
        if not found:
            raise ValueError("no provider has a key")
    return Choice(found, model or env.get(f"{found.name.upper()}_MODEL") or found.default_model)


def pick_judge(presets: list[Preset], env: Mapping[str, str], classifier: Choice, name: str | None = None) -> Choice:
    """The named judge, else the first other vendor with a key, else the classifier's own with a warning."""
    if name:
        return pick(presets, env, name)
    others = [p for p in presets if p != classifier.preset and env.get(p.key_variable)]
    if others:
        return pick(presets, env, others[0].name)
    warnings.warn("the judge is the classifier's own vendor", stacklevel=2)
    return classifier


def cache_enabled(env: Mapping[str, str], variable: str = "FRAMEWRIGHT_NO_CACHE") -> bool:
    return not env.get(variable)
