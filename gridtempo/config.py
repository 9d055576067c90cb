"""Settings that change results, as frozen dataclasses read from YAML or JSON on the driver."""

from __future__ import annotations

import dataclasses
import json
import typing
from dataclasses import dataclass, field
from pathlib import Path


# The defaults under which results are comparable.
@dataclass(frozen=True)
class Market:
    region: str = "NSW1"
    zone: str = "Australia/Brisbane"
    local_zone: str = "Australia/Sydney"
    latitude: float = -33.87
    longitude: float = 151.21
    horizon: int = 48
    origin_hours: tuple[int, ...] = (0, 12)


@dataclass(frozen=True)
class Splits:
    eval_start: str = "2025-06-01"
    early: tuple[int, ...] = (8, 12)
    late: tuple[int, ...] = (19, 23)
    seed: int = 20260613


@dataclass(frozen=True)
class Features:
    heating: float = 16.5
    cooling: float = 20.5
    knots: tuple[float, ...] = (10.5, 18.5, 25.65)
    thermal: tuple[int, ...] = (48, 96)
    daily: int = 10
    weekly: int = 6
    lags: tuple[int, ...] = (48, 336)
    interactions: int = 2


@dataclass(frozen=True)
class Scoring:
    sweep: tuple[float, ...] = (0.0, 0.5, 1.0, 1.5, 2.0)
    quantiles: tuple[float, ...] = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
    intervals: tuple[float, ...] = (0.5, 0.95)
    resamples: int = 10_000
    seed: int = 20260611


@dataclass(frozen=True)
class Config:
    market: Market = field(default_factory=Market)
    splits: Splits = field(default_factory=Splits)
    features: Features = field(default_factory=Features)
    scoring: Scoring = field(default_factory=Scoring)


def build(kind: type, values: dict):
    """A dataclass from nested mappings; unknown names are errors, lists become tuples."""
    hints = typing.get_type_hints(kind)
    if unknown := set(values) - set(hints):
        raise ValueError(f"unknown settings of {kind.__name__}: {', '.join(sorted(unknown))}")
    made = {}
    for name, value in values.items():
        made[name] = build(hints[name], value) if dataclasses.is_dataclass(hints[name]) else tuple(value) if isinstance(value, list) else value
    return kind(**made)


def load(path: str | Path) -> Config:
    text = Path(path).read_text()
    if str(path).endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs PyYAML; JSON works without") from e
        return build(Config, yaml.safe_load(text) or {})
    return build(Config, json.loads(text))
