"""Specifications from YAML files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

import yaml

from ..model import ConditionSpec, FeatureSpec, HoldingRules, Instrument, Market, PositionDirection, Scalar, StrategySpec, Timeframe

COMPOSITE = frozenset(["all", "any", "not", "sustained"])


def _scalars(raw: Mapping[str, Any], where: str, reserved: frozenset[str]) -> dict[str, Scalar]:
    out: dict[str, Scalar] = {}
    for key, value in raw.items():
        if key in reserved:
            continue
        if isinstance(value, bool) or not isinstance(value, (int, float, str)):
            raise ValueError(f"{where}: {key} must be a number or a string, not {value!r}")
        out[str(key)] = value
    return out


def _features(raw: Any, where: str) -> tuple[FeatureSpec, ...]:
    if not isinstance(raw, Sequence) or isinstance(raw, str):
        raise ValueError(f"{where}: features must be a list")
    out = []
    for i, item in enumerate(raw, 1):
        if not isinstance(item, Mapping) or "kind" not in item:
            raise ValueError(f"{where}: feature {i} needs a kind")
        out.append(FeatureSpec(str(item["kind"]), _scalars(item, f"{where}, feature {i}", frozenset(["kind"]))))
    return tuple(out)


def _condition(raw: Any, where: str) -> ConditionSpec:
    if not isinstance(raw, Mapping) or "kind" not in raw:
        raise ValueError(f"{where} must be a mapping with a kind")
    kind, children = str(raw["kind"]), raw.get("of")
    if children is not None and kind not in COMPOSITE:
        raise ValueError(f"{where}: {kind} takes no children")
    if children is not None and (not isinstance(children, Sequence) or isinstance(children, str)):
        raise ValueError(f"{where}: of must be a list")
    parts = tuple(_condition(c, f"{where}.of[{i}]") for i, c in enumerate(children or ()))
    return ConditionSpec(kind, _scalars(raw, where, frozenset(["kind", "of"])), parts)


def _holding(raw: Any, where: str) -> HoldingRules:
    if raw is None:
        return HoldingRules()
    if not isinstance(raw, Mapping) or set(raw) - {"maximum_holding_bars", "cooldown_bars"}:
        raise ValueError(f"{where}: holding knows maximum_holding_bars and cooldown_bars")
    for key, value in raw.items():
        if isinstance(value, bool) or not isinstance(value, int):
            raise ValueError(f"{where}: holding.{key} must be an integer")
    return HoldingRules(**raw)


def _document(text: str, where: str) -> Mapping[str, Any]:
    raw = yaml.safe_load(text)
    if not isinstance(raw, Mapping):
        raise ValueError(f"{where}: a mapping is needed")
    return raw


def parse_strategy(text: str, where: str = "strategy") -> StrategySpec:
    raw = _document(text, where)
    for key in ("name", "features", "entry", "exit"):
        if not raw.get(key):
            raise ValueError(f"{where} lacks {key}")
    try:
        direction = PositionDirection(str(raw.get("direction", "long")))
    except ValueError:
        raise ValueError(f"{where}: direction must be long, flat or short") from None
    filters = raw.get("filters")
    return StrategySpec(str(raw["name"]), _features(raw["features"], where), _condition(raw["entry"], "entry"), _condition(raw["exit"], "exit"), None if filters is None else _condition(filters, "filters"), _holding(raw.get("holding"), where), direction)


def load_strategy(path: str | Path) -> StrategySpec:
    return parse_strategy(Path(path).read_text(encoding="utf-8"), str(path))


def load_features(path: str | Path) -> tuple[FeatureSpec, ...]:
    return _features(_document(Path(path).read_text(encoding="utf-8"), str(path)).get("features"), str(path))


@dataclass(frozen=True)
class PipelineConfiguration:
    instruments: tuple[Instrument, ...]
    start: datetime
    max_concurrency: int = 4
    check_days: int = 5
    tolerance: float = 0.01


def parse_pipeline(text: str, where: str = "pipeline") -> PipelineConfiguration:
    raw = _document(text, where)
    defaults, check = raw.get("defaults") or {}, raw.get("crosscheck") or {}
    market = defaults.get("market", "spot")
    instruments = tuple(Instrument(s["symbol"], Market(s.get("market", market)), Timeframe(t)) for s in raw.get("symbols") or () for t in s["timeframes"])
    if not instruments:
        raise ValueError(f"{where} names no instrument")
    start = datetime.fromisoformat(str(defaults["start"]))
    return PipelineConfiguration(instruments, start if start.tzinfo else start.replace(tzinfo=timezone.utc), int(defaults.get("max_concurrency", 4)), int(check.get("sample_days", 5)), float(check.get("tolerance", 0.01)))
