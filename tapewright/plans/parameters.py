"""A specification's parameters, read with types; what nobody reads is an error."""

from __future__ import annotations

from collections.abc import Mapping
from enum import StrEnum
from typing import TypeVar

from ..model import Scalar

E = TypeVar("E", bound=StrEnum)
_NEEDED = object()


class Parameters:
    def __init__(self, owner: str, values: Mapping[str, Scalar]):
        self.owner, self.values, self.read = owner, dict(values), set()

    def _get(self, key: str, default: object) -> object:
        self.read.add(key)
        if key in self.values:
            return self.values[key]
        if default is _NEEDED:
            raise ValueError(f"{self.owner} needs {key}")
        return default

    def integer(self, key: str, default: object = _NEEDED, least: int | None = None) -> int:
        x = self._get(key, default)
        if isinstance(x, bool) or not isinstance(x, int):
            raise ValueError(f"{self.owner}: {key} must be an integer, not {x!r}")
        if least is not None and x < least:
            raise ValueError(f"{self.owner}: {key} must be at least {least}")
        return x

    def number(self, key: str, default: object = _NEEDED) -> float:
        x = self._get(key, default)
        if isinstance(x, bool) or not isinstance(x, (int, float)):
            raise ValueError(f"{self.owner}: {key} must be a number, not {x!r}")
        return float(x)

    def text(self, key: str, default: object = _NEEDED) -> str:
        x = self._get(key, default)
        if not isinstance(x, str):
            raise ValueError(f"{self.owner}: {key} must be a string, not {x!r}")
        return x

    def choice(self, key: str, kind: type[E], default: object = _NEEDED) -> E:
        x = self.text(key, default)
        try:
            return kind(x)
        except ValueError:
            raise ValueError(f"{self.owner}: {key} must be one of {[m.value for m in kind]}, not {x!r}") from None

    def ensure_used(self) -> None:
        extra = sorted(set(self.values) - self.read)
        if extra:
            raise ValueError(f"{self.owner} doesn't know {extra}")
