"""Condition trees: driver-side nodes that become Boolean columns.

A missing value makes a leaf false, inside every node, so ``not`` of a missing
value is true.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from ..functions.indicators import crosses
from ..functions.windows import last_rows, ordered
from ..model import Comparison, ConditionSpec, CrossDirection
from .parameters import Parameters

MAX_DEPTH = 12


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def compare(left: Column, how: Comparison, right: Column) -> Column:
    return _sure({"above": left > right, "below": left < right, "at_least": left >= right, "at_most": left <= right}[how.value])


@dataclass(frozen=True)
class Condition:
    """Base of all nodes; ``&``, ``|`` and ``~`` combine them."""

    @property
    def required(self) -> frozenset[str]:
        return frozenset().union(*(c.required for c in self.children))

    @property
    def warmup(self) -> int:
        return max((c.warmup for c in self.children), default=0)

    @property
    def children(self) -> tuple[Condition, ...]:
        return ()

    def column(self, w: WindowSpec) -> Column:
        raise NotImplementedError

    def describe(self) -> str:
        raise NotImplementedError

    def evaluate(self, df: DataFrame, w: WindowSpec | None = None) -> Column:
        lacking = sorted(self.required - set(df.columns))
        if lacking:
            raise ValueError(f"the table lacks columns that a condition needs: {lacking}")
        return self.column(w or ordered())

    def __and__(self, other: Condition) -> Condition:
        return All.of(self, other)

    def __or__(self, other: Condition) -> Condition:
        return AnyOf.of(self, other)

    def __invert__(self) -> Condition:
        return Not(self)


@dataclass(frozen=True)
class Threshold(Condition):
    feature: str
    comparison: Comparison
    value: float

    @property
    def required(self) -> frozenset[str]:
        return frozenset([self.feature])

    def column(self, w):
        return compare(F.col(self.feature), self.comparison, F.lit(float(self.value)))

    def describe(self):
        return f"{self.feature} {self.comparison.symbol} {self.value:g}"


@dataclass(frozen=True)
class Compare(Condition):
    left: str
    comparison: Comparison
    right: str

    @property
    def required(self):
        return frozenset([self.left, self.right])

    def column(self, w):
        return compare(F.col(self.left), self.comparison, F.col(self.right))

    def describe(self):
        return f"{self.left} {self.comparison.symbol} {self.right}"


@dataclass(frozen=True)
class Range(Condition):
    feature: str
    lower: float
    upper: float

    def __post_init__(self):
        if self.lower > self.upper:
            raise ValueError("a range's lower end can't exceed its upper end")

    @property
    def required(self):
        return frozenset([self.feature])

    def column(self, w):
        return _sure(F.col(self.feature).between(float(self.lower), float(self.upper)))

    def describe(self):
        return f"{self.lower:g} <= {self.feature} <= {self.upper:g}"


@dataclass(frozen=True)
class Event(Condition):
    feature: str

    @property
    def required(self):
        return frozenset([self.feature])

    def column(self, w):
        return _sure(F.col(self.feature) != 0)

    def describe(self):
        return f"event {self.feature}"


@dataclass(frozen=True)
class Crossover(Condition):
    fast: str
    direction: CrossDirection
    slow: str

    @property
    def required(self):
        return frozenset([self.fast, self.slow])

    @property
    def warmup(self):
        return 1

    def column(self, w):
        golden, death = crosses(F.col(self.fast), F.col(self.slow), w)
        return golden if self.direction == CrossDirection.UP else death

    def describe(self):
        return f"{self.fast} crosses {self.direction} {self.slow}"


@dataclass(frozen=True)
class Constant(Condition):
    value: bool

    def column(self, w):
        return F.lit(self.value)

    def describe(self):
        return "always" if self.value else "never"


@dataclass(frozen=True)
class _Many(Condition):
    parts: tuple[Condition, ...]

    @classmethod
    def of(cls, *parts: Condition):
        """Nested nodes of the same kind become one."""
        if not parts:
            raise ValueError("at least one condition is needed")
        return cls(tuple(p for part in parts for p in (part.parts if type(part) is cls else (part,))))

    @property
    def children(self):
        return self.parts


class All(_Many):
    def column(self, w):
        return reduce(and_, [p.column(w) for p in self.parts])

    def describe(self):
        return "(" + " and ".join(p.describe() for p in self.parts) + ")"


class AnyOf(_Many):
    def column(self, w):
        return reduce(or_, [p.column(w) for p in self.parts])

    def describe(self):
        return "(" + " or ".join(p.describe() for p in self.parts) + ")"


@dataclass(frozen=True)
class Not(Condition):
    part: Condition

    @property
    def children(self):
        return (self.part,)

    def column(self, w):
        return ~self.part.column(w)

    def describe(self):
        return f"not {self.part.describe()}"


@dataclass(frozen=True)
class Sustained(Condition):
    """True where its child was true on each of the last ``bars`` bars."""

    part: Condition
    bars: int

    def __post_init__(self):
        if self.bars < 2:
            raise ValueError("bars must be at least 2")

    @property
    def children(self):
        return (self.part,)

    @property
    def warmup(self):
        return self.part.warmup + self.bars - 1

    def column(self, w):
        return F.sum(self.part.column(w).cast("int")).over(last_rows(w, self.bars)) == self.bars

    def describe(self):
        return f"{self.part.describe()} for {self.bars} bars"


Builder = Callable[[Parameters, tuple[Condition, ...]], Condition]


def _leaf(make: Callable[[Parameters], Condition]) -> Builder:
    def build(p: Parameters, children: tuple[Condition, ...]) -> Condition:
        if children:
            raise ValueError("this kind takes no children")
        return make(p)

    return build


def _one(p: Parameters, children: tuple[Condition, ...]) -> Condition:
    if len(children) != 1:
        raise ValueError("exactly one child is needed")
    return children[0]


#: kind -> builder; extend by adding an entry.
CONDITIONS: dict[str, Builder] = {
    "threshold": _leaf(lambda p: Threshold(p.text("feature"), p.choice("comparison", Comparison), p.number("value"))),
    "compare": _leaf(lambda p: Compare(p.text("left"), p.choice("comparison", Comparison), p.text("right"))),
    "crossover": _leaf(lambda p: Crossover(p.text("fast"), p.choice("direction", CrossDirection), p.text("slow"))),
    "range": _leaf(lambda p: Range(p.text("feature"), p.number("lower"), p.number("upper"))),
    "event": _leaf(lambda p: Event(p.text("feature"))),
    "always": _leaf(lambda p: Constant(True)),
    "never": _leaf(lambda p: Constant(False)),
    "all": lambda p, c: All.of(*c),
    "any": lambda p, c: AnyOf.of(*c),
    "not": lambda p, c: Not(_one(p, c)),
    "sustained": lambda p, c: Sustained(_one(p, c), p.integer("bars")),
}


def build_condition(spec: ConditionSpec, registry: Mapping[str, Builder] = CONDITIONS, depth: int = 1) -> Condition:
    if depth > MAX_DEPTH:
        raise ValueError(f"a condition tree may be {MAX_DEPTH} levels deep")
    if spec.kind not in registry:
        raise ValueError(f"unknown condition {spec.kind!r}; known: {sorted(registry)}")
    p = Parameters(spec.kind, spec.parameters)
    out = registry[spec.kind](p, tuple(build_condition(c, registry, depth + 1) for c in spec.children))
    p.ensure_used()
    return out
