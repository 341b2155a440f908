"""Overloads and how one is chosen."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from brindle.dialect.types import IMPLICIT, Type, converts


@dataclass(frozen=True)
class Bound:
    """An expression with its type; value: of a literal; columns: the table columns it needs outside of aggregates."""

    sql: str
    type: Type
    value: Any = None
    literal: bool = False
    columns: tuple[str, ...] = ()
    aggregate: bool = False


@dataclass(frozen=True)
class Function:
    """params: types ("any" takes all); result: a type, or what gives it from the arguments; udf: a Python function's name that it needs."""

    params: tuple[Type, ...]
    result: Type | Callable[[Sequence[Bound]], Type]
    build: Callable[..., str]
    udf: str | None = None

    def type_of(self, args: Sequence[Bound]) -> Type:
        return self.result(args) if callable(self.result) else self.result


def _cost(source: Type, target: Type) -> int | None:
    """How far a conversion goes; None: there is none."""
    if target == "any":
        return 50
    if source == target:
        return 0
    if not converts(source, target):
        return None
    # Of two wider types the one that converts to the other is nearer.
    return 1 + len(IMPLICIT.get(source, ())) - len(IMPLICIT.get(target, ())) if target in IMPLICIT else 20


def resolve(overloads: Sequence[Function], kinds: Sequence[Type]) -> tuple[Function | None, str]:
    """The overload for argument types; if there is none why: "none" or "ambiguous"."""
    fits = []
    for f in overloads:
        costs = [_cost(k, p) for k, p in zip(kinds, f.params, strict=True)] if len(kinds) == len(f.params) else [None]
        if all(c is not None for c in costs):
            fits.append((costs, f))
    if not fits:
        return None, "none"
    best = [(c, f) for c, f in fits if all(all(x <= y for x, y in zip(c, d, strict=True)) for d, _ in fits)]
    if len(best) == 1 or (best and "null" in kinds):
        return best[0][1], ""
    return (None, "ambiguous") if len(best) != 1 else (best[0][1], "")
