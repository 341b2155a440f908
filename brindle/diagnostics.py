"""What the front-end reports about a query, and the errors it raises.

The ids of diagnostics are fixed values: the dialect's public names for them.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Diagnostic:
    """id: a stable name; message: for people; position: of the offending token in the text."""

    id: str
    message: str
    position: int = 0


class QueryError(ValueError):
    """A query that cannot be compiled."""

    def __init__(self, diagnostics: list[Diagnostic]) -> None:
        self.diagnostics = diagnostics
        super().__init__("; ".join(f"{d.id} at {d.position}: {d.message}" for d in diagnostics))


def fail(id: str, message: str, position: int = 0) -> QueryError:  # noqa: A002
    return QueryError([Diagnostic(id, message, position)])
