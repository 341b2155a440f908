"""The tree of a query. at: where a node starts in the text."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Node:
    at: int


# Expressions


@dataclass
class Literal(Node):
    value: Any


@dataclass
class Name(Node):
    text: str
    exact: bool = False


@dataclass
class Member(Node):
    """target.name, or target.name(args)."""

    target: Node
    name: Name
    args: list[Node] | None = None


@dataclass
class Variable(Node):
    name: str


@dataclass
class Call(Node):
    """args is None for f(*)."""

    name: Name
    args: list[Node] | None


@dataclass
class Unary(Node):
    op: str
    operand: Node


@dataclass
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass
class Between(Node):
    operand: Node
    low: Node
    high: Node
    negated: bool


@dataclass
class In(Node):
    """choices: a list of expressions, or a query."""

    operand: Node
    choices: Any
    negated: bool


@dataclass
class IsNull(Node):
    operand: Node
    negated: bool


@dataclass
class Case(Node):
    subject: Node | None
    branches: list[tuple[Node, Node]]
    default: Node | None


@dataclass
class Coalesce(Node):
    args: list[Node]


@dataclass
class NullIf(Node):
    left: Node
    right: Node


@dataclass
class Cast(Node):
    operand: Node
    type_name: str


@dataclass
class Exists(Node):
    query: Node


@dataclass
class Scalar(Node):
    query: Node


@dataclass
class Quantified(Node):
    """operand op ANY/SOME/ALL (query)."""

    op: str
    operand: Node
    every: bool
    query: Node


# Tables


@dataclass
class TableName(Node):
    name: Name
    alias: Name | None


@dataclass
class Derived(Node):
    query: Node
    alias: Name


@dataclass
class Join(Node):
    """kind: CROSS, INNER, LEFT, RIGHT or FULL."""

    kind: str
    left: Node
    right: Node
    on: Node | None


# Queries


@dataclass
class Item(Node):
    """expr is None for *; table: of t.*."""

    expr: Node | None
    alias: Name | None = None
    table: Name | None = None


@dataclass
class OrderItem(Node):
    expr: Node
    descending: bool


@dataclass
class Select(Node):
    distinct: bool
    top: int | None
    ties: bool
    items: list[Item]
    tables: Node | None
    where: Node | None
    groups: list[Node] | None
    having: Node | None


@dataclass
class SetOp(Node):
    """kind: UNION, UNION ALL, INTERSECT or EXCEPT."""

    kind: str
    left: Node
    right: Node


@dataclass
class Ordered(Node):
    query: Node
    order: list[OrderItem]


@dataclass
class Cte(Node):
    name: Name
    columns: list[Name] | None
    query: Node


@dataclass
class Root(Node):
    """query is None for an empty text."""

    ctes: list[Cte] = field(default_factory=list)
    query: Node | None = None
