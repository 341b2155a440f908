"""Queries and expressions of the dialect, ready to run."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T

from brindle.catalog import Catalog
from brindle.diagnostics import Diagnostic, QueryError, fail
from brindle.dialect import syntax, types
from brindle.dialect.binder import Binder, Relation, Scope
from brindle.dialect.parser import parse_expression, parse_query
from brindle.operators.relational import lift_row_limit
from brindle.reader import TypedReader


def output_names(names: list[str]) -> list[str]:
    """Names for a table of results: "Column" for those without one, numbered where they repeat."""
    out: list[str] = []
    for name in names:
        base = name or "Column"
        n, free = 0, base
        while free.lower() in (o.lower() for o in out):
            n += 1
            free = f"{base}{n}"
        out.append(free)
    return out


class Query:
    """text is compiled when it is first needed; strict: see README."""

    def __init__(self, catalog: Catalog, text: str, strict: bool = False) -> None:
        self.catalog, self.text, self.strict = catalog, text, strict

    @cached_property
    def _bound(self) -> tuple[Relation, Binder]:
        binder = Binder(self.catalog, self.strict)
        return binder.root(parse_query(self.text)), binder

    def diagnostics(self) -> list[Diagnostic]:
        try:
            _ = self._bound
        except QueryError as e:
            return e.diagnostics
        return []

    def sql(self) -> str:
        """The Spark SQL that the text was lowered to."""
        return self._bound[0].sql

    def columns(self) -> list[tuple[str, Any]]:
        """Names and dialect types of the result."""
        return [(c.name, c.type) for c in self._bound[0].columns]

    def dataframe(self) -> DataFrame:
        relation, binder = self._bound
        spark = self.catalog.spark
        for name in (u for u in binder.udfs if u in relation.sql):
            from brindle.functions.python import register

            register(spark, name)
        if binder.recursive:
            lift_row_limit(spark)
        args = {v: self.catalog.variables[v][1] for v in binder.variables}
        df = spark.sql(relation.sql, args=args) if args else spark.sql(relation.sql)
        return df.select() if not relation.columns else df.toDF(*output_names([c.name for c in relation.columns]))

    def reader(self) -> Iterator[Row]:
        return self.dataframe().toLocalIterator()

    def typed_reader(self) -> TypedReader:
        return TypedReader(self.dataframe())

    def schema(self) -> T.StructType:
        return self.dataframe().schema

    def schema_reader(self) -> DataFrame:
        return self.dataframe().limit(0)

    def scalar(self) -> Any:
        """The first column of the first row; None if there is none."""
        row = self.dataframe().first()
        return row[0] if row else None

    def table(self):  # noqa: ANN201
        """The result as an Arrow table, in this process."""
        return self.dataframe().toArrow()

    def dynamic_rows(self) -> Iterator[DynamicRow]:
        return map(DynamicRow, self.reader())


class DynamicRow:
    """A row whose columns are attributes, in any case."""

    def __init__(self, row: Row) -> None:
        self._row = {k.lower(): v for k, v in row.asDict().items()}

    def __getattr__(self, name: str) -> Any:
        try:
            return self._row[name.lower()]
        except KeyError:
            raise AttributeError(name) from None

    def __getitem__(self, name: str) -> Any:
        return self._row[name.lower()]


class Expression:
    """A single expression, without tables; target: the type its value must convert to; default: in place of null."""

    def __init__(self, catalog: Catalog, text: str, target: str | None = None, default: Any = None, strict: bool = False) -> None:
        self.catalog, self.text, self.target, self.default, self.strict = catalog, text, target, default, strict

    @cached_property
    def _query(self) -> Query:
        node = parse_expression(self.text)
        query = Query(self.catalog, "", self.strict)
        binder = Binder(self.catalog, self.strict)
        bound = binder.expr(node, Scope(place="AggregateInvalidInCurrentContext"))
        if self.target is not None and not types.converts(bound.type, self.target):
            raise fail("CannotConvert", f"{types.shown(bound.type)} cannot be converted to {self.target}")
        relation = binder.root(syntax.Root(0, [], syntax.Select(0, False, None, False, [syntax.Item(0, node, syntax.Name(0, "value"))], None, None, None, None)))
        query.__dict__["_bound"] = (relation, binder)
        return query

    @property
    def type(self) -> Any:
        return self._query.columns()[0][1]

    def evaluate(self) -> Any:
        value = self._query.scalar()
        return self.default if value is None else value
