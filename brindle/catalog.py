"""What a query can refer to: tables, variables, functions, aggregates. Immutable; changes give a new catalog."""

from __future__ import annotations

import datetime as dt
import decimal
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from brindle.diagnostics import fail
from brindle.dialect import types as ty
from brindle.functions.aggregates import Aggregate
from brindle.functions.registry import Bound, Function


class Tables(Mapping[str, DataFrame]):
    """Tables by name; one given as a function is opened when it is first asked for."""

    def __init__(self, held: Mapping[str, DataFrame | Callable[[], DataFrame]]) -> None:
        self._held = dict(held._held if isinstance(held, Tables) else held)

    def __getitem__(self, name: str) -> DataFrame:
        if not isinstance(self._held[name], DataFrame):
            self._held[name] = self._held[name]()
        return self._held[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._held)

    def __len__(self) -> int:
        return len(self._held)

    def having(self, name: str, table: DataFrame | Callable[[], DataFrame]) -> Tables:
        return Tables({**self._held, name: table})

    def lacking(self, name: str) -> Tables:
        return Tables({k: v for k, v in self._held.items() if k != name})


@dataclass(frozen=True)
class ForeignKey:
    """Metadata for tools; queries do not need it."""

    parent: str
    parent_columns: tuple[str, ...]
    child: str
    child_columns: tuple[str, ...]

    def __post_init__(self) -> None:
        if len(self.parent_columns) != len(self.child_columns) or not self.parent_columns:
            raise ValueError("a relation needs as many parent columns as child columns")


def type_of_value(value: Any) -> str:
    kinds = ((bool, "bool"), (int, "int"), (float, "double"), (str, "string"), (decimal.Decimal, "decimal"), (dt.datetime, "datetime"), (bytes, "binary"))
    kind = next((k for t, k in kinds if isinstance(value, t)), None)
    if kind is None:
        raise TypeError(f"give the type of a variable with the value {value!r}")
    return "long" if kind == "int" and not -(2**31) <= value < 2**31 else kind


class Provider:
    """Properties and methods of a kind of types; a subclass gives those that it has."""

    def properties(self, kind: ty.Type) -> Mapping[str, tuple[str, str]]:
        """By name the result's type and Spark SQL with {0} for the value."""
        return {}

    def methods(self, kind: ty.Type) -> Mapping[str, tuple[tuple[str, ...], str, str]]:
        """By name the types of arguments, the result's type, and Spark SQL with {0} for the value and {1}, ... for them."""
        return {}


def _as_type(kind: ty.Type | T.DataType) -> ty.Type:
    return ty.of_spark(kind) if isinstance(kind, T.DataType) else kind


@dataclass(frozen=True)
class Catalog:
    spark: SparkSession
    tables: Mapping[str, DataFrame] = field(default_factory=lambda: Tables({}))
    variables: Mapping[str, tuple[str, Any]] = field(default_factory=dict)
    functions: Mapping[str, list[Function]] = field(default_factory=dict)
    aggregates: Mapping[str, Aggregate] = field(default_factory=dict)
    relations: tuple[ForeignKey, ...] = ()
    properties: Mapping[tuple[ty.Type, str], Function] = field(default_factory=dict)
    methods: Mapping[tuple[ty.Type, str], list[Function]] = field(default_factory=dict)
    #: By type, Spark SQL with {0} for the value, by which it is sorted and grouped.
    comparers: Mapping[ty.Type, str] = field(default_factory=dict)
    #: By sign, for operands of which one at least is of no built-in type; and by source type and target.
    operators: Mapping[str, list[Function]] = field(default_factory=dict)
    conversions: Mapping[tuple[ty.Type, str], list[str]] = field(default_factory=dict)
    providers: tuple[Provider, ...] = ()
    #: Names that several aggregates were given.
    twice: frozenset[str] = frozenset()
    _views: dict[str, str] = field(default_factory=dict, compare=False, repr=False)

    def with_table(self, name: str, df: DataFrame | Callable[[], DataFrame]) -> Catalog:
        return replace(self, tables=Tables(self.tables).having(name, df), _views={k: v for k, v in self._views.items() if k != name})

    def with_tables(self, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]) -> Catalog:
        out = self
        for name, df in tables.items():
            out = out.with_table(name, df)
        return out

    def without_table(self, name: str) -> Catalog:
        return replace(self, tables=Tables(self.tables).lacking(name), relations=tuple(r for r in self.relations if name not in (r.parent, r.child)), _views={})

    def with_variable(self, name: str, value: Any, kind: str | None = None) -> Catalog:
        kind = kind or type_of_value(value)
        if kind not in ty.SPARK:
            raise TypeError(f"there is no type {kind}")
        if value is not None and not ty.converts(type_of_value(value), kind) and not (kind in ty.NUMERIC and isinstance(value, int)):
            raise TypeError(f"{value!r} is no {kind}")
        return replace(self, variables={**self.variables, name: (kind, value)})

    def with_relation(self, relation: ForeignKey) -> Catalog:
        for name, columns in ((relation.parent, relation.parent_columns), (relation.child, relation.child_columns)):
            missing = [c for c in columns if name not in self.tables or c not in self.tables[name].columns]
            if missing:
                raise ValueError(f"{name} has no column {', '.join(missing)}")
        return replace(self, relations=(*self.relations, relation))

    def with_function(self, name: str, params: tuple[str, ...], result: str, body: str | Callable[..., Any]) -> Catalog:
        """body: Spark SQL with {0}, {1} for the arguments, or a function for pandas series, which becomes a vectorized UDF.

        Like the built-in functions it gives null if an argument is null.
        """
        key = name.upper()
        if isinstance(body, str):
            made = Function(params, result, lambda args: body.format(*(a.sql for a in args)))
        else:
            from pyspark.sql.functions import pandas_udf

            registered = f"brindle_{name.lower()}_{uuid.uuid4().hex[:8]}"
            self.spark.udf.register(registered, pandas_udf(body, returnType=ty.SPARK[result]))

            def build(args: list[Bound]) -> str:
                call = f"{registered}({', '.join(a.sql for a in args)})"
                return f"(CASE WHEN {' OR '.join(f'{a.sql} IS NULL' for a in args)} THEN NULL ELSE {call} END)" if args else call

            made = Function(params, result, build)
        return replace(self, functions={**self.functions, key: [*self.functions.get(key, []), made]})

    def with_aggregate(self, name: str, result: str, body: str | Callable[..., Any]) -> Catalog:
        """body: Spark SQL with {0} for the argument, or a function from a pandas series to a value."""
        if isinstance(body, str):
            made = Aggregate(lambda t: result, lambda x, strict: body.format(x.sql))
        else:
            from pyspark.sql.functions import PandasUDFType, pandas_udf

            registered = f"brindle_{name.lower()}_{uuid.uuid4().hex[:8]}"
            self.spark.udf.register(registered, pandas_udf(body, ty.SPARK[result], PandasUDFType.GROUPED_AGG))
            made = Aggregate(lambda t: result, lambda x, strict: f"{registered}({x.sql})")
        again = {name.upper()} & set(self.aggregates)
        return replace(self, aggregates={**self.aggregates, name.upper(): made}, twice=self.twice | again)

    def with_property(self, kind: ty.Type, name: str, result: str, body: str) -> Catalog:
        made = Function((kind,), result, lambda args: body.format(args[0].sql))
        return replace(self, properties={**self.properties, (kind, name.upper()): made})

    def with_method(self, kind: ty.Type, name: str, params: tuple[str, ...], result: str, body: str) -> Catalog:
        made = Function((kind, *params), result, lambda args: body.format(*(a.sql for a in args)))
        key = (kind, name.upper())
        return replace(self, methods={**self.methods, key: [*self.methods.get(key, []), made]})

    def with_comparer(self, kind: ty.Type, form: str) -> Catalog:
        return replace(self, comparers={**self.comparers, kind: form})

    def with_operator(self, sign: str, operands: Sequence[ty.Type | T.DataType], result: ty.Type | T.DataType, body: str) -> Catalog:
        """One or two operands; it is looked for where one is of no built-in type. body: Spark SQL with {0}, {1}."""
        made = Function(tuple(map(_as_type, operands)), _as_type(result), lambda args: body.format(*(a.sql for a in args)))
        return replace(self, operators={**self.operators, sign.upper(): [*self.operators.get(sign.upper(), []), made]})

    def with_conversion(self, source: ty.Type | T.DataType, target: str, body: str) -> Catalog:
        """How CAST turns values of a type that is not built in into one that is. body: Spark SQL with {0}."""
        key = (_as_type(source), target)
        return replace(self, conversions={**self.conversions, key: [*self.conversions.get(key, []), body]})

    def with_provider(self, provider: Provider) -> Catalog:
        return replace(self, providers=(*self.providers, provider))

    def property_of(self, kind: ty.Type, name: str) -> Function | None:
        for provider in self.providers:
            for own, (result, body) in provider.properties(kind).items():
                if own.upper() == name:
                    return Function((kind,), result, lambda args, body=body: body.format(args[0].sql))
        return self.properties.get((kind, name))

    def methods_of(self, kind: ty.Type, name: str) -> list[Function]:
        found = [
            Function((kind, *params), result, lambda args, body=body: body.format(*(a.sql for a in args)))
            for provider in self.providers for own, (params, result, body) in provider.methods(kind).items() if own.upper() == name
        ]
        return found + list(self.methods.get((kind, name), []))

    def _without(self, of: str, *keys: Any) -> Catalog:
        held = getattr(self, of)
        if missing := [k for k in keys if k not in held]:
            raise KeyError(missing[0])
        return replace(self, **{of: {k: v for k, v in held.items() if k not in keys}})

    def without_variable(self, name: str) -> Catalog:
        return self._without("variables", name)

    def without_function(self, name: str) -> Catalog:
        return self._without("functions", name.upper())

    def without_aggregate(self, name: str) -> Catalog:
        return replace(self._without("aggregates", name.upper()), twice=self.twice - {name.upper()})

    def without_property(self, kind: ty.Type, name: str) -> Catalog:
        return self._without("properties", (kind, name.upper()))

    def without_method(self, kind: ty.Type, name: str) -> Catalog:
        return self._without("methods", (kind, name.upper()))

    def without_comparer(self, kind: ty.Type) -> Catalog:
        return self._without("comparers", kind)

    def without_operator(self, sign: str) -> Catalog:
        return self._without("operators", sign.upper())

    def without_relation(self, relation: ForeignKey) -> Catalog:
        return replace(self, relations=tuple(r for r in self.relations if r != relation))

    def without_provider(self, provider: Provider) -> Catalog:
        return replace(self, providers=tuple(p for p in self.providers if p is not provider))

    def close(self) -> None:
        """Drops the temporary views that queries of this catalog were given."""
        for view in self._views.values():
            self.spark.catalog.dropTempView(view)
        self._views.clear()

    def sort_form(self, kind: ty.Type) -> str:
        return self.comparers.get(kind, "{0}")

    def view(self, name: str) -> tuple[str, T.StructType]:
        """A temporary view of a table under a name of its own, and its schema."""
        df = self.tables.get(name)
        if df is None:
            raise fail("UndeclaredTable", f"there is no table {name}")
        if name not in self._views:
            self._views[name] = f"brindle_{uuid.uuid4().hex}"
            df.createOrReplaceTempView(self._views[name])
        return self._views[name], df.schema
