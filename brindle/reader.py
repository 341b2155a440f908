"""Rows one after another, their values by getters that check the type."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame


def _integer(low: int, high: int) -> Callable[[Any], int]:
    def checked(value: Any) -> int:
        if isinstance(value, bool) or int(value) != value or not low <= value <= high:
            raise TypeError(f"{value!r} is no whole number from {low} to {high}")
        return int(value)

    return checked


def _of(*kinds: type) -> Callable[[Any], Any]:
    def checked(value: Any) -> Any:
        if not isinstance(value, kinds) or (isinstance(value, bool) and bool not in kinds):
            raise TypeError(f"{value!r} is no {kinds[0].__name__}")
        return value

    return checked


class TypedReader:
    """read() moves to the next row, if there is one; the getters take a column's place or name."""

    def __init__(self, df: DataFrame) -> None:
        self.schema, self._rows, self._row, self.closed = df.schema, df.toLocalIterator(), None, False

    def read(self) -> bool:
        self._row = None if self.closed else next(self._rows, None)
        return self._row is not None

    def close(self) -> None:
        self._row, self.closed = None, True

    def __enter__(self) -> TypedReader:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @property
    def field_count(self) -> int:
        return len(self.schema)

    def name(self, place: int) -> str:
        return self.schema[place].name

    def type_name(self, place: int) -> str:
        return self.schema[place].dataType.simpleString()

    def ordinal(self, name: str) -> int:
        """Of a column; a name in the same case comes first."""
        names = self.schema.names
        if name in names:
            return names.index(name)
        folded = [n.lower() for n in names]
        if name.lower() not in folded:
            raise IndexError(f"there is no column {name}")
        return folded.index(name.lower())

    def value(self, column: int | str) -> Any:
        if self._row is None:
            raise RuntimeError("there is no row")
        return self._row[self.ordinal(column) if isinstance(column, str) else column]

    __getitem__ = value

    def values(self) -> list[Any]:
        return [self.value(i) for i in range(self.field_count)]

    def is_null(self, column: int | str) -> bool:
        return self.value(column) is None

    def _got(self, column: int | str, checked: Callable[[Any], Any]) -> Any:
        value = self.value(column)
        if value is None:
            raise TypeError(f"{column} is null")
        return checked(value)

    def boolean(self, column: int | str) -> bool:
        return self._got(column, _of(bool))

    def byte(self, column: int | str) -> int:
        return self._got(column, _integer(0, 255))

    def int16(self, column: int | str) -> int:
        return self._got(column, _integer(-(2**15), 2**15 - 1))

    def int32(self, column: int | str) -> int:
        return self._got(column, _integer(-(2**31), 2**31 - 1))

    def int64(self, column: int | str) -> int:
        return self._got(column, _integer(-(2**63), 2**63 - 1))

    def double(self, column: int | str) -> float:
        return self._got(column, _of(float))

    single = double

    def decimal(self, column: int | str) -> decimal.Decimal:
        return self._got(column, _of(decimal.Decimal))

    def string(self, column: int | str) -> str:
        return self._got(column, _of(str))

    def char(self, column: int | str) -> str:
        value = self.string(column)
        if len(value) != 1:
            raise TypeError(f"{value!r} is no single character")
        return value

    def datetime(self, column: int | str) -> dt.datetime:
        return self._got(column, _of(dt.datetime))

    def blob(self, column: int | str, offset: int = 0, length: int | None = None) -> bytes:
        return bytes(self._got(column, _of(bytes, bytearray)))[offset : None if length is None else offset + length]
