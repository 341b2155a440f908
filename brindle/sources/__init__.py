"""Tables from files, rows and objects."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import asdict, fields, is_dataclass
from functools import partial
from typing import Any, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from brindle.catalog import Catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_SPARK = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType()}


def load_tables(spark: SparkSession, folder: str, names: Sequence[str] = TABLES[:8]) -> Catalog:
    """A catalog of a folder's Parquet tables, name.parquet each; a table is opened when a query names it."""
    return Catalog(spark).with_tables({n: partial(spark.read.parquet, f"{folder}/{n}.parquet") for n in names})


def from_rows(spark: SparkSession, rows: Iterable[Any], schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def from_objects(spark: SparkSession, objects: Iterable[Any], kind: type | None = None) -> DataFrame:
    """Objects of a dataclass, or with plain public attributes, a column each. kind: for no objects."""
    held = list(objects)
    kind = kind or type(held[0])
    if is_dataclass(kind):
        hints = get_type_hints(kind)
        schema = T.StructType([T.StructField(f.name, _SPARK.get(hints[f.name], T.StringType())) for f in fields(kind) if not f.name.startswith("_")])
        return spark.createDataFrame([tuple(asdict(o)[n] for n in schema.names) for o in held], schema)
    return spark.createDataFrame([{k: v for k, v in vars(o).items() if not k.startswith("_")} for o in held])


def from_pandas(spark: SparkSession, frames: dict[str, Any]) -> Catalog:
    """A catalog of in-memory tables by name."""
    return Catalog(spark).with_tables({name: spark.createDataFrame(frame) for name, frame in frames.items()})
