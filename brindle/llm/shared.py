"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where spark.checkpoint.dir is unset on a single machine (local
    master: tests) a folder of this machine is made and set; on a cluster each
    executor would write to its own disk, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/brindle/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again.

    This cuts the lineage; unlike localCheckpoint it survives lost executors,
    and unlike checkpoint() it computes the input once.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes the files of tables made by written(), once nothing reads them any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def row_key(df: DataFrame) -> Column:
    """A hash of all columns of a row; equal rows have equal keys."""
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}), 256)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_totals(values: Column, chunk: int = 256) -> Column:
    """Running totals of an array, by JVM expressions.

    Appending to an array copies it, so arrays are cut into chunks: the work
    is n * chunk rather than n * n.
    """
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def plain(xs: Column) -> Column:
        return F.aggregate(xs, none, lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), zero) + v)))

    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / chunk).cast("int")),
        lambda k: F.slice(values, k * chunk + 1, F.lit(chunk)),
    )
    ends = plain(F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, v: a + v)))
    before = F.concat(F.array(zero), ends)
    long = F.flatten(F.transform(F.arrays_zip(parts.alias("part"), F.slice(before, 1, F.size(parts)).alias("base")), lambda z: F.transform(plain(z["part"]), lambda v: v + z["base"])))
    return F.when(F.size(values) == 0, none).when(F.size(values) <= chunk, plain(values)).otherwise(long)
