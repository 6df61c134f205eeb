"""Keeping results from being computed more than once: within a plan and across jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sql import Sql, expr

SENT = 8 << 20  # the driver holds what is sent several times over: rows, their hash table, its blocks


def hold(df: DataFrame, **columns: Sql) -> DataFrame:
    """Add costly columns in a way that the optimizer does not copy them.

    A filter on a projected column is pushed below the projection with the column's whole
    expression in it, so the expression runs twice, or many times over a chain of columns. A
    filter does not pass the generator it reads from, while one on other columns still does.
    """
    for name, sql in columns.items():
        df = df.select("*", F.explode_outer(F.array(expr(sql))).alias(name))
    return df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see, under ``spark.checkpoint.dir``; elsewhere only for a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="veilframe-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as a new table in ``folder``, which the caller removes."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_apart(df: DataFrame, mark: str) -> tuple[DataFrame, DataFrame]:
    """Rows where the column ``mark`` is true and all others, as two parts of one table that is written in one pass.

    Neither part needs a shuffle to be told from the other. Like a checkpoint the table lies in the folder the
    cluster names, and stays as long as its readers may need it.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "apart")
    df.withColumn(mark, F.coalesce(mark, F.lit(False))).write.partitionBy(mark).parquet(path)
    columns = [c for c in df.columns if c != mark]
    schema = T.StructType([df.schema[c] for c in columns])
    schema = T.StructType([*schema.fields, T.StructField(mark, T.BooleanType())])
    table = spark.read.schema(schema).parquet(path)
    part = lambda test: table.where(test).drop(mark)
    return part(F.col(mark)), part(~F.col(mark))


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the folder the cluster names.

    What is written survives the loss of executors, and its rows and partition numbers are
    fixed from here on. A folder of our own is only made for a local session without one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="veilframe-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def sent_or_shuffled(df: DataFrame, *strings: Sql, limit: int = SENT) -> DataFrame:
    """``df``, a table that is written already, with the hint to send it to all tasks where it measures ``limit`` bytes at most, else to shuffle it.

    Without the second hint adaptive execution would still send it where its shuffle files, which are compressed, are small.
    """
    size = " + ".join(["64", *strings])
    measured = df.agg(expr(f"coalesce(sum({size}), 0)").alias("bytes")).first()["bytes"]
    return F.broadcast(df) if measured <= limit else df.hint("merge")
