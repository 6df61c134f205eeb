"""Reading documents, tables and rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.python_side import csv_width, same_json
from .formats import admit


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """One row (path, text) per file; a match may span lines, so files are not split."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def read_files(spark: SparkSession, path: str, *, glob: str | None = None) -> DataFrame:
    """One row (path, content) per file, bytes as they are."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content")


@dataclass(frozen=True)
class Read:
    """Rows that could be read, and those that could not, in a table of their own.

    ``rejected`` holds raw text: it has to be kept as carefully as the source.
    """

    rows: DataFrame
    rejected: DataFrame


def read_checked_docs(spark: SparkSession, path: str, *, max_chars: int | None = None) -> Read:
    """``read_text_docs`` for files that may be no text: those that are not UTF-8, or longer than ``max_chars``, are rejected.

    Rejected rows are (path, content, reason), the bytes as they are. The reader keeps bytes that it cannot
    decode, so the check sees them; a detector would take them for other characters and could miss what is beside them.
    """
    docs = read_text_docs(spark, path)
    checked = admit(docs.withColumn("content", F.col("text").cast("binary")), "content", max_chars=max_chars)
    bad = checked.where(F.col("reason").isNotNull())
    return Read(checked.where(F.col("reason").isNull()).select("path", "text"), bad.select("path", "content", "reason"))


def read_csv_table(spark: SparkSession, path: str, width: int) -> Read:
    """A CSV table of strings c0..c{width-1} with ``path`` and ``row``; the header is a row like others.

    Give the width of the widest row: shorter rows are padded with null, wider ones are rejected. Empty
    cells read as null and are written as empty again. ``path`` and ``row`` (the order within the
    file) are a unique key: a file is read whole by one task, so that its rows can be numbered
    as they come. ``anonymize_table(..., scope=["path"], order_by=["path", "row"])`` then has one state per
    file. Files that must keep ragged rows go through ``anonymize_files``.
    """
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(width)]
    schema = T.StructType([*fields, T.StructField("_corrupt", T.StringType())])
    cells = spark.read.csv(
        path,
        schema=schema,
        header=False,
        multiLine=True,  # also: files are not split
        escape='"',
        columnNameOfCorruptRecord="_corrupt",
        mode="PERMISSIVE",
    )
    # ascending within a partition, and a file is in one partition only
    cells = cells.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("row"), *cells.columns)
    # the reader marks shorter rows as well; only wider ones have cells without a column
    wide = cells.withColumn("cells", F.when(F.col("_corrupt").isNotNull(), csv_width(F.col("_corrupt"))))
    # Spark does not read the column of corrupt records alone, so the test names another one
    lost = F.coalesce((F.col("cells") > width) & (F.col("c0").isNotNull() | (F.length("_corrupt") >= 0)), F.lit(False))
    rows = wide.where(~lost).drop("_corrupt", "cells")
    return Read(rows, wide.where(lost).select("path", "row", F.col("_corrupt").alias("raw")))


def read_json_docs(spark: SparkSession, path: str, schema: str | T.StructType) -> Read:
    """JSON lines parsed with an explicit schema, which fixes the order of the keys; the column is ``value``.

    Inference would sort keys and turn mixed arrays into strings. A line is rejected if it is no JSON
    or if the schema does not hold all of it: keys it does not name, values of another type.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    parsed = lines.select("path", "raw", F.from_json("raw", schema).alias("value"))
    # equal texts say the same; only the others are compared in Python. The generator keeps the text from being made again
    parsed = parsed.select("*", F.explode_outer(F.array(json_text("value"))).alias("again"))
    differ = ~F.col("raw").eqNullSafe(F.col("again")) | F.col("raw").isNull()
    compared = same_json(F.when(differ, F.col("raw")), F.when(differ, F.col("again")))
    parsed = parsed.withColumn("whole", ~differ | compared)
    return Read(
        parsed.where("whole").select("path", "value"),
        parsed.where(~F.col("whole") & (F.trim("raw") != "")).select("path", "raw"),
    )


def json_text(value: str | Column) -> Column:
    """JSON of a value, nulls included."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def spread(df: DataFrame, partitions: int | None, *key: str) -> DataFrame:
    """``df`` dealt over so many partitions, unchanged where none are given.

    For inputs that arrive as one row group and would run in one task; it moves all rows, so
    inputs of any size leave it out.
    """
    return df if partitions is None else df.repartition(partitions, *key)
