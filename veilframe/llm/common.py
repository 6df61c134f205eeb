"""What the operators of this package share: reading, batches of bytes, folds, kept tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.durable import durable, shared_folder

__all__ = ["shared_folder", "as_bytes", "concat_words", "documents", "durable", "fold_of", "give_back", "in_batches", "texts_of"]


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """The two columns the text operators read; whatever else a table holds stays behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fold_of(parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``; a null id is in no fold (null)."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text, null as empty, without decoding."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def in_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | T.StructType
) -> DataFrame:
    """``mapInArrow`` over whole texts. A task holds one Arrow batch at a time, and gives back its memory as it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Free memory goes back to the system: a worker outlives its task and would hold it beside the stages after it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def concat_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words of several texts in a row: the words, each word's text, each text's count.

    ``bytes.split`` separates exactly at U+0020 and U+0009 to U+000D.
    """
    words: list[bytes] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.split()
        sizes[i] = len(own)
        words += own
    return words, np.repeat(np.arange(len(texts)), sizes), sizes
