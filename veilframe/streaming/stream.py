"""The unattended lane: the same transformations on a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import type_of
from ..functions.spans import apply_replacements
from ..functions.sql import col, expr, struct, transform
from ..operators.anonymize import anonymize_docs
from ..operators.detect import with_spans
from ..operators.durable import remove_folder, stored
from ..operators.numbering import join_on, number_within
from ..operators.tables import ROW, row_mark


def anonymize_stream(docs: DataFrame, mode: str = "typed", **options) -> DataFrame:
    """Row-scope anonymization of a streaming DataFrame: stateless, any of the modes.

    The result is a streaming DataFrame with the columns of ``anonymize_docs``.
    """
    if not docs.isStreaming:
        raise ValueError("not a streaming DataFrame; use anonymize_docs")
    return anonymize_docs(docs, mode, **options)


def pseudonymize_batches(
    tokens_path: str,
    sink: Callable[[DataFrame, int], None],
    *,
    key: Sequence[str],
    scope: Sequence[str] = (),
    text: str = "text",
    rules=None,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps pseudonyms consistent over the whole stream.

    The tokens table at ``tokens_path`` only grows: a batch joins its distinct values to it,
    numbers the new ones after the highest number of their type and appends them, in a folder
    per batch. A batch that is run again overwrites its own folder and gets the same numbers
    for the same rows. Numbers follow arrival, so they can differ from a batch job's. What a batch
    keeps while it runs lies in ``{tokens_path}_work`` and is removed when its sink is done.
    """
    scopes, keys = list(scope), list(key)

    def run(batch: DataFrame, batch_id: int) -> None:
        work = f"{tokens_path}_work/batch={batch_id}"
        remove_folder(batch.sparkSession, work)  # of a run that was broken off
        try:
            rewrite(batch, batch_id, lambda df: stored(df, work))
        finally:
            remove_folder(batch.sparkSession, work)

    def rewrite(batch: DataFrame, batch_id: int, keep: Callable[[DataFrame], DataFrame]) -> None:
        spark = batch.sparkSession
        carried = [*dict.fromkeys([*scopes, *keys]), ROW]
        marked = batch.withColumn(ROW, expr(row_mark(f"array({col(text)})")))
        found = keep(with_spans(marked, text, "spans", rules=rules).select(*batch.columns, ROW, "spans"))
        each = transform(
            "spans", lambda s: struct(start=f"{s}.start", end=f"{s}.end", label=f"{s}.label", value=f"{s}.text")
        )
        spans = found.select(*carried, F.inline(expr(each)))
        first = F.min(F.struct(*keys, "start", "label")).alias("first")
        values = spans.groupBy(*scopes, "value").agg(first).select(
            *scopes, "value", expr(type_of("first.label")).alias("type"), F.struct("first.*").alias("at")
        )
        known = _known_tokens(spark, tokens_path, batch_id, values, scopes)
        fresh = join_on(values, known.select(*scopes, "value"), ["value"], "left_anti", scopes=scopes)
        numbered = number_within(fresh, [*scopes, "type"], ["at", "value"], keep=keep)
        last = known.groupBy(*scopes, "type").agg(F.max("n").alias("last"))
        offset = join_on(numbered, last, ["type"], "left", scopes=scopes).select(
            *scopes, "value", "type", (F.col("n") + F.coalesce("last", F.lit(0))).alias("n")
        )
        added = offset.withColumn("token", F.concat(F.lit("«"), "type", F.lit("_"), "n", F.lit("»")))
        added.write.mode("overwrite").parquet(f"{tokens_path}/batch={batch_id}")
        written = spark.read.schema(added.schema).parquet(f"{tokens_path}/batch={batch_id}")
        tokens = known.select(*scopes, "value", "token").unionByName(written.select(*scopes, "value", "token"))
        hits = (
            join_on(spans, tokens, ["value"], scopes=scopes)
            .groupBy(*carried)
            .agg(F.sort_array(F.collect_set(F.struct("start", "end", "token"))).alias("hits"))
        )
        joined = join_on(found, hits, [ROW], "left", scopes=carried[:-1]).select(*batch.columns, "hits")
        output = apply_replacements(col(text), "coalesce(hits, array())", lambda h, i: f"{h}.token")
        sink(joined.withColumn("output", expr(output)).drop("hits"), batch_id)

    return run


def _known_tokens(spark, path: str, batch_id: int, values: DataFrame, scopes: list[str]) -> DataFrame:
    """The tokens of earlier batches."""
    columns = [*[f"`{c}` {dict(values.dtypes)[c]}" for c in scopes], "value string", "type string", "n bigint", "token string"]
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    schema = ", ".join(columns)
    if not exists:
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    return stored.where(F.col("batch") < batch_id).drop("batch")

