"""Writing results: data, reversal map and summary go to separate places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import remove_folder, stored
from ..operators.tables import Anonymized
from .files import Files


def _inside(path: str, folder: str) -> bool:
    """Whether ``path`` is ``folder`` or lies in it, by whole path segments."""
    mine, theirs = ([part for part in x.split("/") if part not in ("", ".")] for x in (path, folder))
    return mine[: len(theirs)] == theirs


def _check_apart(data_path: str, map_path: str) -> None:
    if _inside(map_path, data_path) or _inside(data_path, map_path):
        raise ValueError("the reversal map and the data must not be stored inside each other")


def write_result(
    result: Anonymized,
    data_path: str,
    map_path: str,
    summary_path: str,
    *,
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
    format: str = "parquet",
) -> None:
    """Write the three tables of a run. The map re-identifies the data: keep ``map_path``
    somewhere only those allowed to reverse can read. The detectors run once for all three."""
    _check_apart(data_path, map_path)

    def write(df: DataFrame, path: str, by: Sequence[str]) -> None:
        writer = df.write.format(format).mode(mode)
        (writer.partitionBy(*by) if by else writer).save(path)

    if result.combined is None:
        write(result.data, data_path, partition_by)
        write(result.mapping, map_path, ())
        write(result.summary, summary_path, ())
        return
    # the rows as detected once, beside the map, whose secrets they hold; they go when all three are written
    spark, work = result.data.sparkSession, f"{map_path.rstrip('/')}_work"
    try:
        data, mapping, summary = result.split(stored(result.combined, work))
        write(data, data_path, partition_by)
        write(mapping, map_path, ())
        write(summary, summary_path, ())
    finally:
        remove_folder(spark, work)


def write_files(
    files: Files,
    data_path: str,
    map_path: str,
    summary_path: str,
    rejected_path: str,
    *,
    mode: str = "errorifexists",
    format: str = "parquet",
) -> None:
    """Write rewritten files: contents (path, format, engine, mode, content, reversible), the reversal map
    (path, token, original), counts (path, label, n) and the files not taken (path, reason).

    Content and map of a file lie side by side only in a folder beside the map, from which contents, map and counts
    are taken after one detection, and which is removed. A map that is empty leaves an empty table.
    """
    _check_apart(data_path, map_path)
    _check_apart(rejected_path, map_path)
    spark, work = files.accepted.sparkSession, f"{map_path.rstrip('/')}_work"
    try:
        rows = stored(files.accepted, work)
        parts = {
            data_path: rows.drop("map", "summary"),
            map_path: rows.select("path", F.explode("map").alias("token", "original")),
            summary_path: rows.select("path", F.explode("summary").alias("label", "n")),
            rejected_path: files.rejected,
        }
        for path, df in parts.items():
            df.write.format(format).mode(mode).save(path)
    finally:
        remove_folder(spark, work)
