"""The stored ``history`` table (A08-A10): Parquet, partitioned by UTC year, published by marker.

    <store>/attempt=<random>/year=YYYY/part-*.parquet     (undated rows: the null year)
    <store>/_live/                                        which attempt holds an upload's live rows

Every write, batch or stream, goes through :func:`append_history` into a folder
of its own and becomes visible with one small marker (``published``): an upload
id that is written again replaces that upload and nothing else, so a retried
batch adds nothing, and a write that dies on the way loses nothing.
:func:`compact` rewrites many small uploads into few files per year.  No
streaming sink log ever arises in the store (readers would see only the files
in that log), and a folder that has one is refused.  ``date_range`` and
``year_filter`` add the ``year`` range that a ``ts`` range implies, which prunes
whole folders.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replaylab.functions import expr as X
from replaylab.schema import HISTORY, HISTORY_COLUMNS
from replaylab.sources import published


class HistoryNotFound(FileNotFoundError):
    """No history has been uploaded at this location yet."""


class NotAHistoryStore(ValueError):
    """The folder is written by a streaming file sink, whose log hides all other files."""


YEAR = T.StructType([T.StructField("year", T.IntegerType(), True)])
CLUSTER_BY = ("username", "ts")


def refuse_sink_log(spark: SparkSession, path: str) -> None:
    """Raise if ``path`` holds a streaming file sink's log."""
    try:
        spark.read.text(f"{path.rstrip('/')}/_spark_metadata")
    except AnalysisException:
        return
    raise NotAHistoryStore(f"{path}: written by a streaming file sink; stream into a store with ingest_to_store")


def append_history(df: DataFrame, path: str, upload_id: str | None = None, rebalance: bool = True,
                   cluster_by: tuple[str, ...] = CLUSTER_BY) -> str:
    """Create-if-absent and append normalised rows, partitioned by the UTC year of ``ts``.

    Returns the upload's id (a new one if none is given).  Writing the same id
    again replaces that upload, so a retry never doubles rows.

    ``rebalance`` (default) adds Spark's REBALANCE on ``year`` before the write:
    one shuffle after which AQE coalesces small partitions and splits skewed
    ones (a year holding a third of all plays) to the advisory size, so each
    year folder gets a few right-sized files instead of one file per input
    task, and no single task writes a hot year alone.  ``cluster_by`` sorts
    rows within each file so per-listener filters prune row groups.
    """
    refuse_sink_log(df.sparkSession, path)
    upload_id = upload_id or uuid.uuid4().hex
    out = df.select(*HISTORY_COLUMNS, X.year("ts").alias("year"))
    if rebalance:
        out = out.hint("rebalance", "year")
    if cluster_by:
        # Sorted by (year, listener, time) inside each task: the partitioned
        # writer's required order (year) is a prefix, so no extra sort runs, and
        # Parquet min/max statistics on username let a one-listener filter skip
        # every other listener's row groups.
        out = out.sortWithinPartitions("year", *cluster_by)
    published.publish(out, path, upload_id, ("year",), "upload")
    return upload_id


def load_history(spark: SparkSession, path: str, without_upload: str | None = None, only_uploads: Sequence[str] | None = None) -> DataFrame:
    """A10: the stored table with its fixed schema, or :class:`HistoryNotFound`."""
    refuse_sink_log(spark, path)
    df = published.read(spark, path, HISTORY, YEAR, "upload")
    if df is None:
        raise HistoryNotFound(f"{path}: no history stored here yet (append an upload first)")
    if without_upload is not None:
        df = df.where(F.col("upload") != without_upload)
    if only_uploads is not None:
        df = df.where(F.col("upload").isin(list(only_uploads)))
    return df.select(*HISTORY_COLUMNS, "year")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(upload, attempt): the live uploads and the folder that holds each."""
    found = published.marks(spark, path)
    if found is None:
        raise HistoryNotFound(f"{path}: no history stored here yet (append an upload first)")
    return published.live(found).select(F.col("unit").alias("upload"), "attempt")


def compact(spark: SparkSession, path: str) -> int:
    """Rewrite all live uploads into one folder with few files per year; returns the number of uploads.

    Uploads keep their ids, so one that is written again later still replaces its own rows only.
    """
    refuse_sink_log(spark, path)
    return published.compact(spark, path, HISTORY, YEAR, "upload", CLUSTER_BY)


def ingest_report(spark: SparkSession, path: str, files_processed: int) -> DataFrame:
    """Files processed in this upload and the total rows now in the table."""
    total = load_history(spark, path).agg(F.count(F.lit(1)).alias("total_rows"))
    return total.select(F.lit(files_processed).alias("files_processed"), "total_rows")


def upload(spark: SparkSession, paths, path: str, audio_only: bool = False) -> DataFrame:
    """A01..A09 end to end: validate, read, normalise, append, report."""
    from replaylab.sources.export_json import ingest, validate_paths

    files = validate_paths(paths)
    append_history(ingest(spark, files, audio_only=audio_only), path)
    return ingest_report(spark, path, len(files))
