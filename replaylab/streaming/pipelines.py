"""Structured Streaming forms.

* S01 ``ingest_to_store``: newly dropped export files -> normalised plays,
  appended to the same store that batch uploads use.  Each micro-batch is one
  upload, named by stream and batch id, so a repeated batch replaces itself;
  what can't be parsed goes to a quarantine folder with its file's name.  No
  watermark is set because old exports legitimately arrive years late.
* S02 ``dedup_into_store``: the same with cross-export de-duplication against
  the stored plays, in whatever order files arrive.  ``dedup_stream`` is the
  form for a live feed: its state is bounded by a watermark, and rows later
  than that are dropped.
* S03 ``daily_windows``: daily counts as tumbling event-time windows; rows
  later than the watermark are dropped, closed days are emitted (append).
* S04 ``sessions``: gap-based listening sessions per user, for a live feed;
  ``ingest_to_store(run_path=...)`` keeps them for files in any order.

``run_available_now`` drives any of them to completion over what is there
(``trigger(availableNow=True)``) into a Parquet sink with a checkpoint in the
shared checkpoint folder, so a lost executor or a restarted job resumes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replaylab.functions import expr as X
from replaylab.operators.metrics import dedup_key, deduplicate
from replaylab.schema import HISTORY_COLUMNS
from replaylab.session import scratch_folder
from replaylab.sources import history_store as HS
from replaylab.sources import play_keys as K
from replaylab.sources.export_json import normalize, parse_export_text, read_parsed, split_problems
from replaylab.streaming import daily, runs


def read_export_stream(spark: SparkSession, directory: str, max_files_per_trigger: int | None = None,
                       audio_only: bool = False) -> DataFrame:
    """S01 source: files appearing in ``directory``, one (file_name, problem, raw columns) row per play or problem."""
    reader = spark.readStream.option("pathGlobFilter",
                                     "Streaming_History_Audio_*.json" if audio_only else "*.json")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return parse_export_text(reader.text(directory, wholetext=True))


def ingest_stream(spark: SparkSession, directory: str, **kw) -> DataFrame:
    """A streaming ``history`` frame of the good plays with its UTC ``year`` (see :func:`ingest_to_store` for the whole job)."""
    return normalize(split_problems(read_export_stream(spark, directory, **kw))[0]).withColumn("year", X.year("ts"))


def file_stream(spark: SparkSession, directory: str, max_files_per_trigger: int | None = None, audio_only: bool = False) -> DataFrame:
    """S01 source of :func:`ingest_to_store`: the paths of files appearing in ``directory``; none is opened."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    reader = reader.option("pathGlobFilter", "Streaming_History_Audio_*.json" if audio_only else "*.json")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(directory).select("path")


def _exact(path: str) -> str:
    """A path whose name the reader takes as it is, not as a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _run_batches(df: DataFrame, checkpoint: str, write) -> None:
    """Hand every micro-batch that is available now to ``write(batch, batch_id)``."""
    q = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def ingest_to_store(spark: SparkSession, directory: str, store: str, checkpoint: str, stream: str = "drop", dedup: bool = False,
                    quarantine: str | None = None, days: str | None = None, run_path: str | None = None, **kw) -> str:
    """Ingest all files that appeared in ``directory`` since the last run into ``store``.

    ``stream`` names the stream: its batches are uploads ``<stream>-<batch id>``.
    Problems are written below ``quarantine`` (default: beside the checkpoint).
    ``days`` names a folder of maintained daily totals (``streaming.daily``), which
    the same stream keeps, after de-duplication: late plays correct their days.
    ``run_path`` names one of maintained sessions and streaks (``streaming.runs``).
    """
    quarantine = quarantine or f"{checkpoint.rstrip('/')}-quarantine"

    def write(files: DataFrame, batch_id: int) -> None:
        # File names alone, each once; the files are read as uploads are, the large ones split.
        paths = sorted({_exact(r.path) for r in files.collect()})
        if not paths:
            return
        batch = read_parsed(files.sparkSession, paths).persist()  # parsed once for plays and problems; a lost block is parsed again
        plays, problems = split_problems(batch)
        upload = f"{stream}-{batch_id}"
        (_append_new if dedup else HS.append_history)(normalize(plays), store, upload)
        if days:
            daily.publish_days(batch.sparkSession, store, upload, days)
        if run_path:
            runs.publish_runs(batch.sparkSession, store, upload, run_path)
        problems.write.mode("overwrite").json(f"{quarantine}/upload={upload}")
        batch.unpersist()

    _run_batches(file_stream(spark, directory, **kw), checkpoint, write)
    return store


def _append_new(h: DataFrame, store: str, upload: str) -> None:
    """Append the plays of ``h`` that other uploads of the store don't hold, each once."""
    spark = h.sparkSession
    new = deduplicate(h)
    K.index_uploads(spark, store, without=upload)
    HS.append_history(K.new_plays(new, K.held_keys(spark, store, new, without_upload=upload)), store, upload)
    K.index_uploads(spark, store)


def dedup_into_store(spark: SparkSession, directory: str, store: str, checkpoint: str, **kw) -> str:
    """:func:`ingest_to_store` without plays that are stored already; no play is lost to lateness."""
    return ingest_to_store(spark, directory, store, checkpoint, dedup=True, **kw)


def dedup_stream(h: DataFrame, delay: str = "1 day") -> DataFrame:
    """S02 for a live feed: drop repeated plays (same user, time and item) within the watermark.

    Rows later than the watermark are dropped, as with any bounded state: use
    :func:`dedup_into_store` for drops of older files.
    """
    return (h.withColumn("__item", dedup_key()).withWatermark("ts", delay)
            .dropDuplicatesWithinWatermark(["username", "ts", "__item"])
            .drop("__item"))


def daily_windows(h: DataFrame, delay: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Streams and ms per UTC day as tumbling windows (append mode)."""
    return (h.withWatermark("ts", delay)
            .groupBy(*by, F.window("ts", "1 day"))
            .agg(F.count(F.lit(1)).alias("streams"),
                 F.coalesce(F.sum("ms_played"), F.lit(0)).cast("bigint").alias("total_ms"))
            .select(*by, X.day("window.start").alias("day"), "streams", "total_ms"))


def sessions(h: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Listening sessions per user; a new session starts after ``gap`` of silence."""
    return (h.where(F.col("username").isNotNull())
            .withWatermark("ts", delay)
            .groupBy("username", F.session_window("ts", gap))
            .agg(F.count(F.lit(1)).alias("plays"),
                 F.coalesce(F.sum("ms_played"), F.lit(0)).cast("bigint").alias("total_ms"))
            .select("username", F.col("session_window.start").alias("session_start"),
                    F.col("session_window.end").alias("session_end"), "plays", "total_ms"))


def run_available_now(df: DataFrame, sink: str, checkpoint: str, mode: str = "append",
                      partition_by: tuple[str, ...] = ()) -> str:
    """Process everything available now, exactly once, into a Parquet sink."""
    w = (df.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.start(sink)
    q.awaitTermination()
    return sink


def scratch(spark: SparkSession, tag: str) -> tuple[str, str]:
    """Sink and checkpoint locations under the shared checkpoint folder."""
    base = scratch_folder(spark, f"stream-{tag}")
    return f"{base}/out", f"{base}/checkpoint"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a file stream (the folder, filtered to one table's file)."""
    sf_dir = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


__all__ = [
    "read_export_stream", "ingest_stream", "ingest_to_store", "dedup_into_store", "dedup_stream", "daily_windows", "sessions",
    "run_available_now", "scratch", "table_stream", "HISTORY_COLUMNS",
]
