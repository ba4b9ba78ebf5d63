"""Registered queries for ingestion and cleanup.

The whole driver tables go through the real paths: written as export JSON
arrays and scanned back (A01), re-typed from export text (A04-A06), appended
to the year-partitioned store and loaded (A08-A10), as newline-delimited
exports (A01), with private keys (A07), as new files beside known ones (A16)
and as audio files beside video files (A17).  Upload validation (A02) is a
driver-side check with tests of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replaylab.functions import expr as X
from replaylab.operators import cleanup as CL
from replaylab.schema import HISTORY, MAPPING, PRIVATE_KEYS
from replaylab.session import scratch_folder
from replaylab.sources import history_store as HS
from replaylab.sources.export_json import (
    ANY_EXPORT, FAST_PACKING, file_listing, new_files, normalize, present_columns, read_export, to_export, to_raw, write_export,
)
from replaylab.sources.plays import EVENT_PLAYS_SQL, PLAYS_SQL, event_plays, plays
from replaylab.plans.catalog import register, register_raw

_TYPES = {f.name: f.dataType.simpleString() for f in HISTORY.fields}


@register("a03_present_columns", " UNION ALL ".join(
    f"SELECT '{src}' AS key, count({tgt}) AS non_null, count({tgt}) > 0 AS present FROM history"
    for src, tgt, _ in MAPPING), source="events")
def a03_present_columns(h: DataFrame) -> DataFrame:
    """Which export keys carry data in the events feed laid out as raw export text."""
    return present_columns(to_raw(h))


_ROUNDTRIP_SQL = """
SELECT CAST(year(ts) AS INTEGER) AS year, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS total_ms,
       count(*) FILTER (WHERE skipped) AS skips, count(skipped) AS known_skip,
       count(*) FILTER (WHERE shuffle) AS shuffles, count(DISTINCT track_uri) AS songs,
       count(DISTINCT artist_name) AS artists, count(offline_timestamp) AS offline_ts
FROM history GROUP BY 1"""


def _roundtrip_agg(h: DataFrame) -> DataFrame:
    return h.groupBy(X.year("ts").alias("year")).agg(
        F.count(F.lit(1)).alias("plays"),
        F.sum("ms_played").cast("bigint").alias("total_ms"),
        F.count_if(F.col("skipped")).alias("skips"),
        F.count("skipped").alias("known_skip"),
        F.count_if(F.col("shuffle")).alias("shuffles"),
        F.count_distinct("track_uri").alias("songs"),
        F.count_distinct("artist_name").alias("artists"),
        F.count("offline_timestamp").alias("offline_ts"),
    )


@register("a04_normalize_roundtrip", _ROUNDTRIP_SQL)
def a04_normalize_roundtrip(h: DataFrame) -> DataFrame:
    """Every play as raw export text, re-typed by the lenient casts."""
    return _roundtrip_agg(normalize(to_raw(h)))


def _store_path(spark: SparkSession, tag: str) -> str:
    return scratch_folder(spark, f"history-{tag}")


@register_raw("a08_history_store_roundtrip", f"WITH history AS ({PLAYS_SQL})\n{_ROUNDTRIP_SQL}")
def a08_history_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append the plays to a year-partitioned store, load it back, aggregate."""
    path = _store_path(spark, "a08")
    HS.append_history(plays(spark, sf_dir), path)
    return _roundtrip_agg(HS.load_history(spark, path))


@register_raw("a08_compaction", f"WITH history AS ({PLAYS_SQL})\n{_ROUNDTRIP_SQL}")
def a08_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plays as several uploads, compacted; one upload written again before and one after; loaded back, aggregated."""
    whole, path = _store_path(spark, "a08-whole"), _store_path(spark, "a08-compaction")
    # Uploads are written as their tasks hold them: gathering rows into few files per year is the compaction's shuffle.
    HS.append_history(plays(spark, sf_dir), whole, rebalance=False, cluster_by=())
    h = HS.load_history(spark, whole)
    part = lambda i: h.where(F.pmod(F.xxhash64("username", "ts"), F.lit(4)) == i)
    for i in (0, 1, 2, 3, 1):
        HS.append_history(part(i), path, f"upload-{i}", rebalance=False)
    HS.compact(spark, path)
    HS.append_history(part(2), path, "upload-2", rebalance=False)
    return _roundtrip_agg(HS.load_history(spark, path))


@register_raw("a01_export_json_roundtrip", f"WITH history AS ({PLAYS_SQL})\n{_ROUNDTRIP_SQL}")
def a01_export_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays written as export JSON arrays, then scanned and normalised."""
    path = _store_path(spark, "a01-export")
    write_export(plays(spark, sf_dir), path, rows_per_file=10_000, compression="gzip")
    return _roundtrip_agg(normalize(read_export(spark, [path], validate=False, glob="*.txt.gz")))


@register_raw("a09_ingest_report", f"""
WITH history AS ({PLAYS_SQL}), ev AS ({EVENT_PLAYS_SQL})
SELECT 2 AS files_processed, (SELECT count(*) FROM history) + (SELECT count(*) FROM ev) AS total_rows""")
def a09_ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends (plays, then events) and the report of the total table."""
    path = _store_path(spark, "a09")
    HS.append_history(plays(spark, sf_dir), path)
    HS.append_history(event_plays(spark, sf_dir), path)
    return HS.ingest_report(spark, path, files_processed=HS.uploads(spark, path).count())


@register_raw("a11_concat_parts", f"""
WITH history AS ({PLAYS_SQL}), ev AS ({EVENT_PLAYS_SQL})
SELECT username, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS total_ms
FROM (SELECT username, ms_played FROM history UNION ALL SELECT username, ms_played FROM ev) t
GROUP BY username""")
def a11_concat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two export parts concatenated, plays and ms per listener."""
    both = CL.concat_parts(plays(spark, sf_dir), event_plays(spark, sf_dir))
    return both.groupBy("username").agg(F.count(F.lit(1)).alias("plays"),
                                        F.sum("ms_played").cast("bigint").alias("total_ms"))


@register("a12_drop_empty_columns", """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, username, ms_played, artist_name FROM history""",
          source="events")
def a12_drop_empty_columns(h: DataFrame) -> DataFrame:
    """The events feed without its all-null columns."""
    out = CL.drop_empty_columns(h)
    return out.withColumn("ts", F.translate(F.replace(X.iso_text("ts"), F.lit("Z"), F.lit("")), "T", " "))


@register("a14_with_minutes", """
SELECT username, ms_played, ms_played / 60000.0 AS minutes_played FROM history""", source="events")
def a14_with_minutes(h: DataFrame) -> DataFrame:
    """Unrounded minutes per play (events feed)."""
    return CL.with_minutes(h).select("username", "ms_played", "minutes_played")


@register("a15_profile", " UNION ALL ".join(
    f"SELECT (SELECT count(*) FROM history) AS total_rows, {i} AS position, '{f.name}' AS column_name, "
    f"'{_TYPES[f.name]}' AS dtype, count({f.name}) AS non_null FROM history"
    for i, f in enumerate(HISTORY.fields)))
def a15_profile(h: DataFrame) -> DataFrame:
    """Row count, type and non-null count of every history column."""
    return CL.profile(h)


def stored_listing(spark: SparkSession, path: str) -> DataFrame:
    """The listing of a folder as it is now, kept as the manifest of known files."""
    kept = scratch_folder(spark, "manifest")
    file_listing(spark, path, ANY_EXPORT).write.parquet(kept)
    return spark.read.parquet(kept)


def rename_files(spark: SparkSession, source: str, target: str, prefix: str) -> None:
    """Move a folder's part files into ``target`` under ``prefix``: export files have names of their own."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(source)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.startswith("part-"):
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f"{target}/{prefix}{name}"))


#: Plays in a compressed file, which one task reads: some 100 MB of text.
PACKED_ROWS = 250_000
#: Plays in a listener's own export file, about: read whole.
EXPORT_ROWS = 15_000


def _write_ndjson(h: DataFrame, path: str, extra: dict[str, str] | None = None, packed_rows: int = 0) -> None:
    """Plays as newline-delimited export objects; ``extra`` adds more keys to each.  ``packed_rows``: compressed files of so many at most."""
    out = to_export(h)
    for k, v in (extra or {}).items():
        out = out.withColumn(k, F.lit(v))
    out.write.mode("append").options(**FAST_PACKING).option("maxRecordsPerFile", packed_rows).json(path, compression="gzip" if packed_rows else None)


@register_raw("a01_ndjson", f"WITH history AS ({PLAYS_SQL})\n{_ROUNDTRIP_SQL}")
def a01_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays written as compressed newline-delimited export files, all rows scanned back; large files by lines."""
    path = _store_path(spark, "a01-ndjson")
    _write_ndjson(plays(spark, sf_dir), path, packed_rows=PACKED_ROWS)
    return _roundtrip_agg(normalize(read_export(spark, [path], validate=False, glob=ANY_EXPORT, max_whole_bytes=8 << 20)))


@register_raw("a01_large_array", f"WITH history AS ({PLAYS_SQL})\n{_ROUNDTRIP_SQL}")
def a01_large_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays written as one-line JSON arrays, every file read as a large one, split at closing braces."""
    path = _store_path(spark, "a01-large-array")
    write_export(plays(spark, sf_dir), path, rows_per_file=50_000, compression="gzip")
    return _roundtrip_agg(normalize(read_export(spark, [path], validate=False, glob="*.txt.gz", max_whole_bytes=0)))


@register_raw("a07_private_keys", f"""
WITH history AS ({EVENT_PLAYS_SQL})
SELECT username, count(*) AS plays, 0 AS private_columns FROM history GROUP BY username""")
def a07_private_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports that hold private keys; none of them becomes a column."""
    path = _store_path(spark, "a07")
    _write_ndjson(event_plays(spark, sf_dir), path, {k: "private" for k in PRIVATE_KEYS})
    raw = read_export(spark, [path], validate=False)
    private = len(set(raw.columns) & set(PRIVATE_KEYS))
    return normalize(raw).groupBy("username").agg(F.count(F.lit(1)).alias("plays"), F.lit(private).alias("private_columns"))


@register_raw("a16_new_files", f"WITH history AS (SELECT * FROM ({EVENT_PLAYS_SQL}) e)\n{_ROUNDTRIP_SQL}")
def a16_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plays' files are known already; of the whole listing only the events' new files are ingested."""
    path = _store_path(spark, "a16")
    _write_ndjson(plays(spark, sf_dir), path, packed_rows=PACKED_ROWS)
    known = stored_listing(spark, path)
    _write_ndjson(event_plays(spark, sf_dir), path)
    fresh = [r.path for r in new_files(file_listing(spark, path, ANY_EXPORT), known).collect()]
    return _roundtrip_agg(normalize(read_export(spark, fresh)))


@register_raw("a17_audio_only", f"WITH history AS ({PLAYS_SQL})\n{_ROUNDTRIP_SQL}")
def a17_audio_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of audio and video history files; the audio files' plays alone are read."""
    path = _store_path(spark, "a17")
    for kind, loader in (("Audio", plays), ("Video", event_plays)):
        _write_ndjson(loader(spark, sf_dir), f"{path}/{kind}", packed_rows=EXPORT_ROWS)
        rename_files(spark, f"{path}/{kind}", path, f"Streaming_History_{kind}_")
    return _roundtrip_agg(normalize(read_export(spark, [path], validate=False, glob=ANY_EXPORT, audio_only=True)))
