"""JSON export ingestion.

An export file is a JSON array of play objects, or newline-delimited play
objects.  Both are parsed with an explicit all-string schema of the mapped
keys only:

* no inference pass over the data (the reader never scans twice);
* keys absent from a file come back NULL (A06);
* private keys (network address, device fingerprint) are not in the parse
  schema, so they never become a column anywhere in the plan (A07);
* casts happen afterwards with ``try_cast`` semantics: a bad value becomes
  NULL, never an error (A05).

A file of up to ``MAX_WHOLE_BYTES`` is read whole, as one row.  Larger files are split at closing braces, whatever their layout
(``large_export``): the limit is a choice of speed and changes no play.
Compressed files (``.json.gz``) are read alike, a file by one task, so the sink bounds their rows.
What can't be parsed is never lost without a word: a strict read fails with
the file's name, any other read returns it as rows with ``problem`` set
(:func:`split_problems`).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replaylab.functions import expr as X
from replaylab.schema import HISTORY, MAPPING, RAW


class ExportError(ValueError):
    """The batch of export files was rejected before reading."""


# Fixed value: name pattern of audio history export files.
AUDIO_FILE = re.compile(r"^Streaming_History_Audio_.*\.json(\.gz)?$")


def validate_paths(paths: Sequence[str] | str) -> list[str]:
    """A non-empty list whose every name ends in ``.json`` (case-sensitive)."""
    if isinstance(paths, str):
        paths = [paths]
    paths = [p for p in paths if p is not None]
    if not paths:
        raise ExportError("empty batch: at least one export file is required")
    for p in paths:
        name = p.rstrip("/").rsplit("/", 1)[-1]
        if not name.endswith(".json"):
            raise ExportError(f"{name}: only .json export files can be ingested")
    return list(paths)


#: Files up to this size are read as one row each, whose parsing holds many times its size; larger ones are split.
MAX_WHOLE_BYTES = 8 << 20
#: Names of files that the reader decompresses, and how many times its size such a file's text is taken to have.
COMPRESSED = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"
EXPANDS = 10
#: Writer options: zlib's fastest level, where a file is compressed by it.
FAST_PACKING = {"zlib.compress.level": "BEST_SPEED"}
#: Names of plain and of compressed export files.
ANY_EXPORT = "*.{json,json.gz}"

_OBJECT = r"^\s*\{"
_ROW = T.StructType([T.StructField("play", RAW), T.StructField("problem", T.StringType())])
#: A play, or the mark that closes a list (see :func:`_closed`).
_MARKED = T.ArrayType(T.StructType([*RAW.fields, T.StructField("__end", T.StringType())]))


def _mark(body: Column) -> Column:
    return F.xxhash64(body).cast("string")


def _closed(body: Column) -> Column:
    """Values with commas between them -> an array's text, closed with a mark.

    ``from_json`` reads the first root value and ignores what follows it: where
    the mark isn't the last value, the root value ended early.
    """
    return F.concat(F.lit("["), body, F.lit(',{"__end":"'), _mark(body), F.lit('"}]'))


def _ended(parsed: Column, body: Column) -> Column:
    return F.try_element_at(parsed, F.lit(-1))["__end"].eqNullSafe(_mark(body))


def _fields(play: Column) -> Column:
    return F.struct(*[play[f.name].alias(f.name) for f in RAW.fields])


def _rows(elements: Column) -> Column:
    """Texts -> (play, problem) structs: the parsed object, or the text that is no whole single object."""
    parsed = F.transform(elements, lambda x: F.struct(x.alias("text"), F.when(x.rlike(_OBJECT), F.from_json(_closed(x), _MARKED)).alias("list")))
    plays = F.transform(parsed, lambda r: F.struct(
        r["text"].alias("text"), F.when((F.size(r["list"]) == 2) & _ended(r["list"], r["text"]), r["list"][0]).alias("play")))
    return F.transform(plays, lambda r: F.struct(F.when(r["play"].isNotNull(), _fields(r["play"])).alias("play"),
                                                 F.when(r["play"].isNull(), r["text"]).alias("problem")))


def _braces(inner: str) -> str:
    """A pattern for a JSON object whose nested objects match ``inner``; it never tries a text twice."""
    string = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    return r"\{[^{}\"]*+(?:(?:" + string + inner + r')[^{}"]*+)*+\}'


#: Whole objects inside a text that isn't one value, with objects in them up to three levels deep.
OBJECTS = "(?s)" + _braces("|" + _braces("|" + _braces("|" + _braces(""))))


def salvaged(body: Column) -> Column:
    """A damaged text -> (play, problem) structs: its whole objects as far as they parse, then all the rest of it as one problem."""
    found = F.regexp_extract_all(body, F.lit(OBJECTS), F.lit(0))
    rest = F.regexp_replace(body, OBJECTS, "")
    return F.concat(_rows(found), F.array(F.struct(F.lit(None).cast(RAW).alias("play"), rest.alias("problem")))).cast(T.ArrayType(_ROW))


def parse_export_text(text: DataFrame) -> DataFrame:
    """Text rows (``value``) -> one (file_name, problem, RAW columns...) row per play or problem.

    ``from_json`` with an array-of-RAW schema, then ``explode``: parsing a
    file's text in memory is ~25x faster than the multi-line JSON reader when
    numbers and booleans land in string fields (they always do with the
    all-string RAW schema).  Only an array that this can't take as a whole is
    parsed again element by element, so one bad element costs no good one.
    A text that begins with an object is read line by line.  An empty text or
    array gives no rows.  A damaged text, such as a truncated array, gives its
    whole objects, and all the rest of it as one problem.
    """
    # A column of its own: the cases below mention it often, and each mention would trim a whole file again.
    trimmed = F.regexp_extract("value", r"(?s)^\uFEFF?\s*+(.*\S)", 1)
    text = text.select(F.col("_metadata.file_name").alias("file_name"), trimmed.alias("value"))
    value = F.col("value")
    lines = F.transform(F.split(value, r"\r?\n"), lambda x: F.when(x.endswith("}"), x).otherwise(F.regexp_replace(x, r"\s*,?\s*$", "")))
    bodies = (
        F.when(value.startswith("{"), lines)
        .when(value.startswith("[") & value.endswith("]"), F.array(F.substring(value, F.lit(2), F.length(value) - 2)))
        .otherwise(F.array(value))
    )
    listed = text.select("file_name", F.explode(bodies).alias("body")).where(F.col("body").rlike(r"\S"))
    body = F.col("body")
    # Columns of their own, so that each text is parsed once.
    listed = listed.withColumn("list", F.from_json(_closed(body), _MARKED))
    plays = F.slice("list", 1, F.size("list") - 1)
    listed = listed.withColumn("clean", _ended(F.col("list"), body) & ~F.exists(plays, lambda p: p.isNull()))
    elements = F.from_json(F.concat(F.lit("["), body, F.lit(',"'), _mark(body), F.lit('"]')), T.ArrayType(T.StringType()))
    listed = listed.withColumn("elements", F.when(~F.col("clean"), elements))
    texts = F.transform(F.slice("elements", 1, F.size("elements") - 1), lambda x: F.coalesce(x, F.lit("null")))
    rows = (
        F.when(F.col("clean"), F.transform(plays, lambda p: F.struct(_fields(p).alias("play"), F.lit(None).cast("string").alias("problem"))))
        .when(F.try_element_at("elements", F.lit(-1)).eqNullSafe(_mark(body)), _rows(texts))
        .otherwise(salvaged(body))
    )
    named = listed.select("file_name", F.explode(rows).alias("r"))
    return named.select("file_name", F.col("r.problem").alias("problem"), "r.play.*")


def split_problems(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plays, problems): the raw plays, and what could not be parsed by file name."""
    return (parsed.where(F.col("problem").isNull()).drop("file_name", "problem"),
            parsed.where(F.col("problem").isNotNull()).select("file_name", "problem"))


def read_parsed(spark: SparkSession, paths: Sequence[str] | str, audio_only: bool = False, glob: str | None = None,
                max_whole_bytes: int = MAX_WHOLE_BYTES) -> DataFrame:
    """Files -> parsed rows with their problems (see :func:`parse_export_text`)."""
    paths = [paths] if isinstance(paths, str) else list(paths)

    def text_size(size: Column, name: Column) -> Column:
        return F.when(name.rlike(COMPRESSED), size * EXPANDS).otherwise(size)

    def files(whole: bool, separator: str = "}") -> DataFrame:
        reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
        # wholetext and lineSep must be text() arguments: text() resets the options otherwise.
        text = reader.text(paths, wholetext=True) if whole else reader.text(paths, lineSep=separator)
        if audio_only:
            text = text.where(F.col("_metadata.file_name").rlike(AUDIO_FILE.pattern))
        # a metadata filter: other files are never opened
        size = text_size(F.col("_metadata.file_size"), F.col("_metadata.file_name"))
        return text.where(size <= max_whole_bytes if whole else size > max_whole_bytes)

    parsed = parse_export_text(files(True))
    listing = spark.read.format("binaryFile") if glob is None else spark.read.format("binaryFile").option("pathGlobFilter", glob)
    # names and sizes alone; no file is opened
    large = listing.load(paths).where(text_size(F.col("length"), F.col("path")) > max_whole_bytes)
    kinds = {r.packed for r in large.select(F.col("path").rlike(COMPRESSED).alias("packed")).distinct().collect()}
    if not kinds:
        return parsed

    from replaylab.sources.large_export import parse_fragments

    packed = files(False, "{").where(F.col("_metadata.file_name").rlike(COMPRESSED)) if True in kinds else None
    return parsed.unionByName(parse_fragments(files(False), packed))


def read_export(spark: SparkSession, paths: Sequence[str] | str, audio_only: bool = False,
                validate: bool = True, glob: str = "*.json", strict: bool = True,
                max_whole_bytes: int = MAX_WHOLE_BYTES) -> DataFrame:
    """Scan export files as one raw table (all-string columns).

    ``audio_only`` keeps rows from ``Streaming_History_Audio_*.json`` files
    only (video history files are not supported).  Directories are read with a
    ``glob`` filter.  ``strict`` (default) fails on anything that is no play,
    with the file's name; otherwise the good plays of every file are returned.
    """
    if validate:
        paths = validate_paths(paths)
    parsed = read_parsed(spark, paths, audio_only, None if validate else glob, max_whole_bytes)
    if strict:
        wrong = F.raise_error(F.concat(F.lit("Not a JSON array of plays: "), F.col("file_name"), F.lit(": "), F.substring("problem", 1, 100)))
        # The check rides on a column that is always kept, so no pruning drops it.
        parsed = parsed.where(F.when(F.col("problem").isNull(), F.lit(True)).otherwise(wrong.cast("boolean")))
        return parsed.drop("file_name", "problem")
    return split_problems(parsed)[0]


def _lenient(col: Column, sql_type: str) -> Column:
    """Text -> target type, NULL on failure (never an error)."""
    s = F.trim(col)
    if sql_type == "STRING":
        return col
    if sql_type == "BOOLEAN":
        # true/t/yes/y/1 and false/f/no/n/0, case-insensitive; else NULL.
        return s.try_cast("boolean")
    if sql_type == "BIGINT":
        # Whole numbers directly; decimals round half to even (as a double cast does).
        return F.coalesce(s.try_cast("bigint"), F.rint(s.try_cast("double")).try_cast("bigint"))
    if sql_type == "TIMESTAMP":
        return _full_time(s)
    raise ValueError(sql_type)


#: A whole date and time of day, with or without an offset.  (A cast would take "12:30" as today.)
_FULL_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?"


def _full_time(s: Column) -> Column:
    """Text -> instant; without an offset it is UTC, whatever the session's zone.  Other texts are NULL."""
    usual = s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$")  # one pattern instead of four for most plays
    text = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?![:\d])", "$1:00")
    zoned = text.rlike(_FULL_TIME + r"\s*(Z|UTC|GMT|[+-]\d{2}(:?\d{2})?)$")
    return F.when(usual, s).when(text.rlike(_FULL_TIME + "$"), F.concat(text, F.lit("Z"))).when(zoned, text).try_cast("timestamp")


def _epoch_or_text(col: Column) -> Column:
    """offline_timestamp: epoch seconds (or milliseconds above 1e11) or ISO text."""
    s = F.trim(col)
    n = s.try_cast("bigint")
    return (
        F.when(n.isNull(), _full_time(s))
        .when(F.abs(n) > F.lit(100_000_000_000), F.timestamp_millis(n))
        .otherwise(F.timestamp_seconds(n))
    )


def normalize(raw: DataFrame) -> DataFrame:
    """Rename the mapped keys and cast leniently to the ``history`` schema.

    Keys missing from ``raw`` (e.g. a DataFrame built elsewhere) become typed NULLs.
    """
    present = set(raw.columns)
    cols = []
    for (src, tgt, sql_type), field in zip(MAPPING, HISTORY.fields):
        if src not in present:
            cols.append(F.lit(None).cast(field.dataType).alias(tgt))
        elif tgt == "offline_timestamp":
            cols.append(_epoch_or_text(F.col(src).cast("string")).alias(tgt))
        else:
            cols.append(_lenient(F.col(src).cast("string"), sql_type).cast(field.dataType).alias(tgt))
    return raw.select(*cols)


def ingest(spark: SparkSession, paths: Sequence[str] | str, audio_only: bool = False) -> DataFrame:
    """A01+A04..A07: files -> normalised ``history`` rows (lazy)."""
    return normalize(read_export(spark, paths, audio_only=audio_only))


def present_columns(raw: DataFrame) -> DataFrame:
    """Which mapped keys carry data: one row per key with its non-null count."""
    srcs = [src for src, _, _ in MAPPING if src in raw.columns]
    counts = raw.agg(*[F.count(F.col(c)).alias(c) for c in srcs])
    pairs = ", ".join(f"'{c}', `{c}`" for c in srcs)
    return counts.selectExpr(f"stack({len(srcs)}, {pairs}) AS (key, non_null)").withColumn(
        "present", F.col("non_null") > 0
    )


def file_listing(spark: SparkSession, directory: str, glob: str = "*.json") -> DataFrame:
    """A16 input: name and size of every ``*.json`` file (or ``glob``) under ``directory``.

    ``binaryFile`` with only metadata columns selected never reads contents.
    """
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
        .select(F.col("path"), F.element_at(F.split("path", "/"), -1).alias("file_name"),
                F.col("length").alias("file_size"))
    )


def new_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files not yet queued, by (name, size) - an anti join."""
    return listing.join(manifest.select("file_name", "file_size"), on=["file_name", "file_size"],
                        how="left_anti")


def to_raw(history: DataFrame) -> DataFrame:
    """Inverse of :func:`normalize`: a history frame laid out as raw export text.

    Used to round-trip stored history through the ingest path at full scale.
    """
    cols = []
    for (src, tgt, sql_type) in MAPPING:
        c = F.col(tgt)
        if sql_type == "TIMESTAMP" and tgt == "ts":
            c = X.iso_text(c)
        elif tgt == "offline_timestamp":
            c = F.unix_timestamp(c).cast("string")
        cols.append(c.cast("string").alias(src))
    return history.select(*cols)


def to_export(history: DataFrame) -> DataFrame:
    """A history frame with the export's key names and JSON value types."""
    cols = []
    for (src, tgt, sql_type) in MAPPING:
        c = F.col(tgt)
        if tgt == "ts":
            c = X.iso_text(c)
        elif tgt == "offline_timestamp":
            c = F.unix_timestamp(c)
        cols.append(c.alias(src))
    return history.select(*cols)


def _bracketed(rows_per_file: int):
    """Objects' texts -> the same texts with what an array needs around each: every ``rows_per_file`` of a partition are one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, 0  # the newest batch is held back: the last text of all closes its array

        def marked(texts: pa.Array, ends: bool) -> pa.RecordBatch:
            place = np.arange(at, at + len(texts)) % rows_per_file
            closing = place == rows_per_file - 1
            closing[-1] |= ends
            opens, closes = pa.array(np.where(place == 0, "[", "")), pa.array(np.where(closing, "]", ","))
            return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(opens, texts, closes, "")], names=["value"])

        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield marked(held, False)
                    at += len(held)
                held = batch.column(0)
        if held is not None:
            yield marked(held, True)

    return run


def write_export(history: DataFrame, path: str, rows_per_file: int = 10_000, compression: str | None = None) -> None:
    """Sink: write plays as export files, each ONE JSON array of <= ``rows_per_file`` plays on one line.

    A play is a row of the sink with its bracket or comma, and the sink begins
    a file every ``rows_per_file`` rows of a task: nothing is shuffled, and no
    array is held, whatever its size.
    """
    ex = to_export(history)
    texts = ex.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in ex.columns])).alias("value"))
    plays = texts.mapInArrow(_bracketed(rows_per_file), "value string")
    plays.write.mode("append").options(**FAST_PACKING).option("maxRecordsPerFile", rows_per_file).text(path, compression=compression, lineSep=" ")


def union_parts(parts: Iterable[DataFrame]) -> DataFrame:
    """Concatenate raw or normalised frames by column name."""
    it = iter(parts)
    out = next(it)
    for p in it:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
