"""WARC archives with revisit records, and an external merge of their capture index (operator 1).

Method.
1. *Write.*  Each row becomes a WARC/1.1 record, a gzip member of its own.  Records with equal payloads (by digest and
   length, from ``min_revisit_bytes`` on) hold the payload once: the largest id is the response, the others are revisit records
   that refer to it.  Tasks fill archives of about ``ARCHIVE_BYTES``; Spark's text writer stores each archive
   as one file in the shared folder.
2. *Read back.*  Each archive is parsed record by record; payloads are digested again.  Its captures, sorted by URL
   key, timestamp and id, are one locally sorted run.
3. *External merge.*  The runs are dealt to ranges of (URL key, timestamp, id, run, place) found by sampling, so one URL with a third
   of all captures spreads over many ranges.  Each task merges the runs' slices of its range with a loser tree;
   ``shard`` and ``position`` give the global order of the capture histories.

Defined results: a null payload is empty, a null URL is the empty URL (key ``""``).  A row whose id is null never becomes a response that
others refer to; equal payloads that all lack ids are all responses.  Rows repeating id and payload are all responses if that id is the largest.
Without a timestamp column a capture's time is ``EPOCH`` plus its id in seconds (a null id: plus nothing).  Control characters in a URL
are percent-encoded in the archive.  Extra columns are not read, whatever their names.  An empty table writes no archive and
gives none.  A very long payload gets an archive of its own.
"""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from replaylab.llm._common import scratch, slices, stored
from replaylab.llm.losers import merge

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 8 << 20
RANGE_CAPTURES = 50_000
EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
LEVEL = 4
_STEP = 1 << 14

ENTRY = ("run string, place int, urlkey string, captured long, page_id long, url string, archive string, offset long, "
         "length long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, then path and query; scheme, ``www.``, user, default port and fragment don't count."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url
    if not host:
        return url
    host = re.sub(r"^www\d*\.", "", host)
    shown = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    query = "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    return f"{shown}){(parts.path or '/').lower()}" + (f"?{query}" if query else "")


def record(page_id: int | None, url: str, captured: int, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; a revisit has no block."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    when = (EPOCH + dt.timedelta(seconds=captured)).strftime("%Y-%m-%dT%H:%M:%SZ")
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {safe}",
            f"WARC-Date: {when}", f"X-Capture-Seconds: {captured}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
            "Content-Type: text/html", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def parse(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive."""
    at = 0
    while at < len(archive) and archive[at:at + 2] == b"\x1f\x8b":  # the writer ends a file with a line end
        member = zlib.decompressobj(31)
        parts, end = [], at
        while not member.eof and end < len(archive):  # in steps, as what lies behind the member is copied
            parts.append(member.decompress(archive[end:end + _STEP]))
            end += min(_STEP, len(archive) - end)
        whole, length = b"".join(parts), end - at - len(member.unused_data)
        head, _, rest = whole.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        block = rest[:int(headers["Content-Length"])]
        if rest[len(block):] != b"\r\n\r\n":
            raise ValueError(f"bad record length at {at}")
        yield at, length, headers, block
        at += length


def _number(header: str) -> int | None:
    found = header[len("<urn:page:"):-1]
    return int(found) if found else None


def write_archives(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", timestamp: str | None = None,
                   min_revisit_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of ``df`` into archives below ``path`` (seconds since 1970 in ``timestamp``, if there is one)."""
    origin = int(EPOCH.timestamp())
    captured = F.coalesce(F.col(timestamp) - origin if timestamp else F.col(key), F.lit(0)).cast("long")
    body = F.coalesce(F.encode(F.col(payload), "utf-8") if dict(df.dtypes)[payload] == "string" else F.col(payload), F.lit(b""))
    rows = df.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), captured.alias("captured"),
                     body.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    # One row per repeated payload, counted map-side; Spark chooses the join by the sizes it finds.  Stored, so that
    # the join stands alone and Spark can split a payload that a third of all rows share.
    shared = stored((rows.where(F.col("size") >= min_revisit_bytes).groupBy("digest", "size")
              .agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")), "warc-shared")
    told = rows.join(shared, ["digest", "size"], "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")))
    told = told.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, "payload"):
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "captured", "payload", "digest", "size", "refers_to")]
            for row in zip(*columns):
                made = record(*row)
                if held and size + len(made) > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
                    held, size = [], 0
                held.append(made)
                size += len(made)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    made = told.select("page_id", "url", "captured", "payload", "digest", "size", "refers_to").mapInArrow(archives, "archive binary")
    # The text writer stores a cell's bytes as they are and a line end after them; one cell is one archive file.
    made.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of the archives below ``path``: each archive's captures are one sorted run, ``place`` their order in it."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                file, entries = name.rsplit("/", 1)[-1], []
                for offset, length, headers, block in parse(content.as_buffer().to_pybytes()):
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(headers["X-Payload-Length"])
                    if kind == "response" and (hashlib.sha1(block).hexdigest() != digest or len(block) != size):
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} in {file} doesn't match its digest")
                    page, refers = _number(headers["WARC-Record-ID"]), headers.get("WARC-Refers-To")
                    url = headers["WARC-Target-URI"]
                    entries.append((url_key(url), int(headers["X-Capture-Seconds"]), page, url, file, offset, length, size, digest, kind,
                                    _number(refers) if refers else None))
                entries.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0, e[5]))
                for at in range(0, len(entries), 8192):
                    part = entries[at:at + 8192]
                    columns = list(zip(*part))
                    arrays = [pa.array([file] * len(part)), pa.array(np.arange(at, at + len(part), dtype=np.int32))]
                    for values, kind_ in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(),
                                                       pa.int64(), pa.string(), pa.string(), pa.int64())):
                        arrays.append(pa.array(values, kind_))
                    yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in ENTRY.split(", ")])

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option(
        "pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(index, ENTRY)


def merged(runs: DataFrame, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """The stored sorted ``runs`` in global order: (shard, position) and all columns of the entries."""
    n_ranges = max(1, -(-runs.count() // range_captures))
    names = runs.columns
    keys = [names.index(c) for c in ("urlkey", "captured", "page_id", "run", "place")]

    def merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()  # a bounded range, sorted by run and place
        run = table["run"].combine_chunks().dictionary_encode().indices.to_numpy()
        starts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
        urlkey, captured, page, runs_, place = (table.column(k).to_pylist() for k in keys)

        def slice_of(a: int, b: int) -> Iterator[tuple]:
            for i in range(a, b):
                yield urlkey[i], captured[i], page[i] is not None, page[i] or 0, runs_[i], place[i], i

        order = [item[-1] for _, item in merge([slice_of(a, b) for a, b in zip(starts[:-1], starts[1:])])]
        out = table.take(pa.array(order))
        shard = TaskContext.get().partitionId()
        out = out.append_column("shard", pa.array(np.full(len(order), shard, dtype=np.int32)))
        out = out.append_column("position", pa.array(np.arange(len(order), dtype=np.int64)))
        yield from out.combine_chunks().to_batches(max_chunksize=8192)

    ranged = runs.repartitionByRange(n_ranges, "urlkey", "captured", "page_id", "run", "place")
    schema = T.StructType(list(runs.schema)).add("shard", "integer").add("position", "long")
    return ranged.sortWithinPartitions("run", "place").mapInArrow(merge_range, schema)


def capture_history(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` into archives, read them back, and merge their runs into one ordered capture index."""
    spark = df.sparkSession
    path = scratch(spark, "warc")
    write_archives(df, path, **options)
    return merged(stored(capture_runs(spark, path), "warc-runs"))
