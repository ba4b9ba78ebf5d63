"""Large export files, whatever their layout, split at closing braces.

Spark's text reader splits a file at any separator, so a file read with ``}`` as
its separator becomes *fragments* that parse on many executors: one-line
arrays, pretty-printed arrays and newline-delimited objects alike.

* A fragment is a play if, with its brace put back, it is one whole object with
  only a separator before it.  A fragment that begins inside a text can't be
  one: quotes in a text are escaped, which no object's first key is.
* Other fragments (a brace within a text, objects within objects, damage) are
  rare.  Neighbours among them are joined again, in file order, and the
  objects of the joined text are taken out by :func:`~replaylab.sources.export_json.salvaged`.
* What stands between objects must be a comma, a line end or, before the first
  object, an array's opening bracket; anything else is a problem, as is an
  array that isn't closed.

Whole plays never leave the task that read them.  Only fragments in need of
joining are shuffled and sorted by file; a row per file is broadcast.  Strays
are looked for without parsing what a pattern shows to be whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replaylab.schema import RAW
from replaylab.sources import export_json as E

#: Before an object: a comma or a line end, or the beginning of the file or of an array.
_BETWEEN = r"^(\s*,\s*|\s*\n\s*)$"
_BEGIN = r"^﻿?\s*\[?\s*$"
#: After the last object.
_END = r"^\s*,?\s*\]?\s*$"

#: An object of plain scalars, strict JSON without escapes or nesting: what any parser takes, so it needs no parsing to be known as whole.
_TEXT = r'"[^"\\{}\x00-\x1f]*+"'
_PAIR = r"[ \t\r\n]*+" + _TEXT + r"[ \t\r\n]*+:[ \t\r\n]*+(?:" + _TEXT + r"|-?(?:0|[1-9]\d{0,17}+)(?:\.\d{1,17}+)?+|true|false|null)[ \t\r\n]*+"
_FLAT = r"^\{" + _PAIR + "(?:," + _PAIR + r"){0,99}+\}$"
#: Longer objects are parsed, whatever they look like.
_FLAT_BYTES = 20_000


def _as_problem(text: Column) -> Column:
    return F.array(F.struct(F.lit(None).cast(RAW).alias("play"), text.alias("problem"))).cast(T.ArrayType(E._ROW))


def parse_fragments(text: DataFrame, packed: DataFrame | None = None) -> DataFrame:
    """Rows of ``text`` read with ``}`` as line separator -> (file_name, problem, RAW columns...), like ``parse_export_text``.

    ``packed`` has the compressed files among them read with ``{`` as line separator: a file's size doesn't tell their text's.
    """
    rows = text.select(
        F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value")
    # All but a file's last fragment had a brace behind them.  Whether that one had is told by the file's size (the reader drops a
    # byte order mark, which is 3 bytes).  One small row per file is broadcast, so no fragment is shuffled for it.
    held = F.octet_length("value").cast("long") + 1
    counted = rows.groupBy("file_path", "block").agg(F.sum(held).alias("held"), F.max("size").alias("size"), F.max("pos").alias("pos"))
    if packed is None:
        counted = counted.withColumn("other", F.lit(None).cast("long"))
    else:
        other = packed.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.sum(held).alias("other"))
        counted = counted.unionByName(other, allowMissingColumns=True)
    ends = counted.groupBy("file_path").agg(F.sum("held").alias("held"), F.max("size").alias("size"), F.sum("other").alias("other"),
                                            F.max(F.when(F.col("pos").isNotNull(), F.struct("block", "pos"))).alias("last"))
    # The last piece has no separator behind it unless the text ends with one: of two separators, the one that ends it counts one less.
    ends = ends.withColumn("size", F.coalesce(F.col("other") - 1, "size"))
    ends = ends.where(~(F.col("held") - F.col("size")).isin(0, -3)).select(F.col("file_path").alias("path"), "last")
    rows = rows.drop("size").join(F.broadcast(ends), F.col("file_path") == F.col("path"), "left").withColumn(
        "cut", F.coalesce(F.struct("block", "pos") == F.col("last"), F.lit(False))).drop("path", "last")
    lead = F.when(F.instr("value", "{") > 0, F.substring_index("value", "{", 1)).otherwise("")
    body = F.when(F.instr("value", "{") > 0, F.concat(F.substr("value", F.instr("value", "{")), F.lit("}")))
    rows = rows.select("*", lead.alias("lead"), body.alias("body"))
    between = F.col("lead").rlike(_BETWEEN)
    stands = F.col("body").contains('"') & (between | F.col("lead").rlike(_BEGIN))
    listed = F.from_json(E._closed(F.col("body")), E._MARKED)
    first = F.try_element_at("list", F.lit(1))
    one = (F.size("list") == 2) & E._ended(F.col("list"), F.col("body")) & first.isNotNull()
    parsed = rows.withColumn("list", F.when(stands, listed))
    whole = F.coalesce(one & ~F.col("cut"), F.lit(False))

    # Rows are chosen by explode, not by a filter: Spark would push a filter below "list" and parse each fragment once per mention.
    plays = parsed.select("file_name", F.explode(F.when(whole, F.array(E._fields(first)))).alias("play")).select(
        "file_name", F.lit(None).cast("string").alias("problem"), "play.*")

    flat = stands & (F.octet_length("body") < _FLAT_BYTES) & F.col("body").rlike(_FLAT)
    judged = rows.withColumn("flat", F.coalesce(flat, F.lit(False)))
    judged = judged.withColumn("list", F.when(stands & ~F.col("flat"), listed))
    whole = F.coalesce((F.col("flat") | one) & ~F.col("cut"), F.lit(False))
    # Strays, and whole objects that stand where only a file's first one may: one per file at most, and in its first block.
    seen = F.struct("file_name", "file_path", "block", "pos", "cut", F.when(whole, F.col("lead")).alias("lead"), (~whole).alias("stray"),
                    F.when(~whole, F.col("value")).alias("value"))
    odd = judged.select(F.explode(F.when(~whole | ~between, F.array(seen))).alias("o")).select("o.*")
    order = Window.partitionBy("file_path").orderBy("block", "pos")
    before = F.lag(F.struct("block", "pos", "stray")).over(order)
    joined = F.col("stray") & before["stray"] & F.when(before["block"] == F.col("block"), F.col("pos") == before["pos"] + 1).otherwise(True)
    odd = odd.withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("nth", F.sum("new").over(order))
    runs = odd.groupBy("file_path", "nth").agg(
        F.first("file_name").alias("file_name"), F.first("stray").alias("stray"), F.first("lead").alias("lead"), F.max("cut").alias("tail"),
        F.array_join(F.array_sort(F.collect_list(F.struct("block", "pos", "value"))).value, "}").alias("text"))

    # A run that isn't a file's end had a brace behind it too.
    tail = F.col("tail")
    text_of = F.when(tail, F.col("text")).otherwise(F.concat("text", F.lit("}")))
    found = E.salvaged(text_of)
    rest = F.element_at(found, -1)["problem"]
    marks = F.regexp_replace(rest, r"[\s,]+", "")
    allowed = F.when(tail, marks.isin("", "]", "[", "[]") | F.col("text").rlike(_END)).otherwise(marks.isin("", "["))
    parts = F.when(~F.col("stray") & (F.col("nth") > 1), _as_problem(F.concat(F.lit("no separator: "), F.coalesce("lead", F.lit("")))))
    parts = parts.when(F.col("stray") & allowed, F.slice(found, 1, F.size(found) - 1)).when(F.col("stray"), found)

    # Arrays that begin and don't end: their last objects may be missing.  Told beside a file's last run.
    file = Window.partitionBy("file_path")
    opened = F.count_if(F.col("lead").contains("[") | (F.col("stray") & (F.col("nth") == 1) & F.col("text").rlike(r"^﻿?\s*\["))).over(file)
    closed = F.max(F.when(tail, F.col("text").rlike(r"\]\s*$")).otherwise(False)).over(file)
    unclosed = (F.col("nth") == F.max("nth").over(file)) & (opened > 0) & ~closed
    runs = runs.withColumn("unclosed", F.when(unclosed, _as_problem(F.lit("the array is not closed"))).otherwise(F.array().cast(T.ArrayType(E._ROW))))
    # Opening objects that stand first are plays already: no part of theirs is left.
    parts = F.concat(F.coalesce(parts, F.array().cast(T.ArrayType(E._ROW))), F.col("unclosed"))
    repaired = runs.select("file_name", F.explode(parts).alias("r")).select("file_name", F.col("r.problem").alias("problem"), "r.play.*")
    return plays.unionByName(repaired)
