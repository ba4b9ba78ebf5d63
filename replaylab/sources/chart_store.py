"""Maintained monthly charts (C01, C04-C11): a chart that follows uploads without rescanning the history.

    <store>/attempt=<random>/part=<delta|top>/year=YYYY/    published by marker, one attempt per upload (``published``)

Each upload stores two kinds of rows, made live by one marker:

* ``delta``: its own ms and streams per (by, month, entity) - additive, so totals are sums over live uploads, and an upload
  that is committed again takes its old share back by replacing it;
* ``top``: the new list of each (by, month) group that the upload touches, with the commit's version.  A reader takes the newest
  version of a group; a group that lost its last row is stored as one empty entry (``rank`` 0).

A commit reads the upload's plays once, then only the years of the store that it touches, cut down to the touched groups.  Which
groups an upload touches: those of its new rows, and those where its replaced attempt had rows or lists.  Gap months are carried
on reading, from the lists alone, so a late upload between two known months re-carries by itself.  Lifetime totals are sums over
the deltas of entities that chart.  One writer at a time; a commit that dies on the way changes nothing.

Rows without a date count in lifetime totals and in the fallback list; rows whose first key is null count nowhere (as in ``Chart``).
An empty upload is a valid one; a store without any gives empty charts.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replaylab.operators import charts as C
from replaylab.operators._common import By, by_list, materialize, null_safe_join
from replaylab.sources import published

FOLDERS = T.StructType([T.StructField("part", T.StringType()), T.StructField("year", T.IntegerType())])
UNIT = "upload"


class ChartStore:
    """The maintained chart of one entity kind, with lists of ``limit`` places per month."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = C.ARTIST, limit: int = 10, by: By = (), tz: str | None = None):
        if limit < 1:
            raise ValueError("limit must be >= 1")
        self.spark, self.path, self.tz = spark, path.rstrip("/"), tz
        self.keys, self.limit, self.by = list(keys), limit, by_list(by)
        self.groups = [*self.by, "month_start"]
        texts = [T.StructField(c, T.StringType()) for c in [*self.by, *self.keys]]
        self.schema = T.StructType([*texts, T.StructField("month_start", T.DateType()), T.StructField("ms", T.LongType()),
                                    T.StructField("streams", T.LongType()), T.StructField("rank", T.IntegerType()),
                                    T.StructField("version", T.LongType())])

    # -------------------------------------------------------------- reading

    def _rows(self, part: str) -> DataFrame:
        rows = published.read(self.spark, self.path, self.schema, FOLDERS, UNIT)
        if rows is None:
            empty = T.StructType([*self.schema.fields, T.StructField(UNIT, T.StringType()), *FOLDERS.fields])
            rows = self.spark.createDataFrame([], empty)
        return rows.where(F.col("part") == part)

    def _total(self, deltas: DataFrame) -> DataFrame:
        return deltas.groupBy(*self.groups, *self.keys).agg(F.sum("ms").alias("ms"), F.sum("streams").cast("bigint").alias("streams"))

    def entity_months(self) -> DataFrame:
        """C01 from the deltas: the same rows as ``charts.entity_months`` of all live uploads' plays."""
        return self._total(self._rows("delta"))

    def top(self) -> DataFrame:
        """The newest list of each group (by, month_start, keys, ms, streams, rank)."""
        w = Window.partitionBy(*self.groups)
        newest = self._rows("top").withColumn("__newest", F.max("version").over(w))
        return newest.where((F.col("version") == F.col("__newest")) & (F.col("rank") > 0)).select(*self.groups, *self.keys, "ms", "streams", "rank")

    def chart(self, limit: int | None = None) -> MaintainedChart:
        """C05-C11 over the stored lists; ``limit`` may be smaller than the store's."""
        if limit is not None and not 1 <= limit <= self.limit:
            raise ValueError(f"limit must be between 1 and the store's {self.limit}")
        return MaintainedChart(self, limit or self.limit)

    # -------------------------------------------------------------- writing

    def commit(self, h: DataFrame, upload: str) -> int:
        """Add the plays ``h`` as ``upload``, in place of an earlier commit of that id; returns the number of lists ranked anew."""
        own = materialize(C.entity_months(h, self.keys, self.by, self.tz).withColumn("year", F.year("month_start")))
        deltas, lists = self._rows("delta"), self._rows("top")
        mine = F.col(UNIT) == upload
        before = deltas.where(mine).select(*self.groups, "year").unionByName(lists.where(mine).select(*self.groups, "year"))
        touched = materialize(own.select(*self.groups, "year").unionByName(before)
                              .where(F.col("month_start").isNotNull()).distinct())
        # A list of calendar years: bounded, and it prunes the folders of all others.
        years = [r.year for r in touched.select("year").distinct().collect()]
        others = deltas.where(~mine & F.col("year").isin(years)).select(*self.groups, *self.keys, "ms", "streams")
        others = null_safe_join(others, touched.drop("year"), self.groups, how="left_semi")
        dated = own.where(F.col("month_start").isNotNull()).select(*others.columns)
        ranked = C.monthly_top(self._total(others.unionByName(dated)), self.keys, self.limit, self.by)
        version = time.time_ns() // 1000
        new = null_safe_join(touched, ranked, self.groups, how="left")
        new = new.withColumns({"rank": F.coalesce("rank", F.lit(0)), "version": F.lit(version), "part": F.lit("top")})
        gone = {"rank": F.lit(None).cast("int"), "version": F.lit(version), "part": F.lit("delta")}
        columns = [*(f.name for f in self.schema.fields), "part", "year"]
        published.publish(own.withColumns(gone).select(*columns).unionByName(new.select(*columns)), self.path, upload, ("part", "year"), UNIT)
        return touched.count()

    def compact(self) -> int:
        """Rewrite all live uploads into few files per year, with the newest list of each group only; returns how many uploads are live."""
        w = Window.partitionBy("part", *self.groups)

        def newest(rows: DataFrame) -> DataFrame:
            kept = rows.withColumn("__newest", F.max(F.when(F.col("part") == "top", F.col("version"))).over(w))
            return kept.where((F.col("part") == "delta") | (F.col("version") == F.col("__newest"))).drop("__newest")

        return published.compact(self.spark, self.path, self.schema, FOLDERS, UNIT, (*self.by, "month_start"), keep=newest)


class MaintainedChart(C.Chart):
    """A :class:`charts.Chart` whose top lists and totals come from a :class:`ChartStore`; no play is read."""

    def __init__(self, store: ChartStore, limit: int):
        self.store, self.keys, self.limit, self.by, self.tz = store, store.keys, limit, store.by, store.tz
        self.entity_months = store.entity_months()
        self.monthly = C.monthly_totals(self.entity_months)

    @cached_property
    def top(self) -> DataFrame:
        """The stored lists with each listed entity's lifetime totals (summed before the join, so a hot entity is one row)."""
        listed, entity = self.store.top().where(F.col("rank") <= self.limit), [*self.by, *self.keys]
        return materialize(null_safe_join(listed, self.lifetime, entity, how="left"))

    @property
    def ranges(self) -> DataFrame:
        return C.month_ranges(self.top, self.by)

    def fallback(self) -> DataFrame:
        """C11: the lifetime top of groups without a dated row."""
        undated = self.lifetime if not self.by else null_safe_join(self.lifetime, self.ranges.select(*self.by), self.by, how="left_anti")
        if not self.by and self.ranges.take(1):
            undated = undated.limit(0)
        return C.top_of_lifetime(undated, self.keys, self.limit, self.by)
