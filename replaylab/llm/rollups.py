"""Token counts as delta-maintained rollups (operator 7).

Method.  Totals by source, language and tokenizer version are never recomputed: each batch of changes is summed into signed
deltas (an insert adds a document and its tokens, a delete takes them away, a revised count adds the difference), and totals
are the sum of all committed batches.  Additive sums are combined map-side, so a source with a third of all rows costs
one row per task.  A batch is published by marker: committing a batch again replaces it, so a retry, or a batch that is
delivered twice, changes nothing, and one that dies on the way is never seen.  ``compact`` folds many batches' files into few.

Defined results: null sources, languages and tokenizers are groups of their own.  Null counts count zero tokens.  Repeated rows are
changes of their own.  An unknown kind of change is an error.  Groups whose documents and tokens are all zero again are left
out of the totals.  Extra columns are not read, whatever their names.  Empty batches, and a store without any, are fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from replaylab.sources import published

GROUP = ("source", "lang", "tokenizer")
_DELTAS = T.StructType([*(T.StructField(c, T.StringType()) for c in GROUP), *(T.StructField(c, T.LongType()) for c in ("n_docs", "n_tokens"))])


def signed(changes: DataFrame) -> DataFrame:
    """(source, lang, tokenizer, n_docs, n_tokens): signed sums of (change, source, lang, tokenizer, n_tokens, old_tokens) rows."""
    new, old = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_tokens", "old_tokens"))
    change = F.col("change")
    docs = F.when(change == "insert", 1).when(change == "delete", -1).when(change == "revise", 0)
    tokens = F.when(change == "insert", new).when(change == "delete", -new).when(change == "revise", new - old)
    wrong = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(change, F.lit("null"))))
    return changes.groupBy(*GROUP).agg(F.sum(F.coalesce(docs, wrong.cast("int"))).cast("long").alias("n_docs"), F.sum(tokens).alias("n_tokens"))


def differences(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Change rows that lead from per-document counts ``old`` to ``new`` ((key, source, lang, tokenizer, n_tokens), key and tokenizer unique).

    A document that changed its source or language is a delete and an insert.
    """
    o = old.select(F.struct(key, *GROUP, "n_tokens").alias("o"))
    n = new.select(F.struct(key, *GROUP, "n_tokens").alias("n"))
    both = o.join(n, F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")) & F.col("o.tokenizer").eqNullSafe(F.col("n.tokenizer")), "full")
    stays = F.col("o").isNotNull() & F.col("n").isNotNull() & F.col("o.source").eqNullSafe(F.col("n.source")) & F.col("o.lang").eqNullSafe(F.col("n.lang"))
    row = lambda change, side, before: F.struct(F.lit(change).alias("change"), *(F.col(f"{side}.{c}").alias(c) for c in GROUP),
                                                F.col(f"{side}.n_tokens").alias("n_tokens"), before.alias("old_tokens"))
    none = F.lit(None).cast("long")
    rows = F.when(stays, F.array(row("revise", "n", F.col("o.n_tokens")))).otherwise(F.filter(F.array(
        F.when(F.col("o").isNotNull(), row("delete", "o", none)), F.when(F.col("n").isNotNull(), row("insert", "n", none))), lambda x: x.isNotNull()))
    return both.select(F.inline(rows))


class TokenRollup:
    """Totals in a shared folder, maintained by batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, batch_id: str, changes: DataFrame) -> None:
        """Add one batch of changes; the same batch id again replaces that batch."""
        if not batch_id or not all(c.isalnum() or c in "-_." for c in batch_id):
            raise ValueError(f"bad batch id {batch_id!r}")
        deltas = signed(changes).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in _DELTAS))
        published.publish(deltas, self.path, batch_id, column="batch")

    def compact(self) -> int:
        """Rewrite all batches' deltas into few files; batches keep their ids."""
        return published.compact(self.spark, self.path, _DELTAS, column="batch")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches; none before the first."""
        deltas = published.read(self.spark, self.path, _DELTAS, column="batch")
        if deltas is None:
            deltas = self.spark.createDataFrame([], _DELTAS)
        return (deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .where("n_docs != 0 or n_tokens != 0"))
