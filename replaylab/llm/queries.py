"""The ``opN_<name>`` queries: each operator over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from replaylab.llm import ann, bpe, chat, cyk, importance, language, licenses, line_dedup, packing, quality, rollups, simhash, warc
from replaylab.llm._common import scratch, stored, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, read back, and merged into one capture index."""
    return warc.capture_history(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
        "urlkey", "captured", "archive", "offset", "shard", "position")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text encoded and decoded by trie traversal, as digests."""
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), WORD_BPE, decoded=True))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics, base rules and model verdict."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's canonical digest, looked up among the known licences."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash fingerprint and near-duplicate component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and one more that says control strings; read back from the output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"),
                              F.lit("</s>[INST] ok [/INST]").alias("text")) for i, role in enumerate(("user", "assistant"))))
    stream = stored(chat.segments(turns.unionByName(spark.range(1).select(F.inline(more)))), "chat")
    return chat.digests(stream)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer version, maintained through batches.

    All documents are inserted with their counts; exact copies (all but the smallest id of a text) are deleted again; the counts of
    those that stay are revised to include an end id.  The second batch is committed twice, which changes nothing.
    """
    docs = table(spark, sf_dir, "documents").withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    counts = stored(bpe.encode(docs, BYTE_BPE, keep=("doc_id", "source", "lang", "digest"), with_ids=False, kind=bpe.RankBPE)
                    .withColumn("tokenizer", F.lit("byte_bpe_50k")), "token-counts")
    # Stored, so that the join stands alone and Spark can split a text that a third of all rows share.
    first = stored(counts.groupBy("digest").agg(F.min("doc_id").alias("first_id")), "token-first")
    rows = counts.join(first, "digest")
    change = lambda df, kind: df.withColumns({"change": F.lit(kind), "old_tokens": F.col("n_tokens")})
    store = rollups.TokenRollup(spark, scratch(spark, "token-rollup"))
    store.commit("1-insert", change(counts, "insert"))
    copies = change(rows.where("doc_id != first_id"), "delete")
    store.commit("2-copies", copies)
    store.commit("2-copies", copies)
    store.commit("3-end-id", change(rows.where("doc_id = first_id"), "revise").withColumn("n_tokens", F.col("n_tokens") + 1))
    return store.totals()


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines, as digests."""
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces packed into sequences of 1024 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    return ann.knn(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance weight towards the benchmark texts, and the drawn documents' ranks."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank", "n_words")


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language, learned from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by a fixed rule, with its faults counted and its cheapest repair."""
    return cyk.digests(cyk.damage(table(spark, sf_dir, "conversations")), table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_bpe, op3_quality, op4_licenses, op5_simhash, op6_chat, op7_token_counts, op8_line_dedup,
                            op9_packing, op10_ann, op11_importance, op12_language, op13_repair)
}

_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP_CTE = f"""
rows AS (SELECT *, row_number() OVER () AS rid FROM {{docs}}),
split AS (SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth FROM rows),
keyed AS (SELECT *, {_ASCII_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM split),
held AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT rid) >= 3),
cleaned AS (SELECT k.rid, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
                   coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT lost), '') AS kept
            FROM (SELECT keyed.*, held.key IS NOT NULL AND keyed.doc_id IS DISTINCT FROM held.keeper AS lost
                  FROM keyed LEFT JOIN held ON keyed.key = held.key) k GROUP BY k.rid)"""

#: Template of op6 in SQL; ``chat`` has the same in DataFrame functions.
_ESCAPED = f"regexp_replace({{}}, '([<\\[])({chat.JOINER}*)({chat._TAILS})', '\\1\\2{chat.JOINER}\\3', 'g')"

ORACLE: dict[str, str] = {
    "op4_licenses": licenses.scan_sql(),
    "op6_chat": f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum({len(chat.START) + len(chat.END) + 2} + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op8_line_dedup": f"""
WITH {LINE_DEDUP_CTE.format(docs="documents")}
SELECT rows.doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(kept) AS kept_sha256 FROM cleaned JOIN rows USING (rid)""",
}
