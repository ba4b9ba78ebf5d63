"""Chat formatting by prefix-target expansion, in DataFrame functions only (operator 6).

Method.  A conversation's turns are written once, in order, as *segments* of one formatted stream.  Every assistant turn is
exploded into an example of its own: all turns before it are context and only that reply is trainable.  An example's
text is a prefix of its conversation's stream, so ``examples`` gives it as offsets into the stream: context ``[0, loss_start)``, trainable
``[loss_start, loss_end)``.  That keeps the output linear in the input, also for a conversation that holds a third of
all rows; ``render`` writes the examples' texts out, which is quadratic in a conversation's length by nature.

Template: ``<|start|>role`` line end, text, ``<|end|>`` line end.  Control strings inside a text, this template's or those of other common
ones, get an invisible word joiner behind their first character; joiners already there are kept, so unescaping gives
the very text back.

Defined results: a null text is empty, a null role is the empty role (not trainable).  Turns are ordered by turn number (null first), then
role, then text; repeated rows are turns of their own.  A null conversation id is a conversation of its own.  Offsets count code
points.  Other columns are not read, whatever their names.  An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|start|>", "<|end|>"
TRAINABLE = "assistant"
JOINER = "⁠"
#: The tails of control strings, behind their first character ``<`` or ``[``.
_TAILS = r"\||/?s>|/?INST\]|</?SYS>>"
#: Turns per bucket: offsets are summed within buckets, then over buckets, so a long conversation is shared by many tasks.
BUCKET_TURNS = 256


def escape(text: Column) -> Column:
    """Control strings in a text made harmless, reversibly."""
    return F.regexp_replace(text, rf"([<\[])({JOINER}*)({_TAILS})", rf"$1$2{JOINER}$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]){JOINER}({JOINER}*)({_TAILS})", "$1$2$3")


def _escape_role(role: Column) -> Column:
    """Roles stand on one line: line ends and backslashes are written as ``\\n`` and ``\\\\``."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    held = F.replace(unescape(role), F.lit("\\\\"), F.lit("\n"))  # a written role has no line end, so it can stand for a backslash
    return F.replace(F.translate(held, "\n\\", "\\\n"), F.lit("\nn"), F.lit("\n"))


def segments(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn_no, trainable, segment, start, loss_start, end): the formatted stream's pieces, offsets from 0.

    ``turn_no`` counts from 0; ``loss_start`` is where the text begins and ``end - length('<|end|>') - 1`` where it ends.
    """
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                     F.coalesce(F.col(text), F.lit("")).alias("text"))
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select("conv", "turn", "role", "text", F.floor(F.col("turn") / BUCKET_TURNS).alias("bucket"),
                       (F.col("role") == TRAINABLE).alias("trainable"), head.alias("head"))
    rows = rows.withColumn("segment", F.concat("head", escape(F.col("text")), F.lit(END + "\n")))
    rows = rows.withColumn("size", F.length("segment").cast("long"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    within = Window.partitionBy("conv", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"at": F.coalesce(F.sum("size").over(within), F.lit(0)), "nth": F.count("*").over(within)})
    # Whole buckets before a turn's own: one row per bucket.
    before = Window.partitionBy("conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv", "bucket").agg(F.sum("size").alias("size"), F.count("*").alias("n")).select(
        F.col("conv").alias("c"), F.col("bucket").alias("b"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_n"))
    placed = rows.join(sums, rows.conv.eqNullSafe(sums.c) & rows.bucket.eqNullSafe(sums.b))
    start = F.col("base") + F.col("at")
    return placed.select("conv", (F.col("base_n") + F.col("nth")).alias("turn_no"), "trainable", "segment", start.alias("start"),
                         (start + F.length("head")).alias("loss_start"), (start + F.col("size")).alias("end"))


def examples(stream: DataFrame) -> DataFrame:
    """(conv, example, context_end, loss_start, loss_end, reply): one row per assistant turn; offsets into its stream.

    ``example`` is the reply's turn number; the example's text is the stream up to ``loss_end``, its context what stands before
    ``loss_start``; ``reply`` is what the loss mask covers, as formatted.
    """
    loss_end = F.col("end") - len(END) - 1
    return stream.where("trainable").select(
        "conv", F.col("turn_no").alias("example"), F.col("start").alias("context_end"), "loss_start", loss_end.alias("loss_end"),
        F.substring("segment", (F.col("loss_start") - F.col("start") + 1).cast("int"), (loss_end - F.col("loss_start")).cast("int")).alias("reply"))


def render(stream: DataFrame) -> DataFrame:
    """(conv, example, text, loss_start, loss_end): the examples written out, each with its whole context.

    The output is as large as all prefixes together, and a conversation is gathered in one row.
    """
    whole = stream.groupBy("conv").agg(F.array_join(F.array_sort(F.collect_list(F.struct("start", "segment"))).segment, "").alias("stream"))
    wanted = examples(stream).drop("reply")
    whole = whole.withColumnRenamed("conv", "c")
    return wanted.join(whole, wanted.conv.eqNullSafe(whole.c)).select(
        "conv", "example", F.substring("stream", F.lit(1), F.col("loss_end").cast("int")).alias("text"), "loss_start", "loss_end")


def read_back(stream: DataFrame) -> DataFrame:
    """(conv, turn_no, role, text, end): turns parsed from the formatted segments alone."""
    body = F.expr(f"substring(segment, {len(START) + 1}, length(segment) - {len(START) + len(END) + 1})")
    parts = stream.select("conv", "turn_no", "end", body.alias("body"), F.instr(body, "\n").alias("cut"))
    return parts.select("conv", "turn_no", _unescape_role(F.expr("substring(body, 1, cut - 1)")).alias("role"),
                        unescape(F.expr("substring(body, cut + 1)")).alias("text"), "end")


def digests(stream: DataFrame) -> DataFrame:
    """Per conversation, read back from a stored stream and its examples: the contract's columns.

    The contract's digests are over a conversation's whole text, so its turns and replies meet in one row here, and only here.
    """
    none = F.lit(None).cast("long")
    turns = read_back(stream).select("conv", F.struct(F.lit("turn").alias("kind"), F.col("turn_no").alias("n"), F.concat(
        "role", F.lit("\n"), "text", F.lit("\n")).alias("piece")).alias("p"), "end")
    replies = examples(stream).select("conv", F.struct(F.lit("reply").alias("kind"), F.col("example").alias("n"), unescape(
        F.col("reply")).alias("piece")).alias("p"), none.alias("end"))
    grouped = turns.unionByName(replies).groupBy("conv").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.max("end").alias("end"))

    def all_of(kind: str) -> Column:
        return F.filter("ps", lambda p: p["kind"] == kind)["piece"]

    loss = F.array_join(all_of("reply"), "")
    return grouped.select(
        F.col("conv").alias("conv_id"), F.size(all_of("turn")).cast("long").alias("n_turns"),
        F.sha2(F.array_join(all_of("turn"), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.col("end").alias("formatted_chars"))
