"""Conversation structure repair by weighted CYK interval parsing (operator 13).

Method.  A repaired conversation's role initials match ``(s?(ua)+)?``.  As an automaton: state 0 is the beginning, 1 follows ``s``,
2 follows ``u``, 3 follows ``a``; 0 and 3 may end.  The repair grammar in Chomsky normal form has one symbol ``[p,q]`` per pair of
states, which derives whatever leads from ``p`` to ``q``:

* ``[p,r] -> [p,q] [q,r]`` costs nothing;
* ``[p,q] -> row`` is one row kept, re-roled or deleted, with its cost;
* ``[p,q] -> nothing`` is what insertions alone reach: the *insertion closure*, applied around each row once.

A cell holds, for one span of rows, each symbol's cheapest derivation as (cost, audit), the smaller audit breaking ties; ``audit`` is
the edits' initials.  On one span equal costs mean that neither audit is a beginning of the other (an audit's letters fix its cost,
and a longer one has only more insertions), so the least audit of a span is put together from the least audits of its parts.
Since ``[p,r]`` splits at every row alike, one split per span is exact, and spans are combined bottom-up by length: rows, then pairs of
neighbours, then fours, and so on.

Scale.  Rows are sorted by range over (conversation, turn), so one conversation with a third of all rows spreads over many tasks.
They are parsed in blocks of ``BLOCK`` neighbours, each a short string of row symbols; blocks' cells are combined
``FAN_IN`` at a time in rounds until one cell is left per conversation.  Its derivation names the states between blocks, and each
block writes out its own rows from these.  Only the digests, which are over whole conversations, bring one together in one row.

Costs: keep 0, re-role to user or assistant 2, delete 3, insert an empty user or assistant text 2; a row that isn't deleted though its text
is cut off costs 1 more; blank rows and duplicates must be deleted.

Defined results: null turns come first; null roles and texts are read as one space; rows of equal turn are ordered by role, then
text.  Rows without a conversation id form one conversation.  Repeated rows are duplicates.  Roles count by their first letter.
Other columns are not read, whatever their names.  An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from replaylab.llm._common import stored

STATES = 4
START, ENDS = 0, (0, 3)
#: Where a kept initial leads.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
INSERT, REROLE, DELETE, CUT_OFF = 2, 2, 3, 1
ROLE = {"u": "user", "a": "assistant"}
#: Neighbouring rows parsed in one go, and cells combined in one go.
BLOCK_BITS = 8
FAN_IN = 64

#: {(p, q): (cost, audit)}, or with a third part: the states after each combined block.
Cell = dict


def _closure() -> Cell:
    """What insertions alone reach from each state: the shortest way of user and assistant turns."""
    out = {}
    for p in range(STATES):
        reached, at, cost, audit = {p: (0, "")}, p, 0, ""
        while True:
            at = next(STEP[at, x] for x in "ua" if (at, x) in STEP)
            cost, audit = cost + INSERT, audit + "I"
            if at in reached:
                break
            reached[at] = (cost, audit)
        out |= {(p, q): c for q, c in reached.items()}
    return out


CLOSURE = _closure()


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans: ``[p,r] -> [p,q] [q,r]``."""
    out: Cell = {}
    for (p, q), (cost, audit) in left.items():
        for r in range(STATES):
            more = right.get((q, r))
            if more is not None:
                found = (cost + more[0], audit + more[1])
                if (p, r) not in out or found < out[p, r]:
                    out[p, r] = found
    return out


@lru_cache(maxsize=64)
def row_cell(symbol: str) -> Cell:
    """One row's cell.  A symbol is the role's initial (``x``: any other), upper case if cut off; ``-`` must be deleted."""
    rows: Cell = {(p, p): (DELETE, "D") for p in range(STATES)}
    if symbol != "-":
        cut_off = CUT_OFF * symbol.isupper()
        for (p, initial), q in STEP.items():
            if initial == symbol.lower():
                rows[p, q] = (cut_off, "K")
            elif initial in ROLE:
                rows[p, q] = (REROLE + cut_off, "R")
    return combine(combine(CLOSURE, rows), CLOSURE)


@lru_cache(maxsize=4_000)
def parse(symbols: str) -> Cell:
    """The cell of a block of rows, bottom-up by span length."""
    spans = [row_cell(x) for x in symbols]
    while len(spans) > 1:
        spans = [combine(*spans[i:i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0] if spans else CLOSURE


def combine_paths(cells: list[Cell]) -> Cell:
    """Neighbouring spans' cells with a third part, the states after each of their blocks, combined bottom-up by span length."""
    while len(cells) > 1:
        cells = [_with_path(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def _with_path(left: Cell, right: Cell) -> Cell:
    out: Cell = {}
    for (p, q), (cost, audit, path) in left.items():
        for r in range(STATES):
            more = right.get((q, r))
            if more is not None and ((p, r) not in out or (cost + more[0], audit + more[1]) < out[p, r][:2]):
                out[p, r] = (cost + more[0], audit + more[1], path + more[2])
    return out


def repaired_rows(audit: str, symbols: str, state: int) -> list[tuple[str, int | None, str | None]]:
    """(edit, row number or None if inserted, new role or None if kept) of a block's repaired turns; deleted rows are left out."""
    out, row = [], 0
    for edit in audit:
        if edit == "D":
            row += 1
            continue
        initial = symbols[row].lower() if edit == "K" else next(x for x in "ua" if (state, x) in STEP)
        state = STEP[state, initial]
        out.append((edit, None if edit == "I" else row, None if edit == "K" else ROLE[initial]))
        row += edit != "I"
    return out


# -- Spark ------------------------------------------------------------------------------------------


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of ``df`` with faults planted by the checksum of conversation and turn (nulls: one space)."""
    space = F.lit(" ")
    kind = F.pmod(F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))), F.lit(20))
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), space).alias("role"),
                     F.coalesce(F.col(text), space).alias("text"), kind.alias("kind")).where("kind != 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), "kind")
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(times).alias("copy")).drop("copy")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


#: Blanks: space and the ASCII control characters 9 to 13.
_BLANK = " \t\n\x0b\x0c\r"


def faults(df: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) in order, with seq, initial, ``fault`` (blank, duplicate, truncated or null) and symbol.

    Stored.  ``seq`` numbers rows in order, with gaps; neighbours with equal ``seq >> BLOCK_BITS`` form a block.
    """
    space = F.lit(" ")
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    rows = rows.withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # A range's bound holds the beginning of a text only; rows are sorted by the whole one.
    ranges = [*order[:2], F.substring("role", 1, 64), F.substring("text", 1, 64)]
    rows = stored(rows.repartitionByRange(*ranges).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()), "cyk-rows")
    first = rows.groupBy("conv_id", "said").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1").select(
        F.col("conv_id").alias("c"), F.col("said").alias("s"), "first")
    # Stored, so that the join stands alone and Spark can split a text that one conversation repeats over and over.
    first = stored(first, "cyk-repeated")
    rows = rows.join(first, rows.conv_id.eqNullSafe(first.c) & (rows.said == first.s), "left")
    text = F.rtrim("text", F.lit(_BLANK))
    fault = (F.when(text == "", "blank").when(F.col("seq") > F.col("first"), "duplicate")
             .when(~F.substring(text, -1, 1).isin(".", "!", "?"), "truncated"))
    rows = rows.select("conv_id", "turn", "role", "text", "seq", _initial(F.col("role")).alias("initial"), fault.alias("fault"))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    return stored(rows.withColumn("symbol", symbol), "cyk-faults")


def blocks(rows: DataFrame) -> DataFrame:
    """(conv_id, block, symbols, initials): at most ``2 ** BLOCK_BITS`` neighbouring rows of one conversation each."""
    grouped = rows.groupBy("conv_id", F.shiftright("seq", BLOCK_BITS).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "symbol", "initial"))).alias("r"))
    return grouped.select("conv_id", "block", F.array_join("r.symbol", "").alias("symbols"), F.array_join("r.initial", "").alias("initials"))


_CELL = "array<struct<p: int, q: int, cost: bigint, audit: string, path: array<int>>>"
_CELLS = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("path", pa.list_(pa.int32()))]))


def _written(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": c[0], "audit": c[1], "path": c[2]} for (p, q), c in cell.items()]


def _read(cell: list[dict]) -> Cell:
    return {(x["p"], x["q"]): (x["cost"], x["audit"], x["path"]) for x in cell}


def block_cells(found: DataFrame) -> DataFrame:
    """(conv_id, block, cell) of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [_written({k: (*c, [k[1]]) for k, c in parse(s).items()}) for s in batch.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(cells, _CELLS)],
                                             names=["conv_id", "block", "cell"])

    return found.mapInArrow(run, f"conv_id {found.schema['conv_id'].dataType.simpleString()}, block long, cell {_CELL}")


def _combined(cells: DataFrame) -> DataFrame:
    """One round: up to ``FAN_IN`` neighbouring cells of a conversation become one."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("block")) - 1
    grouped = cells.withColumn("part", F.floor(nth / FAN_IN)).groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("block", "cell"))).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [_written(combine_paths([_read(c["cell"]) for c in row])) for row in batch.column("cells").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(cells, _CELLS)],
                                             names=["conv_id", "block", "cell"])

    return grouped.mapInArrow(run, f"conv_id {cells.schema['conv_id'].dataType.simpleString()}, block long, cell {_CELL}")


def cheapest(found: DataFrame) -> DataFrame:
    """(conv_id, cost, audit, path): each conversation's cheapest repair; ``path`` has the state after each of its blocks. Stored."""
    cells = block_cells(found)
    while True:
        cells = stored(cells, "cyk-cells")
        most = cells.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if most is None or most == 1:
            break
        single = cells.groupBy("conv_id").agg(F.count("*").alias("n")).select(F.col("conv_id").alias("c"), "n")
        counted = cells.join(single, cells.conv_id.eqNullSafe(single.c)).drop("c")
        cells = _combined(counted.where("n > 1").drop("n")).unionByName(counted.where("n = 1").drop("n"))
    whole = F.filter("cell", lambda x: (x["p"] == START) & x["q"].isin(*ENDS))
    best = F.array_min(F.transform(whole, lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"), x["path"].alias("path"))))
    return stored(cells.select("conv_id", best.alias("b")).select("conv_id", "b.cost", "b.audit", "b.path"), "cyk-cheapest")


def repair(rows: DataFrame, found: DataFrame, best: DataFrame) -> DataFrame:
    """(conv_id, block, place, edit, role, text): the repaired conversations' turns, ordered by block and place.

    ``rows``, ``found`` and ``best`` come from :func:`faults`, :func:`blocks` and :func:`cheapest`.
    """
    steps = best.select(F.col("conv_id").alias("c"), F.posexplode("path").alias("nth", "leave"), F.concat(
        F.array(F.lit(START)), F.col("path")).alias("enters")).select("c", "nth", "leave", F.get("enters", F.col("nth")).alias("enter"))
    numbered = found.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy("block")) - 1).withColumnRenamed("nth", "number")
    placed = numbered.join(steps, numbered.conv_id.eqNullSafe(steps.c) & (numbered.number == steps.nth)).select("conv_id", "block", "symbols", "enter", "leave")
    turns = pa.list_(pa.struct([("place", pa.int32()), ("edit", pa.string()), ("nth", pa.int32()), ("role", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for symbols, enter, leave in zip(*(batch.column(c).to_pylist() for c in ("symbols", "enter", "leave"))):
                made = repaired_rows(parse(symbols)[enter, leave][1], symbols, enter)
                out.append([{"place": i, "edit": e, "nth": n, "role": r} for i, (e, n, r) in enumerate(made)])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(out, turns)], names=["conv_id", "block", "turns"])

    id_type = found.schema["conv_id"].dataType.simpleString()
    made = placed.mapInArrow(run, f"conv_id {id_type}, block long, turns array<struct<place: int, edit: string, nth: int, role: string>>")
    made = stored(made.select("conv_id", "block", F.inline("turns")), "cyk-turns")
    # A row's number within its block; blocks are bounded.
    block = F.shiftright("seq", BLOCK_BITS)
    numbered = rows.select(F.col("conv_id").alias("c"), block.alias("b"), "seq", F.col("role").alias("was"), "text").withColumn(
        "k", F.row_number().over(Window.partitionBy("c", "b").orderBy("seq")) - 1)
    joined = made.join(numbered, made.conv_id.eqNullSafe(numbered.c) & (made.block == numbered.b) & (made.nth == numbered.k), "left")
    return joined.select("conv_id", "block", "place", "edit", F.coalesce("role", "was").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def summary(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal): each conversation's faults, summed map-side."""
    turns = rows.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    sums = rows.groupBy("conv_id").agg(*(F.count(F.when(F.col("fault") == x, 1)).alias(x) for x in ("blank", "duplicate", "truncated")))
    # Neighbours inside a block, and over its border with the one before.
    before = F.lag(F.substring("initials", -1, 1)).over(Window.partitionBy("conv_id").orderBy("block"))
    pairs = F.concat(F.coalesce(before, F.lit("")), F.col("initials"))
    legal = F.transform(F.sequence(F.lit(1), F.length("line") - 1), lambda i: F.substring(F.col("line"), i, F.lit(2)).isin("su", "ua", "au"))
    bad = F.when(F.length("line") > 1, F.size(F.filter(legal, lambda x: ~x))).otherwise(0)
    illegal = found.select("conv_id", pairs.alias("line")).select("conv_id", bad.alias("bad")).groupBy("conv_id").agg(F.sum("bad").alias("illegal"))
    turns, illegal = (x.withColumnRenamed("conv_id", c) for x, c in ((turns, "c1"), (illegal, "c2")))
    return (sums.join(turns, sums.conv_id.eqNullSafe(turns.c1), "left").join(illegal, sums.conv_id.eqNullSafe(illegal.c2), "left")
            .select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
                    F.coalesce("illegal", F.lit(0)).cast("long").alias("illegal")))


def digests(damaged: DataFrame, original: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The contract's columns for every conversation of ``original``.

    The digest is over a conversation's whole repaired text, so its turns meet in one row here, and only here.
    """
    rows = faults(damaged)
    found = stored(blocks(rows), "cyk-blocks")
    best = cheapest(found)
    line = F.concat("role", F.lit(":"), "text")
    texts = repair(rows, found, best).groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct(
        "block", "place", line.alias("line")))).line, "\n").alias("whole"))
    counts = summary(rows, found).withColumnRenamed("conv_id", "c1")
    texts, best = texts.withColumnRenamed("conv_id", "c2"), best.withColumnRenamed("conv_id", "c3")
    every = original.select(F.col(conv).alias("conv_id")).distinct()
    joined = (every.join(counts, every.conv_id.eqNullSafe(counts.c1), "left").join(texts, every.conv_id.eqNullSafe(texts.c2), "left")
              .join(best, every.conv_id.eqNullSafe(best.c3), "left"))
    return joined.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                         F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("whole", F.lit("")), 256).alias("repaired_sha256"))
