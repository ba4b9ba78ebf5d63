"""Operator 13: exhaustive search on small spans, a left-to-right search on whole tables, odd rows."""

import hashlib
import itertools
import random
import re
import zlib

from replaylab.llm import cyk, queries

PATTERN = re.compile(r"(s?(ua)+)?")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def exhaustive(symbols):
    """The least (cost, audit) over all edits with at most two insertions at each place."""
    best = None
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    for edits in itertools.product(*([("K", "Ru", "Ra", "D")] * len(symbols))):
        if any(e != "D" and s == "-" for e, s in zip(edits, symbols)):
            continue
        for put in itertools.product(gaps, repeat=len(symbols) + 1):
            line, audit, cost = "", "", 0
            for i, made in enumerate(put):
                line, audit, cost = line + "".join(made), audit + "I" * len(made), cost + 2 * len(made)
                if i < len(symbols):
                    e, s = edits[i], symbols[i]
                    audit += e[0]
                    line += "" if e == "D" else s.lower() if e == "K" else e[1]
                    cost += {"K": 0, "R": 2, "D": 3}[e[0]] + (s.isupper() and e != "D")
            if PATTERN.fullmatch(line) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def least(symbols):
    cell = cyk.parse(symbols)
    return min(cell[p] for p in ((0, 0), (0, 3)) if p in cell)


def test_cells_against_all_edits():
    rnd = random.Random(13)
    for n in (0, 1, 2, 3):
        seen = set()
        for _ in range(12 if n < 3 else 25):
            symbols = "".join(rnd.choices("suaxSUAX-", k=n))
            if symbols not in seen:
                seen.add(symbols)
                assert least(symbols) == exhaustive(symbols), symbols


def search(rows):
    """Left to right over the rows, one state after another: (cost, audit, lines)."""
    table = {0: (0, "", ())}

    def insertions(table):
        for _ in range(3):
            for state, (cost, audit, out) in list(table.items()):
                x = {0: "u", 1: "u", 2: "a", 3: "u"}[state]
                put(table, 2 if x == "u" else 3, (cost + 2, audit + "I", out + ({"u": "user:", "a": "assistant:"}[x],)))

    def put(table, state, found):
        if state not in table or found[:2] < table[state][:2]:
            table[state] = found

    insertions(table)
    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, out) in table.items():
            put(new, state, (cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            for (p, x), q in {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.items():
                if p != state:
                    continue
                if role[:1] == x:
                    put(new, q, (cost + more, audit + "K", out + (f"{role}:{text}",)))
                elif x != "s":
                    put(new, q, (cost + 2 + more, audit + "R", out + (f"{ {'u': 'user', 'a': 'assistant'}[x]}:{text}",)))
        insertions(new)
        table = new
    return min(table[s] for s in (0, 3) if s in table)


def brute(rows):
    """The contract, one conversation after another in plain Python."""
    held, every = {}, set()
    for conv, turn, role, text in rows:
        every.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        held.setdefault(conv, []).extend([(turn, role, text)] * (2 if kind == 3 else 1))
    out = []
    for conv in every:
        turns = sorted(held.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        numbers = [t for t, _, _ in turns if t is not None]
        seen, judged = set(), []
        for _, role, text in turns:
            solid = re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
        count = lambda x: sum(f == x for _, _, f in judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, lines = search(judged)
        out.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, count("blank"), count("duplicate"),
                    count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


TURNS = "conv_id long, turn long, role string, text string, block int, cost string, path int, seq string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2, "q") for r in rows], TURNS)


def test_query_matches_brute_force(spark, sf_mid):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_mid}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = queries.op13_repair(spark, sf_mid)
    assert df.columns == COLUMNS and got(df) == brute(rows)


def odd_rows():
    rnd = random.Random(5)
    texts = ["Fine.", "cut", "Why?", "", None, " \t\n", "Ends. ", "a ", "é!", " ", "No!\x0b"]
    roles = ["user", "assistant", "system", "tool", None, "", "s", "User", "umpire"]
    rows = [(c, t if rnd.random() < 0.95 else None, rnd.choice(roles[:3] if rnd.random() < 0.8 else roles), rnd.choice(texts))
            for c in range(40) for t in range(rnd.randrange(1, 14))]
    rows += [(None, t, "user", "Fine.") for t in range(4)] + [(50, None, "user", "a."), (50, None, "assistant", "b.")]
    rows += [(60, t * 3, ["user", "assistant"][t % 2], f"text {t}.") for t in range(1500)]
    rows += [(c, 0, "user", f"alone {c}.") for c in range(100, 160)]
    rows += [(61, 1, "user", "same.")] * 700 + [(62, t, "user", "x" * 100_000 + ".") for t in range(3)]
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    df = frame(spark, rows)
    want = brute(rows)
    assert any(not r[7] for r in want) and {len(r[7]) > 1000 for r in want} == {True, False}
    assert got(cyk.digests(cyk.damage(df), df)) == want


def test_small_blocks_and_many_rounds(spark, monkeypatch):
    rows = [r for r in odd_rows() if r[0] in range(12) or r[0] == 60]
    monkeypatch.setattr(cyk, "BLOCK_BITS", 2)
    monkeypatch.setattr(cyk, "FAN_IN", 3)
    df = frame(spark, rows)
    assert got(cyk.digests(cyk.damage(df), df)) == brute(rows)


def test_repaired_turns_keep_the_pattern(spark):
    df = frame(spark, odd_rows())
    rows = cyk.faults(df)
    found = cyk.blocks(rows)
    turns = cyk.repair(rows, found, cyk.cheapest(found))
    lines = {}
    for r in sorted(turns.collect(), key=lambda r: (r.block, r.place)):
        lines.setdefault(r.conv_id, []).append(r.role[:1])
    assert lines and all(PATTERN.fullmatch("".join(x)) for x in lines.values())


def test_empty_table(spark):
    assert cyk.digests(cyk.damage(frame(spark, [])), frame(spark, [])).count() == 0
