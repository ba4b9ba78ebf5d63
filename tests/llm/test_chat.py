"""Operator 6: SQL oracle, exact round trips, examples."""

import hashlib
import random

import duckdb

from replaylab.llm import chat, queries

TURNS = "conv_id long, turn long, role string, text string, conv string, start int, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2) for r in rows], TURNS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_matches_sql(spark, sf_mid):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_mid}/conversations.parquet'")
    want = sorted(con.execute(queries.ORACLE["op6_chat"]).fetchall())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    df = queries.op6_chat(spark, sf_mid)
    assert sorted(tuple(r) for r in df.select(names).collect()) == want
    (extra,) = df.where("conv_id = -1").collect()
    text = "</s>[INST] ok [/INST]"
    assert extra.loss_sha256 == sha(text) and extra.loss_chars == len(text)
    assert extra.turns_sha256 == sha(f"user\n{text}\nassistant\n{text}\n")
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def odd_turns():
    rnd = random.Random(6)
    bits = ["<|start|>", "<|end|>", "<|", "|>", "<", "[", "/", "s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", chat.JOINER, "\n", "\\", "\\n", "ö", "😀", "$1", " "]
    rows = [(0, i, ["system", "user", "assistant"][i % 3], "".join(rnd.choices(bits, k=rnd.randrange(12)))) for i in range(700)]
    rows += [(1, 0, "user", None), (1, 1, "assistant", None), (2, 5, "assistant", "only"), (None, 0, "user", "x"), (None, 1, "assistant", "y"),
             (3, None, "user", "first"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (3, 1, None, "z"), (4, 1, "no\nrole\\n<|end|>\0n", "t"),
             (5, -600, "user", "b"), (5, None, "user", "a"), (6, 0, "assistant", "long " * 100_000)]
    return rows


def test_round_trip(spark):
    rows = odd_turns()
    stream = chat.segments(frame(spark, rows)).cache()
    back = sorted(((r.conv is None, r.conv or 0, r.turn_no), (r.role, r.text)) for r in chat.read_back(stream).collect())
    want = {}
    for conv, turn, role, text in rows:
        want.setdefault((conv is None, conv or 0), []).append(((turn is not None, turn or 0), role or "", text or ""))
    flat = [(role, text) for conv in sorted(want) for _, role, text in sorted(want[conv])]
    assert [x for _, x in back] == flat
    # Control strings never stand in the text part of a segment.
    for r in stream.collect():
        body = r.segment[r.loss_start - r.start:-len(chat.END) - 1]
        assert not any(c in body for c in ("<|", "</s>", "[INST]", "[/INST]", "<<SYS>>"))
        assert r.segment.startswith(chat.START) and r.segment.endswith(chat.END + "\n") and r.end - r.start == len(r.segment)


def test_every_reply_is_an_example(spark):
    rows = odd_turns()
    stream = chat.segments(frame(spark, rows)).cache()
    whole = {}
    for r in sorted(stream.collect(), key=lambda r: r.start):
        key = r.conv
        assert len(whole.setdefault(key, "")) == r.start
        whole[key] += r.segment
    found = chat.examples(stream).collect()
    assert len(found) == sum(role == "assistant" for _, _, role, _ in rows)
    for e in found:
        context = whole[e.conv][:e.context_end]
        assert context.count(chat.END + "\n") == context.count(chat.START) == e.example
    small = chat.segments(frame(spark, [r for r in rows if r[0] in (1, 2, 3, None)]))
    rendered = {(r.conv, r.example): r for r in chat.render(small).collect()}
    for e in chat.examples(small).collect():
        r = rendered[e.conv, e.example]
        assert r.text == whole[e.conv][:e.loss_end] and (r.loss_start, r.loss_end) == (e.loss_start, e.loss_end)


def test_digests_of_odd_rows(spark):
    df = chat.digests(chat.segments(frame(spark, odd_turns())))
    by_conv = {r.conv_id: r for r in df.collect()}
    assert by_conv[1].loss_sha256 == sha("") and by_conv[1].n_turns == 2
    assert by_conv[3].turns_sha256 == sha("user\nfirst\nassistant\na\nassistant\na\n\nz\n") and by_conv[3].loss_chars == 2
    assert by_conv[5].turns_sha256 == sha("user\na\nuser\nb\n")
    assert by_conv[4].loss_chars == 0
    assert by_conv[0].loss_sha256 == sha("".join(t for c, _, r, t in odd_turns() if c == 0 and r == "assistant"))
    assert chat.digests(chat.segments(frame(spark, []))).count() == 0
