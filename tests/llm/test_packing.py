"""Operator 9: pieces, fill, and the local search."""

import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from replaylab.llm import packing, queries


def library():
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    return tok


def check_places(rows, sequence):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= sequence
    return len(bins)


def test_query_on_documents(spark, sf_mid):
    tok = library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_mid}/documents.parquet").collect()}
    rows = queries.op9_packing(spark, sf_mid).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert by_doc.keys() == texts.keys()
    for doc_id, found in by_doc.items():
        ids = np.array([*tok.encode(texts[doc_id], add_special_tokens=False).ids, 2], dtype="<u4")
        found.sort(key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(len(found)))
        at = 0
        for r in found:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        assert all(r.length == 1024 for r in found[1:]) and 1 <= found[0].length <= 1024
    used, least = check_places(rows, 1024), -(-sum(r.length for r in rows) // 1024)
    assert used <= least + max(2, least // 200)


def test_local_search_empties_bins():
    rnd = random.Random(2)
    saved = 0
    for kind in range(60):
        size = rnd.choice([100, 1024])
        lengths = np.array([rnd.randrange(1, size + 1) if kind % 2 else rnd.randrange(size // 4, size // 2 + size // 8)
                            for _ in range(rnd.randrange(1, 150))])
        start = packing.best_fit(lengths, size)
        squares = sum(int(lengths[b].sum()) ** 2 for b in start)
        end = packing.local_search([list(b) for b in start], lengths, size)
        assert sorted(i for b in end for i in b) == list(range(len(lengths)))
        assert all(lengths[b].sum() <= size for b in end)
        assert len(end) <= len(start)
        assert sum(int(lengths[b].sum()) ** 2 for b in end) >= squares
        saved += len(start) - len(end)
    assert saved > 0


def has_step(bins, lengths, sequence):
    """Whether an underfull bin can give another, at least as full, more tokens than it takes back (two pieces for one at most)."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    held = [[int(lengths[i]) for i in b] for b in bins]
    one = [{0, *h} for h in held]
    two = [{x + y for i, x in enumerate(h) for y in h[:i]} for h in held]
    for s in range(len(bins)):
        for t in range(len(bins)):
            if s != t and fill[s] <= fill[t] < sequence:
                pairs = [(out, back) for out in one[s] | two[s] for back in one[t]] + [(out, back) for out in one[s] for back in two[t]]
                if any(0 < out - back <= sequence - fill[t] for out, back in pairs):
                    return True
    return False


def test_bins_beyond_the_first_partners_are_tried():
    # 70 bins with a room of 1 allow no step; the next fullest bin has room for the piece.
    lengths = np.array([33, 33, 33] * 70 + [60, 30])
    start = [[3 * b, 3 * b + 1, 3 * b + 2] for b in range(70)] + [[210], [211]]
    assert len(packing.local_search(start, lengths, 100)) == 71


def test_no_step_is_left():
    rnd = random.Random(5)
    for kind in range(40):
        few = [rnd.randrange(20, 60) for _ in range(rnd.choice([2, 3, 5]))]
        lengths = np.array([rnd.choice(few) if kind % 2 else rnd.randrange(15, 70) for _ in range(rnd.randrange(100, 260))])
        start = [[i] for i in range(len(lengths))] if kind % 4 < 2 else packing.best_fit(lengths, 100)
        end = packing.local_search(start, lengths, 100, partners=rnd.choice([1, 4, 64]))
        assert sorted(i for b in end for i in b) == list(range(len(lengths)))
        assert all(lengths[b].sum() <= 100 for b in end)
        assert len(end) == -(-lengths.sum() // 100) or not has_step(end, lengths, 100)


def test_many_tiny_pieces_stay_quick():
    for lengths in (np.full(40_000, 5), np.array([700, 5, 3] * 8_000), np.full(40_000, 1), np.arange(40_000) % 45 + 1, np.full(20_000, 300)):
        start = time.monotonic()
        bins = packing.local_search(packing.best_fit(lengths, 1024), lengths, 1024)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert time.monotonic() - start < 60


def test_known_exchanges():
    # Best fit leaves three bins here; one exchange makes two.
    lengths = np.array([6, 5, 5, 4])
    bad = [[0, 2 - 1], [2], [3]]
    assert len(packing.local_search([[0], [1, 2], [3]], lengths, 10)) == 2
    assert len(packing.local_search(bad[1:] + [[0], [1]], lengths, 10)) == 2


def test_edge_rows(make_docs):
    long = "word " * 5000
    df = make_docs([(1, None), (2, ""), (None, "abc"), (3, long), (3, long), (4, "<|endoftext|>")])
    rows = packing.packed(df, P.path("byte_bpe_50k.json"), sequence=64, with_ids=True)
    found = rows.collect()
    assert {(r.length, tuple(r.ids)) for r in found if r.doc_id in (1, 2)} == {(1, (2,))}
    assert [r.ids for r in found if r.doc_id == 4] == [[50256, 2]]
    n = len(library().encode(long, add_special_tokens=False).ids) + 1
    assert sum(r.length for r in found if r.doc_id == 3) == 2 * n
    assert sum(r.doc_id is None for r in found) == 1
    used = check_places(found, 64)
    sequences = packing.sequences(rows).collect()
    assert len(sequences) == used and sum(len(r.ids) for r in sequences) == sum(r.length for r in found)
    assert packing.packed(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_cut():
    assert packing.cut(np.zeros(1), 4) == [(0, 1)]
    assert packing.cut(np.zeros(4), 4) == [(0, 4)]
    assert packing.cut(np.zeros(9), 4) == [(0, 1), (1, 4), (5, 4)]
