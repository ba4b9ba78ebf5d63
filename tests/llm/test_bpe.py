"""Operator 2 against the tokenizers library."""

import hashlib
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from replaylab.llm import bpe, queries

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def library(name):
    tok = Tokenizer.from_file(P.path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def odd_texts():
    rnd = random.Random(7)
    texts = ["", " ", "\n\n x \t ", "Hello <|endoftext|> World's 12345 don't", "ΑΣ σς ΟΔΟΣ", "<|startoftext|><|endoftext|>a",
             "日本語 テスト 😀 é é İstanbul ǅ", "a" * 5000, "<| |>", "'S 'LL It's", "foo\x1cbar \x85x\xa0y\x00z", "ab" * 3000]
    ranges = [(1, 128), (1, 0x250), (1, 0x3000), (1, 0xD7FF), (0x1F300, 0x1F600)]
    texts += ["".join(chr(rnd.randrange(*rnd.choice(ranges))) for _ in range(120)) for _ in range(200)]
    return texts + ["".join(rnd.choice("aab ") for _ in range(80)) for _ in range(100)]


@pytest.mark.parametrize("kind", [bpe.TrieBPE, bpe.LibraryBPE, bpe.RankBPE])
@pytest.mark.parametrize("name", FILES)
def test_same_as_library(name, kind):
    tok, mine, texts = library(name), kind(P.path(name)), odd_texts()
    for got, want in zip(mine.encode_batch(texts), tok.encode_batch(texts, add_special_tokens=False)):
        assert got.tolist() == want.ids
        assert mine.decode(got) == tok.decode(want.ids, skip_special_tokens=False)


def test_small_cache_and_chunks_change_nothing(monkeypatch):
    texts = odd_texts()
    whole = [x.tolist() for x in bpe.TrieBPE(P.path(FILES[0])).encode_batch(texts)]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 5)
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 7)
    assert [x.tolist() for x in bpe.TrieBPE(P.path(FILES[0])).encode_batch(texts)] == whole


def test_query_on_documents(spark, sf_mid):
    tok = library(FILES[0])
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_mid}/documents.parquet").collect()}
    rows = queries.op2_bpe(spark, sf_mid).collect()
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == sha(tok.decode(ids, skip_special_tokens=False))


def test_edge_rows(make_docs):
    df = make_docs([(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b")])
    rows = bpe.digests(bpe.encode(df, P.path(FILES[0]), decoded=True)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in rows) == [
        (False, 1, 0), (False, 2, 0), (False, 3, 2), (False, 3, 2), (True, 0, 2)]
    assert {r.ids_sha256 for r in rows if r.n_tokens == 0} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.encode(df.limit(0), P.path(FILES[0])).count() == 0
    encoded = bpe.encode(df, P.path(FILES[0]))
    assert {r.decoded for r in bpe.decode(encoded, P.path(FILES[0])).collect()} == {"", "a</w> b</w>"}
