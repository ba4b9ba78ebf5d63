"""BPE encoding and decoding by prefix-sharing trie traversal (operator 2).

Method.  The distinct words of a batch form a trie; it is kept as the sorted word list, whose
neighbours' common prefixes are the shared trie paths, and walked depth first.  The walk
propagates one state per prefix: the *last token* of that prefix's BPE encoding.  The encoding
of a prefix is the encoding of the prefix without its last token, followed by it, so one state
per trie node describes the encoding of every prefix, and a shared prefix is worked out once.
At a node, the last token is the one suffix token that BPE would leave next to the last token
before it (``_Merges.stays_apart``).

The distinct words met so far stay in a bounded cache of the Python worker; clearing it changes
no result.  Text normalisation and word splitting follow the tokenizer file.  Common letters use
one compiled pattern; any other text goes through the tokenizer library's own normaliser and
splitter.

Defined results: a null or empty text has no tokens and decodes to the empty text.  Repeated
rows are encoded each.  Null keys are kept.  Only ``keep`` and the text column are read, so other
columns (whatever their names) don't matter.  A very long text is split into words piece by piece.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from replaylab.llm._common import slices

#: Distinct words kept by one Python worker.
CACHE_WORDS = 250_000
#: Remembered answers on token pairs.
CACHE_PAIRS = 500_000
#: Words handled at once.
CHUNK_WORDS = 400_000
#: Letters on which Python's and the tokenizer library's character tables agree.
_PLAIN = frozenset(chr(i) for first, last in ((0, 0x1B), (0x20, 0x24F), (0x400, 0x4FF), (0x2010, 0x2027), (0x2030, 0x205E),
                                              (0x20AC, 0x20AC)) for i in range(first, last + 1))


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, others move above U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(moved)) for b in range(256)]


_LETTER = _byte_letters()
_BYTE = {c: b for b, c in enumerate(_LETTER)}
_TO_LATIN = {ord(c): b for c, b in _BYTE.items()}
_NOT_PLAIN = re.compile("[^" + "".join(regex.escape(c) if ord(c) < 128 else c for c in sorted(_PLAIN)) + "]")


def _plain_pattern(pattern: str) -> re.Pattern:
    """The word pattern with its character classes spelled out over the plain letters (several times faster)."""
    def spelled(keep) -> str:
        return "".join(regex.escape(c) if ord(c) < 128 else c for c in sorted(_PLAIN) if keep(c))

    for name, keep in ((r"\p{L}", lambda c: unicodedata.category(c)[0] == "L"),
                       (r"\p{N}", lambda c: unicodedata.category(c)[0] == "N"),
                       (r"\s", lambda c: regex.match(r"\s", c))):
        inside = spelled(keep)
        pattern = regex.sub(r"(\[[^\]]*)" + regex.escape(name), lambda m, x=inside: m[1] + x, pattern)
        pattern = pattern.replace(name, f"[{inside}]")
    return re.compile(pattern)


def _longest_by_tail(table: dict[str, int]) -> dict[str, int]:
    """Length of the longest token by its last three letters."""
    out: dict[str, int] = {}
    for text in table:
        if len(text) > 2:
            out[text[-3:]] = max(out.get(text[-3:], 0), len(text))
    return out


class _Merges:
    """Merge ranks and, per token, the two tokens it was merged from."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.rank: dict[int, int] = {}  # token pair -> merge rank
        self.born: dict[int, int] = {}  # token -> rank of its merge; letters have none
        self.parts: dict[int, tuple[int, int]] = {}
        self.length: dict[int, int] = {}
        self.inner: dict[str, int] = {}  # by text, tokens inside a word
        self.final: dict[str, int] = {} if suffix else self.inner  # tokens that end a word
        self.apart: dict[int, bool] = {}  # answers of stays_apart so far
        for letter in _LETTER:
            self._add(letter, vocab[letter], self.inner)
            if suffix:
                self._add(letter, vocab[letter + suffix], self.final)
        for r, (a, b) in enumerate(pairs):
            left, right, merged = vocab[a], vocab[b], vocab[a + b]
            self.rank[left << 20 | right] = r
            if merged in self.born:
                raise ValueError(f"token {a + b!r} has two merges")
            self.born[merged], self.parts[merged] = r, (left, right)
            ends = bool(suffix) and b.endswith(suffix)
            self._add((a + b).removesuffix(suffix) if ends else a + b, merged, self.final if ends else self.inner)
        self.inner_longest, self.final_longest = map(_longest_by_tail, (self.inner, self.final))

    def _add(self, text: str, token: int, table: dict[str, int]) -> None:
        table[text], self.length[token] = token, len(text)

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether BPE over the two tokens' joint text ends with just these two tokens.

        While the two sides grow, the tokens that touch the border are on the right edge of ``left``
        and the left edge of ``right``.  A touching pair exists until either side's next merge; the
        border falls if the pair's own merge comes before.  At equal rank the merge further left
        comes first.
        """
        answer = self.apart[left << 20 | right] = self._edges(left, right)
        return answer

    def _edges(self, a: int, b: int) -> bool:
        a_until = b_until = 1 << 30
        while True:
            merge = self.rank.get(a << 20 | b)
            if merge is not None and merge < a_until and merge <= b_until:
                return False
            a_born, b_born = self.born.get(a, -1), self.born.get(b, -1)
            if a_born < 0 and b_born < 0:
                return True
            if a_born > b_born:
                a_until, a = a_born, self.parts[a][1]
            else:
                b_until, b = b_born, self.parts[b][0]


class TrieBPE:
    """A byte-level BPE tokenizer file, encoding through the trie of distinct words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._library = Tokenizer.from_file(path)
        self._merges = _Merges(spec["model"])
        self._lower = spec["normalizer"] is not None
        split = spec["pre_tokenizer"].get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self._words = _plain_pattern(split or _BYTE_LEVEL_WORDS)
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self._special, key=len, reverse=True))) + ")")
        self._cache: dict[str, bytes] = {}  # word -> its ids as int32
        self._again: set[str] = set()  # cached words met again later
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {i: t for t, i in self._special.items()}
        self.names = np.array([names.get(i, "") for i in range(max(names) + 1)], dtype=object)
        self._plain_decoder = spec["decoder"] is None

    # -- text to words -----------------------------------------------------------------------

    def _runs(self, text: str) -> Iterator[list[str] | int]:
        """Lists of words, and ids of special tokens standing in the text."""
        for part in self._cuts.split(text) if "<|" in text else (text,):
            if part in self._special:
                yield self._special[part]
            elif part:
                if not _NOT_PLAIN.search(part):
                    found = (m.group() for m in self._words.finditer(self._normal(part))) \
                        if len(part) > CHUNK_WORDS else iter(self._words.findall(self._normal(part)))
                else:
                    found = iter(self._library_words(part))
                while words := list(islice(found, CHUNK_WORDS)):
                    yield words

    def _normal(self, text: str) -> str:
        if not self._lower:
            return text
        return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()

    def _library_words(self, text: str) -> list[str]:
        if self._library.normalizer is not None:
            text = self._library.normalizer.normalize_str(text)
        pieces = self._library.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(_BYTE[c] for c in p).decode("utf-8", "surrogateescape") for p, _ in pieces]

    # -- words to tokens ---------------------------------------------------------------------

    def learn(self, words: set[str]) -> None:
        """Encode distinct words into the cache by one depth-first walk over their trie."""
        m = self._merges
        length, apart, known = m.length, m.stays_apart, m.apart
        spelled = sorted((w if w.isascii() and w.isprintable() and " " not in w else
                          "".join([_LETTER[b] for b in w.encode("utf-8", "surrogateescape")]), w) for w in words)
        path: list[int] = []  # path[i]: last token of the walked prefix of i + 1 letters
        before = ""

        def last_token(word: str, end: int, tokens: dict[str, int], longest: dict[str, int]) -> int:
            # Just one suffix token fits, so the order of trying is free: first the token before, grown.
            most = min(end, longest.get(word[end - 3:end], 2)) if end > 2 else end
            grown = length[path[end - 2]] + 1 if end > 1 else 1
            for n in (grown, *range(1, grown), *range(grown + 1, most + 1)):
                if n > most or (token := tokens.get(word[end - n:end])) is None:
                    continue
                if n == end:
                    return token
                fits = known.get(path[end - n - 1] << 20 | token)
                if fits or fits is None and apart(path[end - n - 1], token):
                    return token
            raise ValueError(f"no token for {word[:end]!r}")

        for word, raw in spelled:
            shared, most = 0, min(len(path), len(word) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del path[shared:]
            for end in range(shared + 1, len(word)):
                path.append(last_token(word, end, m.inner, m.inner_longest))
            token = last_token(word, len(word), m.final, m.final_longest)
            ids, at = [token], len(word) - length[token]
            while at > 0:
                ids.append(token := path[at - 1])
                at -= length[token]
            self._cache[raw] = struct.pack(f"={len(ids)}i", *reversed(ids))
            before = word

    def encode_batch(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Token ids of each whole text, as int32 arrays."""
        out, waiting, held = [[] for _ in texts], [], 0

        def flush() -> None:
            cache, distinct = self._cache, set().union(*(w for _, w in waiting))
            new = distinct.difference(cache)
            self._again |= distinct - new
            if len(cache) + len(new) > CACHE_WORDS:  # keep the words met more than once, if not too many
                kept = {w: cache[w] for w in self._again} if len(self._again) < CACHE_WORDS // 2 else {}
                self._cache, self._again = cache, _ = kept, set()
                new = distinct.difference(cache)
            if len(self._merges.apart) > CACHE_PAIRS:
                self._merges.apart.clear()
            self.learn(new)
            for i, words in waiting:
                out[i].append(np.frombuffer(b"".join(map(cache.__getitem__, words)), dtype=np.int32))
            waiting.clear()

        for i, text in enumerate(texts):
            for run in self._runs(text):
                if isinstance(run, int):
                    if waiting and waiting[-1][0] == i:
                        flush()
                        held = 0
                    out[i].append(np.array([run], dtype=np.int32))
                    continue
                waiting.append((i, run))
                held += len(run)
                if held >= CHUNK_WORDS:
                    flush()
                    held = 0
        flush()
        none = np.empty(0, dtype=np.int32)
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else none for p in out]

    def decode(self, ids: np.ndarray) -> str:
        """The library's decode(ids, skip_special_tokens=False)."""
        tokens = self.names[ids].tolist()
        if self._plain_decoder:
            return " ".join(tokens)
        return "".join(tokens).translate(_TO_LATIN).encode("latin-1").decode("utf-8", "replace")


class LibraryBPE(TrieBPE):
    """The same, but distinct words are encoded one by one by the tokenizer library's own model.

    For operators that only need ids: the same splitting and cache of distinct words, without a trie.
    """

    def learn(self, words: set[str]) -> None:
        tokenize = self._library.model.tokenize
        for w in words:
            ids = [t.id for t in tokenize("".join([_LETTER[b] for b in w.encode("utf-8", "surrogateescape")]))]
            self._cache[w] = struct.pack(f"={len(ids)}i", *ids)


class RankBPE(LibraryBPE):
    """The same ids for byte-level files, from whole texts by rank merging (tiktoken), without a cache of words.

    Used for texts of plain letters, where word splitting agrees, and for files whose token ids follow the order of merges;
    any other text or file goes the way of :class:`LibraryBPE`.
    """

    def __init__(self, path: str):
        import tiktoken

        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        born = sorted(self._merges.born.items(), key=lambda x: x[1])
        in_order = all(a[0] < b[0] for a, b in zip(born, born[1:])) and (not born or born[0][0] >= len(_LETTER))
        self._ranks = None
        if in_order and not self._lower and not model.get("end_of_word_suffix"):
            ranks = {bytes(_BYTE[c] for c in t): i for t, i in model["vocab"].items() if t not in self._special}
            self._ranks = tiktoken.Encoding("ranks", pat_str=_BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens=self._special)

    def encode_batch(self, texts: Sequence[str]) -> list[np.ndarray]:
        if self._ranks is None:
            return super().encode_batch(texts)
        others = [i for i, t in enumerate(texts) if _NOT_PLAIN.search(t)]
        found = dict(zip(others, super().encode_batch([texts[i] for i in others]))) if others else {}
        return [found[i] if i in found else self._ranks.encode_to_numpy(t, allowed_special="all").view(np.int32) for i, t in enumerate(texts)]


#: Fixed value: the byte-level splitter's published word pattern.
_BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[tuple[str, type], TrieBPE] = {}


def load(path: str, kind: type[TrieBPE] = TrieBPE) -> TrieBPE:
    """The tokenizer of a file, once per Python worker."""
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = kind(path)
    return _LOADED[path, kind]


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", keep: Sequence[str] = ("doc_id",),
           decoded: bool = False, with_ids: bool = True, kind: type[TrieBPE] = TrieBPE) -> DataFrame:
    """``keep`` columns, ``n_tokens`` long and, if asked for, ``ids`` array<int> and ``decoded`` string."""
    schema = T.StructType([df.schema[c] for c in keep]).add("n_tokens", "long")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    if decoded:
        schema = schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path, kind)
        for batch in slices(batches, text):
            rows = bpe.encode_batch([t or "" for t in batch.column(text).to_pylist()])
            sizes = np.array([len(r) for r in rows], dtype=np.int64)
            columns = [*(batch.column(c) for c in keep), pa.array(sizes)]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows))))
            if decoded:
                columns.append(pa.array([bpe.decode(r) for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded`` string of stored token ids; null ids decode to the empty text."""
    schema = T.StructType([df.schema[c] for c in keep]).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in batches:
            texts = [bpe.decode(np.array(r or [], dtype=np.int64)) for r in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())],
                                             names=schema.names)

    return df.select(*keep, ids).mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """Contract columns of an encoded and decoded table."""
    return encoded.select(
        "doc_id", "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
