"""Best-fit packing improved by swap-based local search (operator 9).

Method.
1. Each document becomes its token ids and an end id; a document longer than a sequence is cut into
   sequence-long pieces, its first piece taking the odd rest.  Only the odd pieces need packing.
2. Pieces are dealt round robin to groups of about ``GROUP_PIECES``, so no document, source or length can crowd one
   task.  Each group is packed by one task, in bounded memory: best fit, longest first, as the start.
3. Local search over the underfull bins, emptiest first: move a piece into another bin's gap, exchange one piece
   for a longer one, or two pieces for one, whenever the sum of squared fills grows.  Filling the full bins
   further drains the emptiest, which disappear.  A few partners are looked at first; if they allow no step, an index
   by room and lengths answers for all bins at least as full.  It ends when no underfull bin has a step into any bin
   at least as full, or when the group's bin count has reached its lower bound ceil(tokens / sequence).

The sum of squared fills grows with every step and is bounded, so the search ends.  Grouping costs less than one
underfull sequence per group against packing all pieces at once.

Defined results: a null or empty text is one piece holding the end id only.  Repeated rows, and rows with a null key,
are packed each as a piece of its own.  Other columns are not read, whatever their names.  An empty table gives none.
A very long text gives as many full pieces as needed; its tokens are held by one task while they are cut.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from replaylab.llm import bpe
from replaylab.llm._common import slices, stored

SEQUENCE = 1024
END_ID = 2
GROUP_PIECES = 40_000
#: Bins that a move looks at first, one by one; if they allow no step, all others are looked up.
PARTNERS = 64


def cut(ids: np.ndarray, sequence: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than a sequence."""
    first = (len(ids) - 1) % sequence + 1
    return [(0, first)] + [(at, sequence) for at in range(first, len(ids), sequence)]


def pieces(df: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = True,
           text: str = "text", key: str = "doc_id") -> DataFrame:
    """(``key``, piece, start, length, ids_crc32[, ids]): every document's pieces; the checksum is over uint32 ids."""
    schema = T.StructType([df.schema[key]]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe.load(tokenizer_path, bpe.RankBPE)
        for batch in slices(batches, text):
            rows, found = [], []
            for i, ids in enumerate(tok.encode_batch([t or "" for t in batch.column(text).to_pylist()])):
                ids = np.append(ids, end_id).astype("<u4")
                for k, (start, length) in enumerate(cut(ids, sequence)):
                    part = ids[start:start + length]
                    rows.append(i)
                    found.append((k, start, length, zlib.crc32(part.tobytes()), part))
            k, start, length, crc, parts = zip(*found) if found else [()] * 5
            columns = [batch.column(key).take(pa.array(rows, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                flat = np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, sequence: int) -> list[list[int]]:
    """Bins of piece numbers: longest piece first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    open_at: list[list[int]] = [[] for _ in range(sequence + 1)]  # bins by room left
    rooms = 0  # bit r is set if a bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        higher = rooms >> n
        if higher:
            room = n + (higher & -higher).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = sequence, len(bins)
            bins.append([i])
        left = room - n
        if left:
            open_at[left].append(b)
            rooms |= 1 << left
    return bins


class _Partners:
    """The rooms of underfull bins, with the sums that one piece (or none) and two pieces of theirs can have, counted.

    Bins that have the same room and sum allow the same step, so a look at all bins costs one look per distinct pair.
    """

    def __init__(self, sequence: int):
        self.sequence, self.width = sequence, sequence + 1
        self.held: tuple[dict[int, int], dict[int, int]] = ({}, {})
        self.sorted: list[np.ndarray | None] = [None, None]

    def _keys(self, fill: int, sums) -> list[int]:
        at = (self.sequence - fill) * self.width
        return [at + n for n in sums]

    def change(self, fill: int, sums: tuple, by: int) -> None:
        """Count a bin in (+1) or out (-1); ``sums`` are its (one or no piece, two pieces)."""
        for kind, held in enumerate(self.held):
            for key in self._keys(fill, sums[kind]):
                n = held.get(key, 0) + by
                if n == 0:
                    del held[key]
                    self.sorted[kind] = None
                else:
                    if n == by:
                        self.sorted[kind] = None
                    held[key] = n

    def best(self, fill: int, outs: tuple, own: tuple) -> tuple[int, int, int, int]:
        """(gain, room, kind, sum) of the largest step that a bin of ``fill`` has into another at least as full.

        ``outs`` are the source's sums that are offered for one or no piece, and for two; ``own`` are the sums that
        :meth:`change` counted for the source itself.
        """
        best = (0, 0, 0, 0)
        for kind, held in enumerate(self.held):
            if self.sorted[kind] is None:
                self.sorted[kind] = np.sort(np.fromiter(held, np.int64, len(held)))
            keys = self.sorted[kind]
            keys = keys[:np.searchsorted(keys, (self.sequence - fill + 1) * self.width)]  # at least as full
            if not len(keys) or not len(outs[kind]):
                continue
            most = np.zeros(2 * self.width, np.int64)  # the largest sum up to a bound
            most[list(outs[kind])] = list(outs[kind])
            most = np.maximum.accumulate(most)
            room, back = np.divmod(keys, self.width)
            gain = most[room + back] - back
            alone = [k for k in self._keys(fill, own[kind]) if held[k] == 1]
            gain[np.searchsorted(keys, alone)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (int(gain[at]), int(room[at]), kind, int(back[at]))
        return best


def local_search(bins: list[list[int]], lengths: np.ndarray, sequence: int, partners: int = PARTNERS) -> list[list[int]]:
    """Drain the emptiest bins into the others by moves and exchanges that raise the sum of squared fills.

    Each round empties pieces out of the emptiest underfull bin (``source``).  For a partner bin with room r,
    a step takes more tokens out of the source than it returns, at most r more:
    a move returns nothing, a one-for-one exchange returns one shorter piece, a two-for-one exchange returns one piece for
    two, or two for one.  A bin from which no step is possible is settled.  Settled bins are looked at again after any
    later step, so that at the end no bin has a step left.
    """
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    least = -(-sum(fill) // sequence)
    n_bins = len(bins)
    waiting = [(fill[b], b) for b in range(n_bins) if fill[b] < sequence]
    heapq.heapify(waiting)
    by_fill = sorted((fill[b], b) for b in range(n_bins) if fill[b] < sequence)  # the partners, fullest last

    seen: dict[int, tuple[list, dict, dict]] = {}  # choices of bins that haven't changed

    def choices(b: int) -> tuple[list[int], dict[int, tuple], dict[int, tuple]]:
        """Sums that one or two pieces of a bin can have, sorted, and pieces for each; equal sizes count once, so
        there are never more than a sequence's length of either, however small the pieces."""
        if b not in seen:
            by_size: dict[int, list[int]] = {}
            for i in bins[b]:
                by_size.setdefault(size[i], []).append(i)
            one = {n: (held[0],) for n, held in by_size.items()}
            two = {2 * n: tuple(held[:2]) for n, held in by_size.items() if len(held) > 1}
            two |= {m + n: (by_size[m][0], by_size[n][0]) for m in by_size for n in by_size if m < n}
            seen[b] = sorted({*one, *two}), one, two
        return seen[b]

    def best_step(source: int, target: int):
        """(gain in tokens, out of source, back from target) of the step that fills the target most."""
        room = sequence - fill[target]
        sums, one, two = choices(source)
        _, their_one, their_two = choices(target)
        singles = sorted(one)
        best = (0, (), ())
        # A move, one for one, or two of ours for one; then one of ours for two.
        for outs, backs in ((sums, {0: (), **their_one}), (singles, their_two)):
            for back, returned in backs.items():
                at = bisect_left(outs, back + room + 1) - 1
                if at >= 0 and outs[at] - back > best[0]:
                    out = outs[at]
                    best = (out - back, one.get(out) or two[out], returned)
        return best

    index: _Partners | None = None  # made when the first partners allow no step for the first time

    def sums_of(b: int) -> tuple:
        _, one, two = choices(b)
        return (0, *one), two

    def count(b: int, by: int) -> None:
        if index is not None and bins[b] and fill[b] < sequence:
            index.change(fill[b], sums_of(b), by)

    def widest(source: int):
        """The best step into any bin at least as full, or None."""
        nonlocal index
        if index is None:
            index = _Partners(sequence)
            for _, b in by_fill:
                count(b, 1)
        sums, one, _ = choices(source)
        gain, room, kind, back = index.best(fill[source], (sums, tuple(one)), sums_of(source))
        if not gain:
            return None
        full = sequence - room
        for at in range(bisect_left(by_fill, (full, -1)), len(by_fill)):
            target = by_fill[at][1]
            if target != source and back in sums_of(target)[kind]:
                return target, best_step(source, target)

    stepped = False
    while n_bins > least:
        if not waiting:
            if not stepped:
                break
            stepped = False  # settled bins may have a step into those that changed since
            waiting = list(by_fill)
        held, source = heapq.heappop(waiting)
        if held != fill[source] or not bins[source] or fill[source] == sequence:
            continue
        while bins[source]:
            # Partners: underfull bins at least as full as the source, so that squared fill grows; fullest first.
            tried, found = 0, None
            for at in range(len(by_fill) - 1, -1, -1):
                full, target = by_fill[at]
                if full < fill[source] or tried == partners:
                    break
                if target == source:
                    continue
                tried += 1
                step = best_step(source, target)
                if step[0] and (found is None or step[0] > found[1][0]):
                    found = (target, step)
                    if step[0] == sequence - full:
                        break
            if found is None:
                found = widest(source)
            if found is None:
                break
            stepped = True
            target, (gain, out, back) = found
            for b, gone, got, change in ((source, out, back, -gain), (target, back, out, gain)):
                by_fill.pop(bisect_left(by_fill, (fill[b], b)))
                count(b, -1)
                bins[b] = [i for i in bins[b] if i not in gone] + list(got)
                seen.pop(b, None)
                fill[b] += change
                if bins[b] and fill[b] < sequence:
                    insort(by_fill, (fill[b], b))
                    count(b, 1)
            if fill[target] < sequence:
                heapq.heappush(waiting, (fill[target], target))
        if not bins[source]:
            n_bins -= 1
    return [b for b in bins if b]


def pack(cut_pieces: DataFrame, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """All columns of ``cut_pieces`` (stored; it is counted first) and ``sequence_id`` long, ``offset`` long."""
    n_groups = max(1, -(-cut_pieces.count() // group_pieces))
    schema = T.StructType(list(cut_pieces.schema)).add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        group = pa.Table.from_batches(held)
        lengths = group["length"].to_numpy()
        bins = local_search(best_fit(lengths, sequence), lengths, sequence)
        where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        first = TaskContext.get().partitionId() << 32
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                where[i], offset[i] = first + b, at
                at += int(lengths[i])
        out = group.append_column("sequence_id", pa.array(where)).append_column("offset", pa.array(offset))
        yield from out.combine_chunks().to_batches(max_chunksize=8192)

    return cut_pieces.repartition(n_groups).mapInArrow(run, schema)


def packed(df: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False,
           text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every document's pieces with their place in a sequence."""
    return pack(stored(pieces(df, tokenizer_path, sequence, end_id, with_ids, text, key), "pieces"), sequence)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, ids): the sequences themselves, from placed pieces with ids; a sequence is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.size("parts").alias("n_pieces"), F.flatten("parts.ids").alias("ids"))
