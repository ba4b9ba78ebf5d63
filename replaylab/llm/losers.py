"""A loser tree: k-way merge of sorted runs with one comparison per tree level and output row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


_END = object()


def merge(runs: list[Iterable[tuple]]) -> Iterator[tuple[int, tuple]]:
    """(run number, item) of all runs in the order of the items; equal items in the order of the runs.

    Inner node ``i`` of the tree remembers the run that lost there, node 0 the winner of all.  After the winner's next
    item comes in, only the matches on the way from its leaf to the top are played again.
    """
    k = len(runs)
    if not k:
        return
    sources = [iter(r) for r in runs]
    heads = [next(s, _END) for s in sources]

    def beats(a: int, b: int) -> bool:
        if heads[a] is _END or heads[b] is _END:
            return heads[b] is _END and (heads[a] is not _END or a < b)
        return heads[a] < heads[b] or heads[a] == heads[b] and a < b

    losers = [0] * k

    def play(node: int) -> int:
        """Winner of the subtree; its losers are noted on the way."""
        if node >= k:
            return node - k
        left, right = play(2 * node), play(2 * node + 1)
        winner, losers[node] = (left, right) if beats(left, right) else (right, left)
        return winner

    winner = play(1) if k > 1 else 0
    while heads[winner] is not _END:
        yield winner, heads[winner]
        heads[winner] = next(sources[winner], _END)
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node //= 2
