"""Loser trees for k-way merges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


def merge(runs: list[Iterable[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs of tuples. Each inner node keeps the loser of its match; a new row replays one path to the root."""
    heads = [iter(r) for r in runs]
    k = max(1, len(heads))
    rows: list[tuple | None] = [next(h, None) for h in heads] or [None]

    def beats(a: int, b: int) -> bool:
        """Whether run a's row comes first; ended runs lose, ties go to the earlier run."""
        if b < 0 or rows[b] is None:
            return True
        return rows[a] is not None and (rows[a] < rows[b] or (rows[a] == rows[b] and a < b))

    losers = [-1] * k
    champion = -1
    for run in range(k):  # build: play each run up until it meets an empty seat
        winner, seat = run, (run + k) // 2
        while seat > 0:
            if losers[seat] < 0:
                losers[seat], winner = winner, -1
                break
            if beats(losers[seat], winner):
                losers[seat], winner = winner, losers[seat]
            seat //= 2
        if winner >= 0:
            champion = winner
    while rows[champion] is not None:
        yield rows[champion]
        rows[champion] = next(heads[champion], None)
        winner, seat = champion, (champion + k) // 2
        while seat > 0:
            if beats(losers[seat], winner):
                losers[seat], winner = winner, losers[seat]
            seat //= 2
        champion = winner
