"""A loser tree: k sorted runs become one sorted stream with log2(k) comparisons a record."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any


class LoserTree:
    """Merge iterators of (key, value) that are each sorted by key; ties go to the earlier run."""

    def __init__(self, runs: list[Iterator[tuple[Any, Any]]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.head: list[tuple[Any, Any] | None] = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        for run in range(self.k):
            self._play(run)

    def _wins(self, a: int, b: int) -> bool:
        """Whether run a's record comes before run b's; a finished run loses."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x[0] < y[0] or (x[0] == y[0] and a < b)

    def _play(self, run: int) -> None:
        """Take a run up its path; each node keeps the loser, the winner goes on."""
        node = (run + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # while the tree is being built, the first to arrive waits
                self.losers[node] = run
                return
            if self._wins(other, run):
                self.losers[node], run = run, other
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple[Any, Any]]:
        while (top := self.head[run := self.losers[0]]) is not None:
            yield top
            self.head[run] = next(self.runs[run], None)
            self._play(run)
