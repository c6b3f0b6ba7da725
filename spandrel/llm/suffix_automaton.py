"""Suffix automata over words, with the first document of every factor."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator, Sequence


class SuffixAutomaton:
    """Accepts the factors of all sequences added.  Sequences are added by
    ascending document, so a state's document, fixed when it is made, is the
    smallest that holds its factors (a copy of a state takes the original's)."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self._latest = -1

    def _state(self, length: int, moves: dict, link: int, first: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _part(self, p: int, symbol: Hashable, q: int) -> int:
        """The state of p's longest factor with symbol: q, or a shorter copy of it."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.first[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: Iterable[Hashable], document: int) -> None:
        if document < self._latest:
            raise ValueError("sequences must be added by ascending document")
        self._latest, last = document, 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = self._part(last, symbol, q)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0, document), last
            while p != -1 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p != -1:
                self.link[new] = self._part(p, symbol, self.next[p][symbol])
            last = new

    def matching(self, sequence: Iterable[Hashable]) -> Iterator[tuple[int, int]]:
        """After each symbol: the length of the longest suffix read so far that is a
        factor, and the state that holds it."""
        state, size = 0, 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                size += 1
            yield size, state

    def first_documents(self, sequence: Sequence[Hashable], k: int) -> list[int | None]:
        """For each window of k symbols, the smallest document that has it, or None."""
        out: list[int | None] = []
        for n, (size, state) in enumerate(self.matching(sequence), 1):
            if n < k:
                continue
            if size < k:
                out.append(None)
                continue
            while self.length[self.link[state]] >= k:
                state = self.link[state]
            out.append(self.first[state])
        return out
