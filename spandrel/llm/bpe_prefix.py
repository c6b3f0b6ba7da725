"""Byte-pair encodings by dynamic programming over prefixes.

The encoding of s[:i] ends with one token t = s[j:i], and what stands before t
is the encoding of s[:j].  Of all vocabulary entries that end at i exactly one
is right: the one that its left neighbour (the last token of s[:j]) leaves
alone when the two are merged by themselves.  So one pass over the prefixes
keeps the last token and the number of tokens of every prefix, and a sorted
list of words can share the states of common prefixes.

The vocabulary entries that end at a position are those of an automaton's
state: the longest suffix read so far that begins some entry.  States and moves
are made when they are first met.
"""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence

_NEVER = float("inf")


class Trail:
    """What is known of every prefix of a string: the automaton's state and the
    number of the last token.  A compact one, for long strings that share nothing,
    keeps the last state only."""

    def __init__(self, root: tuple, compact: bool = False):
        self.states = deque([root], 1) if compact else [root]
        self.last = array("i", [-1]) if compact else [-1]

    def cut(self, size: int) -> None:
        """Keep the prefixes of up to ``size`` symbols."""
        del self.states[size + 1 :], self.last[size + 1 :]


class PrefixStates:
    """Last tokens of every prefix of a string.

    rank(a, b) is the priority of merging a and b (lower is earlier, None is
    never); tokens are the strings that can result from merges.  Tokens are
    numbered in the order given; symbols outside the vocabulary get numbers
    when they are met.  ``memo`` bounds the pairs and the moves remembered.
    """

    def __init__(self, rank: Callable[[str, str], float | None], tokens: Iterable[str], memo: int = 1 << 20):
        self.rank, self.memo = rank, memo
        self.names = list(tokens)
        self.number = {t: i for i, t in enumerate(self.names)}
        self.sizes = [len(t) for t in self.names]
        self.prefixes = {t[:i] for t in self.names for i in range(1, len(t) + 1)}
        self.grown: dict[int, tuple | None] = {}
        self._forget()

    def _forget(self) -> None:
        # a state: its moves, the tokens that end there as (size, number, left
        # neighbours known to leave it alone or not), the longest first, and its name
        self.root: tuple = ({}, [], "")
        self.states = {"": self.root}
        self.neighbours: dict[int, dict[int, bool]] = {}
        self.n_moves = self.n_pairs = 0

    def _numbered(self, symbol: str) -> int:
        if symbol not in self.number:
            self.number[symbol] = len(self.names)
            self.names.append(symbol)
            self.sizes.append(len(symbol))
        return self.number[symbol]

    def merged(self, s: str) -> tuple[list[str], list[tuple[float, int, int]]]:
        """Encoding by merging the best pair, leftmost first, from single symbols;
        and the merges made, as (time, start, end).  A merge that had to wait for
        an earlier one of lower priority has that one's time."""
        parts, made, time = list(s), [], -1.0
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            time = max(time, best)
            start = sum(map(len, parts[:at]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            made.append((time, start, start + len(parts[at])))
        return parts, made

    def _sides(self, token: int):
        """For a token that its own symbols merge into: how its first and its last
        part grow, as (part, time at which it is merged further); else None."""
        if token in self.grown:
            return self.grown[token]
        t = self.names[token]
        parts, made = self.merged(t)
        if parts != [t]:
            self.grown[token] = None
            return None
        left, right, n = [], [], len(t)
        first, final = t[:1], t[-1:]
        for time, start, end in made:
            if start == 0:
                left.append((first, time))
                first = t[:end]
            if end == n:
                right.append((final, time))
                final = t[start:]
        left.append((t, _NEVER))
        right.append((t, _NEVER))
        self.grown[token] = left, right
        return left, right

    def _stays(self, a: int, b: int) -> bool:
        """Whether a and b side by side merge into themselves only: no pair of a's
        growing end and b's growing beginning is merged before they grow on."""
        ends, begins, i, j = self._sides(a)[1], self._sides(b)[0], 0, 0
        while True:
            (x, x_time), (y, y_time) = ends[i], begins[j]
            r = self.rank(x, y)
            if r is not None and r < x_time and r <= y_time:
                stays = False
                break
            if x_time == y_time == _NEVER:
                stays = True
                break
            if x_time <= y_time:
                i += 1
            else:
                j += 1
        self.neighbours[b][a] = stays
        self.n_pairs += 1
        return stays

    def _move(self, state: tuple, symbol: str) -> tuple:
        """The state after one more symbol, made if it is new."""
        name = state[2] + symbol
        while name not in self.prefixes and len(name) > 1:
            name = name[1:]
        to = self.states.get(name)
        if to is None:
            self._numbered(symbol)
            tokens = [self.number[name[i:]] for i in range(len(name)) if name[i:] in self.number]
            ends = [(self.sizes[t], t, self.neighbours.setdefault(t, {})) for t in tokens if self._sides(t) is not None]
            to = self.states[name] = ({}, ends, name)
        state[0][symbol] = to
        self.n_moves += 1
        return to

    def trail(self, compact: bool = False) -> Trail:
        """The trail of the empty string.  What is remembered is bounded here."""
        if self.n_moves + self.n_pairs > self.memo:
            self._forget()
        return Trail(self.root, compact)

    def extend(self, s: str, trail: Trail) -> None:
        """Carry the trail of a prefix of s on to all of s."""
        keep_state, last, stays = trail.states.append, trail.last, self._stays
        keep_last, state, i = last.append, trail.states[-1], len(last) - 1
        for symbol in s[i:] if i else s:
            state = state[0].get(symbol) or self._move(state, symbol)
            i += 1
            # of the tokens that end here, the longest first, one is right
            for size, t, known in state[1]:
                if size == i:
                    break
                ok = known.get(last[i - size])
                if stays(last[i - size], t) if ok is None else ok:
                    break
            else:
                raise ValueError(f"no encoding of {s[:i]!r}")
            keep_state(state)
            keep_last(t)

    def tokens_of(self, trail: Trail, end: int | None = None) -> list[int]:
        """The tokens of a prefix, read backwards from its trail."""
        last, sizes, out = trail.last, self.sizes, []
        i = len(last) - 1 if end is None else end
        while i:
            t = last[i]
            out.append(t)
            i -= sizes[t]
        out.reverse()
        return out

    def counts(self, trail: Trail) -> array:
        """The number of tokens of every prefix."""
        out, sizes = array("q", [0]), self.sizes
        for i in range(1, len(trail.last)):
            out.append(out[i - sizes[trail.last[i]]] + 1)
        return out

    def count(self, s: str) -> int:
        """The number of tokens of s."""
        trail = self.trail(compact=True)
        self.extend(s, trail)
        n, i, sizes = 0, len(s), self.sizes
        while i:
            i -= sizes[trail.last[i]]
            n += 1
        return n


def walk_sorted(states: PrefixStates, words: Sequence[str]) -> Iterator[tuple[str, Trail]]:
    """(word, trail) of sorted distinct words: a depth-first walk over their trie,
    in which the states of a common prefix are computed once.  The trail changes
    with the next word."""
    previous, trail = "", states.trail()
    for w in words:
        if not w.startswith(previous):
            shared = 0
            for a, b in zip(previous, w):
                if a != b:
                    break
                shared += 1
            trail.cut(shared)
        states.extend(w, trail)
        previous = w
        yield w, trail
