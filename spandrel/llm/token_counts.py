"""Exact token counts at every prefix, by prefix dynamic programming.

Counts are those of the tokenizers library for a byte-level BPE file: texts are
split at special tokens (one token each) and by the pre-tokenizer's pattern;
each piece is counted by the prefix states of bpe_prefix.  The states also hold
the counts of all prefixes, so truncations and budgets need no re-encoding.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_prefix import PrefixStates, walk_sorted
from .common import BLOCK_BYTES, sliced, text_columns

#: The pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer pieces are counted each time instead of being remembered.
REMEMBERED_LENGTH = 48
#: Pieces remembered by a worker before it starts anew.
REMEMBERED = 400_000
LIMIT = 1024
_BLANK = regex.compile(r"\s+").fullmatch


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in vocabulary files: itself where it is
    printable in Latin-1, else the next free code point from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    out = [chr(b) for b in range(256)]
    for n, b in enumerate(others):
        out[b] = chr(256 + n)
    return out


class _Counts(dict):
    """Number of tokens by piece.  A short piece that is looked up for the first time
    waits to be counted with others; a long one is counted at once and forgotten."""

    def __init__(self, counter: PrefixCounter):
        self.counter, self.new = counter, []

    def __missing__(self, piece: str) -> int:
        if len(piece) > REMEMBERED_LENGTH:
            return self.counter.count_piece(piece)
        self[piece] = n = -1 - len(self.new)
        self.new.append(piece)
        return n


class PrefixCounter:
    """Token counts of texts and of all their prefixes for a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("only byte-level BPE files without a normalizer")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.states = PrefixStates(lambda a, b: self.ranks.get((a, b)), spec["model"]["vocab"])
        self.table = dict(enumerate(byte_symbols()))
        self.split = regex.compile(PATTERN).findall
        special = [regex.escape(t["content"]) for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.special_marks = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.counts = _Counts(self)

    def symbols(self, piece: str) -> str:
        return piece.encode("utf-8").decode("latin-1").translate(self.table)

    def _segments(self, text: str) -> list[str]:
        if self.special is None or not any(m in text for m in self.special_marks):
            return [text]
        return self.special.split(text)

    def count_piece(self, piece: str) -> int:
        """Number of tokens of one piece of the pre-tokenizer."""
        return self.states.count(self.symbols(piece))

    def trail_counts(self, piece: str) -> Sequence[int]:
        """Number of tokens of every prefix, by bytes, of one piece."""
        trail = self.states.trail(compact=True)
        self.states.extend(self.symbols(piece), trail)
        return self.states.counts(trail)

    def count(self, text: str) -> int:
        """Number of tokens of the text."""
        return self.count_all([text])[0]

    def count_all(self, texts: list[str]) -> list[int]:
        """Number of tokens of several texts; their new pieces are counted in sorted
        order, in which the states of common prefixes are shared."""
        if len(self.counts) > REMEMBERED:
            self.counts.clear()
        get, numbers, first, special = self.counts.__getitem__, array("q"), [0], []
        for x in texts:
            segments = self._segments(x)
            special.append(len(segments) - 1)
            for segment in segments:
                numbers.extend(map(get, self.split(segment)))
            first.append(len(numbers))
        new = self.counts.new
        found = np.zeros(len(new), np.int64)
        symbols = list(map(self.symbols, new))
        order = sorted(range(len(new)), key=symbols.__getitem__)
        for i, (_, trail) in zip(order, walk_sorted(self.states, [symbols[i] for i in order])):
            found[i] = self.counts[new[i]] = len(self.states.tokens_of(trail))
        new.clear()
        n = np.frombuffer(numbers, np.int64) if numbers else np.zeros(0, np.int64)
        if len(found):
            n = np.where(n < 0, found[np.maximum(-1 - n, 0)], n)
        ends = np.concatenate([[0], np.cumsum(n)])[first]
        return (np.diff(ends) + special).tolist()

    def prefix_counts(self, text: str) -> list[int]:
        """counts[i] is the number of tokens of text[:i], for i = 0 .. len(text).

        Where cutting a piece changes how it is split (a blank that joins the
        white space before it, a contraction, a special token), the piece's
        prefix is split and counted by itself."""
        return self._prefix_counts(text).tolist()

    def _prefix_counts(self, text: str) -> array:
        out, done, at = array("q", [0]), 0, 0
        special = [m.span() for m in self.special.finditer(text)] if self.special else []
        for start, end in [*special, (len(text), len(text))]:
            previous, before_previous = "", done
            for piece in self.split(text[at:start]):
                counts, byte = self.trail_counts(piece), 0
                for n, char in enumerate(piece, 1):
                    byte += len(char.encode("utf-8"))
                    if n == 1 and previous and _BLANK(char) and _BLANK(previous):
                        out.append(before_previous + self._ordinary(previous + char))
                    elif 1 < len(piece) > n and piece[0] == "'" and piece[1].isalpha():
                        out.append(done + self._ordinary(piece[:n]))
                    else:
                        out.append(done + counts[byte])
                previous, before_previous = piece, done
                done += counts[-1]
            if end > start:
                # inside a special token its characters are ordinary text, which can
                # change the last piece before it only
                for n in range(start + 1, end):
                    out.append(before_previous + self._ordinary(previous + text[start:n]))
                done += 1
                out.append(done)
                at = end
        return out

    def _ordinary(self, text: str) -> int:
        return sum(map(self.count_piece, self.split(text)))

    def truncate(self, text: str, limit: int) -> str:
        """The longest prefix of at most ``limit`` tokens."""
        counts = self._prefix_counts(text)
        return text[: max(i for i, n in enumerate(counts) if n <= limit)]


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """This worker's counter for a file."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    A null or empty text has no bytes and no tokens; long texts are counted
    whole.  Repeated rows and null ids are counted like any other row; an empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_all = counter(path).count_all
        for batch in batches:
            n_bytes, n_tokens = [], []
            for _, part in sliced(batch, "text", 4 * BLOCK_BYTES):
                n_bytes += map(len, part)
                n_tokens += count_all([x.decode("utf-8") for x in part])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = text_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def truncated(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): every text cut to its longest prefix of at most ``limit``
    tokens, as the prefix counts have it.

    A null text stays null, an empty one empty.  Long texts are read whole.
    Repeated rows and null ids are cut like any other row; an empty table gives no
    rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_to = counter(path).truncate
        for batch in batches:
            out = [None if x is None else cut_to(x, limit) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return text_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string")
