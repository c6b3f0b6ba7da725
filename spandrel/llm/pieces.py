"""SentencePiece encoding and decoding with shared-prefix forward passes.

A text becomes one string with a mark for every blank, split into marked words
(marks followed by other characters) and at line ends: no piece crosses such a
border, which is checked when a model is loaded.  Distinct words are sorted, which lays their
trie out depth-first, and the forward pass over a prefix is done once for all
words that share it.  For a BPE model, the best path is the one its merges give;
the forward state of a prefix is its last piece (bpe_prefix).  A worker remembers
the words it has met, up to a length; longer ones are encoded each time.

Rows are independent: one pass, no shuffle.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_prefix import PrefixStates, Trail, walk_sorted
from .common import BLOCK_BYTES, sliced, text_columns

MARK = "▁"
_WORDS = re.compile(f"\\n[^{MARK}\\n]*|{MARK}+[^{MARK}\\n]*").findall
#: Words remembered by a worker before it starts anew, and their greatest length.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 48


class _Known(dict):
    """Numbers of words, written without their first mark if they have one (others
    begin with a line end).  A word that is looked up for the first time gets the
    next number and waits to be learnt; one that is too long to be remembered gets
    a negative number, for the texts at hand only."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.long: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        if len(word) > REMEMBERED_LENGTH:
            return self.long.setdefault(word, -1 - len(self.long))
        self[word] = n = len(self)
        self.new.append(word)
        return n


def _marked(word: str) -> str:
    return word if word[:1] == "\n" else MARK + word


class PieceCoder:
    """Encodes and decodes texts as the sentencepiece library does for a BPE model
    with byte fallback and an identity normalizer."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(MARK in pieces[i].lstrip(MARK) or "\n" in pieces[i] for i in usual):
            raise ValueError("a piece crosses the border of a marked word")
        # a better score is an earlier merge
        order = {pieces[i]: -model.get_score(i) for i in usual}
        self.states = PrefixStates(lambda a, b: order.get(a + b), [pieces[i] for i in usual])
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        # ids by the states' token numbers; symbols outside the vocabulary follow as bytes
        self.spell, self.spell_at, self.spell_size = np.array(usual, np.int32), np.arange(len(usual)), np.ones(len(usual), np.int64)
        raw = [b""] * n
        for i in usual:
            raw[i] = pieces[i].replace(MARK, " ").encode("utf-8")
        for b, i in enumerate(self.byte_ids.tolist()):
            raw[i] = bytes([b])
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_size)])[:-1]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known = _Known()
        self.begins, self.sizes, self.flat = Grown(np.int64), Grown(np.int64), Grown(np.int32)
        self.met = np.zeros(0, np.int64)

    def _forget_rare(self) -> None:
        """Keep the words met more than once since the last time, if they are few."""
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > REMEMBERED // 2:
            kept = kept[:0]
        words, sizes = list(self.known), self.sizes.values()[kept]
        flat, ends = gathered(self.flat.values(), self.begins.values()[kept], sizes)
        flat = flat.copy()
        self.forget()
        for n, i in enumerate(kept.tolist()):
            self.known[words[i]] = n
        self.begins.add(ends - sizes)
        self.sizes.add(sizes)
        self.flat.add(flat)

    def _encoded(self, tokens: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given by their tokens, and the number of each word's."""
        names, spelled = self.states.names, len(self.spell_size)
        if spelled < len(names):  # symbols met since the last time
            more = [x.encode("utf-8") for x in names[spelled:]]
            self.spell_size = np.append(self.spell_size, [len(x) for x in more])
            self.spell = np.append(self.spell, self.byte_ids[np.frombuffer(b"".join(more), np.uint8)])
            self.spell_at = np.cumsum(self.spell_size) - self.spell_size
        at = np.array(tokens, np.int64)
        ids, id_ends = gathered(self.spell, self.spell_at[at], self.spell_size[at])
        return ids, np.diff(np.concatenate([[0], id_ends])[[0, *ends]])

    def _learn(self) -> None:
        """Encode the words that wait, in sorted order."""
        marked = list(map(_marked, self.known.new))
        order = sorted(range(len(marked)), key=marked.__getitem__)
        tokens, ends, tokens_of = [], [], self.states.tokens_of
        for _, trail in walk_sorted(self.states, [marked[i] for i in order]):
            tokens += tokens_of(trail)
            ends.append(len(tokens))
        ids, sizes = self._encoded(tokens, ends)
        places = np.empty((2, len(order)), np.int64)
        places[:, order] = self.flat.size + np.cumsum(sizes) - sizes, sizes
        self.begins.add(places[0])
        self.sizes.add(places[1])
        self.flat.add(ids)
        self.known.new.clear()

    def _with_long(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and begin and size of every known word's, then of the long words at hand."""
        flat, begins, sizes = self.flat.values(), self.begins.values(), self.sizes.values()
        if not self.known.long:
            return flat, begins, sizes
        long = []
        for word in self.known.long:
            trail = self.states.trail(compact=True)
            self.states.extend(_marked(word), trail)
            tokens = self.states.tokens_of(trail)
            long.append(self._encoded(tokens, [len(tokens)])[0])
        self.known.long.clear()
        more = np.array([len(x) for x in long], np.int64)
        return np.concatenate([flat, *long]), np.append(begins, len(flat) + np.cumsum(more) - more), np.append(sizes, more)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text's (one more)."""
        if len(self.known) > REMEMBERED:
            self._forget_rare()
        number, numbers, first = self.known.__getitem__, array("q"), [0]
        for x in texts:
            if x:
                words = x.replace("\n", " \n").split(" ")
                if "" in words or MARK in x:  # words with several marks
                    words = [w[1:] if w[0] == MARK else w for w in _WORDS(MARK + x.replace(" ", MARK))]
                numbers.extend(map(number, words))
            first.append(len(numbers))
        self._learn()
        n_known = len(self.known)
        flat, begins, sizes = self._with_long()
        at = np.frombuffer(numbers, np.int64) if numbers else np.zeros(0, np.int64)
        at = np.where(at < 0, n_known - 1 - at, at)
        met = np.bincount(at, minlength=n_known)[:n_known]
        met[: len(self.met)] += self.met
        self.met = met
        ids, ends = gathered(flat, begins[at], sizes[at])
        return ids, np.concatenate([[0], ends])[first]

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of several id sequences: what the library decodes them to."""
        raw, ends = gathered(self.raw, self.raw_at[ids], self.raw_size[ids])
        at = np.concatenate([[0], ends])[offsets]
        data = raw.tobytes()
        out = [data[at[i] : at[i + 1]].decode("utf-8", "replace") for i in range(len(at) - 1)]
        return [x[1:] if x[:1] == " " else x for x in out]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.room, self.size = np.zeros(1 << 16, kind), 0

    def add(self, more: list[int] | np.ndarray) -> None:
        end = self.size + len(more)
        if end > len(self.room):
            self.room = np.concatenate([self.room[: self.size], np.zeros(max(end, 2 * len(self.room)) - self.size, self.room.dtype)])
        self.room[self.size : end] = more
        self.size = end

    def values(self) -> np.ndarray:
        return self.room[: self.size]


def gathered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[begin : begin + size] of each range in a row, and where each ends."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return flat[:0], ends
    shift = np.repeat(begins - (ends - sizes), sizes)
    return flat[shift + np.arange(ends[-1])], ends


_coders: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    """This worker's coder for a model."""
    if path not in _coders:
        _coders.clear()
        _coders[path] = PieceCoder(path)
    return _coders[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pieces array<int>, n_pieces, round_trip) of every row; round_trip
    says whether the pieces decode to the text again.

    A null or empty text has no pieces and makes the trip as the empty text.
    Texts are encoded whole.  A text that itself holds the mark character
    decodes to a blank there, so it does not make the trip.  Repeated rows and
    null ids are encoded like any other row; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            doc_id = batch.column("doc_id")
            for first, part in sliced(batch, "text", 2 * BLOCK_BYTES):
                texts = [x.decode("utf-8") for x in part]
                ids, offsets = c.encode_all(texts)
                same = [a == b for a, b in zip(c.decode_all(ids, offsets), texts)]
                pieces = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([doc_id.slice(first, len(part)), pieces, pa.array(np.diff(offsets)), pa.array(same, pa.bool_())], ["doc_id", "pieces", "n_pieces", "round_trip"])

    return text_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, pieces array<int>, n_pieces long, round_trip boolean")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """(doc_id, text) of encoded rows.

    Null pieces give a null text, an empty list the empty text.  Pieces that are no
    valid UTF-8 together give replacement characters.  Repeated rows and null ids
    are decoded like any other row; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            out = [None if x is None else c.decode(x) for x in batch.column(pieces_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr(f"`{id_col}` doc_id", f"`{pieces_col}` {pieces_col}").mapInArrow(run, "doc_id long, text string")
