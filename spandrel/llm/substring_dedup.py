"""Substring deduplication by suffix automata of reference shards.

A window of K words leaves every document but the one with the smallest id
that has it.  Suffix automata of all reference text cannot be broadcast: their
size grows with the corpus.  So the reference is cut into shards of bounded
size, and segments travel to the automaton they can match instead of automata
to all documents:

1. Documents are dealt into chunks.  A chunk sends each distinct window's hash
   once, packed by hash bucket; a bucket answers with a bit a window: does
   another chunk have it?
2. Runs of windows that another chunk, or another document of the chunk, has
   are cut into segments by minimizer (the smallest hash among the runs of
   ANCHOR words in a window): equal windows have equal minimizers.  A chunk
   sends each distinct segment once, with its smallest document, to the shard
   of its minimizer.
3. A shard deals its minimizers into reference shards of about AUTOMATON_WORDS
   words, builds the suffix automaton of each one's distinct segments, streams
   every distinct segment through it for matching statistics, and so finds the
   smallest document of every window, comparing words, not hashes.
4. Chunks remove the maximal spans of windows with a smaller document.

At scale: texts are shuffled once (by chunk; later steps reuse that exchange),
chunks, buckets and shards are sized by bytes of text and by documents, hashes cost five bytes a distinct window (equal ones are candidates only).  A passage that a third of all
documents share is sent once a chunk in every step, so no task sees more of it
than there are chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, partitions, text_columns, utf8, window_hashes, within, word_hashes, words
from .pieces import gathered
from .suffix_automaton import SuffixAutomaton

#: Words of a window.
K = 13
#: Words of the runs among which a window's minimizer is chosen.
ANCHOR = 6
#: Documents and bytes of a chunk, at most on average; as many times more for each
#: hash bucket and shard.
CHUNK_DOCS, CHUNK_BYTES, BUCKET_CHUNKS = 2048, 1 << 23, 8
#: Words of the segments that share one suffix automaton, about.
AUTOMATON_WORDS = 1 << 15
#: A bucket's hashes are sent with so many bits.
SENT_BITS = 40


def _distinct_sorted(x: np.ndarray) -> np.ndarray:
    """Like numpy.unique, which hashes and takes many times longer on 64-bit values."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


class Chunk:
    """Words and windows of a chunk's documents.  Rows without an id have none."""

    def __init__(self, t: pa.Table, k: int):
        self.k = k
        self.ids = t.column("doc_id").combine_chunks()
        self.has_id = self.ids.is_valid().to_numpy(zero_copy_only=False)
        self.doc_id = self.ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.data, self.offsets = utf8(t.column("text"))
        hashes, firsts, texts, ends = [], [np.zeros(1, np.int64)], [], [np.zeros(1, np.int64)]
        n_words = size = 0
        for a, b in blocks(self.offsets):
            data, offsets = self.data[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a]
            start, end, first = words(data, offsets)
            hashes.append(word_hashes(data, start, end))
            # words one after another, each followed by a blank
            spaced, at = gathered(np.append(data, np.uint8(32)), start, end - start + 1)
            spaced[at - 1] = 32
            texts.append(spaced)
            ends.append(at + size)
            firsts.append(first[1:] + n_words)
            n_words, size = n_words + len(start), size + len(spaced)
        self.hash = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        self.first = np.concatenate(firsts)
        self.text = np.concatenate(texts or [np.zeros(0, np.uint8)])
        self.word_at = np.concatenate(ends)
        ok = within(self.first, k)
        owner = np.repeat(np.arange(len(self.doc_id)), np.diff(self.first))[: len(ok)]
        self.at = np.flatnonzero(ok & self.has_id[owner]) if len(ok) else np.zeros(0, np.int64)
        self.owner = owner[self.at] if len(ok) else self.at
        self.window = window_hashes(self.hash, k)[self.at] if len(ok) else np.zeros(0, np.uint64)


def bucket_bits(n_chunks: int, least: int) -> int:
    """log2 of the number of buckets, and of shards."""
    return max(1, (max(least, -(-n_chunks // BUCKET_CHUNKS)) - 1).bit_length())


def _sent(window: np.ndarray, bits: int) -> np.ndarray:
    return window >> np.uint64(max(0, 64 - SENT_BITS - bits))


def _bucket_edges(sent: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins among sorted sent hashes (and the end)."""
    kept = min(64, SENT_BITS + bits) - bits
    return np.append(np.searchsorted(sent, np.arange(1 << bits, dtype=np.uint64) << np.uint64(kept)), len(sent))


def _distinct(chunk: Chunk, bits: int) -> pa.Table:
    sent = _distinct_sorted(_sent(chunk.window, bits))
    edges = _bucket_edges(sent, bits)
    low = sent.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (min(64, SENT_BITS + bits) - bits + 7) // 8]
    full = np.flatnonzero(np.diff(edges))
    return full, [np.ascontiguousarray(low[edges[b] : edges[b + 1]]).tobytes() for b in full]


def _shared(rows: pa.Table, bits: int) -> tuple[list[int], list[bytes]]:
    """For each chunk's hashes of one bucket, a bit each: has another chunk it?"""
    width = (min(64, SENT_BITS + bits) - bits + 7) // 8
    parts = []
    for blob in rows.column("hashes"):
        raw = np.frombuffer(blob.as_buffer(), np.uint8).reshape(-1, width)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :width] = raw
        parts.append(wide.view("<u8").ravel())
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")  # merges the sorted parts
    ranked = every[order]
    same = np.zeros(len(every), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    same[:-1] |= same[1:].copy()
    flags = np.empty(len(every), bool)
    flags[order] = same
    ends = np.cumsum([len(p) for p in parts])
    return rows.column("chunk").to_pylist(), [np.packbits(flags[e - len(p) : e]).tobytes() for p, e in zip(parts, ends)]


def _repeated(chunk: Chunk, replies: pa.Table, bits: int) -> np.ndarray:
    """Windows that another chunk or another document of this chunk may have."""
    sent = _sent(chunk.window, bits)
    order = np.argsort(sent)
    ranked, doc = sent[order], chunk.doc_id[chunk.owner[order]]
    new = np.ones(len(sent), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    begins = np.flatnonzero(new)
    flags = np.minimum.reduceat(doc, begins) != np.maximum.reduceat(doc, begins) if len(begins) else np.zeros(0, bool)
    edges = _bucket_edges(ranked[begins], bits)
    for b, blob in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()):
        a, z = edges[b], edges[b + 1]
        flags[a:z] |= np.unpackbits(np.frombuffer(blob, np.uint8))[: z - a].astype(bool)
    out = np.empty(len(sent), bool)
    out[order] = flags[np.cumsum(new) - 1]
    return out


def _segments(chunk: Chunk, chosen: np.ndarray, shards: int) -> dict[int, dict[bytes, list[int]]]:
    """By shard: each distinct segment of the chosen windows with its minimizer and
    its smallest and largest document."""
    at, owner = chunk.at[chosen], chunk.owner[chosen]
    out: dict[int, dict[bytes, list[int]]] = {}
    if not len(at):
        return out
    k, a = chunk.k, min(ANCHOR, chunk.k)
    grams = window_hashes(chunk.hash, a)
    least, where = grams[at], at.copy()
    for shift in range(1, k - a + 1):
        other = grams[at + shift]
        less = other < least
        least, where = np.where(less, other, least), np.where(less, at + shift, where)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1]) | (where[1:] != where[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    text, word_at = chunk.text.tobytes(), chunk.word_at
    rows = zip(word_at[at[begin]].tolist(), (word_at[at[end] + k] - 1).tolist(), least[begin].tolist(), chunk.doc_id[owner[begin]].tolist())
    for x, y, m, doc in rows:
        part = out.setdefault(m % shards, {})
        segment = text[x:y]
        known = part.get(segment)
        if known is None:
            part[segment] = [m, doc, doc]
        elif doc < known[1]:
            known[1] = doc
        elif doc > known[2]:
            known[2] = doc
    return out


def _firsts(shard: list[tuple[int, bytes, int]], k: int) -> dict[bytes, list[int]]:
    """The smallest document of every window of each distinct segment, from
    (minimizer, segment, document) rows; a document may repeat.  Windows that are
    equal have equal minimizers, so a minimizer's segments share an automaton."""
    least: dict[bytes, int] = {}
    of: dict[bytes, int] = {}
    for minimizer, segment, doc in shard:
        known = least.get(segment)
        if known is None:
            least[segment], of[segment] = doc, minimizer
        elif doc < known:
            least[segment] = doc
    out: dict[bytes, list[int]] = {}
    reference: dict[bytes, list[bytes]] = {}
    size = 0
    for _, same in groupby(sorted(least, key=of.__getitem__), key=of.__getitem__):
        for segment in same:
            reference[segment] = segment.split(b" ")
            size += len(reference[segment])
        if size >= AUTOMATON_WORDS:
            out.update(_matched(reference, least, k))
            reference, size = {}, 0
    out.update(_matched(reference, least, k))
    return out


def _matched(reference: dict[bytes, list[bytes]], least: dict[bytes, int], k: int) -> Iterator[tuple[bytes, list[int]]]:
    """Each segment of a reference shard streamed through the shard's automaton."""
    automaton = SuffixAutomaton()
    for segment in sorted(reference, key=lambda s: (least[s], s)):
        automaton.add(reference[segment], least[segment])
    for segment, split in reference.items():
        yield segment, automaton.first_documents(split, k)


def _answers(rows: pa.Table, k: int) -> Iterator[tuple[int, bytes, bytes]]:
    """For each chunk: hashes of the windows it sent whose smallest document is
    below the largest it has them in, and those documents."""
    sent = []
    for chunk, segments, minimizers, least, most in zip(*(rows.column(c).to_pylist() for c in ("chunk", "segments", "minimizers", "least", "most"))):
        sent.append((chunk, segments.split(b"\n"), np.frombuffer(minimizers, np.uint64), np.frombuffer(least, np.int64), np.frombuffer(most, np.int64)))
    firsts = _firsts([x for _, s, m, least, _ in sent for x in zip(m.tolist(), s, least.tolist())], k)
    for chunk, segments, _, _, most in sent:
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
        data = np.frombuffer(b"".join(segments), np.uint8)
        start, end, first = words(data, offsets)
        window = window_hashes(word_hashes(data, start, end), k)[within(first, k)]
        docs = np.fromiter((d for s in segments for d in firsts[s]), np.int64, len(window))
        below = docs < np.repeat(most, np.diff(first) - k + 1)
        if below.any():
            yield chunk, window[below].tobytes(), docs[below].tobytes()


def _removed(chunk: Chunk, window: np.ndarray, first_doc: np.ndarray) -> np.ndarray:
    """True for each word covered by a window with a smaller document."""
    gone = np.zeros(len(chunk.hash) + 1, np.int64)
    if len(window) and len(chunk.window):
        order = np.lexsort((first_doc, window))
        window, first_doc = window[order], first_doc[order]
        at = np.minimum(np.searchsorted(window, chunk.window), len(window) - 1)
        hit = chunk.at[(window[at] == chunk.window) & (first_doc[at] < chunk.doc_id[chunk.owner])]
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + chunk.k, -1)
    return np.cumsum(gone)[:-1] > 0


def _kept(chunk: Chunk, gone: np.ndarray) -> pa.Table:
    sizes = np.diff(chunk.word_at)
    stay = ~gone
    text, at = gathered(chunk.text, chunk.word_at[:-1][stay], sizes[stay])
    raw = text.tobytes()
    count = np.concatenate([[0], np.cumsum(stay)])
    at = np.concatenate([[0], at])[count[chunk.first]]
    n_words = np.diff(chunk.first)
    texts = [raw[a : b - 1].decode("utf-8") if b > a else "" for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    return pa.table({"doc_id": chunk.ids, "n_words": n_words, "n_removed": n_words - np.diff(count[chunk.first]), "kept_text": pa.array(texts, pa.string())})


OUTPUT = "doc_id long, n_words long, n_removed long, kept_text string"


def _whole(k: int):
    """Leaves texts as they are, but for the blanks between words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = Chunk(pa.Table.from_batches([batch]), k)
            yield from _kept(chunk, np.zeros(len(chunk.hash), bool)).to_batches()

    return run


def substring_dedup(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row; kept_text has the
    remaining words with one blank between them.

    A null or empty text has no words.  A window that a document repeats within
    itself stays.  Rows that repeat a doc_id are the same document: they remove
    nothing from each other.  A row without an id is left whole and removes
    nothing.  Documents of fewer than k words are left whole.  An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    texts = text_columns(docs, id_col, text_col)
    n_docs, n_bytes = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    least = partitions(spark)
    chunks = max(least, -(-n_docs // CHUNK_DOCS), -(-n_bytes // CHUNK_BYTES))
    bits = bucket_bits(chunks, least)
    shards = 1 << bits
    # rows without an id take no part
    whole = texts.where("doc_id is null").mapInArrow(_whole(k), OUTPUT)
    dealt = texts.where("doc_id is not null").withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(chunks)).cast("int"))
    dealt = dealt.repartition("chunk")

    def send(t: pa.Table) -> pa.Table:
        full, blobs = _distinct(Chunk(t, k), bits)
        return pa.table({"bucket": pa.array(full, pa.int32()), "chunk": pa.array([t.column("chunk")[0].as_py()] * len(full), pa.int32()), "hashes": pa.array(blobs, pa.binary())})

    def share(t: pa.Table) -> pa.Table:
        to, flags = _shared(t, bits)
        return pa.table({"chunk": pa.array(to, pa.int32()), "bucket": pa.array([t.column("bucket")[0].as_py()] * len(to), pa.int32()), "bits": pa.array(flags, pa.binary())})

    def cut_out(t: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        if t.num_rows:
            chunk = Chunk(t, k)
            found = _segments(chunk, _repeated(chunk, replies, bits), shards)
            number = t.column("chunk")[0].as_py()
            for shard, parts in found.items():
                packed = (np.array(x, kind).tobytes() for x, kind in zip(zip(*parts.values()), (np.uint64, np.int64, np.int64)))
                rows.append((shard, number, b"\n".join(parts), *packed))
        columns = list(zip(*rows)) or [[]] * 6
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, [pa.int32()] * 2 + [pa.binary()] * 4)], ["shard", "chunk", "segments", "minimizers", "least", "most"])

    def match(t: pa.Table) -> pa.Table:
        columns = list(zip(*_answers(t, k))) or [[]] * 3
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, [pa.int32(), pa.binary(), pa.binary()])], ["chunk", "windows", "firsts"])

    def remove(t: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(t, k)
        joined = lambda c, kind: np.frombuffer(b"".join(answers.column(c).to_pylist()), kind)
        return _kept(chunk, _removed(chunk, joined("windows", np.uint64), joined("firsts", np.int64)))

    sent = dealt.groupBy("chunk").applyInArrow(send, "bucket int, chunk int, hashes binary")
    shared = sent.groupBy("bucket").applyInArrow(share, "chunk int, bucket int, bits binary")
    segments = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(cut_out, "shard int, chunk int, segments binary, minimizers binary, least binary, most binary")
    answers = segments.groupBy("shard").applyInArrow(match, "chunk int, windows binary, firsts binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(remove, OUTPUT).unionByName(whole)
