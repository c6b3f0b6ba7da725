"""Hashed n-gram features and the numpy models trained on them.

Features are buckets: hashes of words and of runs of bytes.  A document's
representation is the mean over its features, so a linear model over it is a
sum of table look-ups; training sees a bounded sample of labelled documents
(the bound is a parameter), scoring sees every byte of every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, utf8, word_hashes, words

#: Longer texts, in bytes, are trained on only where a label has no other, and few of them.
LONG_TEXT, LONG_LIMIT = 1 << 16, 4
#: Buckets are numbered with so many bits, for bytes and for words alike.
BITS = 16
_SEEDS = {2: 0x9E3779B1, 3: 0x85EBCA6B, 4: 0xC2B2AE35, 5: 0x27D4EB2F}


def byte_grams(data: np.ndarray, n: int, bits: int = BITS) -> np.ndarray:
    """The bucket of the n bytes that begin at each position; positions near the
    end of the data take zeros for what is missing."""
    padded = np.concatenate([data, np.zeros(n, np.uint8)]).astype(np.uint32)
    h = np.zeros(len(data), np.uint32)
    for k in range(n):
        h = (h ^ padded[k : k + len(data)]) * np.uint32(_SEEDS[n])
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def features(data: np.ndarray, offsets: np.ndarray, grams: tuple[int, ...], with_words: bool, bits: int = BITS):
    """Lists of (buckets, first feature of each document and one more): one list
    for each n of grams, then words.  Byte runs that reach into the next document
    are left out by ending the document's range early."""
    out = []
    for k, n in enumerate(grams):
        starts = offsets[:-1]
        ends = np.maximum(offsets[1:] - (n - 1), starts)
        out.append((byte_grams(data, n, bits) + np.uint32(k << bits), starts, ends))
    if with_words:
        at, end, first = words(data, offsets)
        h = word_hashes(data, at, end) if len(at) else np.zeros(0, np.uint64)
        out.append(((h >> np.uint64(64 - bits)).astype(np.uint32) + np.uint32(len(grams) << bits), first[:-1], first[1:]))
    return out


def means(table: np.ndarray, parts, step: int = 1 << 17) -> np.ndarray:
    """Sum over feature kinds of the mean of their table rows, by document.  Rows are
    summed ``step`` at a time, so memory follows neither a text's length nor, but
    for one block, the width of the table."""
    total = None
    for buckets, starts, ends in parts:
        sums = np.zeros((len(starts), *table.shape[1:]), np.float64)
        for lo in range(0, len(buckets), step):
            hi = min(lo + step, len(buckets))
            a, b = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(starts, hi, "left"))
            upto = np.zeros((hi - lo + 1, *table.shape[1:]), np.float64)
            np.cumsum(table[buckets[lo:hi]], axis=0, out=upto[1:])
            sums[a:b] += upto[np.clip(ends[a:b], lo, hi) - lo] - upto[np.clip(starts[a:b], lo, hi) - lo]
        one = sums / np.maximum(ends - starts, 1).reshape(-1, *[1] * (table.ndim - 1))
        total = one if total is None else total + one
    return total


def sample(labelled: DataFrame, id_col: str, label_col: str, limit: int, most: int) -> DataFrame:
    """Rows to train on: about ``limit`` a label, and ``most`` in all, chosen by a hash
    of the id whose range is fitted to the label's number of rows; the same on
    every run.  Every label has its share."""
    counts = labelled.groupBy(label_col).count().collect()  # one row a label
    if not counts:
        return labelled.where(F.lit(False))
    each = max(1, min(limit, most // len(counts)))
    # the broadcast has one row a label, fewer bytes than the model that goes to every task
    kind = labelled.schema[label_col].dataType.simpleString()
    shares = labelled.sparkSession.createDataFrame([(r[label_col], min(1.0, each / r["count"])) for r in counts], f"_label {kind}, _share double")
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    return labelled.join(F.broadcast(shares), F.col(label_col) == F.col("_label")).where(u < F.col("_share")).drop("_label", "_share")


def trainable(rows: DataFrame, id_col: str, label_col: str, text_col: str) -> DataFrame:
    """The rows of a sample without texts of more than LONG_TEXT bytes; a label that
    has no other keeps LONG_LIMIT of them.  So what goes to the driver is bounded in
    bytes.  The windows run over the sample only."""
    short = F.octet_length(text_col) <= LONG_TEXT
    out = rows.withColumn("_any", F.max(short).over(Window.partitionBy(label_col)))
    out = out.withColumn("_nth", F.row_number().over(Window.partitionBy(label_col).orderBy(id_col, text_col)))
    return out.where(short | (~F.col("_any") & (F.col("_nth") <= LONG_LIMIT))).drop("_any", "_nth")


def documents(texts: pa.ChunkedArray, size: int = 1 << 18):
    """(first document, last document, data, offsets) by blocks of texts."""
    data, offsets = utf8(texts)
    for first, last in blocks(offsets, size):
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and intercept that make sigmoid(a * margin + b) a probability, by
    Newton's method with the usual smoothed targets."""
    if not len(y):
        return 1.0, 0.0
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        g, w = p - t, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * margin).sum() + 1e-4 * a, g.sum()])
        hess = np.array([[(w * margin * margin).sum() + 1e-4, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
