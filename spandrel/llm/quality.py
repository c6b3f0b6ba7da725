"""Quality rules: exact base rules and a hashed n-gram logistic regression.

The model sees words and runs of four bytes, hashed into buckets.  It is
trained on a bounded sample of labelled documents, calibrated on a part of the
sample it has not seen, and applied in Arrow batches with fixed thresholds.

At scale: training reads the labels and about TRAIN_LIMIT documents a label at
most, long ones only where there is no other; its tables (a few hundred KB)
travel with the tasks.  Scoring is one pass without a shuffle, in memory that
follows the longest text, several times its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, mixed, per_document, text_columns, window_hashes, within, word_hashes, words
from .linear import BITS, documents, features, means, platt, sample, sigmoid, trainable

#: Labelled documents used for training, at most, for each label.
TRAIN_LIMIT = 1500
#: Documents scored below this probability of good quality are rejected.
THRESHOLD = 0.2
#: Base rules: fewer words than this fail, or more than this percentage of words in repeated windows.
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
GRAMS = (4,)


@dataclass
class QualityModel:
    """Weights by bucket, intercept, and the calibration of the margin."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return means(self.weights, features(data, offsets, GRAMS, True)) + self.bias

    def probabilities(self, margin: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * margin + self.shift)


def fit(texts: list[str], y: np.ndarray, held: np.ndarray, epochs: int = 40, rate: float = 0.5, seed: int = 3) -> QualityModel:
    """Adagrad on the logistic loss, both classes weighing the same; ``held`` rows
    serve for calibration only."""
    rng = np.random.default_rng(seed)
    weights = np.zeros((len(GRAMS) + 1) << BITS)
    model = QualityModel(weights, 0.0, 1.0, 0.0)
    if not len(y):
        model.shift = 40.0  # nothing to learn from: nothing is rejected
        return model
    per_doc = []
    for text in texts:
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        buckets, values = [], []
        for b, s, e in features(data, np.array([0, len(data)]), GRAMS, True):
            ids, n = np.unique(b[s[0] : e[0]], return_counts=True)
            buckets.append(ids)
            values.append(n / max(1, n.sum()))
        per_doc.append((np.concatenate(buckets), np.concatenate(values)))
    train = np.flatnonzero(~held)
    share = np.array([max(1, (y[train] == k).sum()) for k in (0, 1)], float)
    loss_weight = len(train) / (2 * share[y])
    seen, bias_seen = np.full(len(weights), 1e-8), 1e-8
    for _ in range(epochs):
        for i in rng.permutation(train):
            b, v = per_doc[i]
            g = (sigmoid(weights[b] @ v + model.bias) - y[i]) * loss_weight[i]
            step = g * v
            seen[b] += step * step
            weights[b] -= rate * step / np.sqrt(seen[b])
            bias_seen += g * g
            model.bias -= rate * 0.2 * g / np.sqrt(bias_seen)
    check = np.flatnonzero(held) if held.any() and len(set(y[held])) == 2 else train
    margin = np.array([weights[per_doc[i][0]] @ per_doc[i][1] + model.bias for i in check])
    model.slope, model.shift = platt(margin, y[check])
    return model


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_LIMIT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """A model from labelled documents: about ``limit`` of each label at most, chosen by
    a hash of the id.  Labels other than 0 and 1, null ids and null texts are not
    used; of several labels of a document the smallest counts."""
    clean = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("y"))
    chosen = sample(clean, "doc_id", "y", limit, 2 * limit)  # about 2 * limit rows at most
    rows = text_columns(docs, id_col, text_col).where("text is not null").join(F.broadcast(chosen), "doc_id")
    once = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"), F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(4)).alias("part"))
    got = trainable(once, "doc_id", "y", "text").orderBy("doc_id").toArrow()
    y = got.column("y").to_numpy().astype(np.int64)
    return fit(got.column("text").to_pylist(), y, got.column("part").to_numpy() == 0)


#: Bytes that begin a code point of a word, and symbols.
_BEGINS = np.ones(256, bool)
_BEGINS[0x80:0xC0] = False
_BEGINS[list(SPACE_BYTES)] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LINE_SPACE = b" \t\r\x0b\x0c"


def _counted(marked: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of marked bytes by document."""
    hits = marked[data]
    return np.array([np.count_nonzero(hits[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], np.int64)


def base_features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words by document."""
    n_docs = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    repeated = np.zeros(len(starts) + 1, np.int64)
    windows = window_hashes(word_hashes(data, starts, ends), 3) if len(starts) else np.zeros(0, np.uint64)
    if len(windows):
        doc = np.repeat(np.arange(n_docs), np.diff(first))[: len(windows)]
        keyed = windows ^ mixed(doc.astype(np.uint64) + np.uint64(1))
        at = np.flatnonzero(within(first, 3))
        _, group, count = np.unique(keyed[at], return_inverse=True, return_counts=True)
        twice = at[count[group] > 1]
        covered = np.zeros(len(starts) + 1, np.int64)
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 3, -1)
        repeated[:-1] = np.cumsum(covered[:-1]) > 0
    dup = np.zeros(n_docs, np.int64)
    raw = data.tobytes()
    for i in range(n_docs):
        lines = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip(_LINE_SPACE)]
        dup[i] = len(lines) - len(set(lines))
    return {
        "n_words": np.diff(first), "word_chars": _counted(_BEGINS, data, offsets), "n_symbols": _counted(_SYMBOL, data, offsets),
        "n_dup_lines": dup, "n_repeat_words": per_document(repeated[:-1], first),
    }


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


def quality_rules(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base features, base_failed, kept, and the calibrated probability
    ``quality`` of every row.

    A null or empty text has no words and fails the base rules.  Texts are read
    whole.  Windows are compared by 64-bit hashes within one document.  Repeated
    rows and null ids are judged like any other row; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[str, list[np.ndarray]] = {}
            for _, _, data, offsets in documents(batch.column("text")):
                found = base_features(data, offsets)
                found["quality"] = model.probabilities(model.margins(data, offsets))
                for k, v in found.items():
                    parts.setdefault(k, []).append(v)
            if not parts:
                continue
            out = {k: np.concatenate(v) for k, v in parts.items()}
            n = out["n_words"]
            failed = (n < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED * n)
            kept = ~failed & (out["quality"] >= threshold)
            columns = [batch.column("doc_id"), *(pa.array(out[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(kept), pa.array(out["quality"])]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return text_columns(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def keep_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the quality rules keep; what
    quality_rules says of nulls and empty texts holds.  One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for _, _, data, offsets in documents(batch.column(text_col)):
                found = base_features(data, offsets)
                n = found["n_words"]
                passed = (n >= MIN_WORDS) & (100 * found["n_repeat_words"] <= MAX_REPEATED * n)
                kept.append(passed & (model.probabilities(model.margins(data, offsets)) >= threshold))
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
