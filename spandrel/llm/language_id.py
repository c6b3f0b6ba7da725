"""Language identification: averaged hashed subword embeddings, linear softmax.

A document is the average of the embeddings of its runs of three and four
bytes and of its words.  Embeddings and the softmax layer are trained together
by stochastic gradient descent in numpy.  For scoring, embedding times layer is
one small table if there are no more languages than dimensions, so a document's
logits are averages of table rows; with more languages the averaged embedding is
multiplied by the layer.  There is no limit to the number of languages.

Scores are calibrated by a temperature on documents that training has not
used; below a threshold fitted there a prediction is not ``accepted``.

At scale: training reads a bounded sample (TRAIN_LIMIT a language and TRAIN_MOST
in all, long texts only where there is no other, counted by language map-side);
the table travels with the tasks; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_columns
from .linear import BITS, documents, features, means, sample, trainable

#: Documents used for training, at most, for each language.
TRAIN_LIMIT = 400
#: Documents used for training in all; with many languages each has fewer, one at least.
TRAIN_MOST = 25_600
#: Share of the calibration documents that rejection may lose.
REJECT_SHARE = 0.01
DIMENSIONS = 16
GRAMS = (3, 4)
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}").search


@dataclass
class LanguageModel:
    """Logits by bucket and language (or, with a layer, the embedding by bucket), the
    temperature and the least accepted score."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    layer: np.ndarray | None = None
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.finished(means(self.table, features(data, offsets, GRAMS, True)))

    def finished(self, averaged: np.ndarray) -> np.ndarray:
        return (averaged if self.layer is None else averaged @ self.layer) + self.bias

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return softmax(logits / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], y: np.ndarray, held: np.ndarray, languages: list[str], epochs: int = 12, rate: float = 2.0, seed: int = 7) -> LanguageModel:
    """Stochastic gradient descent over documents, with a falling step."""
    rng = np.random.default_rng(seed)
    n = (len(GRAMS) + 1) << BITS
    embedding = rng.normal(0, 0.1, (n, DIMENSIONS))
    layer, bias = rng.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    per_doc = []
    for text in texts:
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        buckets, values = [], []
        for b, s, e in features(data, np.array([0, len(data)]), GRAMS, True):
            ids, counts = np.unique(b[s[0] : e[0]], return_counts=True)
            buckets.append(ids)
            values.append(counts / max(1, counts.sum()))
        per_doc.append((np.concatenate(buckets), np.concatenate(values)))
    train = np.flatnonzero(~held)
    step_n, steps = 0, max(1, epochs * len(train))
    for _ in range(epochs):
        for i in rng.permutation(train):
            b, v = per_doc[i]
            eta = rate * (1 - step_n / steps)
            step_n += 1
            hidden = v @ embedding[b]
            g = softmax((hidden @ layer + bias)[None, :])[0]
            g[y[i]] -= 1
            back = layer @ g
            layer -= eta * np.outer(hidden, g)
            bias -= 0.1 * eta * g
            embedding[b] -= eta * v[:, None] * back[None, :]
    if len(languages) <= DIMENSIONS:
        model = LanguageModel(languages, (embedding @ layer).astype(np.float32), bias)
    else:
        model = LanguageModel(languages, embedding.astype(np.float32), bias, layer)
    check = np.flatnonzero(held) if held.any() else train
    z = np.array([model.finished(per_doc[i][1] @ model.table[per_doc[i][0]]) for i in check])
    if len(z):
        options = np.geomspace(0.1, 10, 60)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(z)), y[check]], 1e-12)).mean() for t in options]
        model.temperature = float(options[int(np.argmin(loss))])
        model.least = float(np.quantile(model.scores(z).max(axis=1), REJECT_SHARE))
    return model


def remainder(id_col: str):
    """crc32 of the id as text, modulo 3."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def train(docs: DataFrame, limit: int = TRAIN_LIMIT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model from documents whose crc32(id) mod 3 is not 1 and whose language and
    text are known: at most about ``limit`` a language, chosen by a hash of the id
    whose range is fitted to the language's number of documents."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where((F.coalesce(remainder("doc_id"), F.lit(0)) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = trainable(sample(known, "doc_id", "lang", limit, TRAIN_MOST), "doc_id", "lang", "text").withColumn("part", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(29)), F.lit(4)))
    got = chosen.orderBy("doc_id", "lang", "text").toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    if not languages:
        return LanguageModel([], np.zeros(((len(GRAMS) + 1) << BITS, 1), np.float32), np.zeros(1))
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([number[x] for x in got.column("lang").to_pylist()], np.int64)
    return fit(got.column("text").to_pylist(), y, got.column("part").to_numpy() == 0, languages)


def language_id(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every row.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if no language was learnt.  held_out marks documents that training
    never sees (a null id is not held out).  Texts are read whole; ties between
    languages go to the first in alphabetical order.  Repeated rows are answered
    like any other row; an empty table gives no rows.
    """
    names = np.array([*model.languages, UNDETERMINED], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = [], []
            for _, _, data, offsets in documents(batch.column("text")):
                p = model.scores(model.logits(data, offsets))
                best.append(p.argmax(axis=1))
                score.append(p.max(axis=1))
            if not best:
                continue
            best, score = np.concatenate(best), np.concatenate(score)
            for i, text in enumerate(batch.column("text").to_pylist()):
                if not model.languages or text is None or not _LETTER(text):
                    best[i], score[i] = len(names) - 1, 0.0
            accepted = (score >= model.least) & (best < len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score), pa.array(accepted)], ["doc_id", "lang_pred", "score", "accepted"])

    out = text_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
    return out.select("doc_id", F.coalesce(remainder("doc_id") == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
