"""Exact deduplication against a minimal perfect hash of historical digests.

Digests (SHA-256 of the text after lower-casing A-Z) that the history has are
kept in shards by digest.  Each shard is a minimal perfect hash: every digest
has a slot of its own, which holds the full digest, the document that stays
(the largest id) and the number of copies.  A lookup compares all bytes of the
digest with the slot's, so a digest the shard lacks is never mistaken for one
it has; such rows are nonmembers and are grouped among themselves.

At scale: only 32-byte digests and ids are shuffled, never texts.  Groups of
copies larger than 1/HOT_SHARE of all rows (at most HOT_SHARE of them, so the
broadcast is bounded) have a shard of their own, which is sent to the rows; all
other groups are small against a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, cut, mixed, sliced, text_columns

#: Groups of more than 1/HOT_SHARE of all rows are answered map-side.
HOT_SHARE = 256
#: Rows dealt to a shard on average.
SHARD_ROWS = 50_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [hashlib.sha256(x.lower()).digest() for _, part in sliced(batch, "text") for x in part]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "digest"])

    return text_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, digest binary")


def _coordinates(digest: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each digest among the n of a shard, and a number to displace."""
    parts = np.ascontiguousarray(digest).view("<u8").reshape(-1, 4)
    return (parts[:, 1] % np.uint64(max(1, n // 3))).astype(np.int64), parts[:, 2]


def _displaced(number: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    return (mixed(number + seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def perfect_hash(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements by bucket, and the slot of each of n distinct digests (n x 32
    bytes).  Buckets are placed from the largest; a bucket of one key names its
    slot directly, as -1 - slot."""
    n = len(digest)
    bucket, number = _coordinates(digest, n)
    n_buckets = max(1, n // 3)
    size = np.bincount(bucket, minlength=n_buckets)
    order = np.argsort(bucket, kind="stable")
    begin = np.concatenate([[0], np.cumsum(size)])
    seeds, slots, taken = np.zeros(n_buckets, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
    big = np.argsort(-size, kind="stable")
    for k in big[size[big] > 1]:
        keys = order[begin[k] : begin[k + 1]]
        if len(np.unique(number[keys])) < len(keys):  # no displacement parts equal numbers
            raise ValueError("digests do not differ enough for a perfect hash")
        # the last buckets of a small shard must hit the last free slots, which can
        # take about n^3 / 6 tries: many are made at a time
        tried, block = 0, 16
        while True:
            at = _displaced(number[keys], np.arange(tried, tried + block)[:, None], n)
            ranked = np.sort(at, axis=1)
            fits = ~taken[at].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if fits.any():
                break
            tried, block = tried + block, min(4096, 4 * block)
        hit = int(fits.argmax())
        seeds[k], slots[keys], taken[at[hit]] = tried + hit, at[hit], True
    single = big[size[big] == 1]
    free = np.flatnonzero(~taken)[: len(single)]
    seeds[single] = -1 - free
    slots[order[begin[single]]] = free
    return seeds, slots


def slot_of(digest: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot that each digest would have among the n of a shard."""
    bucket, number = _coordinates(digest, n)
    seed = seeds[bucket]
    return np.where(seed < 0, -1 - seed, _displaced(number, np.maximum(seed, 0), n))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """Shards of the distinct digests in ``history`` (digest, winner, copies):
    (shard, n, seeds, slots, winners, copies), packed by slot."""

    def build(t: pa.Table) -> pa.Table:
        d = _matrix(t.column("digest"))
        seeds, slots = perfect_hash(d)
        by_slot = np.argsort(slots)
        null = t.column("winner").is_null().to_numpy()[by_slot]
        winners = t.column("winner").fill_null(0).to_numpy()[by_slot]
        row = {
            "shard": t.column("shard")[:1], "n": pa.array([len(d)], pa.int64()),
            "seeds": pa.array([seeds.tobytes()], pa.binary()), "slots": pa.array([d[by_slot].tobytes()], pa.binary()),
            "winners": pa.array([winners.tobytes()], pa.binary()), "no_winner": pa.array([null.tobytes()], pa.binary()),
            "copies": pa.array([t.column("copies").to_numpy()[by_slot].tobytes()], pa.binary()),
        }
        return pa.table(row)

    keyed = history.select("digest", "winner", "copies", _shard(shards))
    return keyed.groupBy("shard").applyInArrow(build, "shard int, n long, seeds binary, slots binary, winners binary, no_winner binary, copies binary")


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


_FOUND = "doc_id long, digest binary, member boolean, winner long, copies long"


def _find(left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows (doc_id, digest) with what the shard in right, if any, has of them."""
    n_rows = left.num_rows
    member, winner, none, copies = np.zeros(n_rows, bool), np.zeros(n_rows, np.int64), np.ones(n_rows, bool), np.zeros(n_rows, np.int64)
    if n_rows and right.num_rows:
        d, n = _matrix(left.column("digest")), right.column("n")[0].as_py()
        unpack = lambda name, kind: np.frombuffer(right.column(name)[0].as_py(), kind)
        at = slot_of(d, unpack("seeds", np.int64), n)
        member = (unpack("slots", np.uint8).reshape(n, 32)[at] == d).all(axis=1)
        winner, none, copies = unpack("winners", np.int64)[at], unpack("no_winner", bool)[at] | ~member, unpack("copies", np.int64)[at]
    return pa.table({"doc_id": left.column("doc_id"), "digest": left.column("digest"), "member": member, "winner": pa.array(winner, mask=none), "copies": pa.array(copies, mask=~member)})


def lookup(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(doc_id, digest, member, winner, copies) of (doc_id, digest) rows."""
    keyed = rows.select("doc_id", "digest", _shard(shards))
    return keyed.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_find, _FOUND)


def lookup_in_place(rows: DataFrame, shard: pa.Table) -> DataFrame:
    """The same against one small shard that travels with the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _find(pa.Table.from_batches([batch]), shard).to_batches()

    return rows.select("doc_id", "digest").mapInArrow(run, _FOUND)


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, winner, copies) of distinct digests."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("copies"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    The history is the first pass over the table: its digests that repeat, each
    with the largest id and the number of rows.  The second pass looks all rows
    up; nonmembers are those whose digest occurs once and form groups of one.

    A null text counts as empty.  Rows that repeat a doc_id are the same
    document and get the same answer.  A null doc_id is below all others: such
    a row stays only in a group without any id.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = cut(digests(docs, id_col, text_col))
    n = rows.count()
    history = cut(grouped(rows).where("copies > 1"))
    # copies add up to n at most, so this broadcast has HOT_SHARE rows at most
    hot = history.where(F.col("copies") > max(1000, n // HOT_SHARE))
    shards = by_key(SHARD_ROWS, spark, n)
    is_hot = F.broadcast(hot.select("digest"))
    index = build_index(history.join(is_hot, "digest", "left_anti"), shards)
    answered = lookup_in_place(rows.join(is_hot, "digest", "left_semi"), build_index(hot, 1).toArrow())
    others = lookup(rows.join(is_hot, "digest", "left_anti"), index, shards)
    found = answered.unionByName(others)
    keep = F.when(F.col("member"), F.col("winner")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.when(F.col("member"), F.col("copies")).otherwise(F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def new_documents(docs: DataFrame, history: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same columns for ``docs`` that arrive after ``history`` (digest, winner,
    copies: the result of grouped()).  A member is a repeat of the history, never
    kept, and has the history's winner and number of copies; nonmembers are grouped
    among themselves, as exact_dedup does.

    A digest that the history has several times counts once, with the largest
    winner and the sum of copies; rows of the history without a digest are not
    read.  A null text counts as empty; a null doc_id is below all others; a
    null winner makes a null keep_id.  Rows that repeat a doc_id get the same
    answer.  Ties go to the largest id.  An empty history makes every row a
    nonmember; an empty ``docs`` gives no rows.

    Each distinct digest is looked up once, so a digest that a third of all rows
    share is one row of a shard; answers to hot digests (at most HOT_SHARE) are
    broadcast back to their rows.
    """
    spark = docs.sparkSession
    rows = cut(digests(docs, id_col, text_col))
    n = rows.count()
    own = cut(grouped(rows))
    once = history.where("digest is not null").groupBy("digest").agg(F.max("winner").alias("winner"), F.sum("copies").cast("long").alias("copies"))
    shards = by_key(SHARD_ROWS, spark, max(n, once.count()))
    found = lookup(own.select(F.col("winner").alias("doc_id"), "digest"), build_index(once, shards), shards)
    found = found.select("digest", "member", F.col("winner").alias("old"), F.col("copies").alias("old_copies"))
    keep, size = F.when(F.col("member"), F.col("old")).otherwise(F.col("winner")), F.when(F.col("member"), F.col("old_copies")).otherwise(F.col("copies"))
    answers = cut(own.join(found, "digest").select("digest", keep.alias("keep_id"), size.alias("group_size"), "member", (F.col("copies") > max(1000, n // HOT_SHARE)).alias("hot")))
    hot = F.broadcast(answers.where("hot"))  # copies add up to n, so these are HOT_SHARE rows at most
    others = rows.join(hot.select("digest"), "digest", "left_anti").join(answers.where("not hot"), "digest")
    out = rows.join(hot, "digest").unionByName(others)
    kept = ~F.col("member") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
