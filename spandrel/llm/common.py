"""Helpers shared by the text operators: tables, lineage cuts, word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Bytes of text that vectorised kernels handle at a time.
BLOCK_BYTES = 1 << 19

#: A word is a maximal run of bytes other than these (ASCII white space).
SPACE_BYTES = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share (spandrel.session)."""
    return shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, cutting its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes, each of one document at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def sliced(table_: pa.Table | pa.RecordBatch, column: str, size: int = BLOCK_BYTES):
    """(first row, list of byte strings) of a text column, about ``size`` bytes at a time."""
    data, offsets = utf8(table_.column(column))
    raw = memoryview(data) if len(data) else memoryview(b"")
    for first, last in blocks(offsets, size):
        yield first, [bytes(raw[offsets[i] : offsets[i + 1]]) for i in range(first, last)]


def _odd_powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
    return out


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            grown = max(n, 2 * len(self.up))
            self.up, self.down = _odd_powers(self.base, grown), _odd_powers(self.inverse, grown)
        return self.up[:n], self.down[:n]


_BYTE_POWERS = Powers(0x9E3779B97F4A7C15 | 1)
_WORD_POWERS = Powers(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_BYTE_CODES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of all words, and the index of the first word of each document
    (one entry more than documents).  Words never cross documents."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    ink = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of byte codes times powers of the place in the word, unmixed."""
    up, down = _BYTE_POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = 2 * BLOCK_BYTES) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands.  The
    words of about ``size`` bytes are hashed at a time, a longer one in parts."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + size, "right"))
        if j > i:
            out[i:j] = _range_hashes(data[lo : ends[j - 1]], starts[i:j] - lo, ends[i:j] - lo)
        else:
            j, total = i + 1, 0
            for at in range(lo, int(ends[i]), size):
                part = data[at : min(at + size, int(ends[i]))]
                one = _range_hashes(part, np.zeros(1, np.int64), np.array([len(part)]))
                total += int(one[0]) * pow(_BYTE_POWERS.base, at - lo, 1 << 64)
            out[i] = total % (1 << 64)
        i = j
    return mixed(out)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive words (also across documents)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _WORD_POWERS.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=total[1:])
    return mixed((total[k:] - total[:-k]) * down[: n - k + 1])


def within(first: np.ndarray, k: int) -> np.ndarray:
    """True for each run of k words that lies in one document; first: as of words()."""
    n = int(first[-1]) if len(first) else 0
    if n < k:
        return np.zeros(0, bool)
    ok = np.ones(n - k + 1, bool)
    for back in range(1, k):
        at = first[1:-1] - back
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over ranges [first[i], first[i+1])."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def by_key(n_rows_per_group: int, spark: SparkSession, n_rows: int) -> int:
    """Groups to deal rows into so that each holds a bounded share of them."""
    return max(partitions(spark), -(-n_rows // n_rows_per_group))


def text_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
