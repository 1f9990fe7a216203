"""What several operators of this folder share: columns, word hashing in numpy, bounded Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
WS_BYTES = b" \t\n\x0b\x0c\r"
WS_RE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that Spark hands to a Python worker at a time.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches have been limited to ``BATCH_BYTES`` (Spark's own limit is 64 MB, of
    which the JVM and the worker each hold copies). This changes how rows travel, never what comes out."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.match(r"\d+", conf.get(name))
    if conf.get(name).endswith("b") and held and not 0 < int(held[0]) <= BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def held_out(doc_id: Column, of: int, remainder: int = 2) -> Column:
    """crc32 of the id written as text, modulo ``of``, equals ``remainder``; a null id counts as the text ''."""
    crc = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return crc % F.lit(of) == F.lit(remainder)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose ``column`` holds about ``most`` bytes (one row at least), so that the
    Python objects made of a slice stay small whatever the lengths of the texts are."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


# ---- words and their hashes, for all texts of a slice at once ---------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain), on uint64 with wrap-around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(WS_BYTES)] = True
#: The bytes of a little-endian word that belong to a span of so many bytes.
_LEADING = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
#: Spans of more bytes are hashed one by one.
_LONG = 64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def text_data(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets of every text in them); null is the empty text."""
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0]: ends[-1]], ends - ends[0]


def spans(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, none of which goes over one of the positions ``cuts``."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    at = cuts[(cuts > 0) & (cuts < n)]
    begin[at] = inside[at]
    stop[at - 1] = inside[at - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of bytes, the same wherever a span stands. Short spans are mixed eight bytes at a
    time, all spans at once; the mixer between two words is not linear, so texts can not cancel out as they do in sums
    of powers. Long spans go through xxh3."""
    size = (ends - starts).astype(np.int64)
    out = mix64((size.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD))
    if not len(size):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word_at = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from every place on
    live = np.flatnonzero((size > 0) & (size <= _LONG))
    for done in range(0, _LONG, 8):
        if not len(live):
            break
        left = size[live] - done
        word = word_at[starts[live] + done] & _LEADING[np.minimum(left, 8)]
        out[live] = mix64((out[live] ^ word) + np.uint64(_ODD))
        live = live[left > 8]
    long = np.flatnonzero(size > _LONG)
    if len(long):
        held = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh3_64_intdigest(held[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def equal_spans(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray, most: int = 4 << 20) -> np.ndarray:
    """Whether a[a_at[i]: a_at[i] + size[i]] equals b[b_at[i]: b_at[i] + size[i]], byte by byte."""
    out = np.ones(len(size), bool)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        n = size[lo:hi]
        owner = np.repeat(np.arange(lo, hi), n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        out[owner[a[a_at[owner] + step] != b[b_at[owner] + step]]] = False
        lo = hi
    return out


class Words:
    """The words (runs without the contracts' white space) of all texts of a column, with their hashes.

    ``first[i]: first[i + 1]`` are the words of text i; ``lower`` folds A-Z before hashing."""

    def __init__(self, column: pa.Array, lower: bool = True):
        data, self.offsets = text_data(column)
        self.data = LOWER[data] if lower else data
        self.start, self.end = spans(~_SPACE[self.data], self.offsets)
        self.hash = hash_spans(self.data, self.start, self.end)
        self.first = np.searchsorted(self.start, self.offsets)

    def windows(self, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all ``width``-word windows, first window of every text): a text of fewer words is one
        window, a text without words has none."""
        n = np.diff(self.first)
        count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
        first = np.concatenate([[0], np.cumsum(count)])
        begin = np.repeat(self.first[:-1] - first[:-1], count) + np.arange(first[-1])
        size = np.repeat(np.minimum(n, width), count)
        out = size.astype(np.uint64)
        padded = np.concatenate([self.hash, np.zeros(width, np.uint64)])
        for i in range(width):
            step = mix64((out + np.uint64(_ODD)) * np.uint64(_ODD) ^ padded[begin + i])
            out = step if (size > i).all() else np.where(size > i, step, out)
        return out, first


def sizes_within(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes each."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, min(stop, n)
        start = stop
