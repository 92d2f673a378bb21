"""Helpers the training-data operators share: word arithmetic over Arrow batches, cut by bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word separators of most contracts: space and the five control characters 9 to 13.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z on bytes, all other bytes unchanged.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_MIX_A, _MIX_B, _SEED = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0xD6E8FEB86659FD93)


def ascii_lower(col):
    """A-Z lower-cased, every other character unchanged."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_hash(doc_id: Column, text: Column) -> Column:
    """A 64-bit name of a row by doc_id and text; null and empty texts count as one."""
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text.cast("string"), F.lit("")))


#: Bits of a bitmap of keys, and of the slices that tasks make it in.
BITS, SLICE_BITS = 1 << 27, 1 << 20


def may_be_in(keys: DataFrame) -> Callable[[Column], Column]:
    """A condition that holds for all values of ``keys``, one column of 64-bit hashes without nulls, and by chance for few others.

    It is read off a bitmap of a fixed size, so that rows without a key needn't be shuffled to find that out.
    """
    bit = F.col(keys.columns[0]).bitwiseAND(F.lit(BITS - 1))

    def build(rows: pa.Table) -> pa.Table:
        part = np.zeros(SLICE_BITS, bool)
        part[rows["bit"].to_numpy()] = True
        return pa.table({"slice": rows["slice"][:1], "bits": pa.array([np.packbits(part, bitorder="little").tobytes()])})

    placed = keys.select(F.floor(bit / SLICE_BITS).alias("slice"), F.pmod(bit, F.lit(SLICE_BITS)).alias("bit")).groupBy("slice")
    bitmap = np.zeros((BITS // SLICE_BITS, SLICE_BITS // 8), np.uint8)
    for at, bits in zip(*(c.to_pylist() for c in placed.applyInArrow(build, "slice long, bits binary").toArrow().columns), strict=True):
        bitmap[at] = np.frombuffer(bits, np.uint8)
    sent, most = keys.sparkSession.sparkContext.broadcast(bitmap.ravel()), BITS - 1

    @F.pandas_udf("boolean")
    def held(key: pd.Series) -> pd.Series:
        at = key.to_numpy() & most
        return pd.Series((sent.value[at >> 3] >> (at & 7)) & 1 == 1)

    return held


#: Text that one step over a batch holds at a time: a batch of long texts is cut into more steps.
SLICE_BYTES, SLICE_ROWS = 8 << 20, 512


def slices(batch: pa.RecordBatch, text: int, most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``most_rows`` rows and, but for a single longer text, ``most_bytes`` bytes of column ``text``."""
    column = batch.column(text)
    size = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = ends[at] - size[at]
        stop = max(at + 1, min(int(np.searchsorted(ends, before + most_bytes, side="right")), at + most_rows))
        yield batch.slice(at, stop - at)
        at = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column back to back, and each row's start with the end appended; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, rows: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in ``data``, and for each row the index of its first word (the total appended)."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = rows[(rows > 0) & (rows < len(data))]
    begins[cuts] = inside[cuts]  # a row's first character never continues the word before it
    stops = np.zeros(len(data) + 1, dtype=bool)
    stops[1:] = inside[:-1] & ~inside[1:]
    stops[cuts] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, rows)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    return _mix(a * _ROLL + b)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, eight bytes a round, only over words that still have bytes."""
    lengths = ends - starts
    out = _mix(lengths.astype(np.uint64) + _SEED)
    if not len(starts):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), np.uint64, padded, strides=(1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
    live, at, left = np.arange(len(starts)), starts, lengths
    while len(live):
        out[live] = _mix((out[live] ^ (eights[at] & masks[np.minimum(left, 8)])) + _SEED)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def window_hashes(words: np.ndarray, first: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` consecutive words of each row, and each row's first window (the total appended).

    With ``short``, a row of fewer words, but not none, has its whole sequence as its one window.
    """
    counts = np.diff(first)
    per_row = np.maximum(counts - width + 1, 0)
    few = (per_row == 0) & (counts > 0) & short
    per_row = np.where(few, 1, per_row)
    index = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(per_row, out=index[1:])
    row_of = np.repeat(np.arange(len(counts)), per_row)
    begin = first[row_of] + np.arange(index[-1]) - index[row_of]
    out = np.full(len(begin), np.uint64(width), np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        out = out * _ROLL + padded[begin + k]
    out = _mix(out)
    for row in np.flatnonzero(few):
        h = np.full(1, np.uint64(1_000_003) * np.uint64(counts[row]), np.uint64)
        for k in range(first[row], first[row + 1]):
            h = h * _ROLL + words[k : k + 1]
        out[index[row]] = _mix(h)[0]
    return out, index
