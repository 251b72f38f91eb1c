"""Helpers of the text operators: bytes of a column of texts as numpy arrays, words and n-grams without a loop over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = "[^\\x20\\x09-\\x0D]+"  # a word: no space, tab, line feed, vertical tab, form feed, carriage return
GAP = "[\\x20\\x09-\\x0D]+"
SPACES = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE_BYTES, PIECE_ROWS = 1 << 19, 512  # a task holds about 40 bytes for each byte of a piece


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fields(rows: DataFrame, without: tuple[str, ...], **more: str) -> T.StructType:
    """The schema of rows without some columns and with more of the named types."""
    kept = [T.StructField(f.name, f.dataType) for f in rows.schema if f.name not in without]
    return T.StructType([*kept, *[T.StructField(c, T.DataType.fromDDL(kind)) for c, kind in more.items()]])


def id_remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = PIECE_BYTES, most_rows: int = PIECE_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with few bytes; a row is never cut. NULL counts as empty."""
    texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(at, at[first] + most_bytes, "right")) - 1
        end = min(max(end, first + 1), first + most_rows, len(texts))
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def padded(data: np.ndarray, at: np.ndarray, before: int, after: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another with `before` and `after` fill bytes around each; and where each begins, with the end."""
    sizes = np.diff(at)
    n = len(sizes)
    out = np.full(len(data) + n * (before + after), fill, np.uint8)
    starts = at + np.arange(n + 1) * (before + after)
    out[np.arange(len(data)) + np.repeat(starts[:-1] + before - at[:-1], sizes)] = data
    return out, starts


def word_spans(data: np.ndarray, at: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of every word of the texts, runs of bytes that are no `gaps`; positions are in `data`."""
    inside = ~gaps[data]
    first, last = inside.copy(), inside.copy()
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(at, begin, "right") - 1, begin, end


_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(step: np.uint64, n: int) -> np.ndarray:
    """step ** 0 .. step ** (n - 1), modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        top = out[done - 1 : done] * step
        out[done : done + more] = out[:more] * top
        done += more
    return out[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: differences of running sums of table values times powers, finalized with the length."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * powers(_STEP, len(data)), out=sums[1:])
    shift = powers(_BACK, len(data) + 1)
    return mixed((sums[end] - sums[begin]) * shift[begin] + (end - begin).astype(np.uint64) * _STEP)
