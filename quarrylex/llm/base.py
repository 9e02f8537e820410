"""Shared plumbing of the training-data operators: scratch tables, checked broadcasts and vectorised text scanning.

Text is scanned straight from Arrow's string buffers: one uint8 array per slice of a batch, with document offsets, so that
no Python string is made per document and memory is bounded by the slice. A longer text is a slice of its own, of which
scanners work on windows of LONG bytes, so that it takes some bytes for each word and a few for each byte.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylex.session import shared_folder

#: Bytes of text handled at once by the numpy scanners.
SLICE_BYTES = 1 << 19
#: Bytes of a window of a longer text.
LONG = 1 << 20
#: Rows of (long, ...) keys up to which a side may be broadcast; 1 M longs are 8 MB.
BROADCAST_ROWS = 500_000

_M = np.uint64(0xFF51AFD7ED558CCD)
_N = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A full-avalanche finaliser on uint64."""
    x = x ^ (x >> _S)
    x = x * _M
    x = x ^ (x >> _S)
    x = x * _N
    return x ^ (x >> _S)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared scratch folder and read it back: lineage is cut and executors can be lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_made: list[str] = []


def release(spark, but_last: bool = False) -> int:
    """Delete the tables that materialise has written, once nothing will be read from them: results are lazy, so write them
    first. but_last: keep the one written last. Returns how many were deleted.
    """
    kept = [_made.pop()] if but_last and _made else []
    for path in _made:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    n = len(_made)
    _made[:] = kept
    return n


def semi(df: DataFrame, keys: DataFrame, on: str, n_keys: int) -> DataFrame:
    """df's rows whose key is in keys; keys are broadcast only up to BROADCAST_ROWS, else both sides are shuffled."""
    return df.join(F.broadcast(keys) if n_keys <= BROADCAST_ROWS else keys, on, "left_semi")


def attach(df: DataFrame, side: DataFrame, on: str | list[str], n_side: int, how: str = "inner") -> DataFrame:
    """Join with a side whose row count has been measured; broadcast only below the bound."""
    return df.join(F.broadcast(side) if n_side <= BROADCAST_ROWS else side, on, how)


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra or clashing columns of the input never matter; a missing one is null."""
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    have = set(docs.columns)
    return docs.select(*[(F.col(f"`{n}`") if n in have else F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in names])


class Slice:
    """A run of rows of a batch: their bytes and offsets. lo, hi: row numbers in the batch."""

    __slots__ = ("data", "hi", "lo", "off")

    def __init__(self, data: np.ndarray, off: np.ndarray, lo: int, hi: int):
        self.data, self.off, self.lo, self.hi = data, off, lo, hi

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, positions, side="right") - 1


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """uint8 data and int64 offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Consecutive runs of rows of at most limit bytes (one longer row is a run of its own)."""
    data, off = text_buffers(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield Slice(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lo, hi)
        lo = hi


_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_pow: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of each."""
    if not _pow or len(_pow[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _pow[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse)]
    return _pow[0], _pow[1]


def spans_of(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of mask that don't cross a document's bounds."""
    before = np.empty_like(mask)
    before[:1], before[1:] = False, mask[:-1]
    inside = off[(off < len(mask))]
    before[inside] = False
    after = np.empty_like(mask)
    after[-1:], after[:-1] = False, mask[1:]
    last = off[off > 0] - 1
    after[last] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def windows(s: Slice, stops: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of windows of a slice: all of it, or of a long text parts that end after a byte that stops has.

    A part without such a byte goes on to the next one.
    """
    n, lo = len(s.data), 0
    if n <= LONG or s.n > 1:
        yield 0, n
        return
    while lo < n:
        hi = min(lo + LONG, n)
        if hi < n:
            here = np.flatnonzero(stops[s.data[lo:hi]])
            while not len(here) and hi < n:
                at, hi = hi, min(hi + LONG, n)
                here = np.flatnonzero(stops[s.data[at:hi]]) + (at - lo)
            hi = lo + int(here[-1 if hi - lo <= LONG else 0]) + 1 if len(here) else n
        yield lo, hi
        lo = hi


def words(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words (ASCII letters lower-cased, digits, all other code points)."""
    if len(s.data) > LONG and s.n == 1:
        parts = [(lo, words(Slice(s.data[lo:hi], np.asarray([0, hi - lo]), 0, 1))) for lo, hi in windows(s, ~_WORD)]
        return tuple(np.concatenate([p[k] + lo if k < 2 else p[k] for lo, p in parts]) for k in range(3))
    starts, ends = spans_of(_WORD[s.data], s.off)
    return starts, ends, span_hashes(_LOW[s.data], starts, ends)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOW[data]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, which are in order by both their starts and ends."""
    if len(data) > LONG and len(starts) > 1:
        out, i = [], 0
        while i < len(starts):
            lo = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, lo + LONG // 2, side="right")))
            out.append(span_hashes(data[lo : ends[j - 1]], starts[i:j] - lo, ends[i:j] - lo))
            i = j
        return np.concatenate(out)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points that start before each byte; one longer than data."""
    out = np.zeros(len(data) + 1, np.int32 if len(data) > LONG else np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]], empty segments included."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, dtype=np.float64, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def crc_mod(column: str, mod: int):
    """crc32 of the id as text, modulo mod: the fold of the held-out split."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod
