"""Small helpers shared by the operators: plan choices, text as numpy arrays, 64-bit hashes."""

from __future__ import annotations

import ctypes
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.session import ensure_checkpoint_dir

#: Rows up to which a narrow side (a few numbers a row) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 400_000


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow, already written frame for broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= rows else df


def give_back() -> None:
    """Return freed memory to the system at the end of a task; workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column, separators: str) -> Column:
    """The non-empty pieces between runs of ``separators`` (a character class); null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


# ---- text in Arrow batches ------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row (one more than rows); null is empty."""
    if pa.types.is_large_string(column.type) or column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and offsets.size else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, size: int = 2 << 20):
    """Row ranges of about ``size`` bytes each, one row at least."""
    rows = len(offsets) - 1
    lo = 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, min(hi, rows)
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word (a run of bytes that are not white space) of every row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20_240_229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over prefix sums, then mixed with the length."""
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + step, side="right")))
        n = int(ends[hi - 1] - base)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data[base : base + n]] * _powers(_BASE, n), out=sums[1:])
        back = _powers(_BASE_INVERSE, n + 1)
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix64((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64) * _ODD)
        lo = hi
    return out
