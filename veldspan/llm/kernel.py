"""Vectorised text primitives used inside Arrow tasks.

Every function takes a slice of a text column as one flat byte array with row
offsets, so that a task handles a few megabytes of text at a time however many
rows or however long the rows are.  Words are the maximal runs of bytes other
than 0x20 and 0x09-0x0D; nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 2 << 20
LEAN_BYTES = 1 << 19  # where a task holds whole rows beside its slices; sorting a slice takes some 70 times its bytes
SLICE_ROWS = 4096

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(32)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=U64))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n + n // 8, min(2 * n, SLICE_BYTES), 1), U64(base))  # slices differ a little in length
        out[0] = 1
        have = _powers[base] = np.cumprod(out, dtype=U64)
    return have[:n]


class Slice(NamedTuple):
    lo: int
    hi: int
    data: np.ndarray  # bytes of rows lo..hi-1, concatenated
    offsets: np.ndarray  # int64, hi-lo+1 values from 0
    valid: np.ndarray  # False where the text is null


def text_slices(column: pa.Array, limit: int = SLICE_BYTES, max_rows: int = SLICE_ROWS) -> Iterator[Slice]:
    """Consecutive row ranges of a string column of about ``limit`` bytes and at most ``max_rows`` rows each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_binary():
        column = column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    valid = np.asarray(column.is_valid())
    _, off, dat = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(dat, np.uint8) if dat is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    if not valid.all() and lengths[~valid].any():  # a null row that still owns bytes
        column = pa.array([x if v else b"" for x, v in zip(column.to_pylist(), valid)], pa.large_binary())
        _, off, dat = column.buffers()
        offsets, data = np.frombuffer(off, np.int64)[: n + 1], np.frombuffer(dat, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, lo + max_rows, max(hi, lo + 1))
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], valid[lo:hi])
        lo = hi


class Words(NamedTuple):
    doc: np.ndarray  # row of each word, from 0 in the slice
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each row's first word; rows+1 values


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE) -> Words:
    """All words of a slice, with a 64-bit hash of each; ``space`` tells the bytes between words."""
    n = len(data)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(space[data], out=inside[1:-1])
    change = inside[1:] != inside[:-1]
    # a word never crosses a row: cut where a row starts inside a run
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    glued = np.unique(cuts[inside[cuts] & inside[cuts + 1]])
    starts = np.flatnonzero(change & inside[1:])
    ends = np.flatnonzero(change & inside[:-1])
    if len(glued):
        starts = np.sort(np.concatenate([starts, glued]))
        ends = np.sort(np.concatenate([ends, glued]))
    first = np.searchsorted(starts, offsets, "left")
    first[-1] = len(starts)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return Words(doc, starts, ends, span_hash(LOWER[data] if lower else data, starts, ends), first)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, U64)
    sums = total[1:]
    np.take(_BYTE_CODE, data, out=sums, mode="clip")  # all bytes are inside
    sums *= powers(len(data), _BASE)
    np.cumsum(sums, out=sums)
    return total


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte span; ``total`` may pass in the data's prefix_sums."""
    if total is None:
        total = prefix_sums(data)
    h = (total[ends] - total[starts]) * powers(len(data) + 1, _BASE_INV)[starts]
    return mix(h ^ (ends - starts).astype(U64))


def window_hash(items: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive items; len(items)-size+1 values."""
    n = len(items) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(size):
        out *= U64(_BASE)
        out += items[j : j + n]
    return mix(out)


def shingle_sets(w: Words, rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingles of each row, as (hashes sorted within the row, row offsets).

    A row with fewer words has its whole sequence as one shingle, a row without words none.
    """
    count = np.diff(w.first)
    windows = window_hash(w.hash, size)
    owner = w.doc[: len(windows)]
    whole = owner == w.doc[size - 1 : size - 1 + len(windows)]
    h, owner = windows[whole], owner[whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.zeros(len(short), U64)
        for j in range(size - 1):
            more = count[short] > j
            at = w.first[:-1][short][more] + j
            extra[more] = extra[more] * U64(_BASE) + w.hash[at]
        h = np.concatenate([h, mix(extra ^ (count[short].astype(U64) << U64(56)))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(rows + 1))


def row_of_byte(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def table(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of the schema from arrays by column name."""
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in schema for x in [columns[f.name]]]
    return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


def packed(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of the byte spans between ``offsets`` of the items of ``data``."""
    raw = np.ascontiguousarray(data)
    off = (offsets * raw.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(raw.view(np.uint8))])


def unpacked(column: pa.Array, dtype=U64) -> tuple[np.ndarray, np.ndarray]:
    """The items of a binary column of ``packed`` arrays, and their row offsets."""
    column = column.cast(pa.large_binary())
    _, off, dat = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(dat, np.uint8)[offsets[0] : offsets[-1]] if dat is not None else np.zeros(0, np.uint8)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(raw.tobytes(), dtype), (offsets - offsets[0]) // size
