"""Vectorised kernels over the UTF-8 buffers of Arrow string columns.

Everything here works on a whole Arrow batch at once with numpy: word and line
spans, 64-bit span hashes, n-gram hashes and duplicate masks.  Nothing loops
over rows in Python.

A span's hash takes its bytes eight at a time through a 64-bit mixer, a long
span's is XXH3; n-grams of few words are polynomial over word hashes.  They decide
equality inside one text or select candidates; operators that join on them across
texts say so in their docstrings.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: An odd multiplier has an inverse modulo 2**64, so a prefix sum can be shifted back.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: White space of the token definition `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes of text that a kernel takes at a time; it bounds the temporary arrays.
CHUNK_BYTES = 1 << 20
#: Spans of up to so many bytes are hashed side by side.
SHORT_SPAN = 64


def tidy(run: Callable) -> Callable:
    """A batch function that gives freed memory back to the system at its end, so that an idle worker holds little."""

    @wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return tidied


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    raw, n = column.buffers(), len(column)
    offsets = np.frombuffer(raw[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; a longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, twice)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept between calls up to one chunk."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        made = []
        for base in (BASE, BASE_INVERSE):
            p = np.full(size, base, U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 4 * CHUNK_BYTES:
            return made[0][:n], made[1][:n]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span's bytes, the same wherever the span stands.

    No polynomial: modulo 2**64 those give the same for some strings of 1,024
    characters whatever the multiplier.
    """
    n = ends - starts
    out = mix(n.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(0x9E3779B97F4A7C15))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    live = np.flatnonzero((n > 0) & (n <= SHORT_SPAN))
    for at in range(0, SHORT_SPAN, 8):
        rest = n[live] - at
        live, rest = live[rest > 0], rest[rest > 0]
        if not len(live):
            break
        part = eights[starts[live] + at]
        part &= ~U64(0) >> ((8 - np.minimum(rest, 8)) * 8).astype(U64)
        out[live] = mix(out[live] ^ part)
    whole = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(n > SHORT_SPAN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(whole[starts[i] : ends[i]])
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words; a word never crosses rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    ink = ~space[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    starts = np.flatnonzero(ink & (~before | edge[:n]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the \\n-split lines; every row has one at least."""
    breaks = np.flatnonzero(data == 0x0A)
    rows = np.searchsorted(offsets, breaks, "right") - 1
    n = len(offsets) - 1
    row = np.concatenate([np.arange(n), rows])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, row))
    row, starts = row[order], starts[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    ends[last] = offsets[1:][row[last]]
    return starts, ends, row


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of a row's bytes are marked."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def ngram_hash(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, valid) of the n words from each word on; valid: all in one row."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    h = np.zeros(m, U64)
    for i in range(n):
        h *= U64(BASE)
        h += words[i : i + m]
    return mix(h), rows[:m] == rows[n - 1 :]


def with_row(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Keys that differ between rows."""
    return mix(keys ^ mix(rows.astype(U64) + U64(0x632BE59BD9B4E019)))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    out = np.zeros(len(keys), bool)
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def seen_before(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    out = np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    out[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return out


def covered(windows: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a marked window; windows[i] marks the places i to i + width - 1."""
    at = np.flatnonzero(windows)
    steps = np.zeros(n + 1, np.int64)
    steps[at] += 1
    steps[at + width] -= 1
    return np.cumsum(steps[:n]) > 0
