"""Words, windows and hashes of a text column, on whole Arrow batches.

A batch of texts is one byte array plus row offsets. Words are runs of bytes of
a class, and the hash of any byte range comes from one running sum, so nothing
here loops over words in Python. Texts are cut into batches by bytes, never
inside a row: memory is bounded by ``PIECE`` bytes or one longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 5  # odd, so that its powers can be undone
_INVERSE = pow(BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _class(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)])


# [^\x20\x09-\x0D]+ : all bytes but six; bytes of longer code points are inside.
NO_SPACE = _class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z.
LETTERS = _class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next batch."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + 4096), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 2 * PIECE:
            _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``limit`` bytes of text, or one row."""
    _, offsets = column_bytes(batch.column(column))
    first, n = 0, batch.num_rows
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield batch.slice(first, last - first)
        first = last


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, row offsets); a null is empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, first word of each row and the total)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    mask = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = mask.copy()
    starts[1:] &= ~mask[:-1] | edge[1:n]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def running(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``ranges`` takes the hash of any byte range."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(BASE, len(data)), out=sums[1:])
    return sums


def ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges: equal bytes, equal hash, wherever they lie."""
    raw = (sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words inside each row, and each row's first.

    A row with fewer words, but not none, has its whole sequence as one run.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    total = int(begin[-1])
    row = np.repeat(np.arange(len(n)), count)
    at = first[:-1][row] + np.arange(total) - begin[:-1][row]
    size = np.minimum(n, width)[row]
    out = size.astype(np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    for j in range(width):
        step = mix(out * np.uint64(BASE) + padded[at + j])
        out = np.where(j < size, step, out)
    return out, begin
