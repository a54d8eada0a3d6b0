"""Numpy views of Arrow text, and rolling hashes over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240229)
#: A random odd 64-bit value per byte, a multiplier and its inverse modulo 2**64.
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 2**64)
MIX = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * U(2) + U(1)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of terms: ASCII letters and whatever isn't ASCII; with digits in the second.
LETTER = np.arange(256) > 127
LETTER[65:91] = LETTER[97:123] = True
LETTER_OR_DIGIT = LETTER.copy()
LETTER_OR_DIGIT[48:58] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i < n; the table grows as longer texts come."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, U(base))
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def text_chunks(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows of about ``limit`` bytes; null is empty."""
    whole = batch.column(column)
    if whole.null_count:
        whole = whole.fill_null("")
    wide = whole.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = whole.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64) if len(whole) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(whole):
        end = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
        yield start, end, raw[off[start] : off[end]], off[start : end + 1] - off[start]
        start = end


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hashes`` reads the hash of any span."""
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE[data] * powers(BACK, len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, independent of where they lie."""
    return mixed((sums[ends] - sums[starts]) * powers(STEP, len(sums))[starts])


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of bytes that ``inside`` marks), and how many each text has."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = inside[data]
    begins, stops = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = solid[1:-1][cuts]
    stops[cuts - 1] = solid[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    bounds = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(bounds)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and how many each text has."""
    starts, ends, counts = words(data, offsets)
    return span_hashes(prefix_sums(LOWER[data]), starts, ends), counts


def spans_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """The byte spans as an Arrow array of strings."""
    sizes = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    whole = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])] if len(starts) else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(whole)))
