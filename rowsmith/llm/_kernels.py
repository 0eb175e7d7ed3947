"""Vectorised text kernels over Arrow string buffers.

Everything here works on the concatenated UTF-8 bytes of many texts at once, so
the cost for each byte is a few array operations and no Python object is made
for a word.  Callers cut their batches with :func:`chunks`, which bounds the
working memory by ``CHUNK_BYTES`` (or by the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _BASE)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# Symbols: all ASCII but letters and digits.
_SYMBOL = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        size = max(n, 1 << 16)
        table = np.full(size, base, dtype=_U)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if size <= CHUNK_BYTES + 1:
            _powers[name] = table
    return table[:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, count=n + 1, offset=column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, one text at least."""
    limit = CHUNK_BYTES if limit is None else limit
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`range_hash` takes any range's hash; A-Z count as a-z."""
    summed = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE_LOWER[data] * _power("up", _BASE, len(data)), out=summed[1:])
    return summed


def range_hash(summed: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    hashes = (summed[ends] - summed[starts]) * _power("down", _BASE_INV, len(summed))[starts]
    return mix(hashes + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, separators: str = "space") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts, or runs between any ASCII symbols.

    Returns (starts, ends, hashes, word_offsets): byte ranges, 64-bit hashes
    with A-Z lowered, and where each text's words begin.
    """
    offsets = np.asarray(offsets, np.int64)
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, _U), np.zeros(len(offsets), np.int64)
    inside = ~(_SPACE if separators == "space" else _SYMBOL)[data]
    first = np.zeros(n + 1, dtype=bool)
    first[0] = True
    first[offsets] = True
    begins = inside & (first[:-1] | ~np.concatenate(([False], inside[:-1])))
    finishes = inside & (first[1:] | ~np.concatenate((inside[1:], [False])))
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finishes) + 1
    hashes = range_hash(prefix_sums(data), starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


_LANES = [_U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3, 0xC2B2AE3D27D4EB4F)]


def _joined(hashes: np.ndarray, k: int) -> np.ndarray:
    total = np.zeros(max(0, len(hashes) - k + 1), _U)
    for i in range(k if len(total) else 0):
        lane = _LANES[i % len(_LANES)] + _U(2 * (i // len(_LANES)))
        total += mix(hashes[i : len(hashes) - k + 1 + i] ^ lane) * lane
    return mix(total + _U(k))


def shingles(hashes: np.ndarray, word_offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text.

    A text of 1 to k-1 words has its whole sequence as one shingle; a text
    without words has none.
    """
    joined = _joined(hashes, k)
    out = []
    for lo, hi in zip(word_offsets[:-1].tolist(), word_offsets[1:].tolist(), strict=True):
        if hi - lo >= k:
            s = np.sort(joined[lo : hi - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif hi > lo:
            out.append(_joined(hashes[lo:hi], hi - lo))
        else:
            out.append(np.empty(0, _U))
    return out


def text_shingles(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Yields (first row, shingle sets) chunk by chunk over a string column."""
    data, offsets = string_buffers(column)
    for lo, hi in chunks(offsets):
        part = data[offsets[lo] : offsets[hi]]
        _, _, hashes, word_offsets = words(part, offsets[lo : hi + 1] - offsets[lo])
        yield lo, shingles(hashes, word_offsets, k)
