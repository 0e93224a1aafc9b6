"""Word and shingle hashes of whole texts, vectorised over Arrow string buffers.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. Memory follows a
slice of a few MB, not the batch; one longer text is its own slice and is hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21
BLOCK = 1 << 19
U = np.uint64
#: Odd base of the polynomial hash modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection with full avalanche)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_value = mix(np.arange(1, 257, dtype=U) * U(BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i <= n; kept for lengths up to a block."""
    size = max(BLOCK * 2, n + 1)
    if size in _powers:
        return _powers[size]
    up, down = np.full(size, BASE, U), np.full(size, INVERSE, U)
    up[0] = down[0] = 1
    out = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    if size == BLOCK * 2:
        _powers[size] = out
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray = _value) -> np.ndarray:
    """64-bit hash of each byte span; spans ascend and do not overlap."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        part = data[base : int(ends[j - 1])]
        up, down = powers(len(part))
        total = np.zeros(len(part) + 1, U)
        np.cumsum(value[part] * up[: len(part)], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
        i = j
    return out


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts; null reads as empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    n, at = len(texts), texts.offset
    off = np.frombuffer(offs, np.int64 if wide else np.int32, n + 1 + at)[at:].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and each text's first word (one more at the end)."""
    n = len(data)
    body = ~_space[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = body[:-1], body[1:]
    if n:
        before[off[:-1][off[:-1] < n]] = False
        last = off[1:] - 1
        after[last[last >= 0]] = False
    starts, ends = np.flatnonzero(body & ~before), np.flatnonzero(body & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and each text's first word."""
    starts, ends, first = words(data, off)
    return span_hashes(_lower[data], starts, ends), first


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct k-word shingle hashes; the whole sequence if it is shorter."""
    n = len(hashes)
    roll = hashes.copy()
    for j in range(1, k):
        roll[: n - j] = mix(roll[: n - j] + U(BASE)) ^ hashes[j:] if n > j else roll[: n - j]
    roll = mix(roll)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(roll[a : b - k + 1])
            yield s if len(s) < 2 else s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            short = np.array([b - a], U)
            for x in hashes[a:b]:
                short = mix(short + U(BASE)) ^ x
            yield mix(short ^ U(0x5555555555555555))
        else:
            yield np.zeros(0, U)
