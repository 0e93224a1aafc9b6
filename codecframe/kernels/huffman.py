"""Huffman code lengths, canonical codes and their run-length form (RFC 1951, 3.2)."""

from __future__ import annotations

import heapq

from codecframe.kernels.bits import BitReader, reverse
from codecframe.status import CORRUPT, CodecError

#: RFC 1951, 3.2.7: order of the code-length code's lengths (fixed values).
ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)
#: Bits of a decoding table's first step; longer codes are looked up one by one.
FIRST = 9


def kraft(lengths: list[int], limit: int = 15) -> int:
    """Sum of 2^(limit - length); 2^limit is a complete code, more is over-subscribed."""
    return sum(1 << (limit - n) for n in lengths if n)


def canonical_codes(lengths: list[int]) -> list[int]:
    out, code, last = [0] * len(lengths), 0, 0
    for n, sym in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[sym], last, code = code, n, code + 1
    return out


def build_lengths(counts: list[int], limit: int = 15) -> list[int]:
    """Optimal code lengths of at most ``limit`` by package-merge; a lone symbol has length 1."""
    leaves = sorted((c, s) for s, c in enumerate(counts) if c)
    out = [0] * len(counts)
    if len(leaves) < 2:
        for _, s in leaves:
            out[s] = 1
        return out
    singles = [(c, (s,)) for c, s in leaves]
    row = singles
    for _ in range(limit - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2], strict=False)]
        row = list(heapq.merge(singles, pairs, key=lambda x: x[0]))
    for _, symbols in row[: 2 * len(leaves) - 2]:
        for s in symbols:
            out[s] += 1
    return out


def run_lengths(lengths: list[int]) -> list[tuple[int, int]]:
    """(symbol, extra) of the code-length alphabet: 16 repeats, 17 and 18 are zeros."""
    out, i = [], 0
    while i < len(lengths):
        v, n = lengths[i], 1
        while i + n < len(lengths) and lengths[i + n] == v:
            n += 1
        i += n
        if v:
            out.append((v, 0))
            n -= 1
        while n:
            most, least, sym = (6, 3, 16) if v else (138, 11, 18) if n >= 11 else (10, 3, 17)
            if n < least:
                out += [(v, 0)] * n
                break
            take = min(n, most)
            out.append((sym, take - least))
            n -= take
    return out


def expand_runs(runs: list[tuple[int, int]]) -> list[int]:
    """Code lengths of their run-length form."""
    out: list[int] = []
    for sym, extra in runs:
        if not 0 <= sym <= 18 or (sym == 16 and not out):
            raise CodecError(CORRUPT, "repeat without a length")
        out += [sym] if sym < 16 else [out[-1]] * (extra + 3) if sym == 16 else [0] * (extra + (3 if sym == 17 else 11))
    return out


def complete(lengths: list[int], limit: int = 7) -> list[int]:
    """Lengths of a complete code: what an incomplete one leaves goes to unused symbols.

    The space left is a sum of different powers of two, each of which is one code; they go
    to the unused symbols that ``ORDER`` names last, the shortest code first. Where there
    are too few of these, the longest codes stay unused.
    """
    left = (1 << limit) - kraft(lengths, limit)
    if left < 0:
        raise CodecError(CORRUPT, "over-subscribed code")
    needed = [1, 1] if left == 1 << limit else [n for n in range(1, limit + 1) if left >> (limit - n) & 1]
    out = list(lengths) + [0] * (len(ORDER) - len(lengths))
    for sym, n in zip((s for s in reversed(ORDER) if not out[s]), needed, strict=False):
        out[sym] = n
    return out


class DecodeTable:
    """Symbols of a canonical code: a table of ``FIRST`` bits, and longer codes by length."""

    def __init__(self, lengths: list[int]):
        if kraft(lengths) > 1 << 15:
            raise CodecError(CORRUPT, "over-subscribed code")
        self.table: list[tuple[int, int] | None] = [None] * (1 << FIRST)
        self.longer: dict[tuple[int, int], int] = {}
        for sym, (n, code) in enumerate(zip(lengths, canonical_codes(lengths), strict=True)):
            if not n:
                continue
            low = reverse(code, n)
            if n > FIRST:
                self.longer[n, low] = sym
            for at in range(low, 1 << FIRST, 1 << n) if n <= FIRST else ():
                self.table[at] = (sym, n)

    def read(self, bits: BitReader) -> int:
        if bits.n < 15:
            bits.fill(15)
        found = self.table[bits.held & ((1 << FIRST) - 1)]
        if found is None:
            found = next(((self.longer[n, low], n) for n in range(FIRST + 1, 16) if (n, low := bits.held & ((1 << n) - 1)) in self.longer), None)
            if found is None:
                raise CodecError(CORRUPT, "no such code" if bits.n >= 15 else "the stream ends early")
        bits.bits(found[1])
        return found[0]
