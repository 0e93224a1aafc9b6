"""CRC-32 of a whole from the CRCs and lengths of its parts."""

from __future__ import annotations

from functools import lru_cache

POLY = 0xEDB88320


def _times(matrix: tuple[int, ...], vec: int) -> int:
    out = 0
    for row in matrix:
        if vec & 1:
            out ^= row
        vec >>= 1
    return out


@lru_cache(128)
def _zeros(power: int) -> tuple[int, ...]:
    """Operator that appends 2^power zero bits."""
    if power == 0:
        return (POLY, *(1 << i for i in range(31)))
    m = _zeros(power - 1)
    return tuple(_times(m, row) for row in m)


def combine(first: int, second: int, second_len: int) -> int:
    """Finalised CRC of two parts; associative, so parts may be combined in any grouping."""
    bits, power = second_len * 8, 0
    while bits:
        if bits & 1:
            first = _times(_zeros(power), first)
        bits >>= 1
        power += 1
    return first ^ second
