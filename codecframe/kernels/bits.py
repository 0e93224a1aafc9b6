"""Bits of byte strings, lowest first (RFC 1951, 3.1.1)."""

from __future__ import annotations

from codecframe.status import CORRUPT, INVALID_ARG, CodecError

#: Bytes taken into the reader's accumulator at a time.
REFILL = 48


class BitReader:
    """Reads a few bits at a time; ``at`` is the place of the next one."""

    def __init__(self, data: bytes):
        self.data, self.next, self.held, self.n = data, 0, 0, 0

    @property
    def at(self) -> int:
        return 8 * self.next - self.n

    def fill(self, n: int) -> bool:
        """Hold ``n`` bits if there are so many."""
        while self.n < n and self.next < len(self.data):
            part = self.data[self.next : self.next + REFILL]
            self.held |= int.from_bytes(part, "little") << self.n
            self.n += 8 * len(part)
            self.next += len(part)
        return self.n >= n

    def bits(self, n: int) -> int:
        if self.n < n and not self.fill(n):
            raise CodecError(CORRUPT, "the stream ends early")
        out = self.held & ((1 << n) - 1)
        self.held >>= n
        self.n -= n
        return out

    def align(self) -> None:
        self.bits(self.n % 8)

    def skip_bytes(self, n: int) -> None:
        """From a byte border, leave ``n`` bytes out."""
        to = self.at // 8 + n
        if to > len(self.data):
            raise CodecError(CORRUPT, "the stream ends early")
        self.next, self.held, self.n = to, 0, 0


class BitWriter:
    """Collects bits and gives whole bytes; ``flush`` pads the last with zeros."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.held, self.n = 0, 0

    def put(self, value: int, n: int) -> bytes:
        if n < 0 or value < 0 or value >> n:
            raise CodecError(INVALID_ARG, f"{value} does not fit in {n} bits")
        self.held |= value << self.n
        self.n += n
        whole = self.n // 8
        out = (self.held & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
        self.held >>= 8 * whole
        self.n -= 8 * whole
        return out

    def flush(self) -> bytes:
        out = self.held.to_bytes(1, "little") if self.n else b""
        self.reset()
        return out


def reverse(code: int, n: int) -> int:
    """The ``n`` bits of a code in the other order."""
    return int(f"{code:0{n}b}"[::-1], 2) if n else 0
