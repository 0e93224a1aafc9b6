"""Table functions that turn one value into rows: gzip members and DEFLATE blocks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.functions import udtf

from codecframe.kernels import gzip, huffman
from codecframe.kernels.bits import BitReader
from codecframe.kernels.huffman import DecodeTable
from codecframe.options import Options
from codecframe.status import CORRUPT, OK, CodecError

#: RFC 1951, 3.2.5: extra bits of length and distance codes follow from these rules.
LENGTH_EXTRA = [0] * 8 + [n for n in range(1, 6) for _ in range(4)] + [0]
DIST_EXTRA = [0] * 4 + [n for n in range(1, 14) for _ in range(2)]


def bases(extra: list[int], first: int) -> list[int]:
    out = [first]
    for e in extra[:-1]:
        out.append(out[-1] + (1 << e))
    return out


LENGTH_BASE, DIST_BASE = bases(LENGTH_EXTRA, 3), bases(DIST_EXTRA, 1)
LENGTH_BASE[-1] = 258
#: RFC 1951, 3.2.6: lengths of the fixed codes (fixed values).
FIXED = [8] * 144 + [9] * 112 + [7] * 24 + [8] * 8
_fixed = DecodeTable(FIXED), DecodeTable([5] * 32)
#: Symbols of the two alphabets.
LITERALS, DISTANCES = 288, 32


def _codes(bits: BitReader) -> tuple[DecodeTable, DecodeTable]:
    """The codes of a dynamic block's header."""
    nlit, ndist, nclen = bits.bits(5) + 257, bits.bits(5) + 1, bits.bits(4) + 4
    if nlit > 286 or ndist > 30:
        raise CodecError(CORRUPT, "too many length or distance codes")
    meta = [0] * 19
    for s in huffman.ORDER[:nclen]:
        meta[s] = bits.bits(3)
    code, runs, n = DecodeTable(meta), [], 0
    while n < nlit + ndist:
        s = code.read(bits)
        runs.append((s, bits.bits({16: 2, 17: 3, 18: 7}.get(s, 0))))
        n += 1 if s < 16 else runs[-1][1] + (11 if s == 18 else 3)
    out = huffman.expand_runs(runs)
    if n > nlit + ndist or not out[256]:
        raise CodecError(CORRUPT, "bad code lengths")
    return DecodeTable(out[:nlit]), DecodeTable(out[nlit:])


def blocks(data: bytes, counts: tuple[list[int], list[int]] | None = None) -> Iterator[dict]:
    """Each block's type, place, symbols and output size; nothing is inflated.

    ``counts`` takes the uses of length/literal and distance symbols, ends of blocks included.
    """
    bits, done, no, total = BitReader(data), False, 0, 0
    lit_n, dist_n = counts or ([0] * LITERALS, [0] * DISTANCES)
    while not done:
        start = bits.at
        done, kind = bool(bits.bits(1)), bits.bits(2)
        literals = matches = size = 0
        if kind == 3:
            raise CodecError(CORRUPT, "block type 3")
        if kind == 0:
            bits.align()
            size = bits.bits(16)
            if size ^ 0xFFFF != bits.bits(16):
                raise CodecError(CORRUPT, "stored length check")
            bits.skip_bytes(size)
        else:
            lit, dist = _fixed if kind == 1 else _codes(bits)
            while (s := lit.read(bits)) != 256:
                if s < 256:
                    lit_n[s] += 1
                    literals += 1
                    size += 1
                    continue
                if s > 285:
                    raise CodecError(CORRUPT, "bad length symbol")
                n = LENGTH_BASE[s - 257] + bits.bits(LENGTH_EXTRA[s - 257])
                d = dist.read(bits)
                if d > 29:
                    raise CodecError(CORRUPT, "bad distance symbol")
                if DIST_BASE[d] + bits.bits(DIST_EXTRA[d]) > total + size:
                    raise CodecError(CORRUPT, "distance before the start")
                lit_n[s] += 1
                dist_n[d] += 1
                matches += 1
                size += n
            lit_n[256] += 1
        total += size
        yield {"block": no, "kind": ("stored", "fixed", "dynamic")[kind], "final": done, "bit_start": start, "bit_end": bits.at, "literals": literals, "matches": matches, "bytes_out": size}
        no += 1


@udtf(returnType="member int, flags int, mtime long, xfl int, os int, name string, comment string, extra binary, crc long, isize long, status string")
class GzipMembers:
    """A row a gzip member; a last row with the status if the stream is bad."""

    def eval(self, data: bytes):
        d = gzip.Decoder(Options({"gzip.concat": True}))
        status = OK
        try:
            for at in range(0, len(data or b""), 1 << 16):
                d.update(bytes(data[at : at + (1 << 16)]))
            d.finish()
        except CodecError as e:
            status = e.status
        for i, (h, crc, size) in enumerate(d.members):
            yield i, h.flags, h.mtime, h.xfl, h.os, h.name, h.comment, h.extra, crc, size, OK
        if status != OK:
            yield (len(d.members), *[None] * 9, status)


@udtf(returnType="alphabet string, sym int, n long, status string")
class DeflateSymbols:
    """A row a symbol used in a DEFLATE stream; a last row with the status if the stream is bad."""

    def eval(self, data: bytes):
        counts, status = ([0] * LITERALS, [0] * DISTANCES), OK
        try:
            for _ in blocks(bytes(data or b""), counts):
                pass
        except CodecError as e:
            status = e.status
        for alphabet, of in zip(("length", "distance"), counts, strict=True):
            for sym, n in enumerate(of):
                if n:
                    yield alphabet, sym, n, OK
        if status != OK:
            yield None, None, None, status


@udtf(returnType="place int, sym int, extra int")
class CodeLengthRuns:
    """The run-length form of an array of code lengths: a row a symbol of 0 to 18."""

    def eval(self, lengths: list):
        for place, (sym, extra) in enumerate(huffman.run_lengths([int(x or 0) for x in lengths or []])):
            yield place, sym, extra


@udtf(returnType="block int, kind string, final boolean, bit_start long, bit_end long, literals long, matches long, bytes_out long, status string")
class DeflateBlocks:
    """A row a DEFLATE block; a last row with the status if the stream is bad."""

    def eval(self, data: bytes):
        n = 0
        try:
            for b in blocks(bytes(data or b"")):
                n += 1
                yield (*b.values(), OK)
        except CodecError as e:
            yield (n, *[None] * 7, e.status)
