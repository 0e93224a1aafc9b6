"""DEFLATE (RFC 1951) over zlib, with bounded steps and stored blocks written here."""

from __future__ import annotations

import zlib

from codecframe.limits import Limits
from codecframe.options import Options, OptionSpec, Schema
from codecframe.status import CORRUPT, LIMIT, CodecError

STRATEGIES = {"default": zlib.Z_DEFAULT_STRATEGY, "filtered": zlib.Z_FILTERED, "huffman_only": zlib.Z_HUFFMAN_ONLY, "rle": zlib.Z_RLE, "fixed": zlib.Z_FIXED}
SPECS = (
    OptionSpec("deflate.level", "int64", 6, 0, 9, side="encode"),
    OptionSpec("deflate.window_bits", "uint64", 15, 8, 15),
    OptionSpec("deflate.strategy", "string", "default", names=tuple(STRATEGIES), side="encode"),
)
SCHEMA = Schema(SPECS)
#: Bytes of a stored block at most, and of one decoding step.
STORED, STEP = 65535, 1 << 16


def stored_block(data: bytes, final: bool) -> bytes:
    n = len(data)
    return bytes([final]) + n.to_bytes(2, "little") + (n ^ 0xFFFF).to_bytes(2, "little") + data


class Encoder:
    """update() and finish() return what is ready; reset() starts anew."""

    def __init__(self, options: Options, schema: Schema = SCHEMA):
        self.opts = schema.read(options)
        #: A 256-byte window needs zlib's 9 bits, of which it uses 250 bytes.
        self.wbits = max(9, self.opts["deflate.window_bits"])
        Limits.of(self.opts).check_memory((1 << (self.wbits + 2)) + (1 << 17))
        self.reset()

    def reset(self) -> None:
        self.held = b""
        level = self.opts["deflate.level"]
        self.z = zlib.compressobj(level, zlib.DEFLATED, -self.wbits, 8, STRATEGIES[self.opts["deflate.strategy"]]) if level else None

    def update(self, data: bytes) -> bytes:
        if self.z:
            return self.z.compress(data)
        self.held += data
        cut = len(self.held) // STORED * STORED
        out = b"".join(stored_block(self.held[i : i + STORED], False) for i in range(0, cut, STORED))
        self.held = self.held[cut:]
        return out

    def finish(self) -> bytes:
        return self.z.flush() if self.z else stored_block(self.held, True)


class Decoder:
    """update() returns the bytes decoded; ``rest`` are bytes after the stream's end."""

    def __init__(self, options: Options, schema: Schema = SCHEMA):
        self.opts = schema.read(options)
        self.limits = Limits.of(self.opts)
        self.wbits = self.opts["deflate.window_bits"]
        cap = self.opts["limits.max_window_bytes"]
        if cap and cap < 1 << self.wbits:
            raise CodecError(LIMIT, f"window of {1 << self.wbits} bytes is over {cap}")
        self.limits.check_memory((1 << self.wbits) + (1 << 15))
        self.reset()

    def reset(self) -> None:
        self.z, self.bytes_in, self.bytes_out, self.rest = zlib.decompressobj(-self.wbits), 0, 0, b""

    @property
    def done(self) -> bool:
        return self.z.eof

    def update(self, data: bytes) -> bytes:
        if self.z.eof:
            self.rest += data
            return b""
        out = []
        while True:
            try:
                got = self.z.decompress(data, self.limits.room(self.bytes_in, self.bytes_out, STEP))
            except zlib.error as e:
                raise CodecError(CORRUPT, str(e)) from e
            left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.bytes_in += len(data) - len(left)
            self.bytes_out += len(got)
            self.limits.check(self.bytes_in, self.bytes_out)
            out.append(got)
            if self.z.eof:
                self.rest = self.z.unused_data
                break
            data = self.z.unconsumed_tail
            if not data and not got:
                break
        return b"".join(out)

    def finish(self) -> bytes:
        if not self.z.eof:
            raise CodecError(CORRUPT, "the stream ends early")
        return b""
