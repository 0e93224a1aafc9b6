"""gzip (RFC 1952): headers, trailers and members around DEFLATE."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from codecframe.kernels import deflate
from codecframe.limits import Limits
from codecframe.options import U64, Options, OptionSpec, Schema
from codecframe.status import CORRUPT, INVALID_ARG, LIMIT, UNSUPPORTED, CodecError

FTEXT, FHCRC, FEXTRA, FNAME, FCOMMENT, RESERVED = 1, 2, 4, 8, 16, 0xE0
SPECS = (
    *deflate.SPECS,
    OptionSpec("gzip.mtime", "uint64", 0, 0, U64, side="encode"),
    OptionSpec("gzip.os", "uint64", 255, 0, 255, side="encode"),
    OptionSpec("gzip.name", "string", side="encode"),
    OptionSpec("gzip.comment", "string", side="encode"),
    OptionSpec("gzip.extra", "bytes", side="encode"),
    OptionSpec("gzip.header_crc", "bool", False, side="encode"),
    OptionSpec("gzip.xfl", "uint64", None, 0, 255, side="encode"),
    OptionSpec("gzip.header_flags", "uint64", None, 0, 255, side="encode"),
    OptionSpec("gzip.concat", "bool", False, side="decode"),
    OptionSpec("gzip.max_name_bytes", "uint64", 1 << 20, 1, U64, side="decode"),
    OptionSpec("gzip.max_comment_bytes", "uint64", 1 << 20, 1, U64, side="decode"),
    OptionSpec("gzip.max_extra_bytes", "uint64", 64 << 10, 1, U64, side="decode"),
)
SCHEMA = Schema(SPECS)


def xfl_of(level: int) -> int:
    return 4 if level <= 2 else 2 if level >= 6 else 0


def header(opts: dict) -> bytes:
    """Header bytes of checked options."""
    texts = {}
    for key in ("gzip.name", "gzip.comment"):
        if opts[key] is not None:
            try:
                texts[key] = opts[key].encode("latin-1") + b"\0"
            except UnicodeEncodeError as e:
                raise CodecError(INVALID_ARG, f"{key} is not latin-1") from e
            if b"\0" in texts[key][:-1]:
                raise CodecError(INVALID_ARG, f"{key} holds a NUL")
    extra = opts["gzip.extra"]
    if extra is not None and len(extra) > 65535:
        raise CodecError(INVALID_ARG, "gzip.extra is over 65535 bytes")
    asked = opts["gzip.header_flags"] or 0
    if asked & RESERVED:
        raise CodecError(INVALID_ARG, "gzip.header_flags sets reserved bits")
    crc = opts["gzip.header_crc"] or bool(asked & FHCRC)
    extra = b"" if extra is None and asked & FEXTRA else extra
    name = texts.get("gzip.name", b"\0" if asked & FNAME else None)
    comment = texts.get("gzip.comment", b"\0" if asked & FCOMMENT else None)
    flags = asked | FHCRC * crc | FEXTRA * (extra is not None) | FNAME * (name is not None) | FCOMMENT * (comment is not None)
    xfl = opts["gzip.xfl"] if opts["gzip.xfl"] is not None else xfl_of(opts["deflate.level"])
    out = bytes([0x1F, 0x8B, 8, flags]) + (opts["gzip.mtime"] & 0xFFFFFFFF).to_bytes(4, "little") + bytes([xfl, opts["gzip.os"]])
    if extra is not None:
        out += len(extra).to_bytes(2, "little") + extra
    out += (name or b"") + (comment or b"")
    return out + ((zlib.crc32(out) & 0xFFFF).to_bytes(2, "little") if crc else b"")


@dataclass
class Header:
    flags: int
    mtime: int
    xfl: int
    os: int
    extra: bytes | None
    name: str | None
    comment: str | None
    size: int


def parse_header(data: bytes, opts: dict) -> Header | None:
    """The header at the start of ``data``; None if more bytes are needed."""
    for at, (want, status) in enumerate(((0x1F, CORRUPT), (0x8B, CORRUPT), (8, UNSUPPORTED))):
        if len(data) > at and data[at] != want:
            raise CodecError(status, f"header byte {at} is {data[at]}")
    if len(data) > 3 and data[3] & RESERVED:
        raise CodecError(CORRUPT, "reserved flags are set")
    if len(data) < 10:
        return None
    flags, at, extra = data[3], 10, None
    if flags & FEXTRA:
        if len(data) < 12:
            return None
        n = int.from_bytes(data[10:12], "little")
        if n > opts["gzip.max_extra_bytes"]:
            raise CodecError(LIMIT, f"extra field of {n} bytes")
        if len(data) < 12 + n:
            return None
        extra, at = data[12 : 12 + n], 12 + n
    texts: list[str | None] = []
    for flag, key in ((FNAME, "gzip.max_name_bytes"), (FCOMMENT, "gzip.max_comment_bytes")):
        if not flags & flag:
            texts.append(None)
            continue
        end = data.find(b"\0", at)
        if (len(data) if end < 0 else end + 1) - at > opts[key]:
            raise CodecError(LIMIT, f"text is over {key}")
        if end < 0:
            return None
        texts.append(data[at:end].decode("latin-1"))
        at = end + 1
    if flags & FHCRC:
        if len(data) < at + 2:
            return None
        if zlib.crc32(data[:at]) & 0xFFFF != int.from_bytes(data[at : at + 2], "little"):
            raise CodecError(CORRUPT, "header checksum does not match")
        at += 2
    return Header(flags, int.from_bytes(data[4:8], "little"), data[8], data[9], extra, *texts, at)


class Encoder:
    def __init__(self, options: Options, schema: Schema = SCHEMA):
        self.opts = schema.read(options)
        self.head, self.inner = header(self.opts), deflate.Encoder(options, schema)
        self.reset()

    def reset(self) -> None:
        self.inner.reset()
        self.crc, self.size, self.begun = 0, 0, False

    def _head(self) -> bytes:
        out, self.begun = b"" if self.begun else self.head, True
        return out

    def update(self, data: bytes) -> bytes:
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        return self._head() + self.inner.update(data)

    def finish(self) -> bytes:
        return self._head() + self.inner.finish() + self.crc.to_bytes(4, "little") + (self.size & 0xFFFFFFFF).to_bytes(4, "little")


class Decoder:
    """Bytes after a finished member are left in ``rest``, or read as members (``gzip.concat``)."""

    def __init__(self, options: Options, schema: Schema = SCHEMA):
        self.opts, self.options, self.schema = schema.read(options), options, schema
        self.limits = Limits.of(self.opts)
        self.inner = deflate.Decoder(options, schema)
        self.reset()

    def reset(self) -> None:
        self.stage, self.carry, self.bytes_in, self.bytes_out, self.rest = "header", b"", 0, 0, b""
        self.members: list[tuple[Header, int, int]] = []
        self.inner.reset()

    @property
    def done(self) -> bool:
        return self.stage == "done"

    def update(self, data: bytes) -> bytes:
        out, data, self.carry = [], self.carry + data, b""
        while True:
            if self.stage == "header":
                self.head = parse_header(data, self.opts)
                if not self.head:
                    self.carry = data
                    break
                self.bytes_in += self.head.size
                data, self.stage, self.crc, self.size = data[self.head.size :], "body", 0, 0
                self.inner.reset()
            elif self.stage == "body":
                before = self.inner.bytes_in
                got = self.inner.update(data)
                self.bytes_in += self.inner.bytes_in - before
                self.bytes_out += len(got)
                self.limits.check(self.bytes_in, self.bytes_out)
                self.crc, self.size = zlib.crc32(got, self.crc), self.size + len(got)
                out.append(got)
                if not self.inner.done:
                    break
                data, self.stage = self.inner.rest, "trailer"
            elif self.stage == "trailer":
                if len(data) < 8:
                    self.carry = data
                    break
                if int.from_bytes(data[:4], "little") != self.crc:
                    raise CodecError(CORRUPT, "CRC-32 does not match")
                if int.from_bytes(data[4:8], "little") != self.size & 0xFFFFFFFF:
                    raise CodecError(CORRUPT, "size does not match")
                self.members.append((self.head, self.crc, self.size))
                self.bytes_in += 8
                data, self.stage = data[8:], "done"
            else:
                if self.opts["gzip.concat"] and data[:1] == b"\x1f" and data[1:2] in (b"", b"\x8b"):
                    if len(data) < 2:  # the second magic byte may come with the next chunk
                        self.carry = data
                        break
                    self.stage = "header"
                    continue
                self.rest += data
                break
        return b"".join(out)

    def finish(self) -> bytes:
        if self.stage != "done":
            raise CodecError(CORRUPT, f"the stream ends in the {self.stage}")
        self.rest += self.carry
        return b""
