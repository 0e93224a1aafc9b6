"""Column functions: codecs that report errors as data, and what Catalyst can express alone."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from codecframe import registry
from codecframe.options import Options
from codecframe.status import OK, CodecError

RESULT = "struct<status:string,detail:string,data:binary,bytes_in:long,bytes_out:long,rest:long>"
_result = pa.struct([("status", pa.string()), ("detail", pa.string()), ("data", pa.binary()), ("bytes_in", pa.int64()), ("bytes_out", pa.int64()), ("rest", pa.int64())])
#: A codec_result without its data.
VERIFIED = "struct<status:string,detail:string,bytes_in:long,bytes_out:long,rest:long>"
_verified = pa.struct([f for f in _result if f.name != "data"])
#: Bytes of results that a worker holds, and one value's, before it hands them on.
HELD = 4 << 20


def result(method: str, side: str, data: bytes, options: Options, reg: registry.Registry | None = None) -> dict:
    """One value's codec_result; ``rest`` is how many bytes follow the stream's end."""
    try:
        out, rest = registry.run_with_rest(method, side, data, options, reg)
        return {"status": OK, "detail": "", "data": out, "bytes_in": len(data), "bytes_out": len(out), "rest": rest}
    except CodecError as e:
        return {"status": e.status, "detail": e.detail, "data": None, "bytes_in": len(data), "bytes_out": 0, "rest": 0}


def verified(method: str, data: bytes, options: Options, reg: registry.Registry | None = None) -> dict:
    """One value's ``result`` of decoding, without the data."""
    try:
        size, rest = registry.measure(method, "decoder", data, options, reg)
        return {"status": OK, "detail": "", "bytes_in": len(data), "bytes_out": size, "rest": rest}
    except CodecError as e:
        return {"status": e.status, "detail": e.detail, "bytes_in": len(data), "bytes_out": 0, "rest": 0}


def _handed_on(results: Iterable[dict | None]) -> Iterator[pa.Array]:
    """Results as arrays of about ``HELD`` bytes: a batch of small values may decode to any size."""
    rows, size = [], 0
    for r in results:
        rows.append(r)
        size += len(r["data"]) if r and r["data"] else 0
        if size >= HELD:
            yield pa.array(rows, _result)
            rows, size = [], 0
    if rows:
        yield pa.array(rows, _result)


def _checked(method: str, side: str, options: dict | None, reg: registry.Registry | None) -> tuple[Options, list[registry.Method] | None]:
    """Options and methods to send to workers; bad names and options fail before the plan is built."""
    opts = Options(options)
    (reg or registry.DEFAULT).create(method, side, opts)
    return opts, None if reg is None else [reg.find(n) for n in reg.names()]


def _registry(methods: list[registry.Method] | None) -> registry.Registry | None:
    if methods is None:
        return None
    r = registry.Registry()
    for m in methods:
        r.register(m)
    return r


def _codec(col: Column, method: str, side: str, options: dict | None, reg: registry.Registry | None) -> Column:
    opts, methods = _checked(method, side, options, reg)

    @F.arrow_udf(RESULT)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        r = _registry(methods)
        for values in batches:
            yield from _handed_on(None if v is None else result(method, side, v, opts, r) for v in (x.as_py() for x in values))

    return apply(col.cast("binary"))


def encode(col: Column, method: str, options: dict | None = None, reg: registry.Registry | None = None) -> Column:
    """Encode a binary (or UTF-8 string) column; a struct with status, detail, data and sizes."""
    return _codec(col, method, "encoder", options, reg)


def decode(col: Column, method: str, options: dict | None = None, reg: registry.Registry | None = None) -> Column:
    """Decode a binary column under the limits in ``options``."""
    return _codec(col, method, "decoder", options, reg)


def verify(col: Column, method: str, options: dict | None = None, reg: registry.Registry | None = None) -> Column:
    """``decode``'s result without the data: each step's output is dropped once it is counted.

    Several of one ``select`` share a worker, while each ``encode`` or ``decode`` has its own.
    """
    opts, methods = _checked(method, "decoder", options, reg)

    @F.arrow_udf(VERIFIED)
    def apply(values: pa.Array) -> pa.Array:
        r = _registry(methods)
        return pa.array([None if v is None else verified(method, v, opts, r) for v in (x.as_py() for x in values)], _verified)

    return apply(col.cast("binary"))


def _sql_results(side: str, rows: Iterable[tuple]) -> Iterator[dict | None]:
    """Results of (value, method, options) rows."""
    known = {}
    for value, method, given in rows:
        if value is None:
            yield None
            continue
        key = (method, tuple(sorted(given or [])))
        if key not in known:
            try:
                known[key] = registry.DEFAULT.schema(method).parse(dict(key[1])), None
            except CodecError as e:
                known[key] = None, {"status": e.status, "detail": e.detail, "data": None, "bytes_in": 0, "bytes_out": 0, "rest": 0}
        opts, bad = known[key]
        yield bad or result(method, side, value, opts)


def _sql_codec(side: str) -> object:
    @F.arrow_udf(RESULT)
    def apply(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield from _handed_on(_sql_results(side, zip(*[(x.as_py() for x in c) for c in columns], strict=True)))

    return apply


def register_sql(spark: SparkSession) -> None:
    """SQL functions codec_encode and codec_decode (binary, method, map of option texts), and
    the table functions gzip_members, deflate_blocks, deflate_symbols and code_length_runs."""
    from codecframe.operators import tables

    for name, f in (("codec_encode", _sql_codec("encoder")), ("codec_decode", _sql_codec("decoder"))):
        spark.udf.register(name, f)
    for name, f in (("gzip_members", tables.GzipMembers), ("deflate_blocks", tables.DeflateBlocks), ("deflate_symbols", tables.DeflateSymbols), ("code_length_runs", tables.CodeLengthRuns)):
        spark.udtf.register(name, f)


def strict(res: Column) -> Column:
    """The data of a codec_result; any error fails the query."""
    return F.when(res["status"] == OK, res["data"]).when(res.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(res["status"], F.lit(": "), res["detail"])).cast("binary"))


def crc32_raw(col: Column) -> Column:
    """CRC-32 before the final inversion; 0 for empty input."""
    b = col.cast("binary")
    return F.when(F.octet_length(b) == 0, F.lit(0).cast("long")).otherwise(F.crc32(b).bitwiseXOR(F.lit(0xFFFFFFFF)))


def isize(col: Column) -> Column:
    return F.pmod(F.octet_length(col.cast("binary")).cast("long"), F.lit(1 << 32))


def xfl(level: Column) -> Column:
    return F.when(level <= 2, 4).when(level >= 6, 2).otherwise(0)


def little_endian(value: Column, size: int) -> Column:
    """Unsigned integer to ``size`` bytes, lowest first."""
    h = F.lpad(F.hex(value), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * i - 1, 2) for i in range(size, 0, -1)]))


def unsigned_at(data: Column, at: int | Column, size: int) -> Column:
    """Little-endian unsigned integer at a byte position (from 0)."""
    at = at if isinstance(at, Column) else F.lit(at)
    h = F.hex(F.substring(data, at + 1, F.lit(size)))
    return F.conv(F.concat(*[F.substring(h, 2 * i - 1, 2) for i in range(size, 0, -1)]), 16, 10).cast("long")


def stored_deflate(col: Column) -> Column:
    """Level-0 DEFLATE of a value as a plain expression: full stored blocks and a last one."""
    b, n = col.cast("binary"), F.octet_length(col.cast("binary"))
    blocks = F.sequence(F.lit(0), F.floor(n / 65535).cast("int"))
    last = F.floor(n / 65535).cast("int")

    def block(i: Column) -> Column:
        size = F.least(F.lit(65535), n - i * 65535)
        return F.hex(F.concat(F.when(i == last, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), little_endian(size, 2), little_endian(F.lit(65535) - size, 2), F.substring(b, i * 65535 + 1, size)))

    return F.unhex(F.array_join(F.transform(blocks, block), ""))


def stored_gzip(col: Column) -> Column:
    """Level-0 gzip of a value as a plain expression."""
    b = col.cast("binary")
    return F.concat(F.unhex(F.lit("1F8B08000000000004FF")), stored_deflate(b), little_endian(F.crc32(b), 4), little_endian(isize(b), 4))


def gzip_header(data: Column) -> Column:
    """The fixed ten bytes of a gzip header, and the trailer of a one-member stream."""
    n = F.octet_length(data)
    return F.struct(
        (F.hex(F.substring(data, 1, 2)) == "1F8B").alias("magic_ok"),
        unsigned_at(data, 2, 1).alias("cm"),
        unsigned_at(data, 3, 1).alias("flags"),
        unsigned_at(data, 4, 4).alias("mtime"),
        unsigned_at(data, 8, 1).alias("xfl"),
        unsigned_at(data, 9, 1).alias("os"),
        F.when(n >= 18, unsigned_at(data, n - 8, 4)).alias("crc"),
        F.when(n >= 18, unsigned_at(data, n - 4, 4)).alias("isize"),
    )


def ratio_ok(bytes_in: Column, bytes_out: Column, ratio: Column) -> Column:
    """Whether an expansion is allowed; ratio 0 is no cap, no input passes."""
    wide = "decimal(38,0)"
    out, size = bytes_out.cast(wide), F.nullif(bytes_in.cast(wide), F.lit(0).cast(wide))
    over = out % size
    whole = ((out - over) / size).cast(wide)  # exact, and no product that could overflow
    return (ratio == 0) | (bytes_in == 0) | (whole < ratio.cast(wide)) | ((whole == ratio.cast(wide)) & (over == 0))
