"""Chunk rows (stream_id, seq, chunk, eof): split, fold CRCs, decode in order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from codecframe import registry
from codecframe.kernels import crc
from codecframe.kernels.bits import BitWriter
from codecframe.options import Options
from codecframe.status import CORRUPT, OK, CodecError

DECODED = "stream_id string, seq long, data binary, status string, detail string"


def split(df: DataFrame, stream_id: str, data: str, size: int = 1 << 16) -> DataFrame:
    """Cut each value in chunks of ``size`` bytes."""
    n = F.greatest(F.ceil(F.octet_length("data") / size), F.lit(1)).cast("int")
    rows = df.select(F.col(stream_id).cast("string").alias("stream_id"), F.col(data).cast("binary").alias("data")).withColumn("n", n)
    return rows.select("stream_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), "data", "n").select(
        "stream_id", F.col("i").cast("long").alias("seq"), F.substring("data", F.col("i") * size + 1, F.lit(size)).alias("chunk"), (F.col("i") == F.col("n") - 1).alias("eof")
    )


def _decode(batches: Iterator[pa.RecordBatch], method: str, side: str, options: Options) -> Iterator[pa.RecordBatch]:
    """Rows in order of (stream, seq): one coder lives at a time, whatever a stream's length."""
    stream, coder, expect, ended, failed = None, None, 0, True, False

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["stream_id", "seq", "data", "status", "detail"])

    for batch in batches:
        rows = []
        for sid, seq, chunk, eof in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if coder is None or sid != stream:
                if coder is not None and not ended and not failed:
                    rows.append((stream, expect, None, CORRUPT, "the last chunk is missing"))
                stream, coder, expect, ended, failed = sid, registry.DEFAULT.create(method, side, options), 0, False, False
            if failed:
                continue
            try:
                if seq != expect or ended:
                    raise CodecError(CORRUPT, f"chunk {seq} where {expect} was due")
                data = coder.update(chunk or b"")
                if eof:
                    data, ended = data + coder.finish(), True
                rows.append((sid, seq, data, OK, ""))
                expect += 1
            except CodecError as e:
                failed = True
                rows.append((sid, seq, None, e.status, e.detail))
        yield out(rows)
    if coder is not None and not ended and not failed:
        yield out([(stream, expect, None, CORRUPT, "the last chunk is missing")])


def transcode(chunks: DataFrame, method: str, side: str = "decoder", options: dict | None = None) -> DataFrame:
    """Decode (or encode) chunk streams: one output row a chunk, and errors as rows.

    Streams are told apart by key and read in order within the task, a chunk at a time. A
    gap, a repeat or a missing end is CORRUPT; the rows before it stay.
    """
    ordered = chunks.select("stream_id", "seq", "chunk", "eof").repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return ordered.mapInArrow(partial(_decode, method=method, side=side, options=Options(options)), DECODED)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stream, value, bits) in order to (stream, seq, chunk, eof): the writer's bytes."""
    stream, writer, seq, begun = None, BitWriter(), 0, False
    for batch in batches:
        rows, held = [], bytearray()
        for sid, value, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if begun and sid != stream:
                rows.append((stream, seq, bytes(held) + writer.flush(), True))
                held.clear()
                seq = 0
            stream, begun = sid, True
            held += writer.put(value, n)
        if held:
            rows.append((stream, seq, bytes(held), False))
            seq += 1
        yield _chunk_rows(rows)
    if begun:
        yield _chunk_rows([(stream, seq, writer.flush(), True)])


def _chunk_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 4, kinds, strict=True)], ["stream_id", "seq", "chunk", "eof"])


def pack_bits(df: DataFrame, stream_id: str, order: str, value: str, bits: str) -> DataFrame:
    """Write each stream's values, ``bits`` bits of each, lowest bit first, in order, as chunk rows.

    A value that does not fit its bits fails the query; the last byte is padded with zeros.
    """
    rows = df.select(F.col(stream_id).cast("string").alias("stream_id"), F.col(order).alias("at"), F.col(value).cast("long").alias("value"), F.col(bits).cast("int").alias("bits"))
    ordered = rows.repartition("stream_id").sortWithinPartitions("stream_id", "at").select("stream_id", "value", "bits")
    return ordered.mapInArrow(_pack, "stream_id string, seq long, chunk binary, eof boolean")


def _crc_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold runs of (stream, run, seq, chunk) rows to one (crc, length) each."""
    key, first, value, size = None, 0, 0, 0
    names, kinds = ["stream_id", "seq", "crc", "n"], [pa.string(), pa.int64(), pa.int64(), pa.int64()]
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 4, kinds, strict=True)], names)
    for batch in batches:
        rows = []
        for sid, run, seq, chunk in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key is not None and key != (sid, run):
                rows.append((key[0], first, value, size))
            if key != (sid, run):
                key, first, value, size = (sid, run), seq, 0, 0
            value, size = zlib.crc32(chunk or b"", value), size + len(chunk or b"")
        yield make(rows)
    if key is not None:
        yield make([(key[0], first, value, size)])


@F.arrow_udf(LongType())
def _combine(seqs: pa.Array, crcs: pa.Array, sizes: pa.Array) -> pa.Array:
    out = []
    for c, n in zip(crcs.to_pylist(), sizes.to_pylist(), strict=True):
        total = 0
        for a, b in zip(c, n, strict=True):
            total = crc.combine(total, a, b)
        out.append(total)
    return pa.array(out, pa.int64())


def crc_of_chunks(chunks: DataFrame, run: int = 1024) -> DataFrame:
    """CRC-32 and size of each stream: runs of chunks are folded apart, then combined."""
    rows = chunks.select("stream_id", F.floor(F.col("seq") / run).alias("run"), "seq", "chunk")
    parts = rows.repartition("stream_id", "run").sortWithinPartitions("stream_id", "run", "seq").mapInArrow(_crc_parts, "stream_id string, seq long, crc long, n long")
    g = parts.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("seq", "crc", "n"))).alias("p"))
    return g.select("stream_id", _combine("p.seq", "p.crc", "p.n").alias("crc"), F.aggregate("p.n", F.lit(0).cast("long"), lambda a, x: a + x).alias("size"))
