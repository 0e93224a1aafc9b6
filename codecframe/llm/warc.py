"""WARC records as a table of chunks.

A record is rows of (record_id, chunk_no, data): its bytes, cut at a bounded length, in
order. Chunk 0 is the header; concatenated chunks are a WARC/1.1 record. Chunks are cut
and joined to records without any row that holds a whole payload but the input's own; the
reader carries one digest state from chunk to chunk and holds one chunk at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecframe.llm.rows import column
from codecframe.llm.store import Scratch

CHUNK = 1 << 20
#: Smaller payloads are never revisits.
LEAST_SHARED = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FIELDS = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, whole boolean"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(*cols: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def record_chunks(pages: DataFrame, scratch: Scratch, page_id: str = "page_id", url: str = "url", payload: str = "html", chunk: int = CHUNK) -> DataFrame:
    """Rows (record_id, chunk_no, data) of a record a row of ``pages``."""
    body = F.coalesce(column(payload).cast("binary"), F.lit(b""))
    rows = pages.select(column(page_id).alias("page_id"), column(url).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({"n": F.octet_length("body").cast("long"), "digest": F.sha2("body", 256)})
    firsts = rows.where(F.col("n") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    firsts = scratch.table(firsts.select(F.col("digest").alias("shared"), "first_id"), "shared")
    rows = rows.join(firsts, F.col("digest") == F.col("shared"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "revisit": revisit})
    rows = rows.withColumn("record_id", _urn(F.col("page_id"), F.col("digest"), F.col("row")))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("X-Refers-To-Page", F.url_encode(F.col("first_id").cast("string"))), _line("X-Payload-Length", F.col("n").cast("string")))).otherwise(""),
        F.when(F.col("page_id").isNull(), "").otherwise(_line("X-Page", F.coalesce(F.url_encode(F.col("page_id").cast("string")), F.lit("")))),
        _line("Content-Type", F.lit("text/html")),
        _line("Content-Length", F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n")).cast("string")),
        F.lit("\r\n"),
    ).cast("binary")
    size = F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n"))
    last = F.ceil(size / chunk).cast("int") + 1
    numbered = rows.select("record_id", head.alias("head"), F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("body")).alias("body"), last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    piece = F.substring("body", (F.col("chunk_no") - 1) * chunk + 1, F.lit(chunk))
    data = F.when(F.col("chunk_no") == 0, F.col("head")).when(F.col("chunk_no") == F.col("last"), F.lit(b"\r\n\r\n")).otherwise(piece)
    return numbered.select("record_id", "chunk_no", data.alias("data"))


class Reader:
    """Parses one record's chunks in order; keeps the header and a digest state."""

    def __init__(self) -> None:
        self.head, self.fields, self.left, self.sha, self.tail = b"", None, 0, hashlib.sha256(), b""

    def feed(self, data: bytes) -> None:
        view = memoryview(data)
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = self.head[:end].decode("utf-8").split("\r\n")
            self.fields = dict(x.split(": ", 1) for x in lines[1:])
            self.left = int(self.fields["Content-Length"])
            view = memoryview(self.head)[end + 4 :]
        take = view[: self.left]
        self.sha.update(take)
        self.left -= len(take)
        self.tail += bytes(view[len(take) :])

    def row(self) -> tuple:
        f = self.fields or {}
        kind, digest = f.get("WARC-Type"), f.get("WARC-Payload-Digest", "").removeprefix("sha256:")
        ended = self.left == 0 and self.tail == b"\r\n\r\n"
        if kind == "revisit":
            return f.get("X-Page"), int(f["X-Payload-Length"]), digest, kind, f.get("X-Refers-To-Page"), ended
        got = self.sha.hexdigest()
        return f.get("X-Page"), int(f.get("Content-Length", 0)), got, kind, None, ended and got == digest


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, reader = None, Reader()
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            k = batch.column(0)[i].as_py()
            if key is not None and k != key:
                rows.append(reader.row())
                reader = Reader()
            key = k
            reader.feed(batch.column(1)[i].as_py())
        yield _rows(rows)
    if key is not None:
        yield _rows([reader.row()])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    cols = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole"])


def read_records(chunks: DataFrame) -> DataFrame:
    """One row a record: identifiers as percent-encoded text, payload size and digest, type, and ``whole``
    (length, end and digest are right). Chunks meet by record and are read in order."""
    ordered = chunks.repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return ordered.select("record_id", "data").mapInArrow(read_batches, FIELDS)


def archive_and_read(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write the pages as chunked WARC records to the shared folder, and read them back.

    Of equal payloads of at least ``LEAST_SHARED`` bytes the smallest identifier is the
    response; the others are revisits without block that carry the digest and length of
    the full payload. Identifiers are percent-encoded in the headers. Rows that repeat that identifier are responses as well. Null or
    empty payload is an empty response; a null identifier has no X-Page field and is read
    as null; a null address is empty; extra columns are ignored; an empty table gives an
    empty result.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    archive = scratch.table(record_chunks(pages, scratch, page_id, url, payload), "archive")
    kind = pages.schema[page_id].dataType
    return read_records(archive).withColumns({c: F.url_decode(c).cast(kind) for c in ("page_id", "refers_to")})
