"""Byte statistics, Huffman codes and option checks as relational operators."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from codecframe import registry
from codecframe.kernels import huffman
from codecframe.operators.tables import DIST_BASE, DISTANCES, LENGTH_BASE, LITERALS, blocks
from codecframe.options import U64
from codecframe.status import CodecError


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        for v in batch.column(0):
            if v.is_valid:
                total += np.bincount(np.frombuffer(v.as_buffer(), np.uint8), minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], ["sym", "n"])


def byte_histogram(df: DataFrame, col: str) -> DataFrame:
    """(sym, n) of all bytes; 256 partial sums a task are shuffled."""
    parts = df.select(F.col(col).cast("binary")).mapInArrow(_histogram, "sym int, n long")
    return parts.groupBy("sym").agg(F.sum("n").alias("n")).where("n > 0")


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, bad = np.zeros(LITERALS + DISTANCES, np.int64), 0
    for batch in batches:
        for v in batch.column(0):
            counts = [0] * LITERALS, [0] * DISTANCES
            try:
                for _ in blocks(v.as_buffer().to_pybytes() if v.is_valid else b"", counts):
                    pass
                total += np.array(counts[0] + counts[1])
            except CodecError:
                bad += v.is_valid
    at = np.flatnonzero(total)
    alphabet = np.where(at < LITERALS, "length", "distance").tolist()
    sym = np.where(at < LITERALS, at, at - LITERALS).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array([*alphabet, "bad"]), pa.array([*sym.tolist(), 0], pa.int32()), pa.array([*total[at].tolist(), bad], pa.int64())], ["alphabet", "sym", "n"])


def symbol_frequencies(df: DataFrame, col: str) -> DataFrame:
    """(alphabet, sym, n): uses of literal/length and distance symbols in DEFLATE streams, an
    end of block a block. Streams that are bad count in one row of the alphabet ``bad``;
    null is passed over. At most 320 sums a task are shuffled."""
    parts = df.select(F.col(col).cast("binary")).mapInArrow(_symbols, "alphabet string, sym int, n long")
    return parts.groupBy("alphabet", "sym").agg(F.sum("n").alias("n")).where("n > 0")


def entropy_bits(histogram: DataFrame) -> DataFrame:
    """Bits a symbol, of a histogram of at most 256 rows."""
    return histogram.agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy_bits"))


def huffman_lengths(histogram: DataFrame, limit: int = 15) -> DataFrame:
    """(sym, n, len): optimal code lengths. A histogram is one small group."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("sym")
        counts = [0] * (max(table["sym"].to_pylist()) + 1)
        for s, n in zip(table["sym"].to_pylist(), table["n"].to_pylist(), strict=True):
            counts[s] = n
        lengths = huffman.build_lengths(counts, limit)
        return table.append_column("len", pa.array([lengths[s] for s in table["sym"].to_pylist()], pa.int32()))

    return histogram.select(F.col("sym").cast("int").alias("sym"), F.col("n").cast("long").alias("n")).groupBy().applyInArrow(build, "sym int, n long, len int")


def canonical_codes(lengths: DataFrame, by: str) -> DataFrame:
    """Add ``code`` to (by, sym, len): a running sum over each alphabet of at most 288 symbols."""
    before = W.partitionBy(by).orderBy("len", "sym").rowsBetween(W.unboundedPreceding, -1)
    run = F.coalesce(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), 15 - F.col("len"))).over(before), F.lit(0))
    used = lengths.where("len > 0")
    return used.withColumn("code", F.call_function("shiftright", run, 15 - F.col("len")))


def kraft(lengths: DataFrame, by: str) -> DataFrame:
    """Whether each alphabet's lengths are valid, and complete."""
    s = F.sum(F.when(F.col("len") > 0, F.call_function("shiftleft", F.lit(1).cast("long"), 15 - F.col("len"))).otherwise(0))
    return lengths.groupBy(by).agg(s.alias("kraft")).withColumns({"valid": F.col("kraft") <= 1 << 15, "complete": F.col("kraft") == 1 << 15})


def match_codes(df: DataFrame, value: str, kind: str = "length") -> DataFrame:
    """Add ``code``: the symbol of a match length (3 to 258) or distance (1 to 32768), by its
    range; null outside of it."""
    base = LENGTH_BASE if kind == "length" else DIST_BASE
    first, last = (257, 258) if kind == "length" else (0, 32768)
    steps = F.array(*[F.lit(b) for b in base])
    code = F.size(F.filter(steps, lambda b: b <= F.col(value))) - 1 + first
    return df.withColumn("code", F.when(F.col(value).between(base[0], last), code))


def reversed_codes(codes: DataFrame) -> DataFrame:
    """Add ``bits`` to (len, code): the code's bits in the order in which they are written."""
    return codes.withColumn("bits", F.conv(F.reverse(F.lpad(F.bin("code"), F.col("len"), "0")), 2, 10).cast("long"))


@F.arrow_udf(ArrayType(IntegerType()))
def complete_lengths(lengths: pa.Array) -> pa.Array:
    """Code lengths of the code-length alphabet, completed; null if over-subscribed."""
    out = []
    for v in lengths.to_pylist():
        try:
            out.append(None if v is None else huffman.complete([int(x or 0) for x in v]))
        except CodecError:
            out.append(None)
    return pa.array(out, pa.list_(pa.int32()))


def option_schema(spark: SparkSession, method: str) -> DataFrame:
    """A method's options as rows."""
    rows = [(s.key, s.type, None if s.default is None else str(s.default), *[None if x is None else Decimal(x) for x in (s.low, s.high)], list(s.names)) for s in registry.DEFAULT.schema(method).specs.values()]
    return spark.createDataFrame(rows, "key string, type string, default string, low decimal(20,0), high decimal(20,0), names array<string>")


def check_options(options: DataFrame, schema: DataFrame) -> DataFrame:
    """(set_id, key, value) rows with a status: unknown keys, wrong types, out of range, null."""
    j = options.join(F.broadcast(schema), "key", "left")  # one row an option of a method
    number = F.when(F.col("value").rlike(r"^[+-]?[0-9]{1,20}$"), F.expr("try_cast(value as decimal(20,0))"))
    low = F.greatest(F.col("low"), F.when(F.col("type") == "int64", F.lit(Decimal(-(1 << 63)))).otherwise(F.lit(Decimal(0))))
    high = F.least(F.col("high"), F.when(F.col("type") == "int64", F.lit(Decimal((1 << 63) - 1))).otherwise(F.lit(Decimal(U64))))
    bad = (
        F.when(F.col("type").isNull() | F.col("value").isNull(), True)
        .when(F.col("type").isin("int64", "uint64"), number.isNull() | (number < low) | (number > high))
        .when(F.col("type") == "bool", ~F.col("value").isin("true", "false"))
        .when(F.size("names") > 0, ~F.array_contains("names", F.col("value")))
        .otherwise(False)
    )
    return j.select("set_id", "key", F.when(bad, "INVALID_ARG").otherwise("OK").alias("status"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, longest = [], []
        for v in batch.column(1):
            b = np.frombuffer(v.as_buffer(), np.uint8) if v.is_valid else np.zeros(0, np.uint8)
            ends = np.append(np.flatnonzero(b[1:] != b[:-1]) + 1, len(b)) if len(b) else np.zeros(0, np.int64)
            n.append(len(ends))
            longest.append(int(np.diff(ends, prepend=0).max()) if len(ends) else 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(longest, pa.int64())], ["id", "n_runs", "longest"])


def run_stats(df: DataFrame, key: str, col: str) -> DataFrame:
    """Runs of equal bytes in each value: how many, and the longest."""
    rows = df.select(F.col(key).alias("id"), F.col(col).cast("binary").alias("b"))
    return rows.mapInArrow(_runs, f"id {rows.schema['id'].dataType.simpleString()}, n_runs long, longest long").withColumnRenamed("id", key)
