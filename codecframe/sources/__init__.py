"""Compressed files: as streams of chunk rows, or whole through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecframe import functions as C
from codecframe.sources.stream import CodecFiles


def _given(method: str, options: dict | None) -> dict[str, str]:
    texts = {k: v.hex() if isinstance(v, bytes) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in (options or {}).items()}
    return {"method": method, **{f"option.{k}": v for k, v in texts.items()}}


def read_chunks(spark: SparkSession, path: str, method: str = "gzip", options: dict | None = None) -> DataFrame:
    """Files decoded step by step: (path, seq, data, status, detail), a file a task.

    A bad file's last row has its status; the rows before it stay.
    """
    spark.dataSource.register(CodecFiles)
    return spark.read.format("codec").options(path=path, **_given(method, options)).load()


def write_members(df: DataFrame, data: str, path: str, method: str = "gzip", options: dict | None = None, mode: str = "append") -> None:
    """Write a binary column as encoded files, one a partition, each row a member."""
    df.sparkSession.dataSource.register(CodecFiles)
    df.select(F.col(data).cast("binary").alias("data")).write.format("codec").options(path=path, **_given(method, options)).mode(mode).save()


def read_compressed(spark: SparkSession, path: str, method: str = "gzip", options: dict | None = None, glob: str | None = None) -> DataFrame:
    """One row a file: path, status, detail and decoded data. A file is one task's value."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    opts = {"gzip.concat": True, **(options or {})} if method == "gzip" else options
    r = C.decode(F.col("content"), method, opts)
    return reader.load(path).select("path", "length", r.alias("r")).select("path", "length", "r.status", "r.detail", "r.data")


def write_gzip_text(df: DataFrame, col: str, path: str) -> None:
    """Write a text column as gzip files, one a partition, by Spark's own codec."""
    df.select(F.col(col)).write.option("compression", "gzip").text(path)


def read_gzip_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_encoded(df: DataFrame, data: str, path: str, method: str = "gzip", options: dict | None = None) -> None:
    """Write all columns, with ``data`` replaced by its codec_result, as Parquet."""
    df.withColumn(data, C.encode(F.col(data), method, options)).write.parquet(path)
