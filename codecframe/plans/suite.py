"""Queries over the driver's tables, with their DuckDB oracles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codecframe import functions as C
from codecframe.operators import analytics as A
from codecframe.operators import chunks as K
from codecframe.options import U64
from codecframe.registry import DEFAULT
from codecframe.sources import read_chunks, write_members
from codecframe.streaming import decode_stream


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*cols)


def work_dir(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one; a local one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="codecframe-")
    return f"{base.rstrip('/')}/suite-{uuid.uuid4().hex}"


def compression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: documents, their bytes, and how many a gzip round trip gives back."""
    docs = read(spark, sf_dir, "documents", "lang", F.col("text").cast("binary").alias("raw"))
    back = C.decode(C.encode(F.col("raw"), "gzip")["data"], "gzip")["data"]
    same = (back == F.col("raw")).cast("long")
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.octet_length("raw").cast("long")).alias("raw_bytes"), F.sum(same).alias("same"))


def gzip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    back = C.decode(C.encode(F.col("text"), "gzip", {"gzip.name": "t", "gzip.header_crc": True})["data"], "gzip")
    return docs.select("doc_id", F.sha2(back["data"], 256).alias("sha"))


def deflate_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels, strategies and windows over all conversations."""
    rows, out = read(spark, sf_dir, "conversations", "conv_id", "turn", "text"), None
    for level, strategy, bits in ((0, "default", 15), (1, "fixed", 15), (4, "rle", 12), (6, "default", 8), (6, "filtered", 15), (9, "huffman_only", 9)):
        e = C.encode(F.col("text"), "deflate", {"deflate.level": level, "deflate.strategy": strategy, "deflate.window_bits": bits})["data"]
        back = C.decode(e, "deflate", {"deflate.window_bits": bits})["data"]
        one = rows.select("conv_id", "turn", F.lit(level).alias("level"), F.sha2(back, 256).alias("sha"))
        out = one if out is None else out.unionAll(one)
    return out.groupBy("conv_id", "turn", "sha").agg(F.count("*").alias("n"))


def crc_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part", "p_partkey", F.crc32(F.col("p_name").cast("binary")).alias("crc"), C.crc32_raw(F.col("p_name")).alias("raw"))


def gzip_header_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "html")
    h = pages.select("page_id", C.gzip_header(C.encode(F.col("html"), "gzip")["data"]).alias("h"), C.isize(F.col("html")).alias("size"))
    return h.select("page_id", "h.magic_ok", "h.cm", "h.flags", "h.mtime", "h.xfl", "h.os", "h.isize", "size")


def deflate_level0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored blocks by plain expressions, equal to the kernel's."""
    rows = read(spark, sf_dir, "part", "p_partkey", "p_name")
    kernel = C.encode(F.col("p_name"), "deflate", {"deflate.level": 0})["data"]
    return rows.select("p_partkey", F.lower(F.hex(C.stored_deflate(F.col("p_name")))).alias("bytes"), (kernel == C.stored_deflate(F.col("p_name"))).alias("same"))


def level0_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages", "page_id", "html")
    return rows.select("page_id", F.octet_length(C.encode(F.col("html"), "deflate", {"deflate.level": 0})["data"]).cast("long").alias("size"), F.octet_length(C.stored_gzip(F.col("html"))).cast("long").alias("gzip_size"))


def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.byte_histogram(read(spark, sf_dir, "part", "p_name"), "p_name").select(F.col("sym").cast("long").alias("sym"), "n")


def entropy_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.entropy_bits(byte_histogram(spark, sf_dir)).select(F.round("entropy_bits", 6).alias("entropy_bits"))


def huffman_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimal code of the parts' bytes: its symbols, its size in bits, and whether it is complete."""
    lengths = A.huffman_lengths(A.byte_histogram(read(spark, sf_dir, "part", "p_name"), "p_name"))
    kraft = F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), 15 - F.col("len"))) == 1 << 15
    return lengths.agg(F.count("*").alias("symbols"), F.sum(F.col("n") * F.col("len")).alias("bits"), kraft.alias("complete"))


def part_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths 3 to 10 of the parts of a brand, as an alphabet with few symbols each length."""
    rows = read(spark, sf_dir, "nation", F.col("n_regionkey").alias("alphabet"), F.col("n_nationkey").alias("sym"))
    return rows.withColumn("len", (F.pmod("sym", F.lit(5)) + 3).cast("int"))


def canonical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.canonical_codes(part_lengths(spark, sf_dir), "alphabet").select("alphabet", "sym", "len", "code")


def kraft_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.kraft(part_lengths(spark, sf_dir), "alphabet")


def reversed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.reversed_codes(canonical_codes(spark, sf_dir)).select("alphabet", "sym", "bits")


def packed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each alphabet's codes, written one after the other as bits."""
    chunks = K.pack_bits(A.reversed_codes(canonical_codes(spark, sf_dir)), "alphabet", "sym", "bits", "len")
    g = chunks.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.hex("chunk").alias("h")))).alias("p"))
    return g.select(F.col("stream_id").cast("int").alias("alphabet"), F.array_join("p.h", "").alias("bytes"))


def code_length_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths of 320 symbols with long gaps, run-length coded and counted by symbol."""
    C.register_sql(spark)
    lens = read(spark, sf_dir, "nation", "n_nationkey").select("n_nationkey", F.expr("transform(sequence(0, 319), i -> if(i % (n_nationkey + 7) < 5, n_nationkey % 6 + 1, 0))").alias("lengths"))
    lens.createOrReplaceTempView("codecframe_lengths")
    runs = spark.sql("SELECT n_nationkey, r.* FROM codecframe_lengths, LATERAL code_length_runs(lengths) r")
    size = F.when(F.col("sym") == 16, F.col("extra") + 3).when(F.col("sym") == 17, F.col("extra") + 3).when(F.col("sym") == 18, F.col("extra") + 11).otherwise(1)
    zeros = F.sum(F.when(F.col("sym").isin(0, 17, 18), size).otherwise(0))
    return runs.groupBy("n_nationkey").agg(F.sum(size).alias("lengths"), zeros.alias("zeros"), F.sum(F.when(F.col("sym") == 18, 1).otherwise(0)).alias("long_gaps"))


def completed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incomplete code-length codes, completed: used symbols keep their lengths."""
    lens = F.transform(F.sequence(F.lit(0), F.lit(18)), lambda i: F.when(i <= F.pmod("n_nationkey", F.lit(8)), F.lit(4)).otherwise(0))
    rows = read(spark, sf_dir, "nation", "n_nationkey").withColumn("lens", lens).withColumn("full", A.complete_lengths("lens"))
    kraft = F.aggregate("full", F.lit(0), lambda a, n: a + F.when(n > 0, F.call_function("shiftright", F.lit(128), n)).otherwise(0))
    kept = F.forall(F.arrays_zip("lens", "full"), lambda x: (x["lens"] == 0) | (x["lens"] == x["full"]))
    return rows.select("n_nationkey", kraft.alias("kraft"), kept.alias("kept"))


def symbol_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of the parts' names without matches: their bytes, and an end for each."""
    z = C.encode(F.col("p_name"), "deflate", {"deflate.strategy": "huffman_only"})["data"]
    return A.symbol_frequencies(read(spark, sf_dir, "part", "p_name").select(z.alias("z")), "z")


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of all pages' DEFLATE streams, dynamic ones with matches."""
    C.register_sql(spark)
    rows = read(spark, sf_dir, "pages", "page_id", C.encode(F.col("html"), "deflate")["data"].alias("z"))
    rows.createOrReplaceTempView("codecframe_pages")
    out = spark.sql("SELECT page_id, b.* FROM codecframe_pages, LATERAL deflate_blocks(z) b")
    return out.groupBy("page_id").agg(F.sum("bytes_out").alias("size"), F.min("status").alias("status"), F.count_if("final").alias("final_blocks"))


def distance_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance symbols of 1 to 32768, and -1 beyond, from the orders' keys."""
    rows = read(spark, sf_dir, "orders", "o_orderkey", F.pmod("o_orderkey", F.lit(40000)).alias("value"))
    return A.match_codes(rows, "value", "distance").select("o_orderkey", "value", F.coalesce("code", F.lit(-1)).cast("long").alias("code"))


def match_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length symbol of 3 to 258, from the parts' sizes."""
    rows = read(spark, sf_dir, "part", "p_partkey", (F.pmod("p_partkey", F.lit(256)) + 3).alias("value"))
    return A.match_codes(rows, "value").select("p_partkey", "value", F.col("code").cast("long").alias("code"))


def _checked(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return A.check_options(spark.createDataFrame(rows, "set_id long, key string, value string"), A.option_schema(spark, "gzip"))


def option_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, [(1, "deflate.level", "6"), (2, "deflate.level", "10"), (3, "deflate.strategy", "rle"), (4, "deflate.strategy", "best"), (5, "gzip.concat", "true"), (6, "no.such", "1"), (7, "limits.max_output_bytes", "0"), (8, "deflate.window_bits", "7")])


def option_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of wrong types, at and beyond the bounds of the types, and null."""
    most = "limits.max_output_bytes"
    values = [("deflate.level", "6.4"), ("deflate.level", " 6"), ("deflate.level", ""), ("deflate.level", "-1"), ("deflate.level", "9"), ("gzip.concat", None), ("gzip.concat", "1"), ("deflate.strategy", None), (most, str(U64)), (most, str(U64 + 1)), (most, "-1"), ("threads.count", str((1 << 63) - 1)), ("threads.count", str(1 << 63)), ("deflate.window_bits", "1e1"), ("gzip.name", "any text")]
    return _checked(spark, [(i, *v) for i, v in enumerate(values)])


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered methods, what they can do, and how many options each has of its own."""
    rows = [(n, DEFAULT.find(n).encoder is not None, DEFAULT.find(n).decoder is not None, len(DEFAULT.schema(n).own)) for n in DEFAULT.names()]
    return spark.createDataFrame(rows, "method string, encodes boolean, decodes boolean, options int")


def identity_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.decode(C.encode(F.col("p_name"), "identity")["data"], "identity")
    return read(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", r["data"].cast("string").alias("p_name"), r["status"].alias("status"))


def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields that the encoder writes for each level, as the member reader gives them."""
    C.register_sql(spark)
    rows, out = read(spark, sf_dir, "nation", "n_nationkey", "n_name"), None
    for level in range(10):
        opts = {"deflate.level": level, "gzip.name": "n", "gzip.comment": "c", "gzip.extra": b"AB", "gzip.header_crc": True, "gzip.mtime": 7 + level, "gzip.os": 3}
        one = rows.select("n_nationkey", F.lit(level).alias("level"), C.encode(F.col("n_name"), "gzip", opts)["data"].alias("z"))
        out = one if out is None else out.unionAll(one)
    out.createOrReplaceTempView("codecframe_headers")
    return spark.sql("SELECT n_nationkey, level, m.flags, m.mtime, m.xfl, m.os, m.name, m.comment, hex(m.extra) AS extra, m.isize, m.status FROM codecframe_headers, LATERAL gzip_members(z) m")


def sql_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codecs as SQL functions: a good round trip, a bad method, a bad option."""
    C.register_sql(spark)
    read(spark, sf_dir, "nation", "n_nationkey", "n_name").createOrReplaceTempView("codecframe_nation")
    return spark.sql("""
        SELECT n_nationkey, CAST(d.data AS STRING) AS n_name, d.status, d.bytes_out, bad.status AS bad_method, wrong.status AS bad_option FROM (
          SELECT n_nationkey, codec_decode(codec_encode(CAST(n_name AS BINARY), 'gzip', map('deflate.level', '9')).data, 'gzip', NULL) AS d,
                 codec_encode(CAST(n_name AS BINARY), 'no', NULL) AS bad, codec_encode(CAST(n_name AS BINARY), 'gzip', map('deflate.level', '99')) AS wrong
          FROM codecframe_nation)""")


def limit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding under caps: output of one and of two members together, and expansion."""
    pages = read(spark, sf_dir, "pages", "page_id", "html")
    z = C.encode(F.col("html"), "gzip")["data"]
    zeros = spark.range(0, 1, 1, 1).select(C.encode(F.rpad(F.lit(""), 100_000, "0"), "gzip")["data"].alias("zeros"))
    cap = {"limits.max_output_bytes": 2000}
    rows = pages.select("page_id", z.alias("z")).crossJoin(F.broadcast(zeros))  # encoded once, decoded for each page
    status = lambda c, opts: C.verify(c, "gzip", opts)["status"]
    return rows.select(
        "page_id",
        status(F.col("z"), cap).alias("one"),
        status(F.concat("z", "z"), cap | {"gzip.concat": True}).alias("two"),
        status(F.col("zeros"), {"limits.max_expansion_ratio": 50}).alias("over_ratio"),
        status(F.col("zeros"), {"limits.max_expansion_ratio": 0}).alias("no_ratio"),
    )


def trailing_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes after a stream's end are left, and counted."""
    rows = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    z = F.concat(C.encode(F.col("p_name"), "deflate")["data"], F.col("p_brand").cast("binary"))
    r = C.decode(z, "deflate")
    return rows.select("p_partkey", r["status"].alias("status"), r["bytes_out"].alias("bytes_out"), r["rest"].alias("rest"))


#: DEFLATE streams and the status or text that they give (fixed values of the format's tests).
VECTORS = (
    ("empty_stored", "010000FFFF", "OK", ""),
    ("single_byte", "730400", "OK", "A"),
    ("stored", "010500FAFF48656C6C6F", "OK", "Hello"),
    ("fixed", "F348CDC9C9D75128CF2FCA49510400", "OK", "Hello, world!"),
    ("matches", "73747276444200", "OK", "ABCABCABCABCABC"),
    ("no_input", "", "CORRUPT", None),
    ("header_only", "00", "CORRUPT", None),
    ("mid_len", "0105", "CORRUPT", None),
    ("mid_nlen", "010500FA", "CORRUPT", None),
    ("mid_payload", "010500FAFF48656C", "CORRUPT", None),
    ("dynamic_header", "05", "CORRUPT", None),
    ("dynamic_lengths", "050000", "CORRUPT", None),
    ("mid_symbol", "03", "CORRUPT", None),
    ("type_3", "06000000", "CORRUPT", None),
    ("type_3_final", "07000000", "CORRUPT", None),
    ("nlen", "010500000048656C6C6F", "CORRUPT", None),
    ("no_history", "0302", "CORRUPT", None),
    ("short_history", "73044200", "CORRUPT", None),
    ("hlit_30", "F50000", "CORRUPT", None),
    ("hlit_31", "FD0000", "CORRUPT", None),
    ("hdist_30", "051E00", "CORRUPT", None),
)


def deflate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and bad streams: the codec's status and text, and the block reader's status."""
    C.register_sql(spark)
    rows = spark.createDataFrame([(n, h) for n, h, *_ in VECTORS], "name string, hex string").withColumn("z", F.unhex("hex"))
    r = C.decode(F.col("z"), "deflate")
    rows.select("name", "z", r["status"].alias("status"), r["data"].cast("string").alias("text")).createOrReplaceTempView("codecframe_vectors")
    return spark.sql("SELECT name, v.status, text, min(b.status) AS blocks FROM codecframe_vectors v, LATERAL deflate_blocks(z) b GROUP BY name, v.status, text")


def stream_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a source as one stream in an order that mixes them: far over a window.

    Encoded and decoded chunk by chunk; sizes and checksums of both ends.
    """
    docs = read(spark, sf_dir, "documents", F.coalesce("source", F.lit("")).alias("stream_id"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("chunk"))
    order = Window.partitionBy("stream_id").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")))
    chunks = docs.withColumn("seq", F.row_number().over(order).cast("long") - 1)
    chunks = chunks.withColumn("eof", F.col("seq") == F.count("*").over(Window.partitionBy("stream_id")) - 1)
    coded = K.transcode(chunks, "deflate", "encoder")
    last = chunks.select("stream_id", "seq", "eof")
    back = K.transcode(coded.join(last, ["stream_id", "seq"]).select("stream_id", "seq", F.col("data").alias("chunk"), "eof"), "deflate")
    ends = K.crc_of_chunks(back.select("stream_id", "seq", F.col("data").alias("chunk"))).withColumnsRenamed({"crc": "crc_back", "size": "size_back"})
    return K.crc_of_chunks(chunks).join(ends, "stream_id").select("stream_id", "size", "size_back", (F.col("crc") == F.col("crc_back")).alias("same"))


def file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as members of gzip files, read back step by step."""
    at = work_dir(spark)
    write_members(read(spark, sf_dir, "pages", "html").repartition(4), "html", f"{at}/files")
    out = read_chunks(spark, f"{at}/files")
    return out.agg(F.sum(F.octet_length("data").cast("long")).alias("size"), F.count_distinct("path").alias("files"), F.max("status").alias("status"))


def ratio_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("bytes_in"), F.col("l_extendedprice").cast("long").alias("bytes_out"))
    return rows.where(C.ratio_ok(F.col("bytes_in"), F.col("bytes_out"), F.lit(1500))).select("l_orderkey", "l_linenumber")


def concat_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as members of one gzip stream, decoded together."""
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("z", C.encode(F.col("text"), "gzip")["data"])
    g = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.hex("z").alias("h")))).alias("p"))
    whole = F.unhex(F.array_join("p.h", ""))
    return g.select("conv_id", F.sha2(C.decode(whole, "gzip", {"gzip.concat": True})["data"], 256).alias("sha"))


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "html").withColumn("z", C.encode(F.col("html"), "gzip")["data"])
    return K.split(pages, "page_id", "z", 500)


def chunked_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.transcode(_chunked(spark, sf_dir), "gzip")
    return out.groupBy(F.col("stream_id").cast("long").alias("page_id")).agg(F.sum(F.octet_length("data").cast("long")).alias("size"), F.min("status").alias("status"))


def chunked_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = K.split(read(spark, sf_dir, "part", "p_partkey", "p_name"), "p_partkey", "p_name", 4)
    return K.crc_of_chunks(parts, run=2).select(F.col("stream_id").cast("long").alias("p_partkey"), "crc", "size")


def corrupt_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each damage to a page's gzip and the status it gives."""
    z, n = F.col("z"), F.octet_length("z")
    flip = F.concat(F.substring(z, F.lit(1), n - 8), F.unhex(F.lit("DEADBEEF")), F.substring(z, n - 3, F.lit(4)))
    cases = F.map_from_arrays(
        F.array(*[F.lit(x) for x in ("whole", "crc", "cut", "magic", "method", "reserved")]),
        F.array(z, flip, F.substring(z, F.lit(1), n - 1), F.concat(F.unhex(F.lit("00")), F.substring(z, F.lit(2), n)), F.concat(F.unhex(F.lit("1F8B07")), F.substring(z, F.lit(4), n)), F.concat(F.unhex(F.lit("1F8B0820")), F.substring(z, F.lit(5), n))),
    )
    rows = read(spark, sf_dir, "pages", "page_id", "html").select("page_id", C.encode(F.col("html"), "gzip")["data"].alias("z"))
    rows = rows.select("page_id", F.explode(cases).alias("damage", "data"))
    return rows.withColumn("status", C.verify(F.col("data"), "gzip")["status"]).groupBy("damage", "status").agg(F.count("*").alias("n"))


def gzip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part", "p_partkey", C.encode(F.col("p_name"), "gzip", {"gzip.name": "part"})["data"].alias("z"))
    C.register_sql(spark)
    rows.createOrReplaceTempView("codecframe_members")
    return spark.sql("SELECT p_partkey, m.member, m.flags, m.name, m.crc, m.isize, m.status FROM codecframe_members, LATERAL gzip_members(z) m")


def deflate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part", "p_partkey", C.encode(F.col("p_name"), "deflate", {"deflate.strategy": "fixed"})["data"].alias("z"))
    C.register_sql(spark)
    rows.createOrReplaceTempView("codecframe_blocks")
    return spark.sql("SELECT p_partkey, b.block, b.kind, b.final, b.bytes_out, b.status FROM codecframe_blocks, LATERAL deflate_blocks(z) b")


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.run_stats(read(spark, sf_dir, "part", "p_partkey", "p_name"), "p_partkey", "p_name")


def streaming_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as a stream of files, decoded with state, to a table."""
    at = work_dir(spark)
    source = _chunked(spark, sf_dir)
    source.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 64).parquet(f"{at}/in")
    q = decode_stream(stream, wait_ms=None).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.col("stream_id").cast("long").alias("page_id"), "status", F.sha2("data", 256).alias("sha"))


QUERIES = {
    f.__name__: f
    for f in (
        *(compression_report, gzip_roundtrip, deflate_matrix, crc_part, gzip_header_peek, deflate_level0, level0_size),
        *(byte_histogram, entropy_bits, huffman_lengths, canonical_codes, kraft_check, reversed_codes, packed_codes),
        *(code_length_runs, completed_codes, symbol_frequencies, match_codes, distance_codes, option_check, option_types),
        *(methods, identity_roundtrip, header_fields, sql_roundtrip, limit_status, trailing_bytes, deflate_vectors),
        *(ratio_filter, concat_members, chunked_decode, chunked_crc, corrupt_status, gzip_members, deflate_blocks),
        *(page_blocks, run_stats, stream_roundtrip, file_roundtrip, streaming_decode),
    )
}

_CRC = """WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
c AS (SELECT p_partkey, p_name, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(p_name, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(tbl[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)::BIGINT AS crc FROM part, t)
"""
_BYTES = "SELECT ord(unnest(string_split(p_name, ''))) AS sym FROM part"
_LENS = "SELECT n_regionkey AS alphabet, n_nationkey AS sym, (n_nationkey % 5 + 3)::INT AS len FROM nation"
_CODES = f"SELECT alphabet, sym, len, (coalesce(sum((1 << (15 - len))::BIGINT) OVER (PARTITION BY alphabet ORDER BY len, sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT >> (15 - len))::BIGINT AS code FROM ({_LENS})"
_BITS = f"SELECT alphabet, sym, lpad(bin(code), len, '0') AS text FROM ({_CODES})"
_DISTANCES = "WITH e AS (SELECT c, CASE WHEN c < 4 THEN 0 ELSE c // 2 - 1 END AS extra FROM range(30) r(c)), b AS (SELECT c, 1 + coalesce(sum(1 << extra) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM e)"
ORACLES = {
    "compression_report": "SELECT lang, count(*) AS docs, sum(strlen(text))::BIGINT AS raw_bytes, count(*) AS same FROM documents GROUP BY lang",
    "gzip_roundtrip": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "deflate_matrix": "SELECT conv_id, turn, sha256(text) AS sha, (6 * count(*))::BIGINT AS n FROM conversations GROUP BY ALL",
    "crc_part": _CRC + "SELECT p_partkey, crc, xor(crc, 4294967295)::BIGINT AS raw FROM c",
    "gzip_header_peek": "SELECT page_id, true AS magic_ok, 8::BIGINT AS cm, 0::BIGINT AS flags, 0::BIGINT AS mtime, 2::BIGINT AS xfl, 255::BIGINT AS os, strlen(html)::BIGINT AS isize, strlen(html)::BIGINT AS size FROM pages",
    "deflate_level0": "SELECT p_partkey, lower('01' || substr(printf('%04X', strlen(p_name)), 3, 2) || substr(printf('%04X', strlen(p_name)), 1, 2) || substr(printf('%04X', 65535 - strlen(p_name)), 3, 2) || substr(printf('%04X', 65535 - strlen(p_name)), 1, 2) || hex(encode(p_name))) AS bytes, true AS same FROM part",
    "level0_size": "SELECT page_id, (strlen(html) + 5 * (strlen(html) // 65535 + 1))::BIGINT AS size, (strlen(html) + 5 * (strlen(html) // 65535 + 1) + 18)::BIGINT AS gzip_size FROM pages",
    "byte_histogram": f"SELECT sym::BIGINT AS sym, count(*) AS n FROM ({_BYTES}) GROUP BY sym",
    "entropy_bits": f"SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy_bits FROM (SELECT sym, count(*) AS n FROM ({_BYTES}) GROUP BY sym)",
    "canonical_codes": f"SELECT alphabet, sym, len, (coalesce(sum((1 << (15 - len))::BIGINT) OVER (PARTITION BY alphabet ORDER BY len, sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT >> (15 - len))::BIGINT AS code FROM ({_LENS})",
    "kraft_check": f"SELECT alphabet, sum(1 << (15 - len))::BIGINT AS kraft, sum(1 << (15 - len)) <= 32768 AS valid, sum(1 << (15 - len)) = 32768 AS complete FROM ({_LENS}) GROUP BY alphabet",
    "match_codes": "WITH e AS (SELECT c, CASE WHEN c < 8 OR c = 28 THEN 0 ELSE c // 4 - 1 END AS extra FROM range(29) r(c)), b AS (SELECT c, CASE WHEN c = 28 THEN 258 ELSE 3 + coalesce(sum(1 << extra) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS base FROM e) SELECT p_partkey, p_partkey % 256 + 3 AS value, (SELECT max(c) + 257 FROM b WHERE base <= p_partkey % 256 + 3)::BIGINT AS code FROM part",
    "option_check": "SELECT * FROM (VALUES (1::BIGINT, 'deflate.level', 'OK'), (2, 'deflate.level', 'INVALID_ARG'), (3, 'deflate.strategy', 'OK'), (4, 'deflate.strategy', 'INVALID_ARG'), (5, 'gzip.concat', 'OK'), (6, 'no.such', 'INVALID_ARG'), (7, 'limits.max_output_bytes', 'OK'), (8, 'deflate.window_bits', 'INVALID_ARG')) v(set_id, key, status)",
    "huffman_lengths": f"WITH RECURSIVE c AS (SELECT sym, count(*) AS n FROM ({_BYTES}) GROUP BY sym), h(l, bits) AS (SELECT list_sort(list(n)), 0::BIGINT FROM c UNION ALL SELECT list_sort(list_append(l[3:], l[1] + l[2])), (bits + l[1] + l[2])::BIGINT FROM h WHERE len(l) > 1) SELECT (SELECT count(*) FROM c) AS symbols, max(bits) AS bits, true AS complete FROM h",
    "reversed_codes": f"SELECT alphabet, sym, list_sum(list_transform(range(length(text)), lambda i: CASE WHEN substr(text, i::INT + 1, 1) = '1' THEN 1 << i::INT ELSE 0 END))::BIGINT AS bits FROM ({_BITS})",
    "packed_codes": f"SELECT alphabet, array_to_string(list_transform(range((length(s) + 7) // 8), lambda k: printf('%02X', list_sum(list_transform(range(8), lambda j: CASE WHEN substr(s, (8 * k + j + 1)::INT, 1) = '1' THEN 1 << j::INT ELSE 0 END))::INT)), '') AS bytes FROM (SELECT alphabet, string_agg(text, '' ORDER BY sym) AS s FROM ({_BITS}) GROUP BY alphabet)",
    "code_length_runs": "SELECT n_nationkey, 320::BIGINT AS lengths, len(list_filter(range(320), lambda i: i % (n_nationkey + 7) >= 5))::BIGINT AS zeros, (CASE WHEN n_nationkey >= 9 THEN 320 // (n_nationkey + 7) ELSE 0 END + CASE WHEN 320 % (n_nationkey + 7) - 5 >= 11 THEN 1 ELSE 0 END)::BIGINT AS long_gaps FROM nation",
    "completed_codes": "SELECT n_nationkey, 128::INT AS kraft, true AS kept FROM nation",
    "symbol_frequencies": f"SELECT 'length' AS alphabet, sym::INT AS sym, count(*) AS n FROM ({_BYTES}) GROUP BY sym UNION ALL SELECT 'length', 256::INT, count(*) FROM part",
    "distance_codes": _DISTANCES + " SELECT o_orderkey, o_orderkey % 40000 AS value, coalesce(CASE WHEN o_orderkey % 40000 BETWEEN 1 AND 32768 THEN (SELECT max(c) FROM b WHERE base <= o_orderkey % 40000) END, -1)::BIGINT AS code FROM orders",
    "option_types": "SELECT (i - 1)::BIGINT AS set_id, key, status FROM (SELECT unnest(['deflate.level', 'deflate.level', 'deflate.level', 'deflate.level', 'deflate.level', 'gzip.concat', 'gzip.concat', 'deflate.strategy', 'limits.max_output_bytes', 'limits.max_output_bytes', 'limits.max_output_bytes', 'threads.count', 'threads.count', 'deflate.window_bits', 'gzip.name']) AS key, generate_subscripts(range(15), 1) AS i, CASE WHEN generate_subscripts(range(15), 1) IN (5, 9, 12, 15) THEN 'OK' ELSE 'INVALID_ARG' END AS status)",
    "methods": "SELECT * FROM (VALUES ('deflate', true, true, 3::INT), ('gzip', true, true, 15), ('identity', true, true, 0)) v(method, encodes, decodes, options)",
    "identity_roundtrip": "SELECT p_partkey, p_name, 'OK' AS status FROM part",
    "header_fields": "SELECT n_nationkey, l::INT AS level, 30::INT AS flags, (7 + l)::BIGINT AS mtime, (CASE WHEN l <= 2 THEN 4 WHEN l >= 6 THEN 2 ELSE 0 END)::INT AS xfl, 3::INT AS os, 'n' AS name, 'c' AS comment, '4142' AS extra, strlen(n_name)::BIGINT AS isize, 'OK' AS status FROM nation, range(10) r(l)",
    "sql_roundtrip": "SELECT n_nationkey, n_name, 'OK' AS status, strlen(n_name)::BIGINT AS bytes_out, 'UNSUPPORTED' AS bad_method, 'INVALID_ARG' AS bad_option FROM nation",
    "limit_status": "SELECT page_id, CASE WHEN strlen(html) > 2000 THEN 'LIMIT' ELSE 'OK' END AS one, CASE WHEN 2 * strlen(html) > 2000 THEN 'LIMIT' ELSE 'OK' END AS two, 'LIMIT' AS over_ratio, 'OK' AS no_ratio FROM pages",
    "trailing_bytes": "SELECT p_partkey, 'OK' AS status, strlen(p_name)::BIGINT AS bytes_out, strlen(p_brand)::BIGINT AS rest FROM part",
    "deflate_vectors": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{s}', {'NULL' if t is None else chr(39) + t + chr(39)}, '{s}')" for n, _, s, t in VECTORS) + ") v(name, status, text, blocks)",
    "page_blocks": "SELECT page_id, strlen(html)::BIGINT AS size, 'OK' AS status, 1::BIGINT AS final_blocks FROM pages",
    "stream_roundtrip": "SELECT coalesce(source, '') AS stream_id, sum(strlen(coalesce(text, '')))::BIGINT AS size, sum(strlen(coalesce(text, '')))::BIGINT AS size_back, true AS same FROM documents GROUP BY coalesce(source, '')",
    "file_roundtrip": "SELECT sum(strlen(html))::BIGINT AS size, 4::BIGINT AS files, 'OK' AS status FROM pages",
    "ratio_filter": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE trunc(l_quantity) = 0 OR trunc(l_extendedprice) <= 1500 * trunc(l_quantity)",
    "concat_members": "SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS sha FROM conversations GROUP BY conv_id",
    "chunked_decode": "SELECT page_id, strlen(html)::BIGINT AS size, 'OK' AS status FROM pages",
    "chunked_crc": _CRC + "SELECT p_partkey, crc, strlen(p_name)::BIGINT AS size FROM c",
    "corrupt_status": "SELECT damage, status, (SELECT count(*) FROM pages) AS n FROM (VALUES ('whole', 'OK'), ('crc', 'CORRUPT'), ('cut', 'CORRUPT'), ('magic', 'CORRUPT'), ('method', 'UNSUPPORTED'), ('reserved', 'CORRUPT')) v(damage, status)",
    "gzip_members": _CRC + "SELECT p_partkey, 0 AS member, 8 AS flags, 'part' AS name, crc, strlen(p_name)::BIGINT AS isize, 'OK' AS status FROM c",
    "deflate_blocks": "SELECT p_partkey, 0 AS block, 'fixed' AS kind, true AS final, strlen(p_name)::BIGINT AS bytes_out, 'OK' AS status FROM part",
    "run_stats": "WITH b AS (SELECT p_partkey, i, substr(p_name, i::INT, 1) AS c FROM part, unnest(range(1, length(p_name) + 1)) u(i)), s AS (SELECT *, coalesce(c <> lag(c) OVER (PARTITION BY p_partkey ORDER BY i), true)::INT AS new FROM b), g AS (SELECT *, sum(new) OVER (PARTITION BY p_partkey ORDER BY i) AS run FROM s), r AS (SELECT p_partkey, run, count(*) AS n FROM g GROUP BY ALL) SELECT p_partkey, count(*) AS n_runs, max(n) AS longest FROM r GROUP BY p_partkey",
    "streaming_decode": "SELECT page_id, 'OK' AS status, sha256(html) AS sha FROM pages",
}
