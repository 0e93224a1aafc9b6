import gzip
import os
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from codecframe import functions as C
from codecframe import registry
from codecframe.options import Options
from codecframe.registry import Method, Registry


def test_workers_hold_a_few_results_of_a_batch(spark):
    class Coder:
        """4 MiB for every value, which begin with the worker's resident bytes."""

        def __init__(self, options):
            pass

        def update(self, data):
            return b""

        def finish(self):
            with open("/proc/self/statm") as f:
                return b"%020d" % (int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")) + bytes(4 << 20)

    r = Registry()
    r.register(Method("m", Coder, Coder))
    rows = spark.range(0, 150, 1, 1).select(C.decode(F.col("id").cast("string"), "m", reg=r)["data"].alias("data"))
    seen = [x[0] for x in rows.select(F.substring("data", 1, 20).cast("string").cast("long")).collect()]
    assert len(seen) == 150 and max(seen) - min(seen) < 100 << 20  # all results of the batch: 600 MiB


def test_results_stay_with_their_rows(spark):
    z = C.encode(F.when(F.col("id") % 7 > 0, F.expr("repeat('x', int(id * 400))")), "gzip")["data"]
    rows = spark.range(0, 400, 1, 1).select("id", C.decode(z, "gzip", {"limits.max_expansion_ratio": 0}).alias("r"))
    got = rows.select("id", "r.status", F.octet_length("r.data")).collect()
    assert [tuple(x) for x in got] == [(i, "OK" if i % 7 else None, i * 400 if i % 7 else None) for i in range(400)]


def test_sql_results_are_handed_on_in_parts():
    values = [gzip.compress(bytes(1 << 20)), None, b"bad"] * 20
    arrays = list(C._sql_codec("decoder").func(iter([(pa.array(values), pa.array(["gzip"] * 60), pa.array([[("limits.max_expansion_ratio", "0")]] * 60, pa.map_(pa.string(), pa.string())))])))
    assert len(arrays) == 6 and all(a.nbytes < 6 << 20 for a in arrays)
    assert [r and (r["status"], r["bytes_out"]) for a in arrays for r in a.to_pylist()] == [("OK", 1 << 20), None, ("CORRUPT", 0)] * 20


def test_verify_is_decode_without_data(spark):
    z = gzip.compress(b"some text " * 500)
    values = [(i, v) for i, v in enumerate([z, z + z, z + b"tail", z[:-1], b"", None, b"\0" + z, gzip.compress(bytes(10_000_000))])]
    rows = spark.createDataFrame(values, "i int, z binary")
    for opts in ({}, {"gzip.concat": True}, {"limits.max_output_bytes": 5000}, {"limits.max_output_bytes": 4999}, {"limits.max_expansion_ratio": 0}):
        both = rows.select(C.decode(F.col("z"), "gzip", opts).dropFields("data").alias("d"), C.verify(F.col("z"), "gzip", opts).alias("v")).collect()
        assert len(both) == len(values) and all(x.d == x.v for x in both)


def test_measure_drops_each_step():
    data = os.urandom(16 << 20)
    z = registry.run("gzip", "encoder", data, {"deflate.level": 0})
    tracemalloc.start()
    assert registry.measure("gzip", "decoder", z + b"ab", Options()) == (len(data), 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak - len(z) < 4 << 20
