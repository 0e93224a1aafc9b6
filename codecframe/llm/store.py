"""Tables written to the shared folder that the cluster names in ``spark.checkpoint.dir``.

A written table cuts lineage, survives lost executors, and gives the planner a real
size to decide on a broadcast by.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_private: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode, where one machine is all, a private one
    if none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _private:
            _private.append("file://" + tempfile.mkdtemp(prefix="codecframe-"))
        path = _private[0]
    return path.rstrip("/")


_sweeps: list[list] = []


@contextmanager
def swept() -> Iterator[None]:
    """Delete all tables of operators that are called inside, once their results are written."""
    held: list[Scratch] = []
    _sweeps.append(held)
    try:
        yield
    finally:
        _sweeps.remove(held)
        for scratch in held:
            scratch.keep()


class Scratch:
    """Named intermediate tables of one operator call.

    ``drop`` deletes tables that no later plan reads, ``keep`` all but those that the
    returned plan still reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/codecframe-{label}-{uuid.uuid4().hex}"
        self.n, self.paths = 0, []
        for held in _sweeps:
            held.append(self)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            p.getFileSystem(conf).delete(p, True)
            self.paths.remove(t._scratch_path)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        kept = [t._scratch_path for t in tables]
        for path in self.paths:
            if path not in kept:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
        self.paths = kept
