"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes sets boundaries, with a strict mask before the normal
chunk length and a loose one after it. A fingerprint is the set of chunk digests with the
bytes they cover, as text; an insertion changes only the chunks around it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType

from codecframe.llm import textscan as ts
from codecframe.llm.rows import column, extended

U = np.uint64
LEAST, NORMAL, MOST = 16, 48, 160
#: Bits that must be zero before and after the normal length.
STRICT, LOOSE = U(0x7F << 24), U(0x0F << 24)
BLOCK = 1 << 20
#: Rows of a part, and the most parts: beyond so many, parts get more rows.
ROWS_A_PART, MOST_PARTS = 4000, 1 << 16

_gear = ts.mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95)) & U(0xFFFFFFFF)


def gear(data: np.ndarray) -> np.ndarray:
    """Sum over the last 32 bytes of their gear values, shifted by age, modulo 2^32."""
    h = _gear[data]
    for step in (1, 2, 4, 8, 16):
        moved = h.copy()
        moved[step:] += h[:-step] << U(step)
        h = moved & U(0xFFFFFFFF)
    return h


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks; blocks bound the memory that a long text needs."""
    strict, loose = [], []
    for at in range(0, len(data), BLOCK):
        low = max(0, at - 31)
        h = gear(data[low : at + BLOCK])[at - low :]
        strict.append(np.flatnonzero(h & STRICT == 0) + at + 1)
        loose.append(np.flatnonzero(h & LOOSE == 0) + at + 1)
    hard = np.concatenate(strict).tolist() if strict else []
    soft = np.concatenate(loose).tolist() if loose else []
    n, at, out = len(data), 0, []
    while n - at > LEAST:
        i = bisect_left(hard, at + LEAST)
        cut = hard[i] if i < len(hard) and hard[i] < at + NORMAL else 0
        if not cut:
            i = bisect_left(soft, at + NORMAL)
            cut = min(soft[i] if i < len(soft) else n, at + MOST, n)
        out.append(cut)
        at = cut
    if at < n:
        out.append(n)
    return np.array(out, np.int64)


def chunk_weights(text: str) -> dict[int, int]:
    """40-bit chunk digest to the bytes that its chunks cover."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return {}
    ends = boundaries(data)
    starts = np.concatenate(([0], ends[:-1]))
    keys, where = np.unique(ts.span_hashes(data, starts, ends) >> U(24), return_inverse=True)
    return dict(zip(keys.tolist(), np.bincount(where, ends - starts).astype(np.int64).tolist(), strict=True))


def to_string(weights: dict[int, int]) -> str:
    return ",".join(f"{k:010x}:{n:x}" for k, n in sorted(weights.items()))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's bytes whose chunks b has; 1 for an empty a."""
    return sum(min(n, b.get(k, 0)) for k, n in a.items()) / sum(a.values()) if a else 1.0


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """The lesser containment, in either direction; 1 if both are empty, 0 if one is."""
    return min(containment(a, b), containment(b, a))


def _row(i: object, text: str, fp: dict, after: str, after_fp: dict) -> tuple:
    q = len(text) // 4
    edited = text[: len(text) - q] + after[:q]
    efp = fp if edited == text else chunk_weights(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return i, len(text), sha, to_string(fp), to_string(efp), likeness(fp, efp), likeness(fp, after_fp)


def _neighbour_batches(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (part, extra, doc_id, text) in order; an extra row only ends its part."""
    kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = None
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            part, extra, i = (batch.column(c)[k].as_py() for c in range(3))
            text = batch.column(3)[k].as_py() or ""
            fp = chunk_weights(text)
            if held is not None and held[0] == part:
                rows.append(_row(*held[1:], text, fp))
            held = None if extra else (part, i, text, fp)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def compare_neighbours(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of an edited one, and their likeness to each other and
    to the next document's.

    Documents follow each other by identifier (null first, repeats by the text's hash);
    the first follows the last. Null text is empty. Extra columns are ignored; an empty
    table gives an empty result. Ranges of identifiers are parts; the first document of a
    part also ends the part before, so each text is moved once.
    """
    spark = docs.sparkSession
    rows = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    order = F.xxhash64("text")
    ids = rows.select("doc_id", order.alias("h"))
    n = ids.count()
    id_type = rows.schema["doc_id"].dataType
    schema = extended([rows.schema["doc_id"]], "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    if not n:
        return spark.createDataFrame([], schema)
    parts = min(MOST_PARTS, max(1, -(-n // ROWS_A_PART)))
    ranged = ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).withColumn("p", F.spark_partition_id())
    lows = ranged.groupBy("p").agg(F.min("doc_id").alias("low")).orderBy("p").collect()[1:]  # MOST_PARTS rows at most
    lows = spark.sparkContext.broadcast(sorted({r["low"] for r in lows if r["low"] is not None}))
    last = len(lows.value)

    @F.arrow_udf(IntegerType())
    def place(names: pa.Array) -> pa.Array:
        """Twice the part, and one more for its first identifier, by binary search."""
        of = [0 if x is None else bisect_right(lows.value, x) for x in names.to_pylist()]
        return pa.array([2 * k + (k > 0 and lows.value[k - 1] == x) for k, x in zip(of, names.to_pylist(), strict=True)], pa.int32())

    own = rows.withColumns({"place": place("doc_id"), "h": order}).withColumns({"part": F.floor(F.col("place") / 2).cast("int"), "first": F.col("place") % 2 == 1})
    lowest = rows.select("doc_id", order.alias("h")).orderBy(F.col("doc_id").asc_nulls_first(), "h").first()
    is_lowest = F.col("doc_id").eqNullSafe(F.lit(lowest["doc_id"]).cast(id_type)) & (F.col("h") == lowest["h"])
    spots = F.filter(
        F.array(
            F.struct(F.col("part").alias("part"), F.lit(0).alias("extra")),
            F.when(F.col("first"), F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("extra"))),
            F.when(is_lowest, F.struct(F.lit(last).alias("part"), F.lit(1).alias("extra"))),
        ),
        lambda x: x.isNotNull(),
    )
    dealt = own.select("doc_id", "text", "h", F.explode(spots).alias("s")).select("s.part", "s.extra", "doc_id", "h", "text")
    key = [F.col("part"), F.col("extra"), F.col("doc_id").asc_nulls_first(), F.col("h")]
    dealt = dealt.repartitionById(last + 1, F.col("part")).sortWithinPartitions(*key).select("part", "extra", "doc_id", "text")
    return dealt.mapInArrow(partial(_neighbour_batches, id_type=to_arrow_type(id_type)), schema)
