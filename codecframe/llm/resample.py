"""Importance resampling: the ratio of hashed n-gram models of target and raw text, sampled
by Gumbel top-k.

Unigrams and bigrams are hashed to buckets. A text's weight is the sum of its n-grams' log
ratios; noise from a hash of the row makes the k largest a sample without replacement in
proportion to the weights. The k-th largest is found by histograms over key bits, level by
level, so nothing is sorted and no more than a bounded histogram reaches the driver. Texts
are not shuffled: those of the target are found by a bitmap of fixed size before the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecframe.llm import textscan as ts
from codecframe.llm.decontam import _table
from codecframe.llm.rows import column, extended, packed, unpacked, with_matches
from codecframe.llm.store import Scratch

U = np.uint64
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
#: Pseudo-count of each bucket in both models, at the scale of the target counts.
PRIOR = 5.0
LEVEL_BITS, LEVELS = 16, 4


def grams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(texts, place of the text, bucket) of all word unigrams and bigrams, of slices of texts.

    Case is kept out, ASCII punctuation too.
    """
    for i, j, data, off in ts.slices(texts):
        h, first = ts.word_hashes(_table[data], off)
        of = np.repeat(np.arange(j - i), np.diff(first))
        inside = of[1:] == of[:-1]
        two = ts.mix(h[:-1] * U(3) + h[1:])[inside]
        buckets = (np.concatenate([h, two]) >> U(64 - BUCKET_BITS)).astype(np.int64)
        yield j - i, np.concatenate([of, of[:-1][inside]]), buckets


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, buckets in grams(batch.column(0)):
            total += np.bincount(buckets, minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def gram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Occurrences of each bucket in all texts; at most ``BUCKETS`` sums are collected."""
    out = np.zeros(BUCKETS)
    sums = docs.select(column(text)).mapInArrow(_count_batches, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def fit(raw: DataFrame, target: DataFrame, text: str = "text") -> np.ndarray:
    """Log ratio of each bucket, from all texts of both. Null texts have no words."""
    of_raw, of_target = gram_counts(raw, text), gram_counts(target, text)
    scale = of_target.sum() / of_raw.sum() if of_raw.sum() else 0.0
    return np.log((of_target + PRIOR) / (of_raw * scale + PRIOR))


def rows_of(docs: DataFrame, wanted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, whose identifier ``wanted`` has in its first column.

    A null identifier is in none; a repeated one changes nothing.
    """
    scratch = Scratch(docs.sparkSession, "rows")
    ids = wanted.select(F.col(wanted.columns[0]).alias("id")).where("id is not null").distinct()
    ids = scratch.table(ids, "ids")
    rows = docs.select(packed(docs.columns), column(doc_id).alias("doc"))
    return with_matches(rows, ids, "doc", "id", scratch).select(*unpacked(docs.columns))


def _weigh_batches(batches: Iterator[pa.RecordBatch], ratio: object) -> Iterator[pa.RecordBatch]:
    """(row, hash, text) to (row, log weight, key, order): the key's bits, ordered as the key is."""
    for batch in batches:
        parts = [np.bincount(of, ratio.value[buckets], n) for n, of, buckets in grams(batch.column(2))]
        weight = np.concatenate([np.zeros(0), *parts])
        u = ((batch.column(1).to_numpy().view(U) >> U(12)).astype(float) + 0.5) / (1 << 52)
        key = weight - np.log(-np.log(u))
        bits = (key + 0.0).view(np.int64)
        order = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(key), pa.array(order)], ["row", "log_weight", "gumbel_key", "order"])


def top_k(keyed: DataFrame, k: int, key: str) -> DataFrame:
    """Rows with the ``k`` largest 64-bit keys; rows equal to the last are all kept."""
    prefix, rest = 0, k
    if k <= 0:
        return keyed.where(F.lit(False))
    for level in range(LEVELS):
        shift = 64 - (level + 1) * LEVEL_BITS
        inside = keyed if not level else keyed.where(F.shiftright(key, shift + LEVEL_BITS) == prefix)
        counts = inside.groupBy(F.shiftright(key, shift).alias("b")).agg(F.count("*").alias("n"))
        found = None
        for r in sorted(counts.collect(), key=lambda r: -r["b"]):  # 2^16 buckets at most
            if r["n"] >= rest:
                found = r["b"]
                break
            rest -= r["n"]
        if found is None:
            return keyed
        prefix = found
    return keyed.where(F.col(key) >= prefix)


def resample(docs: DataFrame, ratio: np.ndarray, k: int, text: str = "text", doc_id: str = "doc_id", seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """A sample of ``k`` rows of ``docs``, its columns ``keep`` (all if None), with
    ``log_weight`` and ``gumbel_key``.

    Columns of these names are replaced, all others may have any name; those kept are
    written once, so keep the text only if it is wanted. Null or empty text weighs 0. Noise is a hash of
    identifier and text, so reruns agree and equal rows are taken together; rows that tie
    with the k-th are kept. If there are no more than ``k`` rows all stay; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(ratio)  # BUCKETS numbers
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("log_weight", "gumbel_key")]
    cols = docs.select(packed(kept), F.xxhash64(F.lit(seed), column(doc_id), column(text)).alias("hash"), column(text).alias("text"))
    weighed = cols.mapInArrow(partial(_weigh_batches, ratio=sent), extended(cols.schema.fields[:1], "log_weight double, gumbel_key double, order long"))
    found = top_k(Scratch(spark, "resample").table(weighed, "weighed"), k, "order")
    return found.select(*unpacked(kept), "log_weight", "gumbel_key")
