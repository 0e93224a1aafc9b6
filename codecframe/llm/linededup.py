"""Line dedup: drop lines that many documents hold (DataFrame functions only).

Lines are exploded as 128-bit hashes of their normalised form; documents are counted per
hash; the positions to drop go back to their document, whose other lines are joined again
in order. Only hashes are grouped, so a line that a third of all documents hold is summed
before it is shuffled, and its postings are split between tasks by the skew join.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecframe.llm.rows import column, packed, unpacked
from codecframe.llm.store import Scratch

#: ASCII white space, stripped at both ends of a line.
SPACE = " \t\n\x0b\f\r"
LINES = "ln_lines"


def normalised(line: Column) -> Column:
    """A line's key: ASCII white space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def hashed_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """One row for each line whose key has ``min_chars`` code points: k1, k2, ln_doc, ln_row, pos."""
    lines = rows.select("ln_doc", "ln_row", F.posexplode(F.split("ln_text", "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("key", normalised(F.col("line"))).where(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"), "ln_doc", "ln_row", "pos")


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Hashes that at least ``min_docs`` documents hold, with the smallest of these.

    For two documents the smallest and the largest identifier tell; more are counted
    distinct. Documents without identifier count as one, after all others.
    """
    by = lines.groupBy("k1", "k2")
    nameless = F.max(F.col("ln_doc").isNull().cast("int"))
    if min_docs <= 2:
        g = by.agg(F.min("ln_doc").alias("owner"), F.max("ln_doc").alias("other"), nameless.alias("nameless"))
        many = F.lit(True) if min_docs < 2 else (F.col("owner") != F.col("other")) | (F.col("owner").isNotNull() & (F.col("nameless") == 1))
    else:
        g = by.agg(F.min("ln_doc").alias("owner"), F.count_distinct("ln_doc").alias("n"), nameless.alias("nameless"))
        many = F.col("n") + F.col("nameless") >= min_docs
    return g.where(many).select("k1", "k2", "owner")


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 10, min_docs: int = 2, keep_first: bool = True) -> DataFrame:
    """Documents without the lines that at least ``min_docs`` documents hold.

    Adds ``kept_text``, ``n_lines`` (before dropping) and ``n_dropped`` to the columns of
    ``docs``; columns of these names are replaced, all others may have any name. A shared key of at least ``min_chars``
    code points loses all its lines, except in the smallest identifier that holds it
    (``keep_first``). Null or empty text is one empty line; shorter keys stay; rows that
    repeat an identifier are one document, each row with its own lines; a document
    without identifier comes after all others; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    kept = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    body = F.coalesce(column(text), F.lit(""))
    rows = docs.select(column(doc_id).alias("ln_doc"), body.alias("ln_text"), F.xxhash64(body).alias("ln_row"))
    shared = scratch.table(shared_lines(hashed_lines(rows, min_chars), min_docs), "shared")
    hits = hashed_lines(rows, min_chars).join(shared, ["k1", "k2"])
    if keep_first:
        hits = hits.where(~F.col("ln_doc").eqNullSafe(F.col("owner")))
    drops = hits.groupBy("ln_doc", "ln_row").agg(F.collect_set("pos").alias("drop_pos")).select(F.col("ln_doc").alias("d_doc"), F.col("ln_row").alias("d_row"), "drop_pos")
    keyed = docs.select(packed(docs.columns), column(doc_id).alias("ln_doc"), F.xxhash64(body).alias("ln_row"))
    out = keyed.join(drops, F.col("ln_doc").eqNullSafe(F.col("d_doc")) & (F.col("ln_row") == F.col("d_row")), "left")
    body = F.coalesce(F.col("row").getField(text), F.lit(""))
    lines = F.split(body, "\n", -1)
    # array_except hashes, and an array is read by index in constant time: linear in the lines
    places = F.array_except(F.sequence(F.lit(0), F.size(LINES) - 1), F.col("drop_pos"))
    left = F.array_join(F.transform(places, lambda i: F.col(LINES)[i]), "\n")
    out = out.select("row", "drop_pos", body.alias("body"), lines.alias(LINES))
    return out.select(
        *unpacked(kept),
        F.when(F.col("drop_pos").isNull(), F.col("body")).otherwise(left).alias("kept_text"),
        F.size(LINES).cast("long").alias("n_lines"),
        F.when(F.col("drop_pos").isNull(), 0).otherwise(F.size("drop_pos")).cast("long").alias("n_dropped"),
    )
