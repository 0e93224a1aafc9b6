"""A caller's columns as one struct, so that no name can clash with an operator's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from codecframe.llm.store import Scratch

#: Bits of the bitmap of identifiers, and those of one row of it (Spark's own size).
FILTER_BITS, PAGE_BITS = 1 << 25, 1 << 15


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(names: list[str]) -> Column:
    """The columns ``names`` as a struct called ``row``."""
    return F.struct(*[column(n) for n in names] or [F.lit(0).alias("none")]).alias("row")


def unpacked(names: list[str]) -> list[Column]:
    """The columns that ``packed`` put away."""
    return [F.col("row").getField(n).alias(n) for n in names]


def place(names: list[str], name: str) -> int | None:
    """Where the column ``name`` is among ``names``; as in Spark, case decides only if it must."""
    at = [i for i, n in enumerate(names) if n == name] or [i for i, n in enumerate(names) if n.lower() == name.lower()]
    return at[0] if at else None


def extended(fields: list[StructField], more: str) -> StructType:
    """A schema of ``fields`` and those of a DDL string."""
    return StructType([*fields, *StructType.fromDDL(more).fields])


def with_matches(docs: DataFrame, ids: DataFrame, left: str, right: str, scratch: Scratch) -> DataFrame:
    """Inner join of ``docs`` and the smaller ``ids`` on the columns named; null meets null.

    A bitmap of the identifiers' hashes, of fixed size, is sent out first, so that of
    ``docs`` only rows that it lets through are shuffled, whatever the size of either side.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    page = ids.select(spot(column(right)).alias("at")).groupBy(F.floor(F.col("at") / PAGE_BITS).alias("page"))
    pages = scratch.table(page.agg(F.bitmap_construct_agg(F.col("at") % PAGE_BITS).alias("bits")), "pages")
    met = docs.select(packed(docs.columns), column(left).alias("id")).withColumn("at", spot(F.col("id")))
    met = met.join(F.broadcast(pages), F.floor(F.col("at") / PAGE_BITS) == F.col("page"))  # FILTER_BITS at most
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("at") % PAGE_BITS / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = met.where(F.call_function("shiftright", byte, (F.col("at") % 8).cast("int")).bitwiseAND(1) == 1).select("row", "id")
    # the hint keeps the join after the bitmap's: a small side would be sent out before it
    out = met.join(ids.select(packed(ids.columns).alias("match"), column(right).alias("match_id")).hint("merge"), F.col("id").eqNullSafe(F.col("match_id")))
    return out.select(*unpacked(docs.columns), *[F.col("match").getField(n).alias(n) for n in ids.columns])
