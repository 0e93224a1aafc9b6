"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document gets a fixed pseudo-random 60-bit key. For each source the sizes are
summed by the key's first 15 bits; the bucket in which the running sum crosses the
source's budget, a 2^15th of its keys, is then summed by key. Documents below the
threshold are taken once more than those above. Nothing is sorted but bucket sums, in
ranges of buckets: a window has at most 2^15 ranges of a source, and of the buckets of a
range 2^8, of its keys a 2^30th of the source's. No document is moved between tasks to be
chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codecframe.llm.rows import column, packed, unpacked
from codecframe.llm.store import Scratch

#: A word is a run of characters other than ASCII white space.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
WEIGHTS = (3, 1, 2)
#: Of each level the key's bits left after it, and the bits of a range's buckets, whose sums are summed in turn.
LEVELS = ((45, 8), (0, 30))
KEY_BITS = 60


def word_count(text: Column) -> Column:
    """Number of words; null text has none.

    Each word becomes one character: ``regexp_count`` makes an array of all words of a
    text and several objects a word.
    """
    return F.coalesce(F.length(F.ltrim(F.regexp_replace(text, WORD, "x"), F.lit(SPACE))), F.lit(0)).cast("long")


def mixing_key(doc_id: Column, text: Column) -> Column:
    """60 pseudo-random bits of the identifier, or of the text where the identifier is null."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def ranked_sources(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """Sources with their place by code point, null last; a range sort, no single task."""
    part = scratch.table(
        sizes.groupBy("mix_source")
        .agg(F.sum("mix_size").alias("source_size"))
        .repartitionByRange(F.col("mix_source").isNull(), F.col("mix_source"))
        .withColumn("part", F.spark_partition_id()),
        "sources",
    )
    before, offsets = 0, []
    for r in part.groupBy("part").count().orderBy("part").collect():  # one row a partition
        offsets.append((r["part"], before))
        before += r["count"]
    if not offsets:
        return part.withColumn("place", F.lit(0).cast("long"))
    start = F.create_map(*[F.lit(x) for pair in offsets for x in pair])
    order = W.partitionBy("part").orderBy(F.col("mix_source").isNull(), "mix_source")
    return part.withColumn("place", F.element_at(start, F.col("part")) + F.row_number().over(order) - 1)


def with_targets(sources: DataFrame, share: float, most: int, weights: tuple[int, ...]) -> DataFrame:
    """Deal ``share`` of all words by weight; a target stops at ``most`` times its source.

    Each round deals what the stopped sources leave to the others, until none is above;
    stopped sources stay so, so the rounds end. A round is one aggregate over the sources.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("cap", (F.col("source_size") * most).cast("double"))
    total = float(s.agg(F.sum("source_size")).first()[0] or 0)
    rate = -1.0
    while True:
        stopped = F.col("weight") * F.lit(rate) > F.col("cap") if rate >= 0 else F.lit(False)
        capped, open_weight = s.agg(
            F.coalesce(F.sum(F.when(stopped, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0))
        ).first()
        new = (share * total - capped) / open_weight if open_weight else rate
        if new <= rate:
            break
        rate = new
    return s.withColumn("target", F.least(F.col("weight") * F.lit(max(rate, 0.0)), F.col("cap"))).select("mix_source", "source_size", "target")


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Documents with how many words of each the mix takes.

    Adds ``size`` (words), ``source_size``, ``target`` (of the source) and ``taken`` (0,
    ``size`` or more whole repeats) to the columns of ``docs``; columns of these names are
    replaced, all others may have any name. Null text has size 0; a null source is a source, last in order; documents
    without identifier are told apart by their text; equal rows are taken alike, as one
    key; an empty table gives an empty result. A source's taken words differ from its
    target by less than the size of one key's documents. Reruns agree: the key is a hash.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "mix")
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    keyed = docs.select(packed(kept), column(source).alias("mix_source"), word_count(column(text)).alias("mix_size"), mixing_key(column(doc_id), column(text)).alias("mix_key"))
    sizes = scratch.table(keyed.select("mix_source", "mix_size", "mix_key"), "sizes")
    plan = scratch.table(
        with_targets(ranked_sources(sizes, scratch), share, most, weights)
        .withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long")),
        "plan",
    )
    above = KEY_BITS
    for left, wide in LEVELS:
        plan, above = refine(sizes, plan, above, left, wide, scratch), left
    plan = plan.withColumnRenamed("mix_source", "plan_source")
    out = keyed.join(plan, F.col("mix_source").eqNullSafe(F.col("plan_source")), "left")
    extra = F.when(F.col("mix_key") < F.col("prefix"), 1).otherwise(0)
    taken = (F.col("mix_size") * (F.col("rounds") + extra)).cast("long")
    return out.select(*unpacked(kept), F.col("mix_size").alias("size"), "source_size", "target", taken.alias("taken"))


def refine(sizes: DataFrame, plan: DataFrame, above: int, left: int, wide: int, scratch: Scratch) -> DataFrame:
    """Narrow each source's threshold from the bits before the last ``above`` to those before the last ``left``.

    ``prefix`` is the boundary bucket and ``rest`` the words still to take inside it;
    ``wide`` is the bits of a range's buckets. The last level, with no bits left, rounds
    to the nearer key boundary and returns the threshold itself.
    """
    p = plan.select(F.col("mix_source").alias("p_source"), "prefix", "rest")
    inside = sizes.join(p, F.col("mix_source").eqNullSafe(F.col("p_source")) & (F.shiftright("mix_key", above) == F.col("prefix")))
    sums = inside.groupBy("mix_source", "rest", F.shiftright("mix_key", left).alias("bucket")).agg(F.sum("mix_size").alias("words"))
    sums = scratch.table(sums.withColumn("range", F.shiftright("bucket", wide)), f"sums{left}")
    before = W.partitionBy("mix_source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = sums.groupBy("mix_source", "range").agg(F.sum("words").alias("words"))
    ranges = ranges.select(F.col("mix_source").alias("r_source"), F.col("range").alias("r_range"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("mix_source", "range").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    run = sums.withColumn("upto", F.sum("words").over(within)).join(ranges, F.col("mix_source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
    run = run.withColumn("upto", F.col("upto") + F.col("base"))
    #: The boundary bucket is the first whose running sum passes the budget.
    passed = F.col("upto") > F.col("rest")
    step = run.groupBy("mix_source").agg(
        F.min_by("bucket", F.when(passed, F.col("bucket"))).alias("bucket"),
        F.min_by(F.col("rest") - (F.col("upto") - F.col("words")), F.when(passed, F.col("bucket"))).alias("left_over"),
        F.min_by("words", F.when(passed, F.col("bucket"))).alias("words"),
        F.max("bucket").alias("last"),
    )
    if left:
        nxt, rest = F.coalesce("bucket", F.col("last")), F.coalesce("left_over", F.lit(float("inf")))
    else:
        nxt, rest = F.when(F.col("bucket").isNull(), F.col("last") + 1).when(F.col("left_over") * 2 >= F.col("words"), F.col("bucket") + 1).otherwise(F.col("bucket")), F.lit(0.0)
    step = step.select(F.col("mix_source").alias("s_source"), nxt.alias("prefix"), rest.alias("rest"))
    kept = plan.drop("prefix", "rest")
    out = kept.join(step, F.col("mix_source").eqNullSafe(F.col("s_source")), "left").drop("s_source")
    return scratch.table(out, f"level{left}")
