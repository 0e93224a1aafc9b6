"""The corpus pipeline: language ID, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecframe.llm import decontam, jaccard, langid, linededup, mixing
from codecframe.llm.rows import column, packed, place, unpacked
from codecframe.llm.store import Scratch, swept

#: Predictions below this probability reject a document.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters (null or empty text,
    too), or unsure, go.

    Learnt from the texts with a ``lang`` of three in four documents; equal rows are judged
    alike; without such texts, or of an empty table, nothing stays.
    """
    model = langid.fit(docs.where(langid.fold(F.col("doc_id"), 4) != 2))
    told = langid.identified(docs.select(packed(docs.columns)), model, place(docs.columns, "text"))
    return told.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE)).select(*unpacked(docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of a smaller identifier holds.

    Rows of one identifier are one document; null identifiers come last, as one; null text
    becomes empty. ``n_chars`` follows the text; other columns stay.
    """
    old = {c: f"{c} before" for c in ("kept_text", "n_lines", "n_dropped") if c in docs.columns}
    out = linededup.dedup_lines(docs.withColumnsRenamed(old))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[(new[c] if c in new else column(old.get(c, c))).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, one row of it.

    See ``jaccard.first_documents`` for repeated rows and null identifiers. Texts without
    words are no duplicates: all of their rows stay.
    """
    return jaccard.first_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark.

    Null and empty texts stay; repeated rows are judged alike; without a benchmark all stay.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken.

    Texts without words (null, too) are never taken; a null source is one, the last; equal
    rows are taken alike. Columns of the mix's names are replaced.
    """
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]
#: The stages on hashes, models and masks have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, on the documents of ``sf_dir``."""
    scratch, last = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with swept():
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs
