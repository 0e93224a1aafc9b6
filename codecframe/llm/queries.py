"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecframe.llm import chat, decontam, fingerprint, jaccard, langid, lattice, linededup, mixing, resample, warc

#: Where the public tokenizers are; a parameter of the operators.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, with the passages."""
    return decontam.overlaps(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op2_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of all documents, learnt from those of the other folds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", langid.fold(F.col("doc_id"), 7) == 2)
    return lattice.score(docs, ~F.col("held_out"), PIECES, keep=["doc_id", "held_out"])


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.compare_neighbours(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of all documents in the likeness of those labelled good and not toxic.

    It is as large a share of the documents as these are of the labelled ones.
    """
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    wanted = (F.col("quality") == 1) & (F.col("toxic") == 0)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ratio = resample.fit(docs, resample.rows_of(docs, labels.where(wanted)))
    good, n = labels.agg(F.count_if(wanted), F.count("*")).first()
    k = round(docs.count() * good / n) if n else 0
    return resample.resample(docs, ratio, k, keep=["doc_id"])


def op6_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records of all pages, written as chunks and read back."""
    return warc.archive_and_read(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and roles of all conversations, read from transcripts cut at any line.

    Some turns have no marker, and half of the conversations no blank line between turns.
    One row for each turn, or part of one, found in a piece: ``n_lines`` from ``line`` on,
    how many of these have the true role, whether the first truly opens a turn, and how
    many true openings among the others were missed.
    """
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    gap = F.when(F.pmod(F.xxhash64(F.lit(1), "conv_id"), F.lit(2)) == 0, "\n").otherwise("")
    rows = rows.withColumn("text", F.concat(chat.mark(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")), gap))
    held_out = langid.fold(F.col("conv_id"), 4) == 2
    model = chat.fit(rows.where(~held_out))
    out = chat.parse(chat.transcripts(rows), model, turn="piece", keep=["conv_id", "piece", "truth"]).select("conv_id", "piece", "truth", F.explode("turns").alias("t"))
    of = F.slice("truth", (F.col("t.line") + 1).cast("int"), F.col("t.n_lines").cast("int"))
    place = F.array_position(F.array(*map(F.lit, chat.ROLES)), F.col("t.role")) - 1
    return out.withColumns({"held_out": held_out, "of": of, "place": place}).select(
        "conv_id", "piece", "t.line", "t.n_lines", "held_out", F.col("t.role").alias("role_pred"), "t.opens",
        (F.col("of")[0] % 2 == 0).alias("opens_true"),
        F.size(F.filter("of", lambda x: F.floor(x / 2) == F.col("place"))).cast("long").alias("lines_right"),
        (F.size(F.filter("of", lambda x: x % 2 == 0)) - (F.col("of")[0] % 2 == 0).cast("int")).cast("long").alias("openings_missed"),
        F.sha2(chat.render(F.array("t")).cast("binary"), 256).alias("rendered_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from those of the other folds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.fold(F.col("doc_id"), 4) == 2)
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, keep=["doc_id", "held_out"])


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by three-word shingles at 90 %."""
    return jaccard.near_components(read(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=90)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents: kept text as a digest."""
    out = linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents at 150 % of their words."""
    out = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""

OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.line, k.pos, s.owner IS NOT NULL AND s.owner <> k.doc_id AS dropped
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         (source_size * 2)::DOUBLE AS cap FROM s
), o AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM w
), r AS (
  SELECT coalesce(arg_min(rate, cap / weight) FILTER (WHERE weight * rate <= cap), max(rate)) AS rate FROM o
), t AS (
  SELECT w.source, w.source_size, least(w.weight * r.rate, w.cap) AS target,
         CASE WHEN source_size > 0 THEN floor(least(w.weight * r.rate, w.cap) / source_size) ELSE 0 END AS rounds
  FROM w, r
), k AS (
  SELECT source, key, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY key) AS upto FROM d GROUP BY source, key
), x AS (
  SELECT k.source, k.key, t.source_size, t.target, t.rounds,
         CASE WHEN k.upto <= t.target - t.rounds * t.source_size THEN 1
              WHEN k.upto - k.words <= t.target - t.rounds * t.source_size
                   AND (t.target - t.rounds * t.source_size - (k.upto - k.words)) * 2 >= k.words THEN 1
              ELSE 0 END AS extra
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT d.doc_id, d.size, x.source_size, x.target, (d.size * (x.rounds + x.extra))::BIGINT AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.key = x.key
"""


def queries() -> dict:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_lattice_score": op2_lattice_score,
        "op3_fingerprint": op3_fingerprint,
        "op5_resample": op5_resample,
        "op6_warc_chunks": op6_warc_chunks,
        "op4_language_id": op4_language_id,
        "op7_line_dedup": op7_line_dedup,
        "op8_chat_turns": op8_chat_turns,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_source_mix": op10_source_mix,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_warc_chunks": OP6_SQL, "op7_line_dedup": OP7_SQL, "op10_source_mix": OP10_SQL}
