"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed
character n-grams, trained by follow-the-regularised-leader with elastic-net penalties
and calibrated by a temperature.

Document frequencies cover all training documents; the weights are fitted on a bounded,
documented sample of them (``per_language``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecframe.llm.rows import column, extended, packed, place, unpacked

#: Hash buckets of the n-grams, and the orders counted.
BUCKET_BITS, ORDERS = 16, (1, 2, 3)
BUCKETS = 1 << BUCKET_BITS
#: Code points counted at a time, so that a long text needs no more memory.
BLOCK = 1 << 18
UND = "und"

_fold = np.arange(128, dtype=np.uint32)
_fold[[c for c in range(128) if not chr(c).isalpha()]] = 32
_odd = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the text's lower-cased character n-grams."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), BLOCK):
        block = text[max(0, at - len(ORDERS) + 1) : at + BLOCK]  # n-grams across blocks, too
        cp = np.frombuffer(block.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        cp = np.where(cp < 128, _fold[np.minimum(cp, 127)], cp)
        h = np.zeros(len(cp), np.uint32)
        for n in ORDERS:
            if len(cp) < n:
                break
            h = h[: len(cp) - n + 1] * np.uint32(31) + cp[n - 1 :] * _odd[n - 1]
            key = h ^ (h >> np.uint32(15))
            total += np.bincount((key * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)
    hit = np.flatnonzero(total)
    return hit, total[hit]


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their length-normalised TF-IDF, and the bias last."""
    at, count = gram_counts(text)
    v = np.log1p(count) * idf[at]
    norm = np.sqrt((v * v).sum()) or 1.0
    return np.append(at, BUCKETS), np.append(v / norm, 1.0)


@dataclass
class Model:
    """Languages, document-frequency weights, class weights and temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; ``und`` and 0 without letters or model."""
        if not self.languages or not has_letter(text):
            return UND, 0.0
        at, v = features(text, self.idf)
        p = softmax(v @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4) -> np.ndarray:
    """Weights (features by classes) by proximal follow-the-regularised-leader."""
    z = np.zeros((BUCKETS + 1, classes))
    n = np.zeros_like(z)
    for _ in range(epochs):
        for at, v, y in rows:
            w = _leader(z[at], n[at], alpha, beta, l1, l2)
            p = softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return _leader(z, n, alpha, beta, l1, l2)


def _leader(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature of least negative log likelihood, by golden section on its logarithm."""
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    low, high, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _df_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, docs = np.zeros(BUCKETS + 1, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            df[gram_counts(text.as_py())[0]] += 1
            docs += 1
    df[BUCKETS] = docs
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["bucket", "df"])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [gram_counts(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0].tolist() for x in found], pa.list_(pa.int32())), pa.array([x[1].tolist() for x in found], pa.list_(pa.int32()))], ["h", "lang", "at", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 600, most_languages: int = 256) -> Model:
    """Fit on the rows with text and language.

    Document frequencies are over all of them. The weights are fitted on about
    ``per_language`` distinct texts (whole) of each language, chosen by hash of the text;
    one in five of these sets the temperature. Copies of a text count once in the sample.
    The model's size grows with the languages: more than ``most_languages`` are an error,
    none is left out. Without any row the model answers ``und``.
    """
    rows = docs.select(column(text).alias("text"), column(lang).alias("lang")).where("text is not null and lang is not null")
    h = F.xxhash64(F.lit(11), "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_distinct(h).alias("n")).limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages; raise most_languages, the weights take {8 * (BUCKETS + 1)} bytes a language, several times in fitting")
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS + 1, 0), np.float32), 1.0)
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in rows.select("text").mapInArrow(_df_batches, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():  # BUCKETS + 1 rows at most
        df[r["bucket"]] = r["df"]
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / counts[k])))])
    wanted = rows.where(F.pmod(h, F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    once = wanted.select(h.alias("h"), "lang", "text").groupBy("h", "lang", "text").agg(F.lit(1)).select("h", "lang", "text")
    sample = once.mapInArrow(_count_batches, "h long, lang string, at array<int>, n array<int>").collect()
    data = []
    for r in sorted(sample, key=lambda r: (r["h"], r["lang"])):
        at, v = np.array(r["at"], np.int64), np.log1p(np.array(r["n"], float))
        v *= idf[at]
        data.append((np.append(at, BUCKETS), np.append(v / (np.sqrt((v * v).sum()) or 1.0), 1.0), languages.index(r["lang"])))
    train, held = [x for i, x in enumerate(data) if i % 5], data[::5]
    w = train_ftrl(train or data, len(languages))
    t = fit_temperature(np.stack([v @ w[at] for at, v, _ in held]), np.array([y for *_, y in held])) if held else 1.0
    return Model(languages, idf.astype(np.float32), w.astype(np.float32), t)


def _predict_batches(batches: Iterator[pa.RecordBatch], model: object, at: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [model.value.predict(t.as_py()) for t in (batch.column(1) if at is None else batch.column(0).field(at))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["row", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to the columns ``keep`` (all if None).

    Only the text is an input of the prediction. Null text, or one without a letter, is
    ``und`` with score 0; columns of the two names are replaced; equal texts get equal
    answers; an empty table gives an empty result.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    at = place(kept, text)
    cols = docs.select(packed(kept), *([column(text).alias("text")] if at is None else []))
    return identified(cols, model, at).select(*unpacked(kept), "lang_pred", "score")


def identified(rows: DataFrame, model: Model, at: int | None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to the struct ``row``, whose field ``at`` is the text
    (None: it is the second column); so a text that stays goes to Python once."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # buckets by languages: bounded
    return rows.mapInArrow(partial(_predict_batches, model=sent, at=at), extended(rows.schema.fields[:1], "lang_pred string, score double"))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the identifier as text, modulo ``n``; a null identifier is the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))
