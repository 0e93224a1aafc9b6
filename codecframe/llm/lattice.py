"""Language-model scores: the marginal probability over all segmentations of a text.

Words are lattices over an existing piece vocabulary: each arc is a piece, weighted by its
probability, and a log-space forward recursion sums all paths. Piece weights start from
the vocabulary's own scores and take steps of expectation maximisation over the corpus's
distinct words. A known word is one arc more, weighted by its discounted count in
the corpus; what the discount frees goes to the pieces.

Lattices are arrays: words of like length are laid out together, pieces are found by one
walk of a trie over all positions, and the recursion steps through all words at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecframe.llm import textscan as ts
from codecframe.llm.rows import column, extended, packed, unpacked
from codecframe.llm.store import Scratch

U = np.uint64
#: Words more frequent than one in so many are scored in the scan: so many at most.
FREQUENT = 1 << 17
#: Words that a counting task holds before it sums and passes them on.
HELD = 1 << 19
#: Lattice cells (words by positions by piece lengths) and characters held at a time.
CELLS, CHARS = 1 << 21, 1 << 18
WORD_START = "▁"
#: Ends a word, so that the probabilities of all words sum to one at most. No word holds it.
WORD_END = "\n"
NEVER = float("-inf")
#: Pseudo-counts a piece, dealt by the old weights.
PRIOR = 0.02


class Trie:
    """Piece texts as sorted (node, character) edges; ``piece`` is the piece that ends in a node."""

    def __init__(self, texts: list[str]):
        edges: dict[tuple[int, int], int] = {}
        ends = {}
        for k, text in enumerate(texts):
            node = 0
            for c in text:
                node = edges.setdefault((node, ord(c)), len(edges) + 1)
            ends[node] = k
        order = sorted((n << 21 | c, to) for (n, c), to in edges.items())
        self.key = np.array([k for k, _ in order] or [0], np.int64)
        self.to = np.array([t for _, t in order] or [0], np.int64)
        self.piece = np.full(len(edges) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())
        self.longest = max(map(len, texts), default=1)

    def matches(self, rows: np.ndarray, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, row, start, piece) of the pieces that start in columns ``first`` to ``last``.

        A piece that starts a word is only found in column 0.
        """
        wide = rows.shape[1]
        at = (np.arange(rows.shape[0])[:, None] * wide + np.arange(first, last)).ravel()
        flat, node, end = rows.ravel(), np.zeros(len(at), np.int64), (at // wide + 1) * wide
        keep = (flat[at] != ord(WORD_START)) | (at % wide == 0)
        for n in range(1, self.longest + 1):
            at, node, end = at[keep], node[keep], end[keep]
            if not len(at):
                return
            key = node << 21 | flat[at + n - 1]
            k = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[k] == key
            at, node, end = at[hit], self.to[k[hit]], end[hit]
            found = self.piece[node] >= 0
            yield n, at[found] // wide, at[found] % wide, self.piece[node[found]]
            keep = at + n < end


class Pieces:
    """Vocabulary pieces of a word lattice and their natural log probabilities.

    Pieces that start a word share one distribution; pieces inside it, bytes and the
    word's end another. A character inside a word may also be spelt as its bytes.
    """

    def __init__(self, logp: dict[str, float], byte_logp: list[float], trie: Trie | None = None):
        self.texts, self.logp = list(logp), np.array(list(logp.values()), float)
        self.byte_logp = np.array(byte_logp, float)
        self.trie = trie or Trie(self.texts)
        self.opens = np.array([t.startswith(WORD_START) for t in self.texts], bool)

    def _bytes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct character's uses of the 256 bytes, and where each cell's character is among them."""
        chars, back = np.unique(rows, return_inverse=True)
        uses = np.zeros((len(chars), 256))
        for i, c in enumerate(chars.tolist()):
            for b in (chr(c) if c not in range(0xD800, 0xE000) else "?").encode():
                uses[i, b] += 1
        return uses, back.reshape(rows.shape)

    def _windows(self, rows: np.ndarray) -> Iterator[tuple[int, int]]:
        step = max(1, CELLS // (len(rows) * (self.trie.longest + 1)))
        for a in range(0, rows.shape[1], step):
            yield a, min(a + step, rows.shape[1])

    def forward(self, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log probability of all paths from the start to each position of each word.

        ``rows`` are words as code points, start and end included, padded with 0 beyond
        ``size``; positions beyond it are not used.
        """
        n, wide, longest = *rows.shape, self.trie.longest
        alpha = np.full((n, wide + 1), NEVER)
        alpha[:, 0] = 0.0
        carry = np.full((n, longest + 1, longest + 1), NEVER)
        uses, char = self._bytes(rows)
        spelt = (uses @ self.byte_logp)[char]
        spelt[:, 0] = np.where(size > 0, NEVER, spelt[:, 0])
        spelt[np.arange(n), size - 1] = NEVER
        for a, b in self._windows(rows):
            #: arcs by the position at which they end, from a on, and length; 0 is for bytes
            arcs = np.full((n, b - a + longest + 1, longest + 1), NEVER)
            arcs[:, : longest + 1] = carry
            for length, row, start, piece in self.trie.matches(rows, a, b):
                arcs[row, start - a + length, length] = self.logp[piece]
            arcs[:, 1 : b - a + 1, 0] = spelt[:, a:b]
            for t in range(a + 1, b + 1):
                most = min(t, longest)
                x = arcs[:, t - a, : most + 1]
                x[:, 0] += alpha[:, t - 1]
                x[:, 1:] += alpha[:, t - most : t][:, ::-1]
                top = np.maximum(x.max(1), -1e300)
                alpha[:, t] = top + np.log(np.maximum(np.exp(x - top[:, None]).sum(1), 1e-300))
            carry = arcs[:, b - a :].copy()
        return alpha

    def marginals(self, words: pa.Array) -> np.ndarray:
        """Natural log of the sum over all segmentations, for each word."""
        out = np.zeros(len(words))
        for at, rows, size in layouts(words):
            out[at] = self.forward(rows, size)[np.arange(len(at)), size]
        return out

    def marginal(self, word: str) -> float:
        return float(self.marginals(pa.array([word]))[0])

    def expected(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of each piece and byte in the words, by forward and backward."""
        pieces, spelt_bytes = np.zeros(len(self.texts)), np.zeros(256)
        longest = self.trie.longest
        for _, rows, size in layouts(words):
            n, wide = rows.shape
            alpha = self.forward(rows, size)
            whole = alpha[np.arange(n), size]
            beta = np.full((n, wide + longest + 1), NEVER)
            beta[np.arange(n), size] = 0.0
            uses, char = self._bytes(rows)
            spelt = (uses @ self.byte_logp)[char]
            spelt[:, 0] = NEVER
            spelt[np.arange(n), size - 1] = NEVER
            inside = np.arange(wide)[None] < size[:, None]
            for a, b in reversed(list(self._windows(rows))):
                arcs = np.full((n, b - a, longest + 1), NEVER)
                found = list(self.trie.matches(rows, a, b))
                for length, row, start, piece in found:
                    arcs[row, start - a, length] = self.logp[piece]
                arcs[:, :, 0] = np.where(inside[:, a:b], spelt[:, a:b], NEVER)
                for s in range(b - 1, a - 1, -1):
                    x = arcs[:, s - a]
                    x[:, 0] += beta[:, s + 1]
                    x[:, 1:] += beta[:, s + 1 : s + longest + 1]
                    top = np.maximum(x.max(1), -1e300)
                    got = top + np.log(np.maximum(np.exp(x - top[:, None]).sum(1), 1e-300))
                    beta[:, s] = np.where(s < size, got, beta[:, s])
                for length, row, start, piece in found:
                    p = np.exp(alpha[row, start] + self.logp[piece] + beta[row, start + length] - whole[row])
                    pieces += np.bincount(piece, p, len(pieces))
                p = np.where(inside[:, a:b], np.exp(alpha[:, a:b] + spelt[:, a:b] + beta[:, a + 1 : b + 1] - whole[:, None]), 0.0)
                spelt_bytes += np.bincount(char[:, a:b].ravel(), p.ravel(), len(uses)) @ uses
        return pieces, spelt_bytes

    def refit(self, pieces: np.ndarray, spelt_bytes: np.ndarray) -> Pieces:
        """Pieces weighted by expected counts, smoothed by the old weights."""
        prior = len(self.texts) * PRIOR
        total = {True: pieces[self.opens].sum(), False: pieces[~self.opens].sum() + spelt_bytes.sum()}
        of = np.where(self.opens, total[True], total[False]) + prior
        new = np.log((pieces + prior * np.exp(self.logp)) / of)
        new_bytes = np.log((spelt_bytes + prior * np.exp(self.byte_logp)) / (total[False] + prior))
        return Pieces(dict(zip(self.texts, new.tolist(), strict=True)), new_bytes.tolist(), self.trie)


def layouts(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, code points, sizes) of words of like length, start and end added, padded with 0."""
    whole = b"\n".join(w.as_buffer().to_pybytes() if w.is_valid else b"" for w in words.cast(pa.binary())) + b"\n"
    if not len(words):
        return
    cps = np.frombuffer(whole.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = np.flatnonzero(cps == ord(WORD_END))
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = ends - starts
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        least = int(size[order[i]])
        most = least + least // 4 + 1
        j = min(int(np.searchsorted(size[order], most, "right")), i + max(1, CHARS // (most + 2)))
        at = order[i:j]
        wide = int(size[at[-1]])
        rows = np.zeros((len(at), wide + 2), np.int64)
        col = np.arange(wide)
        inside = col[None] < size[at][:, None]
        rows[:, 0] = ord(WORD_START)
        rows[:, 1:-1][inside] = cps[(starts[at][:, None] + col)[inside]]
        rows[np.arange(len(at)), size[at] + 1] = ord(WORD_END)
        yield at, rows, size[at] + 2
        i = j


def load_pieces(model_file: str) -> Pieces:
    """Pieces of a sentencepiece model. Scores that are ranks are read as Zipf's law.

    The public vocabulary at hand is of merges, whose scores are ranks; a unigram model's
    scores are log probabilities and are taken as they are.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    raw = {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
    ranks = bool(raw) and min(raw.values()) < -1000
    weight = {k: 1 / (3 - s) if ranks else math.exp(s) for k, s in raw.items()}
    weight = {k: w for k, w in weight.items() if WORD_START not in k[1:] and WORD_END not in k}
    weight.setdefault(WORD_START, min(weight.values(), default=1.0))
    #: Of what follows a word's start, a hundredth is the bytes' and a quarter the word's end.
    total = {o: sum(w for k, w in weight.items() if k.startswith(WORD_START) == o) / (1.0 if o else 0.74) for o in (True, False)}
    logp = {k: math.log(w / total[k.startswith(WORD_START)]) for k, w in weight.items()}
    return Pieces(logp | {WORD_END: math.log(0.25)}, [math.log(0.01 / 256)] * 256)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte spans as an Arrow string column."""
    size = ends - starts
    off = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(off[-1]) + np.repeat(starts - off[:-1], size)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data[at])])


def _counted(held: list[tuple]) -> pa.RecordBatch:
    """Sum (hash, word, training count, count) parts by hash."""
    h = np.concatenate([x[0] for x in held]) if held else np.zeros(0, U)
    keys, where, back = np.unique(h, return_index=True, return_inverse=True)
    words = pa.concat_arrays([x[1] for x in held]).take(pa.array(where)) if held else pa.array([], pa.string())
    sums = [np.bincount(back, np.concatenate([x[i] for x in held]), len(keys)).astype(np.int64) if held else np.zeros(0, np.int64) for i in (2, 3)]
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), words, *map(pa.array, sums)], ["h", "word", "c", "n"])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for batch in batches:
        learn = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j, data, off in ts.slices(batch.column(1)):
            low = ts._lower[data]
            starts, ends, first = ts.words(data, off)
            keys, where, back = np.unique(ts.span_hashes(low, starts, ends), return_index=True, return_inverse=True)
            c = np.bincount(back, np.repeat(learn[i:j], np.diff(first)), len(keys))
            held.append((keys, _strings(low, starts[where], ends[where]), c, np.bincount(back, minlength=len(keys))))
            if sum(len(x[0]) for x in held) > HELD:
                yield _counted(held)
                held = []
    yield _counted(held)


def _expected_batches(batches: Iterator[pa.RecordBatch], pieces: object) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(pieces.value.texts) + 256)
    for batch in batches:
        total += np.concatenate(pieces.value.expected(batch.column(0)))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])


def _marginal_batches(batches: Iterator[pa.RecordBatch], pieces: object) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(pieces.value.marginals(batch.column(1)))], ["h", "c", "n", "sub"])


class Frequent:
    """Hashes of the most frequent words with their count and log probability."""

    def __init__(self, rows: pa.Table):
        h = rows["h"].to_numpy().view(U)
        order = np.argsort(h)
        self.h, self.c, self.logp = h[order], rows["c"].to_numpy()[order], rows["logp"].to_numpy()[order]


def _score_batches(batches: Iterator[pa.RecordBatch], frequent: object, n: int, v: int) -> Iterator[pa.RecordBatch]:
    """Adds words, known words, base and score of the frequent ones, and the others' (hash, count)."""
    f = frequent.value
    base = np.log10((f.c + 1) / (n + v + 1))
    for batch in batches:
        for i, j, data, off in ts.slices(batch.column(1)):
            h, first = ts.word_hashes(data, off)
            doc = np.repeat(np.arange(j - i), np.diff(first))
            at = np.minimum(np.searchsorted(f.h, h), max(0, len(f.h) - 1))
            hit = f.h[at] == h if len(f.h) else np.zeros(len(h), bool)
            k, of = at[hit], doc[hit]
            sums = [np.bincount(of, x[k], j - i).astype(float) for x in (f.c > 0, base, f.logp)]
            rare, of = h[~hit].view(np.int64), doc[~hit]
            order = np.lexsort((rare, of))
            rare, of = rare[order], of[order]
            new = np.flatnonzero(np.concatenate((np.ones(min(1, len(of)), bool), (rare[1:] != rare[:-1]) | (of[1:] != of[:-1]))))
            pairs = pa.StructArray.from_arrays([pa.array(rare[new]), pa.array(np.diff(np.append(new, len(of))))], ["h", "times"])
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[new], np.arange(j - i + 1)).astype(np.int32)), pairs)
            cols = [batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), rest]
            yield pa.RecordBatch.from_arrays(cols, ["row", "words", "known", "base", "score", "rest"])


def discounts(of: list[int]) -> list[float]:
    """What a word seen once, twice, or more often is discounted, from how many words are
    seen 1 to 4 times (modified Kneser-Ney's estimate, bounded)."""
    once, twice = of[0], of[1]
    if not once or not twice:
        return [0.5, 0.5, 0.5]
    y = once / (once + 2 * twice)
    raw = [k - (k + 1) * y * of[k] / of[k - 1] if of[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return [min(k - 0.05, max(0.05, d)) for k, d in zip((1, 2, 3), raw, strict=True)]


def score(docs: DataFrame, learn: F.Column, model_file: str, text: str = "text", steps: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Score every row's whole text by a model of the rows for which ``learn`` holds.

    Adds ``n_tokens`` (words and one end), ``n_known``, ``train_tokens``, ``base_score``
    (add-one word unigrams) and ``score``, both log10 probabilities, to the columns ``keep``
    of ``docs`` (all if None); columns of these names are replaced, all others may have any
    name. Null text is empty: only the end; a null ``learn`` is false. Without training rows
    the pieces alone give words their probability. Repeated rows count each; an empty table
    gives an empty result. Words are told apart by a 64-bit hash.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lattice")
    sc = spark.sparkContext
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    rows = docs.select(F.coalesce(learn, F.lit(False)).alias("learn"), column(text).alias("text"))
    words = rows.mapInArrow(_count_batches, "h long, word string, c long, n long").groupBy("h", "word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    words = scratch.table(words, "words")
    ends = rows.where("learn").count()
    stats = words.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum("n"), *[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()
    total, distinct, all_, *few = (int(x or 0) for x in stats)
    off = discounts(few)
    freed = (off[0] * few[0] + off[1] * few[1] + off[2] * (distinct - few[0] - few[1])) / total if total else 1.0
    pieces = load_pieces(model_file)
    for _ in range(steps if total else 0):
        counts = words.where("c > 0").select("word").mapInArrow(partial(_expected_batches, pieces=sc.broadcast(pieces)), "at long, n double")
        got = counts.groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # the vocabulary's size
        uses = np.zeros(len(pieces.texts) + 256)
        uses[got["at"].to_numpy()] = got["n"].to_numpy()
        pieces = pieces.refit(uses[:-256], uses[-256:])
    marginals = words.mapInArrow(partial(_marginal_batches, pieces=sc.broadcast(pieces)), "h long, c long, n long, sub double")
    n, v = total + ends, distinct + (ends > 0)
    log_end, log_word = math.log10((ends + 1) / (n + 2)), math.log10((total + 1) / (n + 2))
    if total:
        less = F.when(F.col("c") == 1, off[0]).when(F.col("c") == 2, off[1]).otherwise(off[2])
        unseen = F.col("sub") / math.log(10) + math.log10(freed)
        logp = F.when(F.col("c") > 0, F.log10((F.col("c") - less) / total + F.exp("sub") * freed)).otherwise(unseen)
    else:
        logp = F.col("sub") / math.log(10)
    table = scratch.table(marginals.select("h", "c", "n", (logp + log_word).alias("logp")), "table")
    often = Frequent(table.where(F.col("n") * FREQUENT > all_).select("h", "c", "logp").toArrow())  # fewer than FREQUENT rows
    cols = docs.select(packed(kept), column(text).alias("text"))
    schema = extended(cols.schema.fields[:1], "words long, known long, base double, score double, rest array<struct<h:long,times:long>>")
    first = cols.mapInArrow(partial(_score_batches, frequent=sc.broadcast(often), n=n, v=v), schema)
    first = scratch.table(first.withColumn("id", F.monotonically_increasing_id()), "first")
    rare = first.select("id", F.explode("rest").alias("x")).select("id", "x.h", "x.times")
    found = rare.join(table, "h").groupBy("id").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1) / float(n + v + 1))).alias("rare_base"),
        F.sum(F.col("times") * F.col("logp")).alias("rare_score"),
    )
    out = first.drop("rest").join(found, "id", "left")
    end_base = math.log10((ends + 1) / (n + v + 1))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        *unpacked(kept),
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + zero("rare_known") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + end_base).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0)) + log_end).alias("score"),
    )
