"""Benchmark decontamination by spaced seeds.

Fixed masks ignore some positions, so that a seed survives substitutions there. The masks
of a window length reach every window that agrees enough: whatever positions differ, some
mask at some offset in the window ignores them all. Seeds of test pieces and of documents are joined inside the scan of
the documents: the test side goes out in blocks of bounded size, one scan a block, and no
document is shuffled. Each hit names a diagonal, on which the tokens around it are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecframe.llm import textscan as ts
from codecframe.llm.rows import column, extended, packed, place, unpacked
from codecframe.llm.store import Scratch

U = np.uint64
#: Masks by tokens of the window; "1" positions are hashed. Windows of 1 to 4 tokens must
#: agree whole. The masks of 5 to 9 tokens stand
#: one substitution anywhere, those of 10 to 13 two, as many as ``AGREE`` accepts.
MASKS = {
    **{n: ("1" * n,) for n in range(1, 5)},
    5: ("1111", "10111", "11011", "11101"),
    6: ("11111", "101111", "110111", "111011", "111101"),
    7: ("11111", "110111", "1111001"),
    8: ("111111", "11011011", "1110111"),
    9: ("11011111", "110111101", "111100111", "101111011"),
    10: ("1110111", "1011111", "1100101011", "111001011", "11111001"),
    11: ("101001111", "11101101", "1100110011", "11010111"),
    12: ("1110010111", "111100111", "11010101011", "1011010111", "11111101"),
    13: ("1111101011", "110111111", "111001100111", "11010111011", "101110010111"),
}
#: Tokens of a verified window, and the share of them that must agree.
WINDOW, AGREE = 13, 0.8
#: Code points of scripts without spaces, each a token: South East Asian scripts, kana, Han.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x312F), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
#: Code points of their punctuation, read as space.
POINTS = ((0x3000, 0x3004), (0x3008, 0x301F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
#: Tokens of a piece of a test text, those that neighbouring pieces share, and of a block.
PIECE, OVERLAP, BLOCK_TOKENS = 4096, 64, 2_000_000
#: Seed matches expanded at a time.
EXPAND = 1 << 20

_table = np.arange(256, dtype=np.uint8)
_table[65:91] += 32
_table[[c for c in range(128) if not chr(c).isalnum()]] = 32
_weights = ts.mix(np.arange(1, WINDOW + 1, dtype=U) * U(ts.BASE)) | U(1)


def _within(points: np.ndarray, ranges: tuple) -> np.ndarray:
    out = np.zeros(len(points), bool)
    for low, high in ranges:
        out |= (points >= low) & (points <= high)
    return out


def spaced(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 texts with a space on both sides of characters of unspaced scripts, and for
    their punctuation."""
    lead = np.flatnonzero(data >= 0xE0)
    if not len(lead):
        return data, off
    width = np.where(data[lead] >= 0xF0, 4, 3)
    wide = data[np.minimum(lead[:, None] + np.arange(4), len(data) - 1)].astype(np.int64) & 63
    points = np.where(width == 3, (wide[:, 0] & 15) << 12 | wide[:, 1] << 6 | wide[:, 2], (wide[:, 0] & 7) << 18 | wide[:, 1] << 12 | wide[:, 2] << 6 | wide[:, 3])
    blank, alone = _within(points, POINTS), _within(points, UNSPACED)
    if blank.any():
        data = data.copy()
        at = lead[blank]
        data[at] = data[at + 1] = data[at + 2] = 32
    if not alone.any():
        return data, off
    # before each character, and after it unless another one follows
    first, last = lead[alone], (lead + width)[alone]
    cut = np.union1d(first, last[last < len(data)])
    return np.insert(data, cut, 32), off + np.searchsorted(cut, off)


def token_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's token hashes: A-Z lower-cased, ASCII punctuation read as space, each
    character of an unspaced script a token."""
    for _, _, data, off in ts.slices(texts):
        h, first = ts.word_hashes(*spaced(_table[data], off))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield h[a:b]


def seeds(h: np.ndarray, window: int, mask: int) -> np.ndarray:
    """Seed of a mask of the window length at every position."""
    bits = MASKS[window][mask]
    n = len(h) - len(bits) + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, U(mask + 1 + 64 * window), U)
    for p, bit in enumerate(bits):
        if bit == "1":
            out += h[p : p + n] * _weights[p]
    return ts.mix(out)


def piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Test texts to (item, tokens) pieces of bounded length that overlap."""
    for batch in batches:
        ids, toks = [], []
        for i, h in zip(batch.column(0).to_pylist(), token_hashes(batch.column(1)), strict=True):
            for at in range(0, max(1, len(h) - OVERLAP), PIECE - OVERLAP):
                if len(h):
                    ids.append(i)
                    toks.append(h[at : at + PIECE].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(toks, pa.list_(pa.int64()))], ["item", "tokens"])


class Index:
    """Seeds of one block of pieces, sorted, with a bitmap in front."""

    def __init__(self, pieces: list[tuple]):
        self.items = [p[0] for p in pieces]
        self.tokens = [np.array(p[1], np.int64).view(U) for p in pieces]
        self.windows = sorted({min(WINDOW, len(t)) for t in self.tokens})
        keys, piece, offset = [], [], []
        for i, t in enumerate(self.tokens):
            w = min(WINDOW, len(t))
            for m in range(len(MASKS[w])):
                s = seeds(t, w, m)
                keys.append(s)
                piece.append(np.full(len(s), i, np.int32))
                offset.append(np.arange(len(s), dtype=np.int32))
        key = np.concatenate(keys) if keys else np.zeros(0, U)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.piece = np.concatenate(piece)[order] if keys else np.zeros(0, np.int32)
        self.offset = np.concatenate(offset)[order] if keys else np.zeros(0, np.int32)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.key >> U(42)).astype(np.int64)] = True

    def diagonals(self, h: np.ndarray) -> Iterator[tuple[int, int]]:
        """(piece, document position of its first token) of all seed hits, once each."""
        seen: set[tuple[int, int]] = set()
        for w in self.windows:
            for m in range(len(MASKS[w])):
                s = seeds(h, w, m)
                at = np.flatnonzero(self.bits[(s >> U(42)).astype(np.int64)])
                if not len(at):
                    continue
                low, high = np.searchsorted(self.key, s[at]), np.searchsorted(self.key, s[at], "right")
                at, low, n = at[high > low], low[high > low], (high - low)[high > low]
                ends = np.cumsum(n)
                for start in range(0, int(ends[-1]) if len(ends) else 0, EXPAND):
                    flat = np.arange(start, min(start + EXPAND, int(ends[-1])))
                    row = np.searchsorted(ends, flat, "right")
                    k = low[row] + flat - (ends[row] - n[row])
                    pairs = np.unique(np.stack([self.piece[k], at[row] - self.offset[k]], 1), axis=0)
                    for pair in map(tuple, pairs.tolist()):
                        if pair not in seen:
                            seen.add(pair)
                            yield pair

    def verify(self, h: np.ndarray, piece: int, diag: int) -> tuple[int, int] | None:
        """Position and agreeing tokens of the best window on a diagonal, if enough agree."""
        t = self.tokens[piece]
        a, b = max(0, diag), min(len(h), diag + len(t))
        w = min(WINDOW, len(t))
        if b - a < w:
            return None
        run = np.concatenate(([0], np.cumsum(h[a:b] == t[a - diag : b - diag])))
        got = run[w:] - run[:-w]
        best = int(got.argmax())
        return (a + best, int(got[best])) if got[best] >= AGREE * w else None

    def search(self, h: np.ndarray) -> dict:
        """Item to its best (agreeing tokens, position in the document)."""
        out: dict = {}
        for piece, diag in self.diagonals(h):
            found = self.verify(h, piece, diag)
            if found:
                item, new = self.items[piece], (found[1], -found[0])
                out[item] = max(out.get(item, new), new)
        return out

    def hit(self, h: np.ndarray) -> bool:
        return any(self.verify(h, *d) for d in self.diagonals(h))


def _overlap_batches(batches: Iterator[pa.RecordBatch], index: object, item_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, item, n, -at) for i, h in enumerate(token_hashes(batch.column(1))) for item, (n, at) in index.value.search(h).items()]
        at = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), pa.array([r[1] for r in rows], item_type), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
            ["doc_id", "item_id", "n_agree", "doc_token"],
        )


def _clean_batches(batches: Iterator[pa.RecordBatch], index: object, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = pa.array([not index.value.hit(h) for h in token_hashes(batch.column(0).field(at))], pa.bool_())
        yield batch.filter(keep)


def indexes(tests: DataFrame, text: str, item_id: str) -> Iterator[object]:
    """Broadcast seed indexes of blocks of the test texts, each of bounded size.

    Pieces of at most ``PIECE`` tokens are dealt to blocks by hash; a block holds about
    ``BLOCK_TOKENS``, whatever the size of the test side.
    """
    spark = tests.sparkSession
    rows = tests.select(column(item_id).alias("item"), column(text).alias("text")).where("text is not null")
    pieces = rows.mapInArrow(piece_batches, extended(rows.schema.fields[:1], "tokens array<long>")).distinct()
    pieces = Scratch(spark, "decontam").table(pieces, "pieces")
    total = pieces.agg(F.sum(F.size("tokens"))).first()[0] or 0
    blocks = -(-total // BLOCK_TOKENS)
    block = F.pmod(F.xxhash64("item", "tokens"), F.lit(max(blocks, 1)))
    for b in range(blocks):
        got = pieces.where(block == b).collect()  # about BLOCK_TOKENS tokens
        if got:
            yield spark.sparkContext.broadcast(Index([(r["item"], r["tokens"]) for r in sorted(got, key=lambda r: (r["item"] is None, r["item"] or 0, r["tokens"]))]))


def overlaps(docs: DataFrame, tests: DataFrame, text: str = "text", doc_id: str = "doc_id", test_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row for each document and test text that share a window: ``doc_id``,
    ``item_id``, ``n_agree`` (tokens of the best window) and ``doc_token`` (its place).

    A window is ``WINDOW`` aligned tokens (all, if the test text has fewer), of which
    ``AGREE`` agree; every such window is found. So a test text of 1 to 4 tokens matches
    wherever all of it stands. Null texts and those without tokens match nothing; repeated rows give repeated results; repeated test texts each
    match; extra columns are ignored; an empty table on either side gives no rows.
    """
    rows = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    item = tests.select(column(item_id).alias("item_id"))
    schema = extended([rows.schema["doc_id"], item.schema["item_id"]], "n_agree long, doc_token long")
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(item.schema["item_id"].dataType)
    out = None
    for index in indexes(tests, test_text, item_id):
        found = rows.mapInArrow(partial(_overlap_batches, index=index, item_type=arrow), schema)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, tests: DataFrame, text: str = "text", test_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of ``docs``, all columns, that share no window with any test text.

    Null and empty texts stay. See ``overlaps`` for the rule. Each text goes to Python
    once, inside its row.
    """
    out, at = docs.select(packed(docs.columns)), place(docs.columns, text)
    for index in indexes(tests, test_text, item_id):
        out = out.mapInArrow(partial(_clean_batches, index=index, at=at), out.schema)
    return out.select(*unpacked(docs.columns))
