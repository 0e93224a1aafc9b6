"""Jaccard join of word-shingle sets: size-banded tiles with hashed bitmap signatures.

Each distinct set is one node. Its candidates are found by the rarest shingles of its set:
a prefix, in one order for all sets, that two sets over the threshold must share an
element of. Passages that many documents hold are common, so they come last and seldom
meet. The nodes of a prefix shingle, in the order of their sizes, are compared by hashed
bitmaps: the bits that differ bound the overlap from above. A shingle with many nodes is
cut into size bands and blocks, and a tile compares two blocks. Tiles return links that
connect what may be linked, not all pairs; an exact intersection of the sorted arrays
decides on each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecframe.llm import textscan as ts
from codecframe.llm.graph import components
from codecframe.llm.rows import extended, with_matches
from codecframe.llm.store import Scratch

U = np.uint64
#: Ratio of a band's upper to its lower size.
RATIO = 1.3
#: Bytes of sets that a block may hold, and its most and least documents.
BLOCK_BYTES, BLOCK_MOST, BLOCK_LEAST = 24_000_000, 4096, 16
LARGEST_SET = 1 << 40
#: Bits of a posting's bitmap at most, and of one that is made of a set in a tile.
POSTING_BITS, TILE_BITS = 512, 1 << 15
#: Links of a star that is verified at a time.
STAR = 64
#: A shingle of so many nodes has all its pairs compared; one of more is a tile. The second
#: number is for pairs with a set too large for a bitmap in its postings.
SMALL, LOOSE = 8, 256
#: How many times longer the bitmaps are that candidates are compared by again.
FINER = 4
#: Buckets of the shingle frequencies, which order shingles from rare to common.
SKETCH_BITS = 18
#: A shingle is hot if its bucket has more documents than HOT and HOT_RATIO times the mean.
HOT, HOT_RATIO = 4096, 8


def band_edges(percent: int) -> np.ndarray:
    """Lower sizes of the bands; linked sets are in the same or in neighbouring bands."""
    ratio, edges = max(RATIO, 104 / percent), [1]
    while edges[-1] < LARGEST_SET:
        edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] * ratio))))
    return np.array(edges, np.int64)


def sketch_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Documents of each bucket of shingles, summed over a task."""
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for s in shingle_sets(batch.column(0), k):
            np.add.at(total, (s >> U(64 - SKETCH_BITS)).astype(np.int64), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])


def shingle_sketch(rows: DataFrame, k: int) -> np.ndarray:
    """Frequencies of shingle buckets over all texts: a fixed number of sums is collected."""
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    sums = rows.select("text").mapInArrow(partial(sketch_batches, k=k), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = sums.toArrow()
    out[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return out


def set_digest(mixed: np.ndarray) -> int:
    """Signed 64-bit identity of a set, from its mixed elements."""
    return int(ts.mix(np.array([mixed.sum(dtype=U) + U(len(mixed))], U)).view(np.int64)[0])


def signature(s: np.ndarray, percent: int, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set's prefix, and the bucket frequencies of the prefix.

    Of n elements, the prefix is the n - ceil(n * percent / 100) + 1 rarest. All sets are ordered alike, by bucket frequency, then hash. Linked sets share at least
    ceil(n * percent / 100) elements of either, so the first that they share is in both prefixes.
    """
    size = len(s) - -(-len(s) * percent // 100) + 1
    often = sketch[(s >> U(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((s, often))[:size]
    return s[order].view(np.int64), often[order]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, _, data, off in ts.slices(texts):
        yield from ts.shingles(*ts.word_hashes(data, off), k)


def most_different(upper: int, percent: int) -> int:
    """Elements in which two linked sets may differ, the smaller one of at most ``upper``.

    They share ``percent / (100 + percent)`` of their sizes' sum, which is at most
    ``upper * (100 + percent) / percent``.
    """
    return (100 - percent) * upper // percent


def bitmap(s: np.ndarray, percent: int, most: int, times: int = 1) -> np.ndarray:
    """Parities of the elements that fall on each hashed bit, as 64-bit words.

    Bits that differ between two sets are at most the elements that do. The length is the
    least power of two at which sets without common elements differ in more bits (by 2.5
    standard deviations) than linked sets of this size may, or ``times`` that; none where
    the former is over ``most``.
    """
    least, bits = most_different(len(s), percent), 64
    while bits / 2 - 1.25 * bits**0.5 <= least and bits <= most:
        bits *= 2
    if bits > most:
        return np.zeros(0, U)
    bits = min(bits * times, most)
    odd = np.bincount(((s >> U(5)) & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(U)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ in rows of bitmaps; the longer rows are folded to the shorter."""
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    if not a.shape[1]:
        return np.zeros(max(len(a), len(b)), np.int64)
    b = np.bitwise_xor.reduce(b.reshape(len(b), -1, a.shape[1]), 1)
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class Bitmaps:
    """A column of bitmaps."""

    def __init__(self, column: pa.Array):
        self.offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 8 if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2]
        self.words = np.frombuffer(data, U, int(self.offs[-1])) if data is not None and self.offs[-1] else np.zeros(0, U)
        self.wide = np.diff(self.offs)

    def row(self, i: int) -> np.ndarray:
        return self.words[self.offs[i] : self.offs[i + 1]]

    def differ(self, i: np.ndarray, other: Bitmaps, j: np.ndarray) -> np.ndarray:
        """Bits that differ between rows ``i`` and the other's rows ``j``."""
        out = np.zeros(len(i), np.int64)
        for a, b in {*zip(self.wide[i].tolist(), other.wide[j].tolist(), strict=True)}:
            of = (self.wide[i] == a) & (other.wide[j] == b)
            x, y = self.offs[i[of]][:, None] + np.arange(a), other.offs[j[of]][:, None] + np.arange(b)
            out[of] = differing(self.words[x], other.words[y])
        return out


def may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in so many elements at least can be linked."""
    return (n + m - differ) * (100 + percent) >= 2 * percent * (n + m)


def sign_batches(batches: Iterator[pa.RecordBatch], k: int, percent: int, sketch: object, most: int) -> Iterator[pa.RecordBatch]:
    """(identifier, text) to (doc_id, n, node, sigs, hot, bits, fine); a set's first row in the
    task has its prefix and bitmaps. A hot shingle's bucket has more than ``most`` documents."""
    seen, none = set(), np.zeros(0, np.int64)
    for batch in batches:
        for i, j, data, off in ts.slices(batch.column(1)):
            size, node, sigs, hot, bits, fine = [], [], [none], [np.zeros(0, bool)], [], []
            for s in ts.shingles(*ts.word_hashes(data, off), k):
                d = set_digest(ts.mix(s)) if len(s) else 0
                h, often = (none, none) if d in seen or not len(s) else signature(s, percent, sketch.value)
                size.append(len(s))
                node.append(d)
                sigs.append(h)
                hot.append(often > most)
                bits.append(bitmap(s, percent, POSTING_BITS).tobytes() if len(h) else b"")
                fine.append(bitmap(s, percent, TILE_BITS, FINER).tobytes() if len(h) else None)
                seen.add(d)
            offs = pa.array(np.cumsum([len(x) for x in sigs]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offs, pa.array(np.concatenate(x))) for x in (sigs, hot)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(node, pa.int64()), *lists, pa.array(bits, pa.binary()), pa.array(fine, pa.binary())], ["doc_id", "n", "node", "sigs", "hot", "bits", "fine"])


FOUND = "u long, v long, skipped boolean, blob long, n long, payload binary"


def _found(links: list[np.ndarray], skipped: list[bool], rest: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links, and the rows of shingles that were too many to hold."""
    names = ["u", "v", "skipped", "blob", "n", "payload"]
    if links:
        uv = np.concatenate(links)
        null = [pa.nulls(len(uv), t) for t in (pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1]), pa.array(np.repeat(skipped, [len(x) for x in links])), *null], names)
    for r in rest:
        yield pa.RecordBatch.from_arrays([r.column(2), pa.nulls(len(r), pa.int64()), pa.nulls(len(r), pa.bool_()), r.column(0), r.column(1), r.column(3)], names)


def meet_batches(batches: Iterator[pa.RecordBatch], percent: int, small: int, loose: int, most: int) -> Iterator[pa.RecordBatch]:
    """(sig, n, node, payload) in this order to the links of each shingle's nodes.

    At most one shingle's rows and a batch are held: those of a shingle with more than
    ``most`` go on as they are.
    """
    held: list[pa.RecordBatch] = []
    over = None  # the shingle whose rows go on
    for batch in batches:
        if not len(batch):
            continue
        sig = batch.column(0).to_numpy()
        if over is not None:
            cut = int(np.searchsorted(sig, over, "right"))
            if cut:
                yield from _found([], [], [batch.slice(0, cut)])
            if cut == len(batch):
                continue
            batch, sig, over = batch.slice(cut), sig[cut:], None
        #: the last shingle may go on in the next batch
        cut = int(np.searchsorted(sig, sig[-1], "left"))
        same = bool(held) and held[-1].column(0)[0].as_py() == sig[-1]
        if not same:
            yield from _found(*_meet(pa.concat_batches([*held, batch.slice(0, cut)]), percent, small, loose), [])
            held = []
            batch = batch.slice(cut)
        held.append(batch)
        if sum(map(len, held)) > most:
            over = sig[-1]
            yield from _found([], [], held)
            held = []
    if held:
        yield from _found(*_meet(pa.concat_batches(held), percent, small, loose), [])


def _meet(rows: pa.RecordBatch, percent: int, small: int, loose: int) -> tuple[list[np.ndarray], list[bool]]:
    """Links of whole shingles, and whether each array of them has others left out."""
    sig, n, node = (rows.column(i).to_numpy() for i in range(3))
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    runs = np.unique(sig[fresh], return_counts=True)[1]
    keep = np.flatnonzero(fresh)[np.repeat(runs > 1, runs)]
    if not len(keep):
        return [], []
    sig, n, node, maps = sig[keep], n[keep], node[keep], Bitmaps(rows.column(3).take(pa.array(keep)))
    run, bare = np.repeat(runs[runs > 1], runs[runs > 1]), maps.wide == 0
    links, skipped = [], []
    for d in range(1, max(small, loose)):
        near = (sig[:-d] == sig[d:]) & (100 * n[:-d] >= percent * n[d:]) & ((run[d:] <= small) | (bare[d:] & (run[d:] <= loose)))
        i = np.flatnonzero(near)
        if not len(i):
            break
        i = i[may_link(n[i], n[i + d], maps.differ(i, maps, i + d), percent)]
        links.append(np.stack([node[i], node[i + d]], 1))
        skipped.append(False)
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    for a in first[run[first] > small].tolist():
        of = [i for i in range(a, a + int(run[a])) if not bare[i] or run[a] > loose]
        found = compare_tile((0, 0, 0, 0, 0), [(0, int(node[i]), int(n[i]), maps.row(i)) for i in of], percent, False)
        if found:
            links.append(np.array(found, np.int64))
            skipped.append(True)
    return links, skipped


def finer_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(u, v, skipped, n, m, bitmap, bitmap) to (u, v, skipped, may)."""
    for batch in batches:
        at = np.arange(len(batch))
        differ = Bitmaps(batch.column(5)).differ(at, Bitmaps(batch.column(6)), at)
        may = may_link(batch.column(3).to_numpy(), batch.column(4).to_numpy(), differ, percent)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(may)], ["u", "v", "skipped", "may"])


def candidates(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (u, v, skipped, may): ``skipped`` if others were left out for them, and whether
    longer bitmaps allow them.

    A shingle's nodes are sorted together, in one shuffle. Hot ones, whose number has no
    bound, and those with more nodes than a block are cut into tiles.
    """
    postings = sets.select("node", "n", F.col("bits").alias("payload"), F.explode(F.arrays_zip("sigs", "hot")).alias("x")).select(F.col("x.sigs").alias("sig"), "n", "node", "payload", F.col("x.hot").alias("hot"))
    cold = postings.where("not hot").select("sig", "n", "node", "payload").repartition("sig").sortWithinPartitions("sig", "n", "node")
    found = scratch.table(cold.mapInArrow(partial(meet_batches, percent=percent, small=SMALL, loose=LOOSE, most=BLOCK_MOST), FOUND), "found")
    many = found.where("blob is not null").select(F.col("u").alias("node"), "blob", "n", "payload")
    hot = postings.where("hot").select("node", F.col("sig").alias("blob"), "n", "payload")
    tiled = scratch.table(hot.unionByName(many), "tiled")
    links = found.where("blob is null").select("u", "v", "skipped")
    if not tiled.isEmpty():
        lower = band_edges(percent)
        band = F.size(F.filter(F.array(*[F.lit(int(e)) for e in lower]), lambda e: e <= F.col("n"))) - 1
        above = F.element_at(F.array(*[F.lit(int(e)) for e in lower[1:]]), F.col("band") + 1)
        banded = tiled.withColumn("band", band.cast("int")).withColumn("up", 100 * F.col("n") >= percent * above)
        tiles = tile_rows(banded, percent, 1, scratch).mapInArrow(partial(compare_batches, percent=percent, exact=False), "u long, v long")
        links = links.union(tiles.withColumn("skipped", F.lit(True)))
    both = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "skipped")
    pairs = scratch.table(both.groupBy("u", "v").agg(F.max("skipped").alias("skipped")), "pairs")
    nodes = sets.where("fine is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("fine").alias("fine"))
    nodes = scratch.table(nodes, "nodes")
    u = nodes.select(F.col("node").alias("u"), "n", F.col("fine").alias("a"))
    v = nodes.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("fine").alias("b"))
    met = pairs.join(u, "u").join(v, "v").select("u", "v", "skipped", "n", "m", "a", "b")
    out = scratch.table(met.mapInArrow(partial(finer_batches, percent=percent), "u long, v long, skipped boolean, may boolean"), "candidates")
    scratch.drop(found, tiled, pairs, nodes)
    return out


def load_batches(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(node, blob, text) to (node, blob, band, up, n, payload): the set's sorted elements.

    Rows whose text is another set go.
    """
    edges, seen = band_edges(percent), set()
    for batch in batches:
        node, blob = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows, size = [], 0
        for i, s in enumerate(shingle_sets(batch.column(2), k)):
            if len(s) and node[i] not in seen and set_digest(ts.mix(s)) == node[i]:
                seen.add(node[i])
                b = int(np.searchsorted(edges, len(s), "right")) - 1
                rows.append((node[i], blob[i], b, 100 * len(s) >= percent * int(edges[b + 1]), len(s), s.tobytes()))
                size += s.nbytes
            if size > 8_000_000:
                yield _loaded(rows)
                rows, size = [], 0
        if rows:
            yield _loaded(rows)


def _loaded(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["node", "blob", "band", "up", "n", "payload"])


def blocks_in_band(m: F.Column, band: F.Column, percent: int, width: int) -> F.Column:
    """Blocks for ``m`` sets of a band, by the bytes of its largest, ``width`` an element."""
    edges = band_edges(percent)
    most = [max(BLOCK_LEAST, min(BLOCK_MOST, BLOCK_BYTES // (width * int(e)))) for e in edges[1:]]
    return F.ceil(m / F.element_at(F.array(*[F.lit(x) for x in most]), band + 1)).cast("int")


def tile_rows(sets: DataFrame, percent: int, width: int, scratch: Scratch) -> DataFrame:
    """Each set once for every tile that it is compared in.

    A tile is two blocks of a band, or one of a band and one of the next; ``side`` tells
    the blocks apart. A blob that fits in one block is one tile of all its bands, so that
    its sets are moved once.
    """
    sizes = scratch.table(sets.groupBy("blob", "band").agg(F.count("*").alias("m")).withColumn("blocks", blocks_in_band(F.col("m"), F.col("band"), percent, width)), "bands")
    upper = F.element_at(F.array(*[F.lit(int(e)) for e in band_edges(percent)[1:]]), F.col("band") + 1)
    blobs = sizes.groupBy("blob").agg(F.sum("m").alias("all"), F.sum(F.col("m") * upper * width).alias("bytes"), F.max("band").alias("top"))
    blobs = scratch.table(blobs.select("blob", "all", "top", ((F.col("all") <= BLOCK_MOST) & (F.col("bytes") <= BLOCK_BYTES)).alias("small")), "blobs")
    near = lambda step, name: sizes.select("blob", (F.col("band") - step).alias("band"), F.col("blocks").alias(name))
    around = scratch.table(sizes.join(near(1, "above"), ["blob", "band"], "left").join(near(-1, "below"), ["blob", "band"], "left").join(blobs, "blob").where("all > 1"), "around")
    s = sets.join(around, ["blob", "band"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.coalesce(n, F.lit(0))), lambda x: x < n)
    tile = lambda low, kind, i, j, side: F.struct(low.alias("low"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    none = F.array().cast("array<struct<low:int,kind:int,i:int,j:int,side:int>>")
    own = F.col("own")
    same = F.transform(upto(F.col("blocks")), lambda x: tile(F.col("band"), 0, F.least(x, own), F.greatest(x, own), own > x))
    above = F.transform(upto(F.col("above")), lambda x: tile(F.col("band"), 1, own, x, F.lit(0)))
    below = F.transform(upto(F.col("below")), lambda x: tile(F.col("band") - 1, 1, x, own, F.lit(1)))
    whole = F.array(tile(F.col("top"), 0, F.lit(0), F.lit(0), F.lit(0)))
    tiles = F.when(F.col("small"), whole).otherwise(F.concat(F.when(F.col("m") > 1, same).otherwise(none), F.when(F.col("above").isNotNull() & F.col("up"), above).otherwise(none), F.when(F.col("below").isNotNull(), below).otherwise(none)))
    out = s.select("node", "blob", "n", "payload", F.explode(tiles).alias("t")).select("blob", "t.*", "node", "n", "payload")
    key = ["blob", "low", "kind", "i", "j"]
    return out.repartition(*key).sortWithinPartitions(*key, "side", "node").select(*key, "side", "node", "n", "payload")


def compare_batches(batches: Iterator[pa.RecordBatch], percent: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """Links of consecutive rows of a tile; one tile is held at a time."""
    key, held = None, []
    links: list[tuple[int, int]] = []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(9)]
        for blob, low, kind, i, j, side, node, n, payload in zip(*cols, strict=True):
            if key != (blob, low, kind, i, j):
                links += compare_tile(key, held, percent, exact)
                key, held = (blob, low, kind, i, j), []
            held.append((side, node, n, np.frombuffer(payload, U)))
        if links:
            yield _links(links)
            links = []
    links += compare_tile(key, held, percent, exact)
    yield _links(links)


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["u", "v"])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact intersection of two sorted sets against the threshold."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def compare_tile(key: tuple | None, rows: list[tuple], percent: int, exact: bool) -> list[tuple[int, int]]:
    """Links that connect all linked sets of a tile, and no more than these need.

    Without ``exact`` the bound of the bitmaps decides, so that links may be too many.
    """
    if len(rows) < 2:
        return []
    _, _, kind, i, j = key
    rows = sorted({(r[0], r[1]): r for r in rows}.values(), key=lambda r: (r[2], r[1]))
    whole = kind == 0 and i == j
    sizes = np.array([r[2] for r in rows])
    maps = [bitmap(r[3], percent, TILE_BITS) for r in rows] if exact else [r[3] for r in rows]
    # the length follows the size; none is a length that is never folded
    long = np.array([len(m) for m in maps])
    first = {w: int(np.flatnonzero(long == w)[0]) for w in set(long.tolist())}
    flat = {w: np.stack([m for m in maps if len(m) == w]) for w in first}
    side = np.array([r[0] for r in rows])
    label, out = np.arange(len(rows)), []
    left, right = (np.arange(len(rows)),) * 2 if whole else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for x in left.tolist():
        low, high = np.searchsorted(sizes[right], [-(-int(sizes[x]) * percent // 100), int(sizes[x]) * 100 // percent + 1])
        y = right[max(low, x + 1) if whole else low : high]
        y = y[label[y] != label[x]]
        if not len(y):
            continue
        differ = np.zeros(len(y), np.int64)
        for w in set(long[y].tolist()):
            of = long[y] == w
            differ[of] = differing(maps[x][None], flat[w][y[of] - first[w]]) if long[x] and w else 0
        for z in y[may_link(sizes[x], sizes[y], differ, percent)].tolist():
            if label[z] != label[x] and (not exact or linked(rows[x][3], rows[z][3], percent)):
                out.append((rows[x][1], rows[z][1]))
                label[label == label[z]] = label[x]
    return out


def verify_batches(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(star, hub, node, skipped, text), hubs first, to (u, v, skipped, ok): whether the texts' sets are linked."""
    star, hub, last = None, None, None
    for batch in batches:
        stars, hubs, nodes, skipped = (batch.column(i).to_pylist() for i in range(4))
        out = []
        for s, key, u, v, skip in zip(shingle_sets(batch.column(4), k), stars, hubs, nodes, skipped, strict=True):
            if set_digest(ts.mix(s)) != v:  # another text of the same identifier
                continue
            if u == v:
                star, hub, last = (key, u), s, None
            elif v != last or star != (key, u):
                out.append((u, v, skip, star == (key, u) and linked(hub, s, percent)))
                last = v
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))], ["u", "v", "skipped", "ok"])


def exact_links(rows: DataFrame, links: DataFrame, ids: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """The links (u, v) that the exact intersection confirms, and those hidden by the others.

    Links meet in stars of about ``STAR`` ends around a hub, whose text is moved with them.
    Where one fails for which others were left out, its whole component is compared again
    in tiles of the sets themselves.
    """
    refused, links = links.where("not may and skipped"), links.where("may").drop("may")
    sizes = links.groupBy("u").agg(F.count("*").alias("ends"))
    part = F.pmod(F.xxhash64("v"), F.ceil(F.col("ends") / STAR))
    ends = scratch.table(links.join(sizes, "u").select(F.xxhash64("u", part).alias("star"), F.col("u").alias("hub"), F.col("v").alias("node"), "skipped"), "ends")
    hubs = ends.select("star", "hub", F.col("hub").alias("node"), F.lit(False).alias("skipped")).distinct()
    stars = scratch.table(ends.union(hubs).join(ids, "node"), "stars")
    texts = with_matches(rows, stars, "doc_id", "member_id", scratch).select("star", "hub", "node", "skipped", "text")
    dealt = texts.repartition("star", "hub").sortWithinPartitions("star", "hub", F.col("node") != F.col("hub"), "node")
    told = dealt.mapInArrow(partial(verify_batches, k=k, percent=percent), "u long, v long, skipped boolean, ok boolean")
    told = scratch.table(told.unionByName(refused.select("u", "v", "skipped", F.col("may").alias("ok"))), "verified")
    scratch.drop(ends, stars)
    good, failed = told.where("ok").select("u", "v"), told.where("skipped and not ok")
    if failed.isEmpty():
        return good
    groups = components(told, scratch)
    # written, so that a small one is sent out and the groups, of which one may be large, are not dealt by label
    wrong = scratch.table(groups.join(failed.select(F.col("u").alias("node")), "node").select("label").distinct(), "wrong")
    again = scratch.table(groups.join(wrong, "label", "left_semi").join(ids, "node").select("node", F.col("label").alias("blob"), "member_id"), "again")
    texts = with_matches(rows, again, "doc_id", "member_id", scratch).select("node", "blob", "text")
    loaded = scratch.table(texts.mapInArrow(partial(load_batches, k=k, percent=percent), "node long, blob long, band int, up boolean, n long, payload binary"), "loaded")
    more = tile_rows(loaded, percent, 8, scratch).mapInArrow(partial(compare_batches, percent=percent, exact=True), "u long, v long")
    return good.union(more)


def near_components(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: ``doc_id``, ``n_shingles`` and ``component_id``.

    Documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct
    ``k``-word shingles (a text of fewer words is one shingle); ``component_id`` is the
    smallest identifier reachable by links, itself included. A text without words, or
    null, has an empty set and links with nothing. Rows that repeat an identifier with
    the same text are one node; a document without identifier never names a component
    that has another; extra columns are ignored; an empty table gives an empty result.
    """
    sets, names = _named(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), k, percent)
    return _with_names(sets, names).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _with_names(sets: DataFrame, names: DataFrame) -> DataFrame:
    out = sets.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(names.select("node", "component_id"), "node", "left")
    return out.select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))


def _named(rows: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """A row's set, and for the nodes in components of several rows: ``label``, and the
    component's smallest identifier with the first node of that."""
    scratch = Scratch(rows.sparkSession, "jaccard")
    name = rows.schema["doc_id"]
    sketch = rows.sparkSession.sparkContext.broadcast(shingle_sketch(rows, k))  # 2^SKETCH_BITS numbers
    signed = rows.mapInArrow(partial(sign_batches, k=k, percent=percent, sketch=sketch, most=HOT + HOT_RATIO * int(sketch.value.mean())), extended([name], "n long, node long, sigs array<long>, hot array<boolean>, bits binary, fine binary"))
    signed = scratch.table(signed, "signed")
    sets = scratch.table(signed.select("doc_id", "n", "node"), "sets")
    links = candidates(signed, percent, scratch)
    scratch.drop(signed)
    classes = scratch.table(sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "classes")
    good = exact_links(rows, links, classes.select("node", F.col("first_id").alias("member_id")), k, percent, scratch)
    connected = components(good, scratch)
    groups = scratch.table(classes.join(connected, "node", "left").withColumn("label", F.coalesce("label", "node")), "groups")
    first = F.struct(F.col("first_id").isNull(), "first_id", "node")
    named = groups.join(groups.groupBy("label").agg(F.min("first_id").alias("component_id"), F.min_by("node", first).alias("first_node"), F.sum("copies").alias("all")), "label")
    names = scratch.table(named.where(F.col("all") > 1).select("node", "label", "component_id", "first_node"), "names")
    scratch.keep(sets, names)
    return sets, names


def node_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Replace the text, the last column, by its set's node; null for an empty set."""
    for batch in batches:
        nodes = [set_digest(ts.mix(s)) if len(s) else None for s in shingle_sets(batch.column(batch.num_columns - 1), k)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(nodes, pa.int64())], [*batch.schema.names[:-1], "node"])


def first_documents(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row, all columns, of each component of ``near_components``: that of the smallest
    identifier.

    Of rows that repeat this identifier, with equal or linked texts, the one with the
    first set and then the first as JSON stays; of rows without identifier the same, if
    no row of the component has one. An identifier that repeats in several components is
    judged in each. Texts without words are each a component, so all of their rows stay.
    """
    sets, names = _named(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), k, percent)
    repeated = sets.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("repeated_id"))
    repeated = Scratch(docs.sparkSession, "jaccard").table(repeated, "repeated")
    first = _with_names(sets, names).where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("first_id")).distinct()
    first = first.join(repeated, F.col("first_id").eqNullSafe(F.col("repeated_id")), "left_anti")
    out = docs.join(first, F.col(doc_id).eqNullSafe(F.col("first_id")), "left_semi")
    if repeated.isEmpty():
        return out
    of = docs.join(repeated, F.col(doc_id).eqNullSafe(F.col("repeated_id")), "left_semi")
    row = of.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = row.mapInArrow(partial(node_batches, k=k), f"row {row.schema['row'].dataType.simpleString()}, id {row.schema['id'].dataType.simpleString()}, node long")
    rows = rows.join(names, "node", "left")
    alone = rows.where("label is null").select("row.*")
    chosen = rows.where("label is not null and node = first_node and id <=> component_id")
    chosen = chosen.groupBy("label").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return out.unionAll(alone).unionAll(chosen)
