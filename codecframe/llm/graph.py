"""Connected components of large graphs by rounds of contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecframe.llm.store import Scratch

#: Edges that one task connects; more are contracted first.
FEW = 1 << 17


def connect_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (u, v) of a small graph to (node, label): the smallest node connected."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if len(b)]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts, 1), return_inverse=True)
    u, v = at.reshape(2, -1)
    label, last = np.arange(len(nodes)), None
    while not np.array_equal(label, last):
        last, low = label.copy(), np.minimum(label[u], label[v])
        # a root with a smaller neighbour goes there, so that at most half of a component's roots stay
        np.minimum.at(label, last[u], low)
        np.minimum.at(label, last[v], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "label"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, label)`` for each node of the edges ``(u, v)``: equal labels, connected nodes.

    In each round every node points at its smallest neighbour, or itself, and the edges
    move to where their ends point; loops and repeats go. Node identifiers are hashes, so
    the nodes left shrink by a constant factor a round. A hub's edges are reduced before
    they are shuffled, and split between tasks when they are joined. As soon as at most
    ``FEW`` edges are left, one task connects these, in place of rounds of small tables.
    """
    live = scratch.table(edges.select("u", "v").where("u <> v"), "edges")
    labels = None
    while live.count() > FEW:
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = scratch.table(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), "step")
        if labels is None:
            nxt = step.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:
            moved = step.select(F.col("u").alias("label"), "p")
            nxt = labels.join(moved, "label", "left").select("node", F.coalesce("p", "label").alias("label"))
        nxt = scratch.table(nxt, "labels")
        a = live.join(step, "u").select(F.col("p").alias("x"), F.col("v").alias("u"))
        b = a.join(step, "u").select(F.least("x", "p").alias("u"), F.greatest("x", "p").alias("v"))
        rest = scratch.table(b.where("u <> v").distinct(), "edges")
        scratch.drop(live, step, *([labels] if labels is not None else []))
        live, labels = rest, nxt
    out = scratch.table(live.coalesce(1).mapInArrow(connect_batches, "node long, label long"), "connected")
    if labels is not None:
        moved = out.select(F.col("node").alias("label"), F.col("label").alias("p"))
        ends, out = out, scratch.table(labels.join(moved, "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        scratch.drop(ends, labels)
    scratch.drop(live)
    return out
