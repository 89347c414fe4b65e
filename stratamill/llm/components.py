"""Connected components of links that are too many for one machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamill.llm._grams import mixed
from stratamill.llm._shared import checkpointed

#: Links that one task contracts at once.
CHUNK_LINKS = 2_000_000


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Of n nodes the smallest that links u-v reach from each, by steps that halve the paths."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        open_ = np.flatnonzero(a != b)
        if not len(open_):
            return label
        np.minimum.at(label, np.maximum(a[open_], b[open_]), np.minimum(a[open_], b[open_]))
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter


def _contracted(turn: int):
    """From batches of links to node, root and the root's rank, for the components of what one task has at once."""

    def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        rank = mixed(nodes.view(np.uint64) ^ mixed(np.full(1, turn + 1, np.uint64)))
        order = np.argsort(rank)
        place = np.empty(len(nodes), np.int64)
        place[order] = np.arange(len(nodes))
        root = order[roots(place[at[: len(u)]], place[at[len(u) :]], len(nodes))[place]]
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root]), pa.array(rank[root].view(np.int64))], names=["node", "root", "rank"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
            if n > CHUNK_LINKS:
                yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component, its smallest node, for every node of the links; self-links and repeated ones are fine.

    In each round every task contracts the links that it holds, so that a node has one row from each task at most,
    however many links it has. A node's roots of several tasks are then linked with the one of lowest rank, and the next
    round has these links only. Ranks are drawn anew for each round, so about a third of the nodes of any path go.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    first = Window.partitionBy("node").orderBy("rank")
    levels = []
    while not levels or not edges.isEmpty():
        stars = edges.mapInArrow(_contracted(len(levels)), "node long, root long, rank long")
        told = checkpointed(stars.select("node", "root", F.first("root").over(first).alias("label"), F.row_number().over(first).alias("n")))
        levels.append(told.where("n = 1").select("node", "label"))
        edges = told.where("n > 1 and root != label").select(F.col("root").alias("u"), F.col("label").alias("v"))
    labels = levels.pop()
    while levels:
        # a label that has none of its own in the next round is a last one
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("last"))
        labels = levels.pop().join(later, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
