"""Connected components of an edge table, without bringing edges or labels to the driver.

Tasks first bring the edges that they hold, a bounded number at a time, to stars about the least nodes, before and after
edges are dealt by their larger node; what crosses tasks is left to rounds over the whole table. Edges that are no more than a task
may hold anyway, from the start or after some rounds, are ended by one task: each round costs the driver some twenty stages of tasks, whose
records it keeps. Each round every node points to the least of itself and its neighbours, pointers are doubled until they end at nodes
that point to themselves, and the edges are contracted to those ends. Doubling takes the logarithm of the longest run of
pointers, and only ends that are the least of their own neighbourhood outlive a round, so few rounds are needed. The
minima are pre-aggregated before the shuffle; in the joins back, nodes that very many rows point to are broadcast, and no
others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracepath.llm.common import cut, let_go, narrow, spread_join


MOST_HELD = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node that isn't the least of its component among these edges: that least node, and the node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        least, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while not np.array_equal(further := new[new], new):
            new = further
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def _as_stars(edges: DataFrame) -> DataFrame:
    """u, v with the same components, by fewer edges; u is less than v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(2)])
            n += batch.num_rows
            if n > MOST_HELD:
                u, v = stars(*map(np.concatenate, zip(*held)))
                held, n = [[u, v]], len(u)
                if n > MOST_HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*map(np.concatenate, zip(*held)))], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def _ended(edges: DataFrame) -> DataFrame:
    """u, p: all nodes of these edges, of which there are at most ``MOST_HELD``, and the least node of their component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[batch.column(i).to_numpy() for i in range(2)] for batch in batches]
        if held:
            least, node = stars(*map(np.concatenate, zip(*held)))
            own = np.unique(least)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(own, node)), pa.array(np.append(own, least))], ["u", "p"])

    return edges.coalesce(1).mapInArrow(run, "u long, p long")


def _follow(parent: DataFrame) -> DataFrame:
    """u, p with p replaced by the end of its run of pointers; ends point to themselves."""
    while True:
        up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        further = cut(spread_join(parent, up, "p").select("u", "p", "pp"))
        parent = further.select("u", F.col("pp").alias("p"))
        if further.where("p <> pp").isEmpty():
            return parent


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node), for nodes that have an edge. Loops and repeated edges do no harm."""
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = cut(_as_stars(_as_stars(e).repartition("v")))
    labels = None
    while n := e.count():
        let_go(e.sparkSession)
        few = n <= MOST_HELD
        if few:
            parent = cut(_ended(e))
        else:
            both = e.union(e.select("v", "u"))
            parent = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
            parent = _follow(cut(parent))
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            step = parent.select(F.col("u").alias("component"), "p")
            rest = labels.select("component").distinct().join(step, "component", "left_anti")
            step = cut(narrow(step.union(rest.select("component", F.col("component").alias("p")))))
            labels = cut(spread_join(labels, step, "component").select("node", F.col("p").alias("component")))
        if few:
            break
        e = spread_join(e, parent, "u").select(F.col("p").alias("pu"), "v")
        e = spread_join(e, parent.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        e = cut(e.where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
    if labels is None:
        labels = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
