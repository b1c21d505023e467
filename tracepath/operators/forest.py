"""Forests as tables: what is above a node, and where its subtree lies.

A forest is rows of key columns (one or more trees have a key), node and parent (null: a root). Nothing walks a tree: pointers
double until they stop, so a chain of n nodes takes the logarithm of n rounds, each a join of the pointers that
still move with all pointers. Rounds are cut, and what a round replaced is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracepath.plans.session import cut, forget, keep, narrow

NODE = ("trace_id",)


def nearest_marked(nodes: DataFrame, key: tuple[str, ...] = NODE) -> DataFrame:
    """key, node, found, depth for nodes with a boolean ``marked``: the nearest marked one among a node, its parent, its parent's
    parent and so on, and how many steps up it is. Nodes with none above have null twice. A parent that has no row ends the walk, and
    so does a cycle."""
    ends = F.col("marked") | F.col("parent").isNull()
    pointers = cut(nodes.select(*key, "node", F.when(ends, F.col("node")).otherwise(F.col("parent")).alias("at"), F.when(ends, 0).otherwise(1).cast("long").alias("depth"), ends.alias("stopped"), (ends & F.col("marked")).alias("hit")))
    most = pointers.count().bit_length()
    for _ in range(most + 1):
        moving = pointers.where("NOT stopped")
        if moving.isEmpty():
            break
        beyond = pointers.select(*key, F.col("node").alias("at"), F.col("at").alias("further"), F.col("depth").alias("more"), F.col("stopped").alias("stops"), F.col("hit").alias("hits"))
        moved = moving.join(beyond, [*key, "at"], "left").select(
            *key, "node", F.coalesce("further", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("stops", F.lit(True)).alias("stopped"), F.coalesce("hits", F.lit(False)).alias("hit")
        )
        both = cut(narrow(pointers.where("stopped").unionByName(moved)))
        forget(pointers)
        pointers = both
    hit = F.col("stopped") & F.col("hit")
    return pointers.select(*key, "node", F.when(hit, F.col("at")).alias("found"), F.when(hit, F.col("depth")).alias("depth"))


def runs(starts: DataFrame, pointers: DataFrame, key: tuple[str, ...] = NODE) -> DataFrame:
    """key, first, k, node: the nodes from each start (key, first) on along pointers (key, node, next) that have no cycle. What is
    written of a run doubles in each round; runs that nobody asks for are not written."""
    found = cut(starts.select(*key, "first", F.lit(0).cast("long").alias("k"), F.col("first").alias("node")).distinct())
    jump, length = cut(pointers.where("next IS NOT NULL").select(*key, "node", "next")), 1
    while True:
        more = cut(found.join(jump, [*key, "node"]).select(*key, "first", (F.col("k") + length).alias("k"), F.col("next").alias("node")))
        if more.isEmpty():
            return found
        both = cut(narrow(found.unionByName(more)))
        further = cut(jump.join(jump.select(*key, F.col("node").alias("next"), F.col("next").alias("after")), [*key, "next"]).select(*key, "node", F.col("after").alias("next")))
        for old in (found, more, jump):
            forget(old)
        found, jump, length = both, further, 2 * length


def every_run(pointers: DataFrame, *more: str) -> DataFrame:
    """first, k, node, and the columns in ``more`` of that node: the run from every node on along pointers (node, next, more) that have
    no cycle. Only runs from nodes that another points to are put together by doubling, a row each, which is less than what they are
    written out as; what nothing points to takes that of its next, and nothing is dealt once it is written out. A next that has no row is not written."""
    all_ = keep(pointers.select("node", "next", *more))
    step = F.struct("node", *more)
    called = all_.where("next IS NOT NULL").select(F.col("next").alias("node")).distinct()
    state = keep(all_.join(called, "node", "left_semi").select("node", F.col("next").alias("at"), F.array(step).alias("run")))
    while not state.where("at IS NOT NULL").isEmpty():
        beyond = state.select(F.col("node").alias("at"), F.col("at").alias("further"), F.col("run").alias("on"))
        longer = F.when(F.col("on").isNull(), F.col("run")).otherwise(F.concat("run", "on"))
        both = keep(state.join(beyond, "at", "left").select("node", F.col("further").alias("at"), longer.alias("run")))
        forget(state)
        state = both
    runs_ = all_.join(state.select(F.col("node").alias("next"), "run"), "next", "left")
    whole = F.when(F.col("run").isNull(), F.array(step)).otherwise(F.concat(F.array(step), F.col("run")))
    out = runs_.select(F.col("node").alias("first"), F.posexplode(whole).alias("k", "x"))
    return out.select("first", F.col("k").cast("long").alias("k"), "x.node", *[f"x.{c}" for c in more])


def tour(nodes: DataFrame, key: tuple[str, ...], opened: str) -> DataFrame:
    """Adds ``open`` and ``close``: the node's place, from 0, among its key's nodes by ``opened``, and the last place in its subtree. A
    parent comes before its children there, and a subtree's nodes are together, as blocks are in the order of their opening."""
    placed = cut(nodes.withColumn("open", (F.row_number().over(Window.partitionBy(*key).orderBy(opened)) - 1).cast("long")))
    last = placed.where("parent IS NOT NULL").groupBy(*key, F.col("parent").alias("node")).agg(F.max_by("node", "open").alias("last"))
    down = placed.select(*key, "node").join(last, [*key, "node"], "left").select(*key, "node", F.col("last").alias("parent"), F.col("last").isNull().alias("marked"))
    leaf = nearest_marked(down, key).select(*key, "node", F.col("found").alias("leaf"))
    close = leaf.join(placed.select(*key, F.col("node").alias("leaf"), F.col("open").alias("close")), [*key, "leaf"]).select(*key, "node", "close")
    return placed.join(close, [*key, "node"])


def running(toured: DataFrame, key: tuple[str, ...], **counted: Column) -> DataFrame:
    """Adds to toured nodes, for each name, how many of the node and the nodes above it are as the condition says: +1 where a node
    opens, -1 behind its close, summed up along the key."""
    opens = toured.select(*key, "node", F.col("open").alias("at"), F.lit(0).alias("side"), *[c.cast("long").alias(k) for k, c in counted.items()])
    closes = toured.select(*key, F.lit(None).cast(toured.schema["node"].dataType).alias("node"), F.col("close").alias("at"), F.lit(1).alias("side"), *[(-c.cast("long")).alias(k) for k, c in counted.items()])
    w = Window.partitionBy(*key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    sums = opens.unionByName(closes).select(*key, "node", "side", *[F.sum(k).over(w).alias(k) for k in counted]).where("side = 0").drop("side")
    return toured.join(sums, [*key, "node"])
