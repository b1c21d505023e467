"""Blocks of source as tables, and what is done again in a loop though nothing in it changes.

blocks: file_id, node, parent, kind (File, Repeat, Define or Plain), line, end_line, opened (their order); heads: file_id, node,
name (what a block's head mentions); assigned: file_id, line, name; calls: file_id, call_id (their order), within (a block), name,
args (squeezed), line, fresh (its arguments are new values), allocates; mentions: file_id, call_id, name (in its arguments).

A routine written inside another is not part of it: blocks belong to the nearest definition, their ``home``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracepath.plans.session import cut

HOMES = ("Define", "File")
SPOT = "rule string, file_id string, line long, name string"


def block_tree(blocks: DataFrame) -> DataFrame:
    """Adds open, close (a block's place in its file by ``opened``, from 0, and the last place inside it), depth (blocks around it, itself
    included), home, and repeats: how often what stands directly inside is run again within its home, in loops. ``opened`` goes.

    A parent opens before what is inside it, and that stands together; so a file is streamed once in that order through a stack of what is
    open, and a block is told when it closes: a task needs memory for the nesting depth."""
    kept = [f for f in blocks.schema.fields if f.name != "opened"]
    names = [f.name for f in kept]
    file_at, node_at, parent_at, kind_at = map(names.index, ("file_id", "node", "parent", "kind"))
    longs = ("open", "close", "depth", "repeats")
    schema = StructType([*kept, *[StructField(x, LongType()) for x in longs], StructField("home", blocks.schema["node"].dataType)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, place, kinds = None, 0, None
        stack: list[tuple] = []  # row, open, depth, repeats within home, home of what is open
        closed: list[tuple] = []

        def close() -> None:
            row, at, depth, repeats, home = stack.pop()
            closed.append((*row, at, place - 1, depth, repeats, home))

        def out() -> pa.RecordBatch:
            columns = zip(*closed) if closed else [()] * len(kinds)
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)
            closed.clear()
            return batch

        for batch in batches:
            if kinds is None:
                kinds = [*batch.schema.types, *[pa.int64()] * len(longs), batch.schema.types[node_at]]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[file_at] != file:
                    while stack:
                        close()
                    file, place = row[file_at], 0
                while stack and (row[parent_at] is None or stack[-1][0][node_at] != row[parent_at]):
                    close()
                home, repeats = (stack[-1][4], stack[-1][3]) if stack else (None, 0)
                if row[kind_at] in HOMES:
                    home, repeats = row[node_at], 0
                stack.append((row, place, len(stack) + 1, repeats + (row[kind_at] == "Repeat"), home))
                place += 1
            yield out()
        while stack:
            close()
        if closed:
            yield out()

    rows = blocks.where("file_id IS NOT NULL").repartition("file_id").sortWithinPartitions("file_id", "opened").select(*names)
    return cut(rows.mapInArrow(walk, schema))


def subtrees(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """file_id, root, node for roots (file_id, node): the blocks inside a root, itself included, that have the root's home."""
    r = roots.select("file_id", "node").join(tree, ["file_id", "node"]).select("file_id", F.col("node").alias("root"), "home", F.col("open").alias("low"), F.col("close").alias("high"))
    inside = F.col("open").between(F.col("low"), F.col("high"))
    return r.join(tree.select("file_id", "home", "node", "open"), ["file_id", "home"]).where(inside).select("file_id", "root", "node")


def loops_of(tree: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls by each loop that they stand in: call's columns and root, low, high, first, last (of the loop)."""
    loops = tree.where("kind = 'Repeat'").select("file_id", F.col("node").alias("root"), "home", F.col("open").alias("low"), F.col("close").alias("high"), F.col("line").alias("first"), F.col("end_line").alias("last"))
    at = calls.join(tree.select("file_id", F.col("node").alias("within"), "home", F.col("open").alias("at")), ["file_id", "within"])
    return at.join(loops, ["file_id", "home"]).where("at BETWEEN low AND high").drop("at")


def varying_names(tree: DataFrame, heads: DataFrame, assigned: DataFrame) -> DataFrame:
    """file_id, root, name of every loop: what its own head, the heads of loops around it and of loops inside it mention, and what
    is assigned on its lines."""
    loops = tree.where("kind = 'Repeat'").select("file_id", F.col("node").alias("root"), "home", F.col("open").alias("low"), F.col("close").alias("high"), F.col("line").alias("first"), F.col("end_line").alias("last"))
    told = _told(tree, heads).withColumnRenamed("home", "its_home")
    mentioned = loops.join(told, "file_id").where(_varies_by_head()).select("file_id", "root", "name")
    on_lines = loops.join(assigned, "file_id").where("line BETWEEN first AND last").select("file_id", "root", "name")
    return mentioned.union(on_lines).distinct()


def _told(tree: DataFrame, heads: DataFrame) -> DataFrame:
    return heads.join(tree.where("kind = 'Repeat'").select("file_id", "node", "home", F.col("open").alias("its_low"), F.col("close").alias("its_high")), ["file_id", "node"]).select("file_id", "name", "home", "its_low", "its_high")


def _varies_by_head():
    """The head's loop is the loop or around it, wherever that is, or inside it with the same home."""
    around = (F.col("its_low") <= F.col("low")) & (F.col("high") <= F.col("its_high"))
    inside = (F.col("its_home") == F.col("home")) & F.col("its_low").between(F.col("low"), F.col("high"))
    return around | inside


def calls_by_loop(tree: DataFrame, heads: DataFrame, assigned: DataFrame, calls: DataFrame, mentions: DataFrame) -> DataFrame:
    """Each call with each loop around it, and ``depends``: whether a name of the call varies in that loop. Names meet on file and
    name, so what varies in a loop is never put out in full; a call and a loop that no name joins are disjoint."""
    asked = cut(loops_of(tree, calls))
    names = mentions.select("file_id", "call_id", "name").union(calls.select("file_id", "call_id", "name")).distinct()
    by_name = asked.select("file_id", "call_id", "root", "home", "low", "high", "first", "last").join(names, ["file_id", "call_id"])
    told = _told(tree, heads).withColumnRenamed("home", "its_home")
    a, t, s = by_name, told.withColumnsRenamed({"file_id": "f", "name": "n"}), assigned.selectExpr("file_id AS f", "name AS n", "line AS l").distinct()
    same = (F.col("file_id") == F.col("f")) & (F.col("name") == F.col("n"))
    joined = a.join(t, same & _varies_by_head(), "left_semi").unionByName(a.join(s, same & F.col("l").between(F.col("first"), F.col("last")), "left_semi"))
    depends = joined.select("file_id", "call_id", "root").distinct().withColumn("depends", F.lit(True))
    return asked.join(depends, ["file_id", "call_id", "root"], "left").na.fill(False, ["depends"])


def within_loops(judged: DataFrame) -> DataFrame:
    """Spots: a call that no name of a loop reaches is the same in each turn (InvariantCall, or InvariantAllocation if it makes
    something); one that depends on the loop and is given new values has another identity each turn (IdentityChurn)."""
    rule = F.when(F.col("depends"), F.when(F.col("fresh"), "IdentityChurn")).when(F.col("allocates"), "InvariantAllocation").otherwise("InvariantCall")
    return judged.select(rule.alias("rule"), "file_id", "line", "name").where("rule IS NOT NULL").distinct()


def repeated_calls(calls: DataFrame, assigned: DataFrame) -> DataFrame:
    """Spots: the same call in the same block again, if nothing is assigned on lines strictly between it and the first. How many lines
    with an assignment stand before a line numbers the islands between them; two calls of one island have none between."""
    lines = assigned.select("file_id", "line").distinct().select("file_id", "line", F.lit(1).alias("assigns"), *[F.lit(None).cast(calls.schema[c].dataType).alias(c) for c in ("call_id", "within", "name", "args")])
    w = Window.partitionBy("file_id").orderBy("line")
    both = calls.select("file_id", "line", F.lit(0).alias("assigns"), "call_id", "within", "name", "args").unionByName(lines)
    n = both.withColumns({"before": F.coalesce(F.sum("assigns").over(w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)), "upto": F.sum("assigns").over(w.rangeBetween(Window.unboundedPreceding, 0))}).where("assigns = 0")
    first = Window.partitionBy("file_id", "within", "name", "args").orderBy("call_id")
    n = n.withColumns({"nth": F.row_number().over(first), "island": F.first("upto").over(first)})
    return n.where("nth > 1 AND before <= island").select(F.lit("RepeatedCall").alias("rule"), "file_id", "line", "name").distinct()
