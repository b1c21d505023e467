"""Which spans overlap which, by a tree of halves over each group's time.

Time is cut into 2**16 buckets a group, and buckets into blocks of 1, 2, 4, ... of them. A span is put at the few blocks that make it up (two a
level at most), a moment at the one block of each level that holds it. Two spans overlap if one starts inside the other: each moment
lies in one block of a span, so a pair meets once, and a long span has at most 32 rows, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 16
BLOCK = "array<struct<level:int,block:bigint>>"


def blocks_of(low: Column, high: Column) -> Column:
    """The blocks that make up the buckets from low to high."""
    start = F.struct(low.alias("l"), (high + 1).alias("r"), F.array().cast(BLOCK).alias("found"))

    def level(acc: Column, n: Column) -> Column:
        live = acc["l"] < acc["r"]
        left, right = live & (acc["l"] % 2 == 1), live & (acc["r"] % 2 == 1)

        def one(taken: Column, block: Column) -> Column:
            return F.when(taken, F.array(F.struct(n.cast("int").alias("level"), block.alias("block")))).otherwise(F.array().cast(BLOCK))

        found = F.concat(acc["found"], one(left, acc["l"]), one(right, acc["r"] - 1))
        half = F.floor((acc["l"] + left.cast("long")) / 2).cast("long"), F.floor((acc["r"] - right.cast("long")) / 2).cast("long")
        return F.struct(half[0].alias("l"), half[1].alias("r"), found.alias("found"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, level)["found"]


def blocks_with(bucket: Column) -> Column:
    """The block of each level that holds a bucket."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda n: F.struct(n.cast("int").alias("level"), F.floor(bucket / F.pow(F.lit(2.0), n)).cast("long").alias("block")))


def overlapping(a: DataFrame, b: DataFrame, group: str = "trace_id") -> DataFrame:
    """Pairs of spans of a and b (both: group, start, end and columns of their own, spans being of positive length and half open) that overlap, with all
    columns; those of b that a has too get the suffix _b."""
    same = {"start": "start_b", "end": "end_b"}
    b = b.withColumnsRenamed(same)
    both = a.select(group, "start", "end").union(b.select(group, "start_b", "end_b"))
    scale = both.groupBy(group).agg(F.min("start").alias("_base"), F.greatest(F.lit(1), F.ceil((F.max("end") - F.min("start") + 1) / (1 << LEVELS))).cast("long").alias("_width"))

    def bucket(at: str) -> Column:
        return F.floor((F.col(at) - F.col("_base")) / F.col("_width")).cast("long")

    def at_blocks(df: DataFrame, blocks: Column) -> DataFrame:
        return df.join(scale, group).withColumn("_at", F.explode(blocks)).select(*df.columns, F.col("_at.level").alias("_level"), F.col("_at.block").alias("_block"))

    meet = [group, "_level", "_block"]
    starts_in_a = at_blocks(a, blocks_of(bucket("start"), bucket("end"))).join(at_blocks(b, blocks_with(bucket("start_b"))), meet).where("start_b > start AND start_b < `end`")
    starts_in_b = at_blocks(a, blocks_with(bucket("start"))).join(at_blocks(b, blocks_of(bucket("start_b"), bucket("end_b"))), meet).where("start >= start_b AND start < end_b")
    return starts_in_a.unionByName(starts_in_b).drop("_level", "_block")
