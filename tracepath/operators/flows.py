"""Dependencies: flow points bound to activities, edges, and the links among them that a chain may use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracepath.functions import columns as C
from tracepath.operators.tracks import TRACK


def next_after(points: DataFrame, activities: DataFrame) -> DataFrame:
    """Adds ``bound`` to points (track, ``at``, ``point_id``): the first trusted, observed activity of the track that starts
    at that moment or later. A forward as-of join as one window over the union of both."""
    a = activities.where("confidence > 0 AND NOT inferred").select(*TRACK, F.col("start").alias("at"), F.lit(1).alias("side"), (-F.col("end")).alias("wide"), F.col("activity_id"), F.lit(None).cast("long").alias("point_id"))
    p = points.select(*TRACK, "at", F.lit(0).alias("side"), F.lit(None).cast("long").alias("wide"), F.lit(None).cast("long").alias("activity_id"), "point_id")
    w = Window.partitionBy(*TRACK).orderBy("at", "side", "wide", "activity_id").rowsBetween(0, Window.unboundedFollowing)
    both = a.unionByName(p).withColumn("bound", F.first("activity_id", ignorenulls=True).over(w))
    return points.join(both.where("side = 0").select("trace_id", "point_id", "bound"), ["trace_id", "point_id"], "left")


def enclosing(points: DataFrame, activities: DataFrame) -> DataFrame:
    """Adds ``bound`` to points: the last activity in track order, trusted and observed, with start <= at <= end. The
    activities are walked along the track with those still open on a stack, so crossing slices are found too."""
    from collections.abc import Iterator

    import pyarrow as pa

    a = activities.where("confidence > 0 AND NOT inferred").select(*TRACK, F.col("start").alias("at"), F.lit(0).alias("side"), F.col("end"), F.col("activity_id").alias("key"))
    p = points.select(*TRACK, "at", F.lit(1).alias("side"), F.col("at").alias("end"), F.col("point_id").alias("key"))
    rows = a.union(p).repartition(*TRACK).sortWithinPartitions(*TRACK, "at", "side", F.desc("end"), "key")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, open_ = None, []
        for batch in batches:
            traces, keys, bound = [], [], []
            for trace, pid, tid, at, side, end, key in zip(*(c.to_pylist() for c in batch.columns)):
                if (trace, pid, tid) != track:
                    track, open_ = (trace, pid, tid), []
                if side == 0:
                    while open_ and open_[-1][0] < at:  # ends before all that comes; what is below may yet hold
                        open_.pop()
                    open_.append((end, key))
                else:
                    while open_ and open_[-1][0] < at:
                        open_.pop()
                    traces.append(trace)
                    keys.append(key)
                    bound.append(open_[-1][1] if open_ else None)
            yield pa.RecordBatch.from_arrays([pa.array(traces, pa.string()), pa.array(keys, pa.int64()), pa.array(bound, pa.int64())], ["trace_id", "point_id", "bound"])

    return points.join(rows.mapInArrow(walk, "trace_id string, point_id long, bound long"), ["trace_id", "point_id"], "left")


def flow_edges(bound: DataFrame) -> DataFrame:
    """Consecutive bound points of one flow are an edge; a point bound to nothing takes no part."""
    w = Window.partitionBy("trace_id", "flow_id").orderBy("at", "point_id")
    pairs = bound.where("bound IS NOT NULL").select("trace_id", F.col("bound").alias("from_id"), F.lead("bound").over(w).alias("to_id"))
    return pairs.where("to_id IS NOT NULL AND from_id <> to_id").select("trace_id", "from_id", "to_id", F.lit("flow").alias("kind")).distinct()


def all_edges(flow: DataFrame, serial: DataFrame) -> DataFrame:
    """One edge for each pair: a stated flow stands before order on a track."""
    return flow.unionByName(serial).groupBy("trace_id", "from_id", "to_id").agg(F.min("kind").alias("kind"))


def usable_edges(edges: DataFrame, activities: DataFrame) -> DataFrame:
    """Edges between two deciding activities of which neither holds the other, with ``forward``: the first starts no
    later than the second. Edges that aren't forward are contradictions."""
    a = activities.where(C.decides()).select("trace_id", F.col("activity_id").alias("from_id"), F.col("start").alias("from_start"), F.col("end").alias("from_end"))
    b = activities.where(C.decides()).select("trace_id", F.col("activity_id").alias("to_id"), F.col("start").alias("to_start"), F.col("end").alias("to_end"))
    e = edges.where("from_id <> to_id").join(a, ["trace_id", "from_id"]).join(b, ["trace_id", "to_id"])
    e = e.where(~C.nested(F.col("from_start"), F.col("from_end"), F.col("to_start"), F.col("to_end")))
    return e.select("trace_id", "from_id", "to_id", "kind", (F.col("from_start") <= F.col("to_start")).alias("forward"), C.wait_between(F.col("from_end"), F.col("to_start")).alias("wait"))


def links(edges: DataFrame, activities: DataFrame) -> DataFrame:
    return usable_edges(edges, activities).where("forward").drop("forward")


def contradictions(edges: DataFrame, activities: DataFrame) -> DataFrame:
    """trace_id, contradicted: how many usable edges run against time."""
    return usable_edges(edges, activities).groupBy("trace_id").agg(F.count_if(~F.col("forward")).alias("contradicted"))
