"""What the order of work on one track says: nesting, self time and serial order.

A track is streamed in order (start, widest first, id) through a stack of what is open, so a task needs memory for the
nesting depth and not for the track. One pass yields both notions of a parent and the serial predecessor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracepath.functions import columns as C
from tracepath.operators.scan import scan

TRACK = ("trace_id", "pid", "tid")


def track_window() -> Window:
    return Window.partitionBy(*TRACK).orderBy("start", F.desc("end"), "activity_id")


def track_order(activities: DataFrame) -> DataFrame:
    """Adds ``place``, from 0, and ``furthest``, the running maximum of end."""
    out = scan(activities, TRACK, [F.col("start"), F.desc("end"), F.col("activity_id")], place=("sum", F.lit(1).cast("long")), furthest=("max", F.col("end")))
    return out.withColumn("place", F.col("place") - 1)


SWEPT = "trace_id string, activity_id long, open_parent long, inside long, parent long, serial_from long"


def sweep_tracks(activities: DataFrame) -> DataFrame:
    """For each activity: ``open_parent``, the innermost one still open when it starts, and how much of it lies inside
    that; ``parent``, the innermost one that holds it entirely (slices that cross what is open neither have nor are
    one); ``serial_from``, the work before it in the chain of informative, non-concurrent work that doesn't overlap."""
    rows = activities.select(*TRACK, "start", "end", "activity_id", "concurrent", (C.informative() & ~F.col("concurrent")).alias("serial"))
    rows = rows.repartition(*TRACK).sortWithinPartitions(*TRACK, "start", F.desc("end"), "activity_id")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track: tuple | None = None
        open_: list[tuple[int, int]] = []
        strict: list[tuple[int, int]] = []
        last: tuple[int, int] | None = None
        kinds = [pa.string(), *[pa.int64()] * 5]
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for trace, pid, tid, start, end, activity, concurrent, serial in zip(*(c.to_pylist() for c in batch.columns)):
                if (trace, pid, tid) != track:
                    track, open_, strict, last = (trace, pid, tid), [], [], None
                up = inside = parent = before = None
                if not concurrent:
                    while open_ and open_[-1][0] <= start:
                        open_.pop()
                    if open_:
                        up, inside = open_[-1][1], max(min(end, open_[-1][0]) - start, 0)
                    open_.append((end, activity))
                    while strict and strict[-1][0] <= start:
                        strict.pop()
                    if not strict or end <= strict[-1][0]:
                        parent = strict[-1][1] if strict else None
                        strict.append((end, activity))
                if serial and (last is None or start >= last[0]):
                    before = last[1] if last else None
                    last = (end, activity)
                for column, value in zip(out, (trace, activity, up, inside, parent, before)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], [x.split()[0] for x in SWEPT.split(", ")])

    return rows.mapInArrow(sweep, SWEPT)


def self_times(activities: DataFrame, swept: DataFrame | None = None) -> DataFrame:
    """trace_id, activity_id, self_time: duration less what its direct children spent inside it, never below zero."""
    swept = sweep_tracks(activities) if swept is None else swept
    spent = swept.where("open_parent IS NOT NULL").groupBy("trace_id", F.col("open_parent").alias("activity_id")).agg(F.sum("inside").alias("spent"))
    whole = activities.select("trace_id", "activity_id", C.duration().alias("duration"))
    return whole.join(spent, ["trace_id", "activity_id"], "left").select("trace_id", "activity_id", F.greatest(F.col("duration") - F.coalesce("spent", F.lit(0)), F.lit(0)).alias("self_time"))


def serial_edges(swept: DataFrame) -> DataFrame:
    return swept.where("serial_from IS NOT NULL").select("trace_id", F.col("serial_from").alias("from_id"), F.col("activity_id").alias("to_id"), F.lit("serial").alias("kind"))


def with_nested(activities: DataFrame, roots: DataFrame) -> DataFrame:
    """trace_id, activity_id of the roots and of all that ran inside them, by the chain of open parents: one more pass
    along the tracks, in which what is open says whether it is included."""
    flagged = activities.select(*TRACK, "start", "end", "activity_id", "concurrent").join(roots.select("trace_id", "activity_id", F.lit(True).alias("root")).distinct(), ["trace_id", "activity_id"], "left")
    rows = flagged.select(*TRACK, "start", "end", "activity_id", "concurrent", F.coalesce("root", F.lit(False)).alias("root"))
    rows = rows.repartition(*TRACK).sortWithinPartitions(*TRACK, "start", F.desc("end"), "activity_id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track: tuple | None = None
        open_: list[tuple[int, bool]] = []
        for batch in batches:
            traces, ids = [], []
            for trace, pid, tid, start, end, activity, concurrent, included in zip(*(c.to_pylist() for c in batch.columns)):
                if (trace, pid, tid) != track:
                    track, open_ = (trace, pid, tid), []
                if not concurrent:
                    while open_ and open_[-1][0] <= start:
                        open_.pop()
                    included = included or (bool(open_) and open_[-1][1])
                    open_.append((end, included))
                if included:
                    traces.append(trace)
                    ids.append(activity)
            yield pa.RecordBatch.from_arrays([pa.array(traces, pa.string()), pa.array(ids, pa.int64())], ["trace_id", "activity_id"])

    return rows.mapInArrow(walk, "trace_id string, activity_id long")
