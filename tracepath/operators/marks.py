"""Intervals inferred from marks: moments that state the same value of a field in the same scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracepath.functions.columns import SEPARATOR
from tracepath.operators.scan import scan


def mark_groups(marks: DataFrame) -> DataFrame:
    """marks: trace_id, pos, scope, category, pid, tid, at, fields (array of path, value). One row for each scope, field
    and value: first, last, marks, category (null unless all agree), the track of the earliest in file order, and the
    fields of the marks that open and close it."""
    each = marks.select("trace_id", "pos", "scope", "category", "pid", "tid", "at", "fields", F.explode("fields").alias("f")).select("*", "f.path", "f.value")
    whole = F.struct("pid", "tid")
    return each.groupBy("trace_id", "scope", F.col("path").alias("field"), "value").agg(
        F.min("at").alias("first"),
        F.max("at").alias("last"),
        F.count(F.lit(1)).alias("marks"),
        F.when(F.min("category") == F.max("category"), F.min("category")).alias("category"),
        F.min_by(whole, "pos").alias("track"),
        F.min_by("fields", F.struct("at", "pos")).alias("opened"),
        F.max_by("fields", F.struct(F.col("at"), -F.col("pos"))).alias("closed"),
        F.min("pos").alias("seen"),
    )


def inferred_intervals(groups: DataFrame, windows: DataFrame) -> DataFrame:
    """windows: trace_id, opens, closes. Groups of two marks and more whose ends don't contradict each other, as activities
    without ids; confidence is the part of the recording that they leave free."""
    clash = F.exists("opened", lambda a: F.exists("closed", lambda b: (a.path == b.path) & (a.value != b.value)))
    g = groups.where((F.col("marks") >= 2) & (F.col("last") > F.col("first")) & ~clash).join(windows, "trace_id")
    whole = F.greatest(F.col("closes") - F.col("opens"), F.lit(0))
    told = F.array_sort(F.array_union("opened", "closed"))
    subject = F.array_join(F.transform(told, lambda f: F.concat(f.path, F.lit("="), f.value)), SEPARATOR)
    return g.select(
        "trace_id",
        F.col("field").alias("name"),
        F.coalesce("category", F.lit("")).alias("category"),
        "track.pid",
        "track.tid",
        F.col("first").alias("start"),
        F.col("last").alias("end"),
        F.when(whole > 0, F.greatest(F.lit(0.0), 1 - (F.col("last") - F.col("first")) / whole)).otherwise(0.0).alias("confidence"),
        F.lit(True).alias("concurrent"),
        F.nullif(subject, F.lit("")).alias("subject"),
        F.lit(True).alias("inferred"),
        "seen",
        "value",
    )


def fuse_arrivals(arrivals: DataFrame) -> DataFrame:
    """arrivals: trace_id, arrival_id, at, interaction, latency. Where a trace states interactions, one arrival is kept for
    each of them (greatest latency, then the first), and none that belongs to none; other traces are left as they are."""
    stated = F.count("interaction").over(Window.partitionBy("trace_id")) > 0
    best = F.row_number().over(Window.partitionBy("trace_id", "interaction").orderBy(F.desc(F.coalesce("latency", F.lit(0))), "arrival_id"))
    keep = ~F.col("stated") | (F.coalesce(F.col("interaction") != 0, F.lit(False)) & (F.col("best") == 1))
    return arrivals.withColumn("stated", stated).withColumn("best", best).where(keep).drop("stated", "best")


def first_after(moments: DataFrame, presentations: DataFrame) -> DataFrame:
    """Adds ``deadline`` to moments (trace_id, key, at): the first presentation strictly after each, or null."""
    p = presentations.select("trace_id", "at", F.lit(0).alias("side"), F.lit(None).cast("long").alias("key"), F.col("at").alias("shown"))
    m = moments.select("trace_id", "at", F.lit(1).alias("side"), "key", F.lit(None).cast("long").alias("shown"))
    both = scan(p.unionByName(m), ("trace_id",), [F.desc("at"), F.desc("side")], deadline=("min", F.col("shown"))).where("side = 1")
    return moments.join(both.select("trace_id", "key", "deadline"), ["trace_id", "key"], "left")
