"""From raw events to activities, edges, coverage, arrivals and presentations, as DataFrames keyed by recording.

Begins and ends on one track pair as a stack does, those with an identity as a queue does; both are windows: an end that
takes the running balance below its former minimum has no begin, and among the rest depth, or rank, names the partner.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracepath.functions.columns import SEPARATOR
from tracepath.operators import flows, marks, tracks
from tracepath.plans.session import cut
from tracepath.sources.vocabulary import BY_NAME

INTERVAL, ASYNC, INSTANT, FLOW, IGNORED = ("X", "B", "E"), ("b", "e"), ("I", "i"), ("s", "t", "f"), ("M", "c", "C", "n", "R")


@dataclass
class Recording:
    """The tables of a set of recordings, each with trace_id."""

    problems: DataFrame
    windows: DataFrame
    activities: DataFrame
    swept: DataFrame
    edges: DataFrame
    coverage: DataFrame
    presentations: DataFrame
    arrivals: DataFrame
    envelopes: DataFrame
    census: DataFrame
    origins: DataFrame


def subject_of(fields: str = "fields") -> Column:
    told = F.array_sort(F.transform(fields, lambda f: F.concat(f.path, F.lit("="), f.value)))
    return F.nullif(F.array_join(told, SEPARATOR), F.lit(""))


def classified(raw: DataFrame) -> DataFrame:
    """Adds ``class``: interval, async, instant, flow, ignored, or unread where a needed field is missing."""
    placed = F.col("pid").isNotNull() & F.col("tid").isNotNull() & F.col("ts").isNotNull()
    identified = placed & F.col("ident").isNotNull()
    ph = F.col("ph")
    return raw.where("problem IS NULL").withColumn(
        "class",
        F.when(ph.isin(*IGNORED), "ignored")
        .when(ph.isin(*INTERVAL) & placed, "interval")
        .when(ph.isin(*ASYNC) & identified, "async")
        .when(ph.isin(*INSTANT) & placed, "instant")
        .when(ph.isin(*FLOW) & identified & F.col("binds").isNotNull(), "flow")
        .otherwise("unread"),
    )


def _floor_ends(events: DataFrame, keys: list[str], begin: str) -> DataFrame:
    """Adds ``lost``: an end that nothing open before it matches."""
    w = Window.partitionBy(*keys).orderBy("pos")
    step = F.when(F.col("ph") == begin, 1).otherwise(-1)
    e = events.withColumn("balance", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    floor = F.least(F.lit(0), F.coalesce(F.min("balance").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return e.withColumn("lost", (F.col("ph") != begin) & (F.col("balance") < floor)).drop("balance")


def stack_pairs(events: DataFrame) -> DataFrame:
    """Begins (B) with ``close_pos`` and ``close_ts`` of their ends (null: still open), and ends that are ``lost``."""
    track = ["trace_id", "pid", "tid"]
    e = _floor_ends(events, track, "B")
    step = F.when(F.col("ph") == "B", 1).otherwise(-1)
    kept = e.where("NOT lost").withColumn("depth", F.sum(step).over(Window.partitionBy(*track).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) + F.when(F.col("ph") == "B", 0).otherwise(1))
    w = Window.partitionBy(*track, "depth").orderBy("pos")
    kept = kept.withColumns({"close_pos": F.lead("pos").over(w), "close_ts": F.lead("ts").over(w)}).where("ph = 'B'").drop("depth")
    lost = e.where("lost").withColumns({"close_pos": F.lit(None).cast("long"), "close_ts": F.lit(None).cast("long")})
    return kept.unionByName(lost)


def queue_pairs(events: DataFrame) -> DataFrame:
    """The same for begins (b) and ends (e) of one identity, category and name: the oldest open first."""
    keys = ["trace_id", "ident", "cat", "name"]
    e = _floor_ends(events, keys, "b")
    kept = e.where("NOT lost").withColumn("k", F.row_number().over(Window.partitionBy(*keys, "ph").orderBy("pos")))
    ends = kept.where("ph = 'e'").select(*keys, "k", F.col("pos").alias("close_pos"), F.col("ts").alias("close_ts"))
    begins = kept.where("ph = 'b'").join(ends, [*keys, "k"], "left").drop("k")
    lost = e.where("lost").withColumns({"close_pos": F.lit(None).cast("long"), "close_ts": F.lit(None).cast("long")})
    return begins.unionByName(lost)


def record(raw: DataFrame, producer: str = "chrome") -> Recording:
    """Every table of the recordings."""
    v = BY_NAME[producer]
    raw = cut(raw)
    e = classified(raw)
    phased = F.col("ph").isNotNull()
    windows = e.groupBy("trace_id").agg(
        F.min(F.when(phased & (F.col("class") != "ignored"), F.col("ts"))).alias("opens"),
        F.max(F.when(phased, F.col("ts") + F.col("whole_dur"))).alias("closes"),
        F.count_if(F.col("class") == "unread").alias("unread"),
        F.count_if("presents").alias("presentations"),
        F.count_if("stimulus").alias("stimuli"),
    )
    sync = stack_pairs(e.where("class = 'interval' AND ph <> 'X'"))
    timed = queue_pairs(e.where("class = 'async'"))
    common = ["trace_id", "name", F.col("cat").alias("category"), "pid", "tid", F.col("ts").alias("start")]
    told = subject_of()

    def rows(df: DataFrame, end: Column, stage: int | Column, at: Column, concurrent: bool, trusted: Column) -> DataFrame:
        stage = F.lit(stage) if isinstance(stage, int) else stage
        return df.select(*common, end.alias("end"), F.when(trusted & (end > F.col("ts")), 1.0).otherwise(0.0).alias("confidence"), F.lit(concurrent).alias("concurrent"), told.alias("subject"), F.lit(False).alias("inferred"), stage.alias("stage"), at.alias("at"), F.lit("").alias("sub"), (~trusted).alias("censored"))

    whole = rows(e.where("ph = 'X' AND class = 'interval'"), F.col("ts") + F.coalesce("dur", F.lit(0)), 0, F.col("pos"), False, F.lit(True))
    closed = F.col("close_pos").isNotNull()
    begun = [
        rows(df.where("NOT lost").join(windows.select("trace_id", "closes"), "trace_id"), F.when(closed, F.col("close_ts")).otherwise(F.col("closes")), F.when(closed, 0).otherwise(held), F.when(closed, F.col("close_pos")).otherwise(F.col("pos")), concurrent, closed)
        for df, held, concurrent in ((sync, 1, False), (timed, 2, True))
    ]
    moments = e.where("class = 'instant'").select("trace_id", "pos", "scope", F.col("cat").alias("category"), "pid", "tid", F.col("ts").alias("at"), "fields")
    inferred = marks.inferred_intervals(marks.mark_groups(moments), windows)
    inferred = inferred.select(*[c for c in inferred.columns if c not in ("seen", "value")], F.lit(3).alias("stage"), F.col("seen").alias("at"), F.concat_ws("\u0001", "name", "value").alias("sub"), F.lit(False).alias("censored"))
    every = whole.unionByName(begun[0]).unionByName(begun[1]).unionByName(inferred)
    number = F.row_number().over(Window.partitionBy("trace_id").orderBy("stage", "at", "sub")) - 1
    every = cut(every.withColumn("activity_id", number.cast("long")).drop("stage", "at", "sub"))
    activities = every.drop("censored")
    swept = cut(tracks.sweep_tracks(activities))
    points = e.where("class = 'flow'").select("trace_id", "pid", "tid", F.col("ts").alias("at"), F.col("pos").alias("point_id"), F.col("ident").alias("flow_id"), "binds")
    bound = cut(flows.enclosing(points.where("binds = 'enclosing'"), activities).unionByName(flows.next_after(points.where("binds = 'next'"), activities)))
    edges = cut(flows.all_edges(flows.flow_edges(bound), tracks.serial_edges(swept)))

    def count(df: DataFrame, condition: str, name: str) -> DataFrame:
        return df.where(condition).groupBy("trace_id").agg(F.count(F.lit(1)).alias(name))

    unpaired = count(sync.select("trace_id", "lost").unionByName(timed.select("trace_id", "lost")), "lost", "unpaired")
    coverage = windows.select("trace_id", "unread")
    for part in (unpaired, count(bound, "bound IS NULL", "unbound_flows"), flows.contradictions(edges, activities), count(every, "censored", "censored")):
        coverage = coverage.join(part, "trace_id", "left")
    coverage = cut(coverage.na.fill(0))
    handlers = activities.where(F.col("name").isin(*v.stimuli)).groupBy("trace_id", F.col("start").alias("at")).agg(F.min("activity_id").alias("activity_id"))
    came = e.where("stimulus AND ts IS NOT NULL").select("trace_id", F.col("pos").alias("arrival_id"), F.col("ts").alias("at"), "kind", "interaction", "phases", F.col("phases.latency").alias("latency"))
    arrivals = cut(marks.fuse_arrivals(came).join(handlers, ["trace_id", "at"], "left"))
    shown = e.where("presents AND ts IS NOT NULL").select("trace_id", F.col("ts").alias("at"))
    stated = arrivals.where("activity_id IS NOT NULL AND phases IS NOT NULL").select("trace_id", (F.col("at") + F.col("latency")).alias("at"))
    fused = arrivals.where("interaction IS NOT NULL").groupBy("trace_id").agg(F.count(F.lit(1)).alias("stated_interactions"))
    has = arrivals.groupBy("trace_id").agg(F.count(F.lit(1)).alias("arrivals"))
    return Recording(
        problems=raw.where("problem IS NOT NULL").select("trace_id", "problem"),
        windows=windows.select("trace_id", "opens", "closes"),
        activities=activities,
        swept=swept,
        edges=edges,
        coverage=coverage,
        presentations=shown.union(stated).distinct(),
        arrivals=arrivals,
        envelopes=activities.where(F.col("name").isin(*v.stimuli, *v.envelopes)).select("trace_id", "activity_id") if v.stimuli else activities.limit(0).select("trace_id", "activity_id"),
        census=windows.select("trace_id", "stimuli", "presentations").join(fused, "trace_id", "left").join(has, "trace_id", "left").na.fill(0),
        origins=e.select("trace_id", F.explode("origins").alias("origin")).groupBy("trace_id", "origin").agg(F.count(F.lit(1)).alias("n")),
    )
