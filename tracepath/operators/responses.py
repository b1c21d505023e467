"""How long each interaction took, and the chain of work between it and the screen's answer.

An activity answers to the first presentation after its end, its deadline; work is chained onward only among activities of
one deadline, so deadlines are independent problems. There may be as many as activities, most of them small, so a task takes them
in order, as many at a time as there are in a batch of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracepath.functions import columns as C
from tracepath.operators import marks
from tracepath.operators.forest import runs
from tracepath.plans.session import keep

TAILS = "trace_id string, activity_id long, deadline long, start long, end long, tail long, goes_to long"


def _apart(df: DataFrame) -> DataFrame:
    """The same columns under identities of their own, so that both sides of a cogroup may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def tails(activities: DataFrame, links: DataFrame, presentations: DataFrame) -> DataFrame:
    """trace_id, activity_id, deadline, tail (the longest run of dependent work onward within its deadline), goes_to (the
    next of that run)."""
    moments = activities.where(C.decides()).select("trace_id", F.col("activity_id").alias("key"), F.col("end").alias("at"), "start")
    due = keep(marks.first_after(moments, presentations).where("deadline IS NOT NULL").select("trace_id", F.col("key").alias("activity_id"), "deadline", "start", F.col("at").alias("end")))
    to = links.select("trace_id", "from_id", "to_id").join(due.select("trace_id", F.col("activity_id").alias("to_id"), "deadline"), ["trace_id", "to_id"])
    to = to.groupBy("trace_id", F.col("from_id").alias("activity_id")).agg(F.collect_list(F.struct("to_id", "deadline")).alias("links"))
    same = F.filter("links", lambda x: x["deadline"] == F.col("deadline"))
    rows = due.join(to, ["trace_id", "activity_id"], "left").select("trace_id", "deadline", "start", "end", "activity_id", F.array_sort(F.transform(same, lambda x: x["to_id"])).alias("to"))
    ordered = rows.repartition("trace_id", "deadline").sortWithinPartitions("trace_id", "deadline", F.desc("start"), F.desc("activity_id"))
    return ordered.mapInArrow(longest_onward, TAILS)


def longest_onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tail and goes_to of rows (trace_id, deadline, start, end, activity_id, to) of whole deadlines, one after the other, each from its last start
    back. Of a deadline only what has been met is held, until the next begins."""
    at, met = None, {}
    for batch in batches:
        tails, goes = [], []
        columns = [batch.column(c).to_pylist() for c in ("trace_id", "deadline", "start", "end", "activity_id", "to")]
        for trace, deadline, start, end, i, to in zip(*columns):
            if (trace, deadline) != at:
                at, met = (trace, deadline), {}
            best, onward = end - start, None
            for n in to or ():
                begins, tail = met[n]
                if (through := end - start + max(begins - end, 0) + tail) > best:
                    best, onward = through, n
            met[i] = start, best
            tails.append(best)
            goes.append(onward)
        kept = [batch.column(c) for c in ("trace_id", "activity_id", "deadline", "start", "end")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(tails, pa.int64()), pa.array(goes, pa.int64())], ["trace_id", "activity_id", "deadline", "start", "end", "tail", "goes_to"])


SEEDS = "trace_id string, arrival_id long, seed long, tail long, start long"


def best_inside(windows: pd.DataFrame, works: pd.DataFrame) -> pd.DataFrame:
    """For each window (arrival_id, began, presented) the work (seed, start, end, tail) that lies inside it and has the longest tail, of
    equals the first to start, then the lowest id. Works come in from the last start back; a tree over their ends holds
    the best up to each end, so neither windows nor works meet one by one."""
    if windows.empty:
        works = works.iloc[:0]
    seed, start, end, tail = (works[c].to_numpy(np.int64) for c in ("seed", "start", "end", "tail"))
    began, presented = (windows[c].to_numpy(np.int64) for c in ("began", "presented"))
    ranked = np.lexsort((-seed, -start, tail))
    rank = np.empty(len(seed), np.int64)
    rank[ranked] = np.arange(len(seed))
    ends = np.unique(end)
    place, upto = (np.searchsorted(ends, end) + 1).tolist(), np.searchsorted(ends, presented, side="right").tolist()
    last_first = np.argsort(-start, kind="stable")
    asked = np.argsort(-began, kind="stable")
    known = np.searchsorted(-start[last_first], -began[asked], side="right").tolist()  # works that start no sooner
    order, ranks, size = last_first.tolist(), rank.tolist(), len(ends)
    tree, best, i = [-1] * (size + 1), np.full(len(began), -1), 0
    for q, n in zip(asked.tolist(), known):
        while i < n:
            k, r = place[order[i]], ranks[order[i]]
            while k <= size:
                if tree[k] < r:
                    tree[k] = r
                k += k & -k
            i += 1
        k, r = upto[q], -1
        while k:
            if tree[k] > r:
                r = tree[k]
            k &= k - 1
        best[q] = r
    hit = best >= 0
    of = ranked[best[hit]]
    return pd.DataFrame({"trace_id": pd.Series(windows["trace_id"].array[hit].tolist(), dtype=object), "arrival_id": windows["arrival_id"].to_numpy(np.int64)[hit], "seed": seed[of], "tail": tail[of], "start": start[of]})


def decode(starts: DataFrame, t: DataFrame) -> DataFrame:
    """Adds ``chain`` to starts (trace_id, first): the run from there. Only runs that are asked for are written out."""
    steps = runs(starts.select("trace_id", "first"), t.select("trace_id", F.col("activity_id").alias("node"), F.col("goes_to").alias("next")))
    chains = steps.groupBy("trace_id", "first").agg(F.array_sort(F.collect_list(F.struct("k", "node"))).alias("chain"))
    return starts.join(chains.withColumn("chain", F.transform("chain", lambda x: x["node"])), ["trace_id", "first"])


def responses(activities: DataFrame, links: DataFrame, presentations: DataFrame, arrivals: DataFrame, envelopes: DataFrame) -> DataFrame:
    """trace_id, arrival_id, activity_id, began, presented, chain, working, waiting, elapsed, exact, kind; the slowest of a
    recording first by ``place``."""
    t = keep(tails(activities, links, presentations))
    every = activities.select("trace_id", F.col("activity_id").alias("key"), F.col("end").alias("at"))
    due = marks.first_after(every.join(arrivals.where("phases IS NULL").select("trace_id", F.col("activity_id").alias("key")), ["trace_id", "key"], "left_semi"), presentations)
    a = arrivals.where("activity_id IS NOT NULL").join(due.select("trace_id", F.col("key").alias("activity_id"), "deadline").distinct(), ["trace_id", "activity_id"], "left")
    a = a.withColumns({"began": F.col("at"), "presented": F.when(F.col("phases").isNotNull(), F.col("at") + F.col("latency")).otherwise(F.col("deadline"))}).where("presented IS NOT NULL")
    inside = t.join(envelopes, ["trace_id", "activity_id"], "left_anti").select("trace_id", F.col("activity_id").alias("seed"), "start", "end", "tail")
    stated = a.where("phases IS NOT NULL").select("trace_id", "arrival_id", "began", "presented")
    # Windows meet what starts inside them in buckets as wide as the recording's widest window: each is in two at most.
    width = stated.groupBy("trace_id").agg((F.max(F.col("presented") - F.col("began")) + 1).alias("width"))
    stated = stated.join(width, "trace_id").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("began") / F.col("width")), F.floor(F.col("presented") / F.col("width"))))).drop("width")
    inside = inside.join(width, "trace_id").withColumn("bucket", F.floor(F.col("start") / F.col("width"))).drop("width")
    at = ["trace_id", "bucket"]
    seeds = _apart(stated).groupBy(*at).cogroup(_apart(inside).groupBy(*at)).applyInPandas(best_inside, SEEDS)
    seeds = seeds.groupBy("trace_id", "arrival_id").agg(F.max_by("seed", F.struct("tail", -F.col("start"), -F.col("seed"))).alias("seed"))
    a = a.join(seeds, ["trace_id", "arrival_id"], "left").withColumn("first", F.coalesce("seed", "activity_id"))
    a = decode(keep(a), t)
    steps = a.select("trace_id", "arrival_id", "began", F.posexplode("chain").alias("k", "step")).join(activities.select("trace_id", F.col("activity_id").alias("step"), "start", "end"), ["trace_id", "step"])
    w = Window.partitionBy("trace_id", "arrival_id").orderBy("k")
    steps = steps.withColumn("reached", F.greatest("began", F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("began"))))
    sums = steps.groupBy("trace_id", "arrival_id").agg(F.sum(C.duration()).alias("working"), F.sum(F.greatest(F.col("start") - F.col("reached"), F.lit(0))).alias("waited"), F.greatest(F.max("end"), F.max("began")).alias("reached"))
    out = a.join(sums, ["trace_id", "arrival_id"])
    elapsed = F.when(F.col("phases").isNotNull(), F.col("latency")).otherwise(F.greatest(F.col("presented") - F.col("began"), F.lit(0)))
    out = out.select("trace_id", "arrival_id", "activity_id", "kind", "began", "presented", "chain", "working", (F.col("waited") + F.greatest(F.col("presented") - F.col("reached"), F.lit(0))).alias("waiting"), elapsed.alias("elapsed"), F.col("phases").isNotNull().alias("exact"), "phases")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("elapsed"), "began", "arrival_id")) - 1)
