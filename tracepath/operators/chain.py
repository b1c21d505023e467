"""The chain of dependent work that decided the finish, and the slack behind everything else.

Links run forward in time between activities that don't hold each other. A trace is solved on arrays (``potentials``), about
a hundred bytes an activity; traces are solved in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracepath.functions import columns as C
from tracepath.operators.potentials import solve_arrays

SOLVED = "trace_id string, activity_id long, head long, came_from long, latest long, free long, step long"


def solve(activities: DataFrame, links: DataFrame) -> DataFrame:
    """A row for each deciding activity."""
    a = activities.where(C.decides()).select("trace_id", "activity_id", "start", "end")

    def one(acts: pd.DataFrame, ls: pd.DataFrame) -> pd.DataFrame:
        if acts.empty:
            return pd.DataFrame({c.split()[0]: [] for c in SOLVED.split(", ")})
        out = solve_arrays(*(acts[c].to_numpy(np.int64) for c in ("start", "end", "activity_id")), *(ls[c].to_numpy(np.int64) for c in ("from_id", "to_id")))
        frame = pd.DataFrame({k: pd.arrays.IntegerArray(v.data, np.ma.getmaskarray(v)) for k, v in out.items()})
        frame.insert(0, "trace_id", acts["trace_id"].iloc[0])
        return frame

    return a.groupBy("trace_id").cogroup(links.select(F.col("trace_id").alias("trace_id"), "from_id", "to_id").groupBy("trace_id")).applyInPandas(one, SOLVED)


def slack(solved: DataFrame, activities: DataFrame) -> DataFrame:
    """trace_id, activity_id, total (how much later it could end without a later finish), free (null: nothing depends)."""
    return solved.join(activities.select("trace_id", "activity_id", "end"), ["trace_id", "activity_id"]).select("trace_id", "activity_id", F.greatest(F.col("latest") - F.col("end"), F.lit(0)).alias("total"), "free")


def chain_steps(solved: DataFrame, activities: DataFrame, edges: DataFrame) -> DataFrame:
    """The chain in order: trace_id, step, activity_id, wait_before, waited_on, stated (a flow says so)."""
    w = Window.partitionBy("trace_id").orderBy("step")
    on = solved.where("step IS NOT NULL").join(activities.select("trace_id", "activity_id", "start", "end"), ["trace_id", "activity_id"])
    on = on.select("trace_id", "step", "activity_id", "start", "end", F.coalesce(C.wait_between(F.lag("end").over(w), F.col("start")), F.lit(0)).alias("gap"), F.lag("activity_id").over(w).alias("waited_on"))
    on = on.withColumn("gap", F.when(F.col("waited_on").isNull(), F.lit(0)).otherwise(F.col("gap")).cast("long"))
    flow = edges.where("kind = 'flow'").select("trace_id", F.col("from_id").alias("waited_on"), F.col("to_id").alias("activity_id"), F.lit(True).alias("said")).distinct()
    return on.join(flow, ["trace_id", "waited_on", "activity_id"], "left").select("trace_id", "step", "activity_id", "start", "end", F.col("gap").alias("wait_before"), "waited_on", F.coalesce("said", F.lit(False)).alias("stated"))


def margin(solved: DataFrame, slacks: DataFrame) -> DataFrame:
    """trace_id, margin: the least room off the chain, null where nothing is off it; corridor: nothing is."""
    both = solved.select("trace_id", "activity_id", "step").join(slacks.select("trace_id", "activity_id", "total"), ["trace_id", "activity_id"])
    return both.groupBy("trace_id").agg(F.min(F.when(F.col("step").isNull(), F.col("total"))).alias("margin"), (F.count("step") >= F.count(F.lit(1))).alias("corridor"))


def path_summary(steps: DataFrame, margins: DataFrame) -> DataFrame:
    """One row a trace: steps, work, wait, finish, margin, corridor."""
    s = steps.groupBy("trace_id").agg(F.count(F.lit(1)).alias("steps"), F.sum(C.duration()).alias("work"), F.sum("wait_before").alias("wait"), F.max("end").alias("finish"))
    return s.join(margins, "trace_id", "left")
