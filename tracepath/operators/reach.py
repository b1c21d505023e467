"""What each of several entries reaches, in one fix-point for all of them.

An entry is a bit; a component holds the bits of the entries that reach it, 64 to a row. A round sends on only bits that are new
where they arrive, so it moves what changed, and rounds are as many as declarations are deep. What declares nothing sends nothing on,
so it takes no part in the rounds: it gets its bits in one step at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracepath.plans.session import cut, forget, keep, narrow

KEY = ("repo_id", "component", "word")


def numbered(entries: DataFrame) -> DataFrame:
    """entries (repo_id, component) with their word and bit: by name within a repository, from 0."""
    n = F.row_number().over(Window.partitionBy("repo_id").orderBy("component")) - 1
    return entries.select("repo_id", "component").distinct().withColumn("n", n).select("repo_id", "component", F.floor(F.col("n") / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n") % 64).alias("mask"))


def _told(edges: DataFrame, declaring: DataFrame) -> DataFrame:
    inner = declaring.select("repo_id", F.col("component").alias("target"), F.lit(True).alias("inner"))
    return edges.join(inner, ["repo_id", "target"], "left").select("repo_id", "component", "target", "inner")


def between(edges: DataFrame) -> DataFrame:
    """The edges (repo_id, component, target) whose target declares something itself."""
    return _told(edges, edges.select("repo_id", "component").distinct()).where("inner").drop("inner")


def parted(declares: DataFrame, declaring: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """repo_id, component, target: the declarations of what declares something itself (each once; or of what is in ``declaring``: repo_id,
    component, each once), and the others. Declarations are dealt once for it; the third frame is what the others are read from."""
    edges = declares.select("repo_id", F.col("source").alias("component"), "target")
    told = keep(_told(edges, edges.select("repo_id", "component").distinct() if declaring is None else declaring))
    return keep(told.where("inner").drop("inner").distinct()), told.where("inner IS NULL").drop("inner"), told


def reached(declares: DataFrame, entries: DataFrame, declaring: DataFrame | None = None) -> DataFrame:
    """repo_id, component: what any of the entries (repo_id, component) reaches, itself included, by declarations of all or of what is in
    ``declaring``; a component may stand there more than once."""
    inner, ends, _ = parted(declares, declaring)
    found = fresh = keep(entries.select("repo_id", "component").distinct())
    while True:
        sent = fresh.join(inner, ["repo_id", "component"]).select("repo_id", F.col("target").alias("component")).distinct()
        news = keep(sent.join(found, ["repo_id", "component"], "left_anti"))
        if news.isEmpty():
            break
        more = keep(narrow(found.unionByName(news)))
        for old in (fresh, found):
            forget(old)
        found, fresh = more, news
    forget(inner)
    return found.union(ends.join(found, ["repo_id", "component"], "left_semi").select("repo_id", F.col("target").alias("component")))


def reached_from(declares: DataFrame, entries: DataFrame) -> DataFrame:
    """repo_id, component, word, mask: the entries that reach a component, itself included. declares: repo_id, source, target."""
    inner, ends, _ = parted(declares)
    first = cut(numbered(entries))
    state = fresh = first
    while True:
        sent = fresh.join(inner, ["repo_id", "component"]).groupBy("repo_id", F.col("target").alias("component"), "word").agg(F.bit_or("mask").alias("mask"))
        news = sent.join(state.withColumnRenamed("mask", "old"), [*KEY], "left").withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))))
        arrived = keep(news.where("mask <> 0").select(*KEY, "mask"))
        if arrived.isEmpty():
            break
        more = keep(narrow(state.unionByName(arrived)).groupBy(*KEY).agg(F.bit_or("mask").alias("mask")))
        for old in (fresh, state):
            forget(old)
        state, fresh = more, arrived
    last = state.join(ends, ["repo_id", "component"]).select("repo_id", F.col("target").alias("component"), "word", "mask")
    return state.unionByName(last).groupBy(*KEY).agg(F.bit_or("mask").alias("mask"))


def entries_reaching(reached: DataFrame) -> DataFrame:
    """repo_id, component, entries: how many entries reach it."""
    return reached.groupBy("repo_id", "component").agg(F.sum(F.bit_count("mask")).cast("long").alias("entries"))
