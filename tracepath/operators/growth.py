"""How fast a routine's work grows with its data: loops inside loops, and loops around calls.

symbols: symbol_id, name, own (the depth of its deepest loop); calls: symbol_id, callee (a name), depth (of loops around the
call), line. A call reaches a routine only if one routine alone has that name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracepath.operators.forest import every_run, nearest_marked
from tracepath.plans.session import cut, forget, keep, narrow


def call_edges(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    alone = symbols.groupBy(F.col("name").alias("callee")).agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("callee_id")).where("n = 1")
    return calls.join(alone.select("callee", "callee_id"), "callee").select("symbol_id", "callee_id", "depth", "line")


def _composed(singles: DataFrame) -> DataFrame:
    """singles: symbol_id, a, w, v, which say that a routine's degree is the greater of a and w + that of v, the only routine it still
    waits for. Adds ``ends``: whether v is none of them, after such steps were put together by doubling. Steps compose to steps:
    the greater of a and w + (the greater of b and x + ...) is the greater of (the greater of a and w + b) and w + x + ... What still
    doesn't end goes round a cycle."""
    state = cut(singles.join(singles.select(F.col("symbol_id").alias("v"), F.lit(False).alias("ends")), "v", "left").select("symbol_id", "a", "w", "v", F.col("ends").isNull().alias("ends")))
    for _ in range(state.count().bit_length() + 1):
        moving = state.where("NOT ends")
        if moving.isEmpty():
            break
        beyond = state.select(F.col("symbol_id").alias("v"), F.col("a").alias("b"), F.col("w").alias("x"), F.col("v").alias("further"), F.col("ends").alias("stops"))
        moved = moving.join(beyond, "v").select("symbol_id", F.greatest("a", F.col("w") + F.col("b")).alias("a"), (F.col("w") + F.col("x")).alias("w"), F.col("further").alias("v"), F.col("stops").alias("ends"))
        both = cut(narrow(state.where("ends").unionByName(moved)))
        forget(state)
        state = both
    return state


def _folded(routines: DataFrame, told: DataFrame) -> DataFrame:
    """Routines (symbol_id, a) with what their calls are now known to reach at least (symbol_id, a) taken in."""
    return routines.unionByName(told).groupBy("symbol_id").agg(F.max("a").alias("a"))


def _peeled(waits: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """waits (symbol_id, v, w, own and more) of routines that are called themselves, and those of the others in layers: nothing left calls a
    layer's routines, so they can be settled after all else. Layers are taken as long as they hold an eighth of what is left, so that
    they are few and all of them together read a small multiple of the calls."""
    layers, left, n = [], waits, waits.count()
    while n:
        called = left.select(F.col("v").alias("symbol_id"), F.lit(True).alias("inner")).distinct()
        told = keep(left.join(called, "symbol_id", "left").select(*waits.columns, F.coalesce("inner", F.lit(False)).alias("inner")))
        m = told.where("inner").count()
        if 8 * (n - m) < n:
            forget(told)
            break
        layers.append(told.where("NOT inner").drop("inner"))
        left, n = told.where("inner").drop("inner"), m
    return left, layers


def degrees(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """symbol_id, degree (null: unbounded, since it reaches itself or what does), through (the call that attains it, null for
    its own loops), line.

    Routines that nobody left calls are put aside in layers, and settled from the innermost layer out once the rest is known."""
    own = cut(symbols.groupBy("symbol_id").agg(F.max("own").cast("long").alias("own")))
    known = call_edges(symbols, calls).select("symbol_id", F.col("callee_id").alias("v"), F.col("depth").cast("long").alias("w"), "line").repartition("symbol_id")
    each = known.groupBy("symbol_id", "v").agg(F.max(F.struct("w", (-F.col("line")).alias("up"))).alias("x"))  # of one routine's calls to another the greatest, of equals the first
    waits = keep(each.join(own, "symbol_id").select("symbol_id", "v", "x.w", "own", "x.up"))
    left, layers = _peeled(waits)
    if layers:
        forget(waits)  # the first layer's frame holds them all
    aside = reduce(DataFrame.unionByName, [x.select("symbol_id") for x in layers], symbols.limit(0).select("symbol_id"))
    core = cut(own.withColumnRenamed("own", "a").join(aside, "symbol_id", "left_anti"))
    settled = _settled(core, cut(narrow(left.select("symbol_id", "v", "w"))))
    call = F.max(F.struct((F.col("w") + F.col("d")).alias("degree"), "up", (-F.col("v")).alias("least"))).alias("b")
    best = left.join(settled.select(F.col("symbol_id").alias("v"), F.col("a").alias("d")), "v").groupBy("symbol_id").agg(call)
    done = keep(settled.join(best, "symbol_id", "left").select("symbol_id", "a", "b"))
    for layer in reversed(layers):  # routines that wait for something unsettled stay so themselves
        at = layer.join(done.select(F.col("symbol_id").alias("v"), F.col("a").alias("d")), "v", "left")
        told = at.groupBy("symbol_id").agg(F.max("own").alias("own"), F.max(F.when(F.col("d").isNotNull(), F.struct((F.col("w") + F.col("d")).alias("degree"), "up", (-F.col("v")).alias("least")))).alias("b"), (F.count("d") < F.count(F.lit(1))).alias("lost"))
        told = told.where("NOT lost").select("symbol_id", F.greatest("own", "b.degree").alias("a"), "b")
        both = keep(narrow(done.unionByName(told)))
        forget(done)
        done = both
    found = own.join(done, "symbol_id", "left")
    by_call = F.coalesce((F.col("b.degree") > F.col("own")) & F.col("a").isNotNull(), F.lit(False))
    return found.select("symbol_id", F.col("a").alias("degree"), F.when(by_call, -F.col("b.least")).cast("long").alias("through"), F.when(by_call, -F.col("b.up")).cast("long").alias("line"))


def _settled(open_: DataFrame, waits: DataFrame) -> DataFrame:
    """symbol_id, a (the degree) of the bounded ones among routines (symbol_id, a: of its own loops) that wait (symbol_id, v, w) for
    each other only.

    In each round the routines that wait for one other only are put together by doubling, however long a row of them is, and the
    calls to them become calls to where the row ends; then the routines that wait for none are settled. What is left when none can be
    settled all calls something that is left, so it reaches a cycle."""
    none = open_.limit(0)
    settled, rows = [], []
    while True:
        of = waits.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("w", "v")).alias("x"))
        singles = of.where("n = 1").select("symbol_id", "x.w", "x.v").join(open_, "symbol_id").select("symbol_id", "a", "w", "v")
        row = _composed(singles)
        ended, circling = row.where("ends"), row.where("NOT ends").select("symbol_id")
        if not circling.isEmpty():  # they are never settled, nor is what calls them
            waits, open_ = cut(waits.join(circling, "symbol_id", "left_anti")), cut(open_.join(circling, "symbol_id", "left_anti"))
        if not ended.isEmpty():
            rows.append(ended)
            skipped = waits.join(ended.select(F.col("symbol_id").alias("v"), F.col("a").alias("b"), F.col("w").alias("x"), F.col("v").alias("further")), "v", "left")
            skipped = cut(skipped.join(ended.select("symbol_id"), "symbol_id", "left_anti"))
            open_ = cut(_folded(open_.join(ended.select("symbol_id"), "symbol_id", "left_anti"), skipped.where("further IS NOT NULL").select("symbol_id", (F.col("w") + F.col("b")).alias("a"))))
            waits = cut(skipped.groupBy("symbol_id", F.coalesce("further", "v").alias("v")).agg(F.max(F.col("w") + F.coalesce("x", F.lit(0))).alias("w")))
        ready = cut(open_.join(waits.select("symbol_id"), "symbol_id", "left_anti"))
        if ready.isEmpty():
            break
        settled.append(ready)
        reached = waits.join(ready.select(F.col("symbol_id").alias("v"), F.col("a").alias("d")), "v")
        open_ = cut(_folded(open_.join(ready.select("symbol_id"), "symbol_id", "left_anti"), reached.select("symbol_id", (F.col("w") + F.col("d")).alias("a"))))
        waits = cut(waits.join(ready.select(F.col("symbol_id").alias("v")), "v", "left_anti").select("symbol_id", "v", "w"))
    done = cut(narrow(reduce(DataFrame.unionByName, settled, none)))
    for row in reversed(rows):  # what a row's end came to be, the row is by its step
        at_end = row.join(done.select(F.col("symbol_id").alias("v"), F.col("a").alias("d")), "v").select("symbol_id", F.greatest("a", F.col("w") + F.col("d")).alias("a"))
        both = cut(narrow(done.unionByName(at_end)))
        forget(done)
        done = both
    return done


def innermost(solved: DataFrame) -> DataFrame:
    """symbol_id, innermost, hops for bounded routines: the routine whose own loops carry the degree, and how many calls away it is."""
    nodes = solved.where("degree IS NOT NULL").select(F.lit(0).alias("all"), F.col("symbol_id").alias("node"), F.col("through").alias("parent"), F.col("through").isNull().alias("marked"))
    return nearest_marked(nodes, ("all",)).select(F.col("node").alias("symbol_id"), F.col("found").alias("innermost"), F.col("depth").alias("hops"))


def chains(solved: DataFrame) -> DataFrame:
    """symbol_id, step, at, line of bounded routines: from a routine by the calls that attain its degree to where it is written."""
    bounded = solved.where("degree IS NOT NULL").select(F.col("symbol_id").alias("node"), F.col("through").alias("next"), "line")
    return every_run(bounded, "line").select(F.col("first").alias("symbol_id"), F.col("k").alias("step"), F.col("node").alias("at"), "line")


def growth_spots(symbols: DataFrame, solved: DataFrame) -> DataFrame:
    """symbol_id, name, rule: growth hidden behind a call, nested in the routine, or unbounded."""
    s = symbols.select("symbol_id", "name").join(solved, "symbol_id")
    rule = F.when(F.col("degree").isNull(), "UnboundedGrowth").when((F.col("degree") > 1) & F.col("through").isNotNull(), "HiddenGrowth").when(F.col("degree") > 1, "NestedGrowth")
    return s.withColumn("rule", rule).where("rule IS NOT NULL").select("symbol_id", "name", "rule", "degree", "through", "line")


def never_called(symbols: DataFrame, calls: DataFrame, exported: DataFrame) -> DataFrame:
    """symbol_id, name of routines whose name is called nowhere and isn't exported (name)."""
    return symbols.join(calls.select(F.col("callee").alias("name")), "name", "left_anti").join(exported.select("name"), "name", "left_anti").select("symbol_id", "name")
