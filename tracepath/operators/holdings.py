"""What each component of a repository holds in place: reachability, dominators, retained weight, removal plans.

A repository is not held by any task. Dominators are paths in a tree of what is reached, from the entry down; a component's dominator
is where the paths of all that declare it part, which is that of the least and the greatest of these paths. Components that
declare nothing decide nothing about others: they get their dominators in one step, after those of the rest have settled. Rounds are as
many as declarations are deep, and a path is as long as that.

components: repo_id, component, weight (not negative; null: 0), owned; declares: repo_id, source, target; the entry is a component by name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracepath.operators.reach import parted, reached
from tracepath.plans.session import forget, keep, narrow

NODE = ("repo_id", "component")
PLAN = "repo_id string, component string, frees long, plan_frees long, margin long"


def dominators(n: int, entry: int, out: list[list[int]]) -> tuple[list[int], list[int]]:
    """Immediate dominators (-1: unreachable; the entry is its own) and the reachable nodes, each after its dominator.
    Two branches meet at the lowest common ancestor in the tree so far; sweeps in reverse post-order until nothing moves."""
    order, seen, stack = [], [False] * n, [(entry, 0)]
    seen[entry] = True
    while stack:
        node, k = stack.pop()
        if k < len(out[node]):
            stack.append((node, k + 1))
            if not seen[t := out[node][k]]:
                seen[t] = True
                stack.append((t, 0))
        else:
            order.append(node)
    order.reverse()
    place = {node: i for i, node in enumerate(order)}
    before: list[list[int]] = [[] for _ in order]
    for node in order:
        for t in out[node]:
            before[place[t]].append(place[node])
    up = [0] + [-1] * (len(order) - 1)
    moved = True
    while moved:
        moved = False
        for i in range(1, len(order)):
            meet = -1
            for p in before[i]:
                if up[p] < 0:
                    continue
                if meet < 0:
                    meet = p
                while meet != p:  # the later of the two climbs
                    if meet > p:
                        meet = up[meet]
                    else:
                        p = up[p]
            if up[i] != meet:
                up[i], moved = meet, True
    idom = [-1] * n
    for i, node in enumerate(order):
        idom[node] = order[up[i]]
    return idom, order


def _nodes(components: DataFrame, declares: DataFrame) -> DataFrame:
    """repo_id, component, weight, owned, inner (it declares something): each component once."""
    declaring = declares.select("repo_id", F.col("source").alias("component"), F.lit(True).alias("inner")).distinct()
    return keep(components.select(*NODE, "weight", "owned").dropDuplicates([*NODE]).join(declaring, [*NODE], "left"))


def _start(components: DataFrame, entry: str) -> DataFrame:
    return components.where(F.col("component") == entry).select(*NODE).distinct()


def reachable(components: DataFrame, declares: DataFrame, entry: str) -> DataFrame:
    """Adds to components whether the entry reaches them."""
    sources = declares.select("repo_id", F.col("source").alias("component")).distinct()
    declaring = sources.join(components.select(*NODE), [*NODE], "left_semi")
    found = reached(declares, _start(components, entry), declaring)
    return components.join(found.distinct().withColumn("reachable", F.lit(True)), [*NODE], "left").na.fill(False, ["reachable"])


def _walk(start: DataFrame, inner: DataFrame) -> DataFrame:
    """repo_id, component, path: what edges lead to from start, and a shortest way there, from the start on and itself included."""
    tree = fresh = keep(start.select(*NODE, F.array("component").alias("path")))
    while True:
        sent = fresh.join(inner, [*NODE]).groupBy("repo_id", F.col("target").alias("component")).agg(F.min("path").alias("path"))
        news = keep(sent.join(tree.select(*NODE), [*NODE], "left_anti").select(*NODE, F.array_append("path", F.col("component")).alias("path")))
        if news.isEmpty():
            return tree
        more = keep(narrow(tree.unionByName(news)))
        for old in (tree, fresh):
            forget(old)
        tree, fresh = more, news


def _meet(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """repo_id, component, meet: for each target the path that the paths of all that declare it begin with. Few targets are declared
    often, so paths are dealt by target as they are, one a declaration, not two for each target and task."""
    each = edges.join(tree, [*NODE]).select("repo_id", F.col("target").alias("component"), "path")
    held = each.repartition(*NODE).groupBy(*NODE).agg(F.min("path").alias("low"), F.max("path").alias("high"))
    parts = F.array_position(F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False))), False).cast("int")
    return held.select(*NODE, F.when(parts == 0, F.col("low")).otherwise(F.slice("low", 1, parts - 1)).alias("meet"))


def _settled(start: DataFrame, inner: DataFrame, entry: str) -> DataFrame:
    """repo_id, component, path for what is reached over these edges: its dominators from the entry on, and itself. Begins with any tree of
    ways, in which all dominators of a component are above it; to hang a component where the ways to it part leaves them there, and what
    then moves no more has nothing else above it."""
    tree = _walk(start, inner)
    several = inner.where(F.col("target") != entry).groupBy("repo_id", "target").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    joint = keep(inner.join(several.select("repo_id", "target"), ["repo_id", "target"], "left_semi").select(*NODE, "target"))
    if joint.isEmpty():
        return tree
    while True:
        moved = keep(_meet(joint, tree).join(tree, [*NODE]).where(F.size("meet") < F.size("path") - 1).select(*NODE, F.element_at("meet", -1).alias("up")))
        if moved.isEmpty():
            return tree
        old_up = F.when(F.size("path") > 1, F.get("path", F.size("path") - 2))
        up = tree.join(moved, [*NODE], "left").select("repo_id", F.coalesce("up", old_up).alias("component"), F.col("component").alias("target"))
        hung = _walk(start, keep(up.where("component IS NOT NULL")))
        forget(tree)
        tree = hung


def _weight() -> Column:
    weight = F.coalesce("weight", F.lit(0)).cast("long")
    return F.when(weight < 0, F.raise_error(F.lit("a component's weight is negative"))).otherwise(weight)


def dominated(components: DataFrame, declares: DataFrame, entry: str) -> tuple[DataFrame, DataFrame]:
    """repo_id, component, path of what is reached and declares something: its dominators from the entry on, and itself; and each
    component with weight, owned and, if it is reached and declares nothing, meet: its dominators from the entry on."""
    nodes = _nodes(components, declares)
    inner, ends, told = parted(declares, nodes.where("inner").select(*NODE))
    tree = _settled(_start(components, entry), inner, entry)
    ends = ends.where(F.col("target") != entry)
    every = keep(nodes.drop("inner").join(_meet(ends, tree), [*NODE], "left"))
    for old in (nodes, inner, told):
        forget(old)
    return tree, every


def _retained(paths: DataFrame, *more: str) -> DataFrame:
    """Each component on these paths with the weight of all paths that lead through it."""
    return paths.select("repo_id", *more, F.explode("path").alias("component"), "weight").groupBy("repo_id", *more, "component").agg(F.sum("weight").alias("retained"))


def hold(components: DataFrame, declares: DataFrame, entry: str) -> DataFrame:
    """Adds reachable, dominator (null for the entry and what isn't reached) and retained: the weight that goes with it. What declares
    nothing retains itself, and its weight counts from its dominator on up."""
    tree, every = dominated(components, declares, entry)
    ends, rest = every.where("meet IS NOT NULL"), every.where("meet IS NULL").drop("meet")
    up = F.element_at("meet", -1)
    under = ends.groupBy("repo_id", up.alias("component")).agg(F.sum(_weight()).alias("under"))
    paths = tree.join(rest.select(*NODE, _weight().alias("weight")), [*NODE]).join(under, [*NODE], "left")
    paths = keep(paths.select(*NODE, "path", (F.col("weight") + F.coalesce("under", F.lit(0))).alias("weight")))
    dominator = F.when(F.size("path") > 1, F.get("path", F.size("path") - 2))
    held = paths.select(*NODE, dominator.alias("dominator")).join(_retained(paths), [*NODE])
    out = rest.join(held, [*NODE], "left").select(*NODE, "weight", "owned", F.col("retained").isNotNull().alias("reachable"), "dominator", F.coalesce("retained", F.lit(0)).cast("long").alias("retained"))
    return out.unionByName(ends.select(*NODE, "weight", "owned", F.lit(True).alias("reachable"), up.alias("dominator"), _weight().alias("retained")))


def best_cuts(children: list[list[int]], root: int, retained: list[int], budget: int) -> tuple[list[int], int, int]:
    """The nodes to cut, at most ``budget`` and none inside another, that free the most; what they free; and what one more
    would add. Ties: cuts below a node are kept unless cutting the node itself frees more, and of shares that free as much a later
    child gets the smaller one."""
    width = budget + 2  # 0 cuts to one more than allowed
    cuts = np.arange(width)
    left = cuts[:, None] - cuts[None, :]  # what is left of a row's cuts when a column's are given to a child
    best: dict[int, np.ndarray] = {}
    gives: dict[int, list[np.ndarray]] = {}
    whole: dict[int, np.ndarray] = {}
    below, todo = [], [root]
    while todo:
        v = todo.pop()
        below.append(v)
        todo += children[v]
    for v in reversed(below):
        spread, gives[v] = np.zeros(width, np.int64), []
        for c in children[v]:
            if not best[c][-1]:  # nothing to free there
                gives[v].append(np.zeros(width, np.int64))
                continue
            shared = np.where(left >= 0, spread[left] + best[c][None, :], -1)
            give = shared.argmax(axis=1)  # the first of equals
            spread = shared[cuts, give]
            gives[v].append(give)
        whole[v] = (retained[v] > spread) & (cuts > 0) & (v != root)
        best[v] = np.where(whole[v], retained[v], spread)
    chosen, todo = [], [(root, budget)]
    while todo:
        v, k = todo.pop()
        if whole[v][k]:
            chosen.append(v)
            continue
        for c, give in zip(reversed(children[v]), reversed(gives[v])):
            todo.append((c, int(give[k])))
            k -= int(give[k])
    return chosen, int(best[root][budget]), int(best[root][budget + 1] - best[root][budget])


def removal_plan(components: DataFrame, declares: DataFrame, entry: str, budget: int) -> DataFrame:
    """The components whose removal frees the most, at most ``budget`` of a repository; components of one holder are taken in the order
    of their names.

    No weight is negative, so to cut a component frees no less than any cuts inside it, and they free as much with one cut only if
    one component in there holds all of it. So of those just below the entry the ``budget + 1`` greatest (of equals the first) can be
    chosen, or what is inside such a one and frees the same; these few rows are a group."""
    tree, every = dominated(components, declares, entry)
    rest = tree.where("size(path) > 1").join(every.where("meet IS NULL").select(*NODE, _weight().alias("weight")), [*NODE]).select(*NODE, "path", "weight")
    ends = every.where("meet IS NOT NULL").select(*NODE, F.array_append("meet", F.col("component")).alias("path"), _weight().alias("weight"))
    paths = rest.unionByName(ends).withColumn("top", F.get("path", 1))
    tops = paths.groupBy("repo_id", "top").agg(F.sum("weight").alias("most")).where("most > 0")
    nth = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("most"), "top"))
    tops = keep(tops.withColumn("nth", nth).where(F.col("nth") <= budget + 1).select("repo_id", "top", "most"), measured=True)
    inside = keep(paths.join(tops, ["repo_id", "top"]))
    same = _retained(inside.withColumn("path", F.slice("path", 2, F.size("path"))), "top", "most").where("retained = most").select(*NODE, "retained")
    rows = same.join(inside.select(*NODE, "path"), [*NODE])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("component")
        names = [entry, *rows["component"]]
        number = {c: i for i, c in enumerate(names)}
        children: list[list[int]] = [[] for _ in names]
        for c, path in zip(rows["component"], rows["path"]):
            children[number[path[-2]]].append(number[c])
        retained = [0, *rows["retained"].tolist()]
        chosen, frees, margin = best_cuts(children, 0, retained, budget)
        return pd.DataFrame({"repo_id": [rows["repo_id"].iloc[0]] * len(chosen), "component": [names[i] for i in chosen], "frees": [retained[i] for i in chosen], "plan_frees": [frees] * len(chosen), "margin": [margin] * len(chosen)})

    return rows.groupBy("repo_id").applyInPandas(one, PLAN)


def unreachable(held: DataFrame) -> DataFrame:
    """What nothing reaches and nobody here owns: weight that is only carried along."""
    return held.where("NOT reachable AND NOT owned").select("repo_id", "component", "weight")
