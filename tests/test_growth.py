"""Degrees of routines by hand, and against a memoised walk."""

import random
import sys

from pyspark.sql import functions as F

from tracepath.operators import growth as g

SYMBOLS, CALLS = "symbol_id long, name string, own long", "symbol_id long, callee string, depth long, line long"


def test_degrees(spark):
    symbols = spark.createDataFrame([(0, "leaf", 1), (1, "mid", 0), (2, "top", 2), (3, "rec", 0), (4, "uses_rec", 0), (5, "twin", 1), (6, "twin", 1), (7, "calls_twin", 0)], "symbol_id long, name string, own long")
    calls = spark.createDataFrame([(1, "leaf", 1, 10), (2, "mid", 1, 20), (3, "rec", 0, 1), (4, "rec", 1, 1), (7, "twin", 1, 1), (7, "unknown", 1, 1)], "symbol_id long, callee string, depth long, line long")
    solved = g.degrees(symbols, calls)
    assert {r["symbol_id"]: (r["degree"], r["through"], r["line"]) for r in solved.collect()} == {0: (1, None, None), 1: (2, 0, 10), 2: (3, 1, 20), 3: (None, None, None), 4: (None, None, None), 5: (1, None, None), 6: (1, None, None), 7: (0, None, None)}
    assert {r["name"]: r["rule"] for r in g.growth_spots(symbols, solved).collect()} == {"mid": "HiddenGrowth", "top": "HiddenGrowth", "rec": "UnboundedGrowth", "uses_rec": "UnboundedGrowth"}
    exported = spark.createDataFrame([("top",)], "name string")
    assert {r["name"] for r in g.never_called(symbols, calls, exported).collect()} == {"uses_rec", "calls_twin"}


def settle(own, calls):
    """degree, through, line of each routine by a walk; None if it reaches a cycle."""
    sys.setrecursionlimit(10_000)
    reach = {}

    def reaches(u):
        if u not in reach:
            reach[u] = set()
            todo = [v for v, _, _ in calls.get(u, [])]
            while todo:
                v = todo.pop()
                if v not in reach[u]:
                    reach[u].add(v)
                    todo += [x for x, _, _ in calls.get(v, [])]
        return reach[u]

    cyclic = {u for u in own if u in reaches(u)}
    out = {}

    def degree(u):
        if u in cyclic or reaches(u) & cyclic:
            return None, None, None
        if u not in out:
            best = (own[u], None, None)
            for v, depth, line in sorted(calls.get(u, []), key=lambda c: (c[2], c[0])):
                if depth + degree(v)[0] > best[0]:
                    best = (depth + degree(v)[0], v, line)
            out[u] = best
        return out[u]

    return {u: degree(u) for u in own}


def test_degrees_and_chains_equal_a_walk(spark):
    r = random.Random(8)
    own, calls, base = {}, {}, 0
    for _ in range(8):  # graphs of several kinds side by side
        n, kind = r.randint(2, 8), r.choice(["dag", "dag", "any", "row"])
        for i in range(n):
            own[base + i] = r.randint(0, 3)
            targets = {"dag": range(i), "any": range(n), "row": range(max(0, i - 1), i)}[kind]
            calls[base + i] = [(base + v, r.randint(0, 2), r.randint(1, 5)) for v in targets if kind == "row" or r.random() < (0.3 if kind == "dag" else 0.15)]
        base += n
    symbols = spark.createDataFrame([(u, f"s{u}", d) for u, d in own.items()], SYMBOLS)
    solved = g.degrees(symbols, spark.createDataFrame([(u, f"s{v}", d, line) for u, out in calls.items() for v, d, line in out], CALLS))
    expected = settle(own, calls)
    assert {r["symbol_id"]: (r["degree"], r["through"], r["line"]) for r in solved.collect()} == expected
    walks = {}
    for u, (degree, through, _) in expected.items():
        if degree is not None:
            walks[u] = [u]
            while expected[walks[u][-1]][1] is not None:
                walks[u].append(expected[walks[u][-1]][1])
    assert {(x["symbol_id"], x["innermost"], x["hops"]) for x in g.innermost(solved).collect()} == {(u, w[-1], len(w) - 1) for u, w in walks.items()}
    assert {(x["symbol_id"], x["step"], x["at"], x["line"]) for x in g.chains(solved).collect()} == {(u, k, v, expected[v][2]) for u, w in walks.items() for k, v in enumerate(w)}


def test_a_long_row_of_calls_and_a_long_cycle_settle_in_few_rounds(spark, monkeypatch):
    n, kept = 3_000, []
    monkeypatch.setattr(g, "cut", lambda df, cut=g.cut: kept.append(1) or cut(df))
    symbols = spark.range(2 * n).selectExpr("id AS symbol_id", "concat('s', id) AS name", "CASE WHEN id = 0 THEN 2L ELSE 0L END AS own")
    row = spark.range(1, n).selectExpr("id AS symbol_id", "concat('s', id - 1) AS callee", "id % 2 AS depth", "id AS line")
    cycle = spark.range(n, 2 * n).selectExpr("id AS symbol_id", f"concat('s', CASE WHEN id = {n} THEN {2 * n - 1} ELSE id - 1 END) AS callee", "1L AS depth", "id AS line")
    solved = g.degrees(symbols, row.union(cycle))
    assert len(kept) < 45
    assert solved.where("degree IS NULL").count() == n and solved.where(f"symbol_id < {n} AND degree = 2 + CAST((symbol_id + 1) / 2 AS BIGINT)").count() == n


def test_no_routines(spark):
    assert g.degrees(spark.createDataFrame([], SYMBOLS), spark.createDataFrame([], CALLS)).collect() == []


def test_kept_frames_start_with_a_size_of_their_own(spark):
    """Each round joins what the last one kept with itself; an estimate carried along would have as many digits as there are rows."""
    from tracepath.plans.session import cut

    kept = cut(spark.range(10).withColumnRenamed("id", "node"))
    for _ in range(9):
        kept = cut(kept.join(kept.withColumnRenamed("node", "other"), kept["node"] == F.col("other")).select("node"))
    assert kept.count() == 10 and len(str(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 40


def test_layers_of_callers_are_put_aside(spark):
    symbols = spark.createDataFrame([(i, f"f{i}", i % 3) for i in range(31)], SYMBOLS)
    calls = spark.createDataFrame([(i, f"f{i // 2}", i % 2, 1) for i in range(1, 31)], CALLS).where("symbol_id <> 1")
    waits = g.call_edges(symbols, calls).selectExpr("symbol_id", "callee_id AS v", "depth AS w", "0L AS own")
    left, layers = g._peeled(waits)
    assert len(layers) == 4 and sum(x.count() for x in layers) == 29 and left.isEmpty()


def test_chains_are_not_dealt_once_they_are_written_out(spark):
    solved = spark.createDataFrame([(i, 1, i // 2 if i > 1 else None, i % 5 if i > 1 else None) for i in range(1, 60)], "symbol_id long, degree long, through long, line long")
    chains = g.chains(solved.union(solved.selectExpr("symbol_id + 100", "CAST(NULL AS LONG)", "CAST(NULL AS LONG)", "CAST(NULL AS LONG)")))
    up = {i: [i >> k for k in range(i.bit_length())] for i in range(1, 60)}
    assert {tuple(x) for x in chains.collect()} == {(i, k, v, v % 5 if v > 1 else None) for i, run in up.items() for k, v in enumerate(run)}
    plan = chains._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("Generate")]
