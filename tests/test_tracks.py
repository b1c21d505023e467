"""Track sweeps and chains against literal definitions on random intervals."""

import random

from pyspark.sql import functions as F

from tracepath.operators import chain, flows, tracks

SCHEMA = "trace_id string, activity_id long, name string, category string, pid long, tid long, start long, end long, confidence double, concurrent boolean, subject string, inferred boolean"


def some(seed, n=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.randint(0, 60)
        e = s + r.choice([0, 1, 3, 8, 20])
        out.append((f"t{seed}", i, r.choice("abc"), "c", 1, r.randint(1, 3), s, e, 1.0 if e > s else 0.0, r.random() < 0.1, f"k={r.randint(0, 3)}", False))
    return out


def test_sweep(spark):
    data = [a for seed in range(8) for a in some(seed)]
    got = {(r["trace_id"], r["activity_id"]): r for r in tracks.sweep_tracks(spark.createDataFrame(data, SCHEMA)).collect()}
    for seed in range(8):
        for tid in (1, 2, 3):
            track = sorted((a for a in some(seed) if a[5] == tid), key=lambda a: (a[6], -a[7], a[1]))
            plain = [a for a in track if not a[9]]
            last, stack = None, []
            for k, a in enumerate(plain):
                up = [b for b in plain[:k] if b[7] > a[6]]
                row = got[(a[0], a[1])]
                assert row["open_parent"] == (up[-1][1] if up else None)
                while stack and stack[-1][7] <= a[6]:
                    stack.pop()
                holds = not stack or a[7] <= stack[-1][7]
                assert row["parent"] == (stack[-1][1] if stack and holds else None)
                if holds:
                    stack.append(a)
                if a[7] > a[6] and (last is None or a[6] >= last[7]):
                    assert row["serial_from"] == (last[1] if last else None)
                    last = a
                else:
                    assert row["serial_from"] is None


def test_chain_is_longest(spark):
    data = [a for seed in range(5) for a in some(seed, 25)]
    acts = spark.createDataFrame(data, SCHEMA)
    swept = tracks.sweep_tracks(acts)
    points = acts.where("confidence > 0").select("trace_id", F.col("subject").alias("flow_id"), F.col("start").alias("at"), F.col("activity_id").alias("point_id"), F.col("activity_id").alias("bound"))
    edges = flows.all_edges(flows.flow_edges(points), tracks.serial_edges(swept))
    links = flows.links(edges, acts)
    solved = {(r["trace_id"], r["activity_id"]): r for r in chain.solve(acts, links).collect()}
    into: dict = {}
    for r in links.collect():
        into.setdefault((r["trace_id"], r["to_id"]), []).append(r["from_id"])
    by_id = {(a[0], a[1]): a for a in data}

    def head(k):
        a = by_id[k]
        return a[7] - a[6] + max([0, *(head((k[0], p)) + max(a[6] - by_id[(k[0], p)][7], 0) for p in into.get(k, []))])

    deciding = [k for k, a in by_id.items() if a[7] > a[6]]
    assert set(solved) == set(deciding)
    assert all(solved[k]["head"] == head(k) for k in deciding)


def test_empty(spark):
    acts = spark.createDataFrame([], SCHEMA)
    assert tracks.sweep_tracks(acts).count() == 0
    assert tracks.self_times(acts).count() == 0
