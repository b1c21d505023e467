"""The best work inside each window, against a look at every pair."""

import random
import time

import numpy as np
import pandas as pd

from tracepath.operators.responses import best_inside, tails


def test_best_inside_equals_all_pairs():
    r = random.Random(4)
    for _ in range(60):
        works = [(i, s := r.randint(0, 30), s + r.randint(1, 12), r.randint(1, 5)) for i in r.sample(range(99), r.randint(1, 25))]
        windows = [("t", i, b := r.randint(0, 30), b + r.randint(0, 20)) for i in range(r.randint(1, 20))]
        found = best_inside(pd.DataFrame(windows, columns=["trace_id", "arrival_id", "began", "presented"]), pd.DataFrame(works, columns=["seed", "start", "end", "tail"]))
        wanted = {i: max(inside)[2] * -1 for _, i, b, p in windows if (inside := [(t, -s, -w) for w, s, e, t in works if s >= b and e <= p])}
        assert dict(zip(found["arrival_id"], found["seed"])) == wanted


def test_wide_windows_over_many_works():
    n = 50_000
    at = np.arange(n)
    began = time.perf_counter()
    found = best_inside(pd.DataFrame({"trace_id": "t", "arrival_id": at, "began": at, "presented": at + n}), pd.DataFrame({"seed": at, "start": at, "end": at + 1, "tail": n - at}))
    assert (found.set_index("arrival_id")["seed"].sort_index() == at).all() and time.perf_counter() - began < 20


def test_many_deadlines_are_solved_in_order_by_one_task(spark):
    """A deadline for nearly each activity, and some with many: against a walk for each deadline, without a group for each."""
    r = random.Random(6)
    acts, links, shown = [], [], []
    for trace in ("t", "u"):
        spans = {i: (s := r.randint(0, 2000), s + r.randint(1, 60)) for i in range(150)}
        at = sorted(r.sample(range(0, 1200), 60)) + [2500]
        acts += [(trace, i, s, e, 1.0, False) for i, (s, e) in spans.items()]
        shown += [(trace, x) for x in at]
        links += [(trace, i, n) for i in spans for n in r.sample(range(150), 12) if spans[i][0] < spans[n][0] and spans[i][1] < spans[n][1]]
    a = spark.createDataFrame(acts, "trace_id string, activity_id long, start long, end long, confidence double, inferred boolean")
    found = tails(a, spark.createDataFrame(links, "trace_id string, from_id long, to_id long"), spark.createDataFrame(shown, "trace_id string, at long"))
    due = {(t, i): min((x for u, x in shown if u == t and x > e), default=None) for t, i, _, e, _, _ in acts}
    out, span, want = {}, {(t, i): (s, e) for t, i, s, e, _, _ in acts}, {}
    for t, i, n in sorted(links):
        if due[t, i] == due[t, n]:
            out.setdefault((t, i), []).append((t, n))
    for k in sorted(span, key=span.get, reverse=True):
        start, end = span[k]
        runs = [(end - start, 0, None)] + [(end - start + max(span[n][0] - end, 0) + want[n][0], -n[1], n[1]) for n in out.get(k, ()) ]
        best = max(runs[1:], default=runs[0])
        want[k] = (best[0], best[2]) if best[0] > runs[0][0] else (runs[0][0], None)
    assert {(x["trace_id"], x["activity_id"]): (x["tail"], x["goes_to"]) for x in found.collect()} == {k: v for k, v in want.items() if due[k] is not None}
    assert all((x["start"], x["end"]) == span[x["trace_id"], x["activity_id"]] and x["deadline"] == due[x["trace_id"], x["activity_id"]] for x in found.collect())
    assert "FlatMapCoGroupsInPandas" not in found._jdf.queryExecution().toString()
