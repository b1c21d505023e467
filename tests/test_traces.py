"""Small recordings with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from tracepath.operators.ingest import record
from tracepath.plans.analyse import analyse_recording
from tracepath.plans.report import report
from tracepath.sources.trace_events import as_micros, leaves, parse_texts


def x(name, ts, dur, tid=1, pid=1, **args):
    return {"ph": "X", "name": name, "cat": "c", "pid": pid, "tid": tid, "ts": ts, "dur": dur, **({"args": args} if args else {})}


def recorded(spark, **traces):
    rows = [(k, v if isinstance(v, str) else json.dumps({"traceEvents": v})) for k, v in traces.items()]
    return record(parse_texts(spark.createDataFrame(rows, "trace_id string, text string")))


REPEAT = [x("Load", 0, 10_000), x("Parse", 10_000, 5_000, url="a.js"), x("Parse", 20_000, 5_000, url="a.js"), x("Paint", 60_000, 1_000), x("Parse", 30_000, 1_000, tid=1, url="b.js")]
FLOWING = [
    x("Main", 0, 10_000), x("Other", 20_000, 5_000, tid=2),
    {"ph": "s", "id": "1", "pid": 1, "tid": 1, "ts": 5_000}, {"ph": "f", "id": "1", "pid": 1, "tid": 2, "ts": 15_000},
    x("Big", 0, 12_000, tid=3),
]
PAIRS = [
    {"ph": "B", "name": "out", "pid": 1, "tid": 1, "ts": 0}, {"ph": "B", "name": "in", "pid": 1, "tid": 1, "ts": 10},
    {"ph": "E", "pid": 1, "tid": 1, "ts": 20}, {"ph": "E", "pid": 1, "tid": 1, "ts": 40}, {"ph": "E", "pid": 1, "tid": 1, "ts": 50},
    {"ph": "b", "name": "get", "cat": "n", "id": 7, "pid": 1, "tid": 1, "ts": 60}, {"ph": "b", "name": "get", "cat": "n", "id": 7, "pid": 1, "tid": 1, "ts": 70},
    {"ph": "e", "name": "get", "cat": "n", "id": 7, "pid": 1, "tid": 2, "ts": 90}, {"ph": "Q", "pid": 1, "tid": 1, "ts": 95}, {"ph": "B", "name": "left", "pid": 1, "tid": 1, "ts": 99},
]
CLICK = [
    x("EventDispatch", 1_000, 100, data={"type": "click"}), x("RunTask", 1_500, 500),
    {"ph": "I", "name": "FramePresented", "pid": 1, "tid": 9, "ts": 3_000}, x("RunTask", 4_000, 500),
]


@pytest.fixture(scope="module")
def analysis(spark):
    return analyse_recording(recorded(spark, repeat=REPEAT, flowing=FLOWING, pairs=PAIRS, bad="{", empty=[], click=CLICK))


def rows(df, trace, *order):
    return df.where(F.col("trace_id") == trace).orderBy(*(order or ("trace_id",))).collect()


def test_numbers():
    assert [as_micros(v) for v in (5, 5.9, -5.9, "5", True, None, 1e300)] == [5, 5, -5, None, None, None, (1 << 63) - 1]
    assert leaves({"b": {"y": 1.5, "x": "q"}, "a": [1, {"z": 2}]}) == [("a", '[1,{"z":2}]'), ("b.x", '"q"'), ("b.y", "1.5")]


def test_chain_and_repeats(analysis):
    (s,) = rows(analysis.summary, "repeat")
    assert (s["steps"], s["work"], s["wait"], s["finish"], s["corridor"]) == (5, 22_000, 39_000, 61_000, True)
    f = rows(analysis.findings, "repeat", "place")
    assert [r["cost"] for r in f] == [29_000, 5_000, 5_000, 5_000]
    assert sorted(r["rule"] for r in f) == ["dead wait"] * 3 + ["repeated work"]
    (p,) = rows(analysis.repair(2), "repeat")
    assert len(p["chosen"]) == 2 and p["recovered"] == 34_000


def test_flow(analysis):
    steps = rows(analysis.steps, "flowing", "step")
    assert [(r["wait_before"], r["stated"]) for r in steps] == [(0, False), (10_000, True)]
    off = [r for r in rows(analysis.findings, "flowing") if r["rule"] == "off-path dominance"]
    assert [(r["name"], r["evidence"], r["room"]) for r in off] == [("Big", 12_000, 13_000)]


def test_pairs_and_coverage(analysis):
    acts = {(r["name"], r["start"], r["end"], r["confidence"], r["concurrent"]) for r in rows(analysis.recording.activities, "pairs")}
    assert acts == {("out", 0, 40, 1.0, False), ("in", 10, 20, 1.0, False), ("get", 60, 90, 1.0, True), ("get", 70, 99, 0.0, True), ("left", 99, 99, 0.0, False)}
    (c,) = rows(analysis.recording.coverage, "pairs")
    assert (c["unread"], c["unpaired"], c["censored"]) == (1, 1, 2)
    assert {r["rule"] for r in rows(analysis.silences, "pairs")} == {"repeated work", "dead wait", "off-path dominance", "in flight while waiting"}


def test_refusals_keep_every_recording(analysis):
    why = {r["trace_id"]: r["because"] for r in analysis.refusals.collect()}
    assert why["bad"].startswith("not JSON")
    assert "refused" in report(analysis, "bad") and "dead wait" not in report(analysis, "bad")
    assert "steps" in report(analysis, "repeat")


def test_response(spark):
    a = analyse_recording(recorded(spark, click=CLICK, quiet=REPEAT), "response")
    (r,) = rows(a.responses, "click")
    assert (r["elapsed"], r["working"], r["waiting"], r["exact"], len(r["chain"])) == (2_000, 600, 1_400, False, 2)
    assert {x["trace_id"] for x in a.refusals.collect()} == {"quiet"}


def timed(ts, ident, kind, interaction, began, start, end, latency):
    common = {"cat": "c", "name": "EventTiming", "id": ident, "pid": 1, "tid": 1}
    data = {"type": kind, "interactionId": interaction, "timeStamp": began, "processingStart": start, "processingEnd": end, "duration": latency}
    return [{**common, "ph": "b", "ts": ts, "args": {"data": data}}, {**common, "ph": "e", "ts": ts + int(latency * 1000)}]


def test_stated_interaction(spark):
    events = [*timed(1_000, "1", "pointerdown", 7, 10.0, 10.5, 10.75, 100.0), *timed(2_000, "2", "click", 7, 11.0, 11.5, 12.0, 90.0), *timed(3_000, "3", "mousedown", 0, 12.0, 12.1, 12.2, 50.0)]
    events += [x("RunTask", 20_000, 5_000), x("RunTask", 30_000, 6_000), x("RunTask", 105_000, 50_000)]
    a = analyse_recording(recorded(spark, t=events), "response")
    (r,) = rows(a.responses, "t")
    assert (r["kind"], r["elapsed"], r["exact"], r["working"], r["waiting"], len(r["chain"])) == ("pointerdown", 100_000, True, 11_000, 89_000, 2)
    assert r["phases"].asDict() == {"input_delay": 500, "processing": 250, "presentation_delay": 99_250, "latency": 100_000}


def test_marks(spark):
    def mark(ts, tid=1, **args):
        return {"ph": "I", "name": "m", "cat": "net", "s": "g", "pid": 1, "tid": tid, "ts": ts, "args": args}

    r = recorded(spark, t=[x("A", 0, 1_000), mark(100, id=5, url="u"), mark(400, id=5, status=200), mark(200, code=1, id=6), mark(300, code=1, id=7)])
    got = {(a["name"], a["start"], a["end"], a["subject"]) for a in rows(r.activities.where("inferred"), "t")}
    assert got == {("id", 100, 400, 'id=5\u0001status=200\u0001url="u"')}
