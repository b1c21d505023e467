"""Source maps: numbers, index maps, calibration and proof."""

import json
import random

import pytest

from tracepath.operators import placement as p
from tracepath.operators.ingest import record
from tracepath.plans.analyse import analyse_recording
from tracepath.plans.report import report
from tracepath.sources import source_maps as m
from tracepath.sources.trace_events import parse_texts


def encode(*values):
    out = ""
    for v in values:
        v = abs(v) << 1 | (v < 0)
        while True:
            out += next(c for c, i in m.DIGITS.items() if i == (v & 31) | (32 if v > 31 else 0))
            v >>= 5
            if not v:
                break
    return out


def test_numbers():
    for values in ([0], [1, -1, 16, -17, 123456], [5, 0, 2**30]):
        assert m.numbers(encode(*values)) == values
    assert m.numbers("A!C") == [0]


SOURCE = "function open() {\n  work();\n}\nfunction layout() {\n}\n"
MAP = {"version": 3, "sources": ["src/App.js", "node_modules/@s/lib/x.js"], "sourceRoot": "root", "sourcesContent": [SOURCE, None], "mappings": ",".join([encode(0, 0, 0, 0), encode(10, 0, 3, 2), encode(20, 1, 0, 0)])}


def test_parse():
    segments, lines = m.parse_map(json.dumps(MAP))
    assert segments == [(0, 0, 0, "root/src/App.js", 0, 0), (0, 10, 0, "root/src/App.js", 3, 2), (0, 30, 1, "root/node_modules/@s/lib/x.js", 3, 2)]
    assert [s[-1] for s in m.spans(segments)] == [2, 3, 3] and lines[1] == (0, 1, "  work();")
    index = {"sections": [{"offset": {"line": 0, "column": 5}, "map": MAP}, {"offset": {"line": 3, "column": 0}, "map": MAP}]}
    both = m.parse_map(json.dumps(index))[0]
    assert [s[:3] for s in both] == [(0, 5, 0), (0, 15, 0), (0, 35, 1), (3, 0, 2), (3, 10, 2), (3, 30, 3)]
    assert m.parse_map("[]") is None and m.parse_map("{") is None


def test_resolve(spark):
    segments, lines = m.parse_maps(spark.createDataFrame([("b.js.map", json.dumps(MAP)), ("bad.js.map", "{")], "map_name string, text string"))
    sites = spark.createDataFrame(
        [("t", 0, "https://x/b.js?v=1", 1, 4, "App.open"), ("t", 1, "https://x/b.js", 1, 12, "layout"), ("t", 2, "https://x/b.js", 1, 40, ""), ("t", 3, "https://x/c.js", 1, 1, "f"), ("t", 4, "https://x/b.js", 9, 1, "open"), ("t", 5, "https://x/b.js", 1, 5, "function")],
        "trace_id string, site_id long, script string, line_number long, column_number long, symbol string",
    )
    told = p.calibrate(sites, segments, lines)
    assert [(r["shift"], r["votes"], r["against"]) for r in told.collect()] == [(1, 3, 1)]
    got = {r["site_id"]: (r["status"], r["source"], r["line"], r["package"]) for r in p.resolve(sites, told, segments, lines).collect()}
    assert got[0] == ("Proved", "root/src/App.js", 1, None) and got[1] == ("Proved", "root/src/App.js", 4, None)
    assert got[2] == ("Derived", "root/node_modules/@s/lib/x.js", 4, "@s/lib") and got[3][0] == "Absent" and got[4][0] == "Unmapped" and got[5][0] == "Proved"
    costs = spark.createDataFrame([("t", i, 10) for i in range(6)], "trace_id string, site_id long, cost long")
    places = p.by_line(p.resolve(sites, told, segments, lines), costs)
    assert {(r["source"], r["line"]): r["cost"] for r in places.collect()}["root/src/App.js", 1] == 20
    assert {r["package"]: r["lines"] for r in p.by_package(places).collect()} == {"@s/lib": 1}


def call(name, ts, dur, line, column, function, url="https://app.test/static/b.js?v=2", tid=1):
    data = {"url": url, "lineNumber": line, "columnNumber": column, "functionName": function}
    return {"ph": "X", "name": name, "cat": "devtools", "pid": 1, "tid": tid, "ts": ts, "dur": dur, "args": {"data": data}}


def plain(name, ts, dur, tid=1):
    return {"ph": "X", "name": name, "cat": "devtools", "pid": 1, "tid": tid, "ts": ts, "dur": dur}


#: Two calls inside a task, layout inside the first, a call in a package, one whose source doesn't name it, one without a map; and the first again.
WORK = [
    plain("Task", 0, 1_000), call("FunctionCall", 100, 400, 1, 4, "App.open"), plain("Layout", 200, 100), call("FunctionCall", 600, 300, 1, 34, "far"),
    call("FunctionCall", 2_000, 50, 1, 12, "ghost"), call("FunctionCall", 3_000, 70, 1, 1, "f", url="https://cdn.test/vendor.js"), call("FunctionCall", 5_000, 400, 1, 4, "App.open"), plain("Idle", 9_000, 10),
    {"ph": "X", "name": "Half", "cat": "devtools", "pid": 1, "tid": 1, "ts": 9_500, "dur": 5, "args": {"data": {"url": "https://app.test/static/b.js", "lineNumber": 1}}},
]


@pytest.fixture(scope="module")
def placed(spark):
    raw = parse_texts(spark.createDataFrame([("w", json.dumps({"traceEvents": WORK})), ("none", json.dumps([plain("Task", 0, 5)]))], "trace_id string, text string"))
    recording = record(raw)
    maps = m.parse_maps(spark.createDataFrame([("b.js.map", json.dumps(MAP))], "map_name string, text string"))
    return analyse_recording(recording, maps=maps), analyse_recording(recording)


def test_each_work_is_where_the_nearest_call_says(placed):
    with_maps, _ = placed
    names = with_maps.recording.activities.select("trace_id", "activity_id", "name", "start")
    at = {r["start"]: r for r in with_maps.isolation.at.join(names, ["trace_id", "activity_id"]).collect()}
    assert sorted(at) == [100, 200, 600, 2_000, 5_000]  # neither the task, nor the script without a map, nor half a place
    assert (at[100]["source"], at[100]["line"], at[100]["depth"], at[100]["proved"]) == ("root/src/App.js", 1, 0, True)
    assert (at[200]["source"], at[200]["line"], at[200]["depth"], at[200]["proved"]) == ("root/src/App.js", 1, 1, True)
    assert (at[600]["package"], at[600]["proved"]) == ("@s/lib", False)
    assert (at[2_000]["line"], at[2_000]["proved"]) == (4, False)  # the source there doesn't name it


def test_lines_are_charged_self_time_and_packages_are_told_apart(placed):
    i = placed[0].isolation
    places = {(r["source"], r["line"]): r for r in i.places.collect()}
    assert (places["root/src/App.js", 1]["cost"], places["root/src/App.js", 1]["calls"]) == (700, 2)  # layout inside is not its own
    assert {r["fixable"] for r in places.values()} == {"Repository", "Dependency"}
    assert [(r["package"], r["cost"], r["lines"], r["calls"]) for r in i.packages.collect()] == [("@s/lib", 300, 1, 1)]
    (n,) = i.counts.collect()
    assert (n["stated"], n["placed"], n["confirmed"], n["agreements"], n["disagreements"]) == (5, 4, 2, 2, 2)


def test_findings_are_placed_and_nothing_else_changes(placed):
    with_maps, without = placed
    assert {tuple(r) for r in with_maps.findings.collect()} == {tuple(r) for r in without.findings.collect()}
    text, same = report(with_maps, "w"), report(without, "w")
    assert "in root/src/App.js:1: function open() {" in text and "App.js:1" not in same.replace('"https', "")
    assert set(same.splitlines()) <= set(text.splitlines())
    again = with_maps.placed(with_maps.findings).where("rule = 'repeated work'").collect()
    assert [(r["source"], r["line"], r["depth"]) for r in again] == [("root/src/App.js", 1, 0)]
    assert report(with_maps, "none") == report(without, "none")


def test_votes_settle_as_in_order(spark):
    r, rows, expected = random.Random(6), [], {}
    for k in range(200):
        votes = [r.choice([0, 0, 1, 1, None]) for _ in range(r.randint(1, 9))]
        shift, n, against = None, 0, 0
        for v in votes:
            n += v is not None
            if v is None or (shift is not None and shift != v):
                against += 1
                shift = shift if v is None else None
            else:
                shift = v
        expected[f"m{k}"] = (shift, n, against)
        rows += [("t", f"m{k}", i, v) for i, v in enumerate(votes)]
    got = p.settle_votes(spark.createDataFrame(rows, "trace_id string, map_name string, site_id long, agreed int"))
    assert {x["map_name"]: (x["shift"], x["votes"], x["against"]) for x in got.collect()} == expected


def test_stated_sites_read_each_subject_once(spark):
    from tracepath.functions import columns as C

    r, rows = random.Random(16), []
    for i in range(1500):
        parts = [r.choice(["data.url=", "url=", "a.b.url=", "xurl=", "lineNumber=", "d.lineNumber=", "data.columnNumber=", "functionName=", "k", "a=url="]) + r.choice(['"s.js"', "7", "+08", "", "x=1", "4294967296", "00000000012", '"a\n.b"']) for _ in range(r.randint(0, 16))]
        rows.append((i, C.SEPARATOR.join(parts)))
    rows.append((1500, None))

    def by_hand(subject):
        leaves = {}
        for part in (subject or "").split(C.SEPARATOR):
            path, equals, value = part.partition("=")
            if equals:
                leaves[path.rpartition(".")[2]] = value
        bare = [v[1:-1] if len(v) > 1 and v[0] == v[-1] == '"' else v for v in (leaves.get("url", ""), leaves.get("functionName", ""))]
        numbers = [int(v) if (v := leaves.get(n, "").removeprefix("+")).isdigit() and int(v) < 1 << 32 else None for n in ("lineNumber", "columnNumber")]
        return None if not bare[0] or None in numbers else (bare[0], *numbers, bare[1])

    acts = spark.createDataFrame([("t", *x) for x in rows], "trace_id string, activity_id long, subject string")
    sites = p.stated_sites(acts.withColumn("subject", p.F.concat("subject", p.F.lit(""))))
    expected = {i: x for i, s in rows if (x := by_hand(s)) is not None}
    assert len(expected) > 20 and {x[1]: tuple(x[2:]) for x in sites.collect()} == expected
    # a filter or a field may not have the expression once more
    assert sites._jdf.queryExecution().optimizedPlan().toString().count("lineNumber=") + sites._jdf.queryExecution().optimizedPlan().toString().count("= lineNumber") == 1
