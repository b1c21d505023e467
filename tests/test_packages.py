"""A small repository on disk."""

import json
import random

from tracepath.operators import holdings, reach
from tracepath.sources import packages


def test_repository(spark, tmp_path):
    def put(path, needs=(), size=0, **more):
        d = tmp_path / path
        d.mkdir(parents=True, exist_ok=True)
        (d / "package.json").write_text(json.dumps({"name": path.rpartition("/")[2] or "app", "dependencies": {n: "1" for n in needs}, **more}))
        (d / "x.js").write_text("y" * size)

    put("", ["a", "member"], workspaces=["packages/*"])
    put("packages/member", ["b"])
    put("node_modules/a", ["b", "gone"], 1000)
    put("node_modules/a/node_modules/b", [], 500)
    put("node_modules/b", [], 300)
    put("node_modules/@s/lost", [], 70)
    comps, decl = packages.read_repository(spark, str(tmp_path))
    assert {(r["source"], r["target"]) for r in decl.collect()} == {("", "node_modules/a"), ("", "packages/member"), ("packages/member", "node_modules/b"), ("node_modules/a", "node_modules/a/node_modules/b")}
    held = {r["component"]: r for r in holdings.hold(comps, decl, "").collect()}
    sizes = {k: v["weight"] for k, v in held.items()}
    assert held["node_modules/a"]["retained"] == sizes["node_modules/a"] + sizes["node_modules/a/node_modules/b"]
    assert held["packages/member"]["owned"] and not held["node_modules/@s/lost"]["reachable"]
    assert [r["component"] for r in holdings.unreachable(holdings.hold(comps, decl, "")).collect()] == ["node_modules/@s/lost"]
    assert 1000 <= sizes["node_modules/a"] < 1100 and 500 <= sizes["node_modules/a/node_modules/b"] < 600


def test_broken_absent_and_nameless_manifests_and_the_census(spark, tmp_path):
    def put(path, text, size=0):
        d = tmp_path / path
        d.mkdir(parents=True, exist_ok=True)
        if text is not None:
            (d / "package.json").write_text(text if isinstance(text, str) else json.dumps(text))
        (d / "x.js").write_text("y" * size)

    put("", {"name": "app", "dependencies": {"a": "1", "gone": "1"}, "workspaces": ["packages/*", "tools/none", "tools/list"]})
    put("packages/good", {"name": "good", "optionalDependencies": {"b": "1"}, "devDependencies": {"c": "1"}})
    put("packages/broken", "{")
    put("packages/nameless", {"dependencies": {"a": "1"}})
    put("packages/bare", None)
    put("tools/list", "[1]")
    put("node_modules/a", {"name": "a"}, 100)
    put("node_modules/b", "not json", 50)
    put("node_modules/c", {"name": "c"}, 30)
    manifests = packages.read_manifests(spark, str(tmp_path))
    why = {r["dir"]: r["because"] for r in packages.problems(manifests).collect()}
    assert sorted(why) == ["packages/broken", "packages/nameless", "tools/list", "tools/none"]
    assert "read" in why["packages/broken"] == why["tools/list"] and "name" in why["packages/nameless"] and "no manifest" in why["tools/none"]
    comps, decl = packages.read_repository(spark, str(tmp_path))
    assert {r["component"] for r in comps.collect()} == {"", "packages/good", "node_modules/a", "node_modules/c"}
    missing = packages.unresolved(manifests, comps, str(tmp_path))
    assert {(r["source"], r["need"]) for r in missing.collect()} == {("", "gone"), ("packages/good", "b")}
    (c,) = packages.census(comps, decl, missing).collect()
    sizes = {r["component"]: r["weight"] for r in comps.collect()}
    assert (c["declared"], c["missing"], c["undeclared"]) == (1, 2, 1) and c["confidence"] == 1 / 3
    assert c["installed"] == sizes["node_modules/a"] + sizes["node_modules/c"] and c["undeclared_weight"] == sizes["node_modules/c"]
    (e,) = packages.entry_of(comps).collect()
    assert e["entry"] is None and "app, good" in e["because"]
    assert [(r["entry"], r["because"]) for r in packages.entry_of(comps, "good").collect()] == [("packages/good", None)]
    assert "nobody" in packages.entry_of(comps, "nobody").collect()[0]["because"]
    assert packages.entry_of(comps.where("NOT owned")).collect()[0]["because"] is not None


def test_no_root(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "package.json").write_text("{}")
    assert [(r["dir"], r["because"]) for r in packages.problems(packages.read_manifests(spark, str(tmp_path))).collect()] == [("", "there is no manifest")]


def test_what_many_entries_reach(spark):
    r = random.Random(3)
    edges, entries = [], []
    for g in ("r", "s"):
        edges += [(g, f"c{r.randrange(90):02}", f"c{r.randrange(90):02}") for _ in range(140)]
        entries += [(g, f"c{i:02}") for i in range(0, 80)]
    got = {}
    for x in reach.reached_from(spark.createDataFrame(edges, "repo_id string, source string, target string"), spark.createDataFrame(entries, "repo_id string, component string")).collect():
        got.setdefault((x["repo_id"], x["component"]), set()).update(64 * x["word"] + b for b in range(64) if x["mask"] >> b & 1)
    expected = {}
    for g in ("r", "s"):
        for i in range(80):
            seen, todo = {f"c{i:02}"}, [f"c{i:02}"]
            while todo:
                u = todo.pop()
                for h, a, b in edges:
                    if h == g and a == u and b not in seen:
                        seen.add(b)
                        todo.append(b)
            for v in seen:
                expected.setdefault((g, v), set()).add(i)
    assert got == expected


def test_census_reads_declarations_thrice(spark):
    """To find what declares something, to part them, and to count them."""
    read = spark.sparkContext.accumulator(0)

    def counted(row):
        read.add(1)
        return row

    rows = [("r", "app", f"a{i}") for i in range(20)] + [("r", f"a{i}", f"p{i // 2}") for i in range(19)] + [("r", "lost", "more")]
    c = spark.createDataFrame([("r", x, 1, x == "app") for x in sorted({x for _, s, t in rows for x in (s, t)})], "repo_id string, component string, weight long, owned boolean")
    d = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(counted), "repo_id string, source string, target string")
    (got,) = packages.census(c, d, spark.createDataFrame([("r", "a1", "x")], "repo_id string, source string, need string")).collect()
    assert tuple(got) == ("r", 40, 1, 40 / 41, 32, 2, 2) and read.value <= 3 * len(rows)
