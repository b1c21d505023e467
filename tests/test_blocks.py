"""Forests by doubled pointers, and rules over tables of blocks, against plain walks."""

import random

from tracepath.operators import blocks as b
from tracepath.operators import forest
from tracepath.functions import columns as C

NODES = "trace_id string, node long, parent long, marked boolean"


def walk(parents, marked, node):
    seen, depth = set(), 0
    while node in parents and node not in seen:
        if marked[node]:
            return node, depth
        seen.add(node)
        node, depth = parents[node], depth + 1
    return None, None


def test_nearest_marked_equals_a_walk(spark):
    r = random.Random(1)
    rows = []
    for t in range(6):
        n = r.randint(1, 60)
        for i in range(n):
            parent = r.choice([None, *range(i)]) if t < 4 else r.randrange(n + 3)  # the last two have cycles and parents without a row
            rows.append((f"t{t}", i, parent, r.random() < 0.2))
    got = {(x.trace_id, x.node): (x.found, x.depth) for x in forest.nearest_marked(spark.createDataFrame(rows, NODES)).collect()}
    for t in range(6):
        parents = {i: p for x, i, p, _ in rows if x == f"t{t}"}
        marked = {i: m for x, i, _, m in rows if x == f"t{t}"}
        assert {i: got[f"t{t}", i] for i in parents} == {i: walk(parents, marked, i) for i in parents}
    assert forest.nearest_marked(spark.createDataFrame([], NODES)).collect() == []


def test_a_chain_of_a_hundred_thousand_takes_seventeen_rounds_and_leaves_one(spark, monkeypatch):
    rounds, kept = [], []
    forgotten = []
    monkeypatch.setattr(forest, "cut", lambda df, cut=forest.cut: kept.append(cut(df)) or kept[-1])
    monkeypatch.setattr(forest, "forget", lambda df, forget=forest.forget: forgotten.append(df) or forget(df))
    n = 100_000
    chain = spark.range(n).selectExpr("'t' AS trace_id", "id AS node", "CASE WHEN id > 0 THEN id - 1 END AS parent", "id = 0 AS marked")
    found = forest.nearest_marked(chain)
    rounds = len(kept) - 1
    assert rounds <= 17 and len(forgotten) == rounds
    assert found.where("found = 0 AND depth = node").count() == n


def blocks_of(spark, rows):
    """(file, node, parent, kind, line, end_line), in the order of opening."""
    return spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "file_id string, node long, parent long, kind string, line long, end_line long, opened long")


def test_labels_and_subtrees_equal_a_walk(spark):
    r = random.Random(2)
    rows = []
    for f in range(5):
        stack, line = [0], 1
        rows.append([f"f{f}", 0, None, "File", 0, 999])
        mine = {0: rows[-1]}
        for node in range(1, r.randint(2, 50)):
            while len(stack) > 1 and r.random() < 0.4:
                line += 1
                mine[stack.pop()][5] = line
            line += r.randint(0, 2)
            rows.append([f"f{f}", node, stack[-1], r.choice(["Repeat", "Repeat", "Define", "Plain"]), line, 999])
            mine[node] = rows[-1]
            stack.append(node)
    tree = b.block_tree(blocks_of(spark, rows))
    got = {(x.file_id, x.node): x for x in tree.collect()}
    by = {(x[0], x[1]): x for x in rows}

    def up(f, node):
        while node is not None:
            yield node
            node = by[f, node][2]

    inside = set()
    for f, node in by:
        path = list(up(f, node))
        home = next(a for a in path if by[f, a][3] in ("Define", "File"))
        x = got[f, node]
        below = [m for g, m in by if g == f and node in up(f, m)]
        assert (x.depth, x.home, x.close - x.open) == (len(path), home, len(below) - 1)
        assert x.repeats == sum(by[f, a][3] == "Repeat" for a in path[: path.index(home)])
        for a in path:
            if by[f, a][3] == "Repeat":
                inside.add((f, a, node))
            if by[f, a][3] in ("Define", "File"):
                break
    assert {tuple(x) for x in b.subtrees(tree, tree.where("kind = 'Repeat'")).collect()} == inside


HEADS, ASSIGNED = "file_id string, node long, name string", "file_id string, line long, name string"
CALLS = "file_id string, call_id long, within long, name string, args string, line long, fresh boolean, allocates boolean"
MENTIONS = "file_id string, call_id long, name string"


def test_planted_calls_and_their_clean_twins(spark):
    # f: a routine with a loop over i, and in that a loop over j; g: a routine inside the loop, which is none of its own
    tree = b.block_tree(blocks_of(spark, [("a", 0, None, "File", 1, 40), ("a", 1, 0, "Define", 2, 30), ("a", 2, 1, "Repeat", 3, 25), ("a", 3, 2, "Repeat", 5, 9), ("a", 4, 2, "Define", 10, 14), ("a", 5, 4, "Repeat", 11, 13), ("a", 6, 2, "Plain", 15, 18)]))
    heads = spark.createDataFrame([("a", 2, "i"), ("a", 3, "j"), ("a", 5, "m"), ("a", 4, "p"), ("b", 3, "q")], HEADS)
    assigned = spark.createDataFrame([("a", 20, "sum"), ("a", 28, "out"), ("b", 20, "fixed")], ASSIGNED)
    calls = [
        ("a", 1, 2, "load", "fixed", 4, False, False), ("a", 2, 2, "load", "i", 4, False, False), ("a", 3, 2, "make", "fixed", 6, False, True), ("a", 4, 2, "draw", "i {", 7, True, False), ("a", 5, 2, "draw", "fixed {", 8, True, False),
        ("a", 6, 3, "load", "i", 6, False, False), ("a", 7, 6, "load", "sum", 16, False, False), ("a", 8, 6, "load", "out", 17, False, False), ("a", 9, 5, "load", "i", 12, False, False), ("a", 10, 2, "i", "", 19, False, False), ("a", 11, 1, "load", "fixed", 29, False, False), ("a", 12, 2, "load", "j", 21, False, False),
    ]
    calls = spark.createDataFrame(calls, CALLS)
    mentions = spark.createDataFrame([("a", 1, "fixed"), ("a", 2, "i"), ("a", 3, "fixed"), ("a", 4, "i"), ("a", 5, "fixed"), ("a", 6, "i"), ("a", 7, "sum"), ("a", 8, "out"), ("a", 9, "i"), ("a", 11, "fixed"), ("a", 12, "j")], MENTIONS)
    judged = b.calls_by_loop(tree, heads, assigned, calls, mentions)
    assert {(x.call_id, x.root): x.depends for x in judged.collect()} == {
        (1, 2): False, (2, 2): True, (3, 2): False, (4, 2): True, (5, 2): False, (6, 2): True, (6, 3): True, (7, 2): True, (8, 2): False, (9, 5): True, (10, 2): True, (12, 2): True,
    }
    assert {(x.rule, x.line, x.name) for x in b.within_loops(judged).collect()} == {("InvariantCall", 4, "load"), ("InvariantAllocation", 6, "make"), ("IdentityChurn", 7, "draw"), ("InvariantCall", 8, "draw"), ("InvariantCall", 17, "load")}
    varying = {(x.root, x.name) for x in b.varying_names(tree, heads, assigned).collect()}
    # the head of the loop inside g varies with the loops around g, and not the other way round for what g's loop alone binds
    assert varying == {(2, "i"), (2, "j"), (2, "sum"), (3, "i"), (3, "j"), (5, "i"), (5, "m")}


def test_repeated_calls_equal_a_scan(spark):
    r = random.Random(4)
    calls = sorted((r.choice("ab"), i, r.randint(0, 2), r.choice("fg"), r.choice(["x", "y", ""]), r.randint(1, 12)) for i in range(120))
    calls = [(f, i, w, n, a, line) for i, (f, _, w, n, a, line) in enumerate(sorted(calls, key=lambda c: (c[0], c[5])))]
    assigned = [(f, line, "n") for f in "ab" for line in (2, 2, 5, 9)]
    expected, first = set(), {}
    for f, i, w, n, a, line in calls:
        if (f, w, n, a) in first:
            if not any(g == f and first[f, w, n, a] < x < line for g, x, _ in assigned):
                expected.add(("RepeatedCall", f, line, n))
        else:
            first[f, w, n, a] = line
    got = b.repeated_calls(spark.createDataFrame([(*c, False, False) for c in calls], CALLS), spark.createDataFrame(assigned, ASSIGNED))
    assert {tuple(x) for x in got.collect()} == expected
    one_line = spark.createDataFrame([("a", 1, 0, "f", "", 5, False, False), ("a", 2, 0, "f", "", 5, False, False)], CALLS)
    assert b.repeated_calls(one_line, spark.createDataFrame([("a", 5, "x")], ASSIGNED)).count() == 1  # nothing is strictly between


def test_places_in_code(spark):
    rows = [
        'data.url="https://x/a.js"\u0001data.lineNumber=12\u0001data.columnNumber=0\u0001data.functionName="go"', 'url=""\u0001lineNumber=1\u0001columnNumber=1', "url=a\u0001lineNumber=1", "url=a\u0001lineNumber=-1\u0001columnNumber=1",
        "url=a\u0001lineNumber=4294967296\u0001columnNumber=1", "url=a\u0001x.url=b\u0001lineNumber=1\u0001lineNumber=7\u0001columnNumber=4294967295", "nothing", "url=a=b\u0001lineNumber=99999999999999999999999\u0001columnNumber=2", None, 'url=a=b\u0001lineNumber=2\u0001columnNumber=3\u0001',
    ]
    sites = spark.createDataFrame([(x,) for x in rows], "s string").select(C.site_of(C.F.col("s")).alias("x")).collect()
    assert [tuple(x.x) if x.x else None for x in sites] == [("https://x/a.js", 12, 0, "go"), None, None, None, None, ("b", 7, 4294967295, ""), None, None, None, ("a=b", 2, 3, "")]


def test_block_tree_is_one_pass(spark):
    """F21 F23 F24: rounds of pointers, each a join and a checkpoint, took most of what the loop queries took."""
    n = 300
    rows = [("a", 0, None, "File", 0, 0), *[("a", i, i - 1, "Define" if i == 100 else "Repeat", 0, 0) for i in range(1, n)], ("a", n, 0, "Plain", 0, 0), ("b", 0, None, "Repeat", 0, 0), ("b", 1, 0, "Plain", 0, 0)]
    sc = spark.sparkContext
    sc.setJobGroup("one pass", "")
    tree = b.block_tree(blocks_of(spark, rows))
    jobs = len(sc.statusTracker().getJobIdsForGroup("one pass"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    got = {(r["file_id"], r["node"]): (r["open"], r["close"], r["depth"], r["home"], r["repeats"]) for r in tree.collect()}
    assert len(got) == len(rows)
    assert all(got["a", i] == (i, n - 1, i + 1, 100 if i >= 100 else 0, i - 100 if i >= 100 else i) for i in range(1, n))
    assert got["a", 0] == (0, n, 1, 0, 0) and got["a", n] == (n, n, 2, 0, 0)
    assert got["b", 0] == (0, 1, 1, None, 1) and got["b", 1] == (1, 1, 2, None, 1)
    assert jobs <= 2
