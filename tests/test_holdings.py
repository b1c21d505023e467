"""Dominators and plans against their definitions on random graphs."""

import random
from itertools import combinations

from tracepath.operators import holdings as h


def reach(n, out, entry, without=-1):
    seen, todo = {entry} - {without}, [entry] if entry != without else []
    while todo:
        for t in out[todo.pop()]:
            if t not in seen and t != without:
                seen.add(t)
                todo.append(t)
    return seen


def graphs():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(1, 9)
        yield n, [sorted({r.randrange(n) for _ in range(r.randint(0, 3))}) for _ in range(n)], [r.randint(0, 9) for _ in range(n)]


def test_dominators():
    for n, out, _ in graphs():
        idom, order = h.dominators(n, 0, out)
        assert set(order) == reach(n, out, 0) and all((d >= 0) == (v in order) for v, d in enumerate(idom))
        for v in set(order) - {0}:
            over = [d for d in order if d != v and v not in reach(n, out, 0, d)]
            assert idom[v] in over and all(d == idom[v] or idom[v] not in reach(n, out, 0, d) for d in over)


def test_plan_is_the_best():
    for n, out, weight in graphs():
        idom, order = h.dominators(n, 0, out)
        kids = [[] for _ in range(n)]
        for v in order[1:]:
            kids[idom[v]].append(v)
        retained = list(weight)
        for v in reversed(order[1:]):
            retained[idom[v]] += retained[v]

        def above(v):
            while v:
                v = idom[v]
                yield v

        for budget in range(4):
            sets = [c for k in range(budget + 1) for c in combinations(order[1:], k) if not any(a in above(b) for a in c for b in c)]
            best = max(sum(retained[v] for v in c) for c in sets)
            chosen, frees, margin = h.best_cuts(kids, 0, retained, budget)
            assert frees == best == sum(retained[v] for v in chosen) and len(chosen) <= budget and margin >= 0


def literal(children, root, retained, budget):
    """By the definition: best[v][k] and who is cut, the first of equals in the order in which shares are tried."""

    def solve(v, k):
        spread = [(0, [])] * (k + 1)
        for c in children[v]:
            new = []
            for j in range(k + 1):
                options = [(spread[j - give][0] + solve(c, give)[0], spread[j - give][1] + solve(c, give)[1]) for give in range(j + 1)]
                new.append(max(options, key=lambda o: o[0]))
            spread = new
        if v != root and k and retained[v] > spread[k][0]:
            return retained[v], [v]
        return spread[k]

    return sorted(solve(root, budget)[1])


def test_ties_go_to_what_is_below_and_to_earlier_children():
    assert h.best_cuts([[1], [2], []], 0, [5, 5, 5], 1)[0] == [2]
    assert h.best_cuts([[1, 2], [], []], 0, [0, 4, 4], 1)[0] == [1]
    assert h.best_cuts([[1], []], 0, [0, 0], 3) == ([], 0, 0)
    r = random.Random(3)
    for _ in range(80):
        n = r.randint(1, 7)
        children = [[] for _ in range(n)]
        for v in range(1, n):
            children[r.randrange(v)].append(v)
        retained = [r.choice([0, 0, 1, 2]) for _ in range(n)]
        for v in range(n - 1, 0, -1):
            for c in children[v]:
                retained[v] += retained[c]
        for budget in range(4):
            assert sorted(h.best_cuts(children, 0, retained, budget)[0]) == literal(children, 0, retained, budget)


def test_hold(spark):
    c = spark.createDataFrame([("r", "app", 1, True), ("r", "a", 10, False), ("r", "b", 5, False), ("r", "shared", 7, False), ("r", "lost", 3, False)], "repo_id string, component string, weight long, owned boolean")
    d = spark.createDataFrame([("r", "app", "a"), ("r", "app", "b"), ("r", "a", "shared"), ("r", "b", "shared"), ("r", "b", "absent")], "repo_id string, source string, target string")
    held = {x["component"]: x for x in h.hold(c, d, "app").collect()}
    assert {k: v["retained"] for k, v in held.items()} == {"app": 23, "a": 10, "b": 5, "shared": 7, "lost": 0}
    assert [x["component"] for x in h.unreachable(h.hold(c, d, "app")).collect()] == ["lost"]
    assert {x["component"] for x in h.removal_plan(c, d, "app", 2).collect()} == {"a", "shared"}


def test_no_repository_is_one_group(spark):
    """Dominators, weights and plans of random graphs, cycles and absent components included, against one graph at a time."""
    r = random.Random(5)
    comps, decls, want, plans, lost = [], [], set(), set(), set()
    for g, (n, out, weight) in enumerate(graphs()):
        weight = [w if r.random() < 0.6 else 0 for w in weight]
        repo, name = f"r{g}", [f"n{i}" for i in range(n)]
        comps += [(repo, name[i], weight[i], False) for i in range(n)]
        decls += [(repo, name[i], name[t]) for i in range(n) for t in out[i]] + [(repo, "n0", "absent")]
        idom, order = h.dominators(n, 0, out)
        retained = [w if d >= 0 else 0 for w, d in zip(weight, idom)]
        for v in reversed(order[1:]):
            retained[idom[v]] += retained[v]
        want |= {(repo, name[i], d >= 0, name[d] if d >= 0 and i else None, retained[i]) for i, d in enumerate(idom)}
        lost |= {(repo, name[i]) for i, d in enumerate(idom) if d < 0}
        if n - 1 not in reach(n, out, 0):
            decls.append((repo, "absent", name[-1]))
        kids = [sorted(v for v in order[1:] if idom[v] == i) for i in range(n)]
        chosen, frees, margin = h.best_cuts(kids, 0, retained, 2)
        plans |= {(repo, name[i], retained[i], frees, margin) for i in chosen}
    c = spark.createDataFrame(comps, "repo_id string, component string, weight long, owned boolean")
    d = spark.createDataFrame(decls, "repo_id string, source string, target string")
    held = h.hold(c, d, "n0")
    assert {(x["repo_id"], x["component"], x["reachable"], x["dominator"], x["retained"]) for x in held.collect()} == want
    assert {(x["repo_id"], x["component"]) for x in h.unreachable(h.reachable(c, d, "n0")).collect()} == lost
    assert {tuple(x) for x in h.removal_plan(c, d, "n0", 2).collect()} == plans
    for frame in (held, h.reachable(c, d, "n0"), h.removal_plan(c, d, "n0", 2)):  # groups are of pruned plans at most
        assert "FlatMapCoGroupsInPandas" not in frame._jdf.queryExecution().toString()


def test_declarations_are_read_twice(spark):
    """Once for what declares something, once to part them: large tables are not dealt again for each step."""
    read = spark.sparkContext.accumulator(0)

    def counted(row):
        read.add(1)
        return row

    rows = [("r", "app", f"a{i}") for i in range(20)] + [("r", f"a{i}", f"p{i // 2}") for i in range(20)] + [("r", f"a{i}", "q") for i in range(9)]
    c = spark.createDataFrame([("r", x, 1, x == "app") for x in sorted({x for _, s, t in rows for x in (s, t)})], "repo_id string, component string, weight long, owned boolean")
    d = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(counted), "repo_id string, source string, target string")
    held = {x["component"]: x["retained"] for x in h.hold(c, d, "app").collect()}
    assert held["app"] == 32 and held["q"] == 1 and {held[f"a{i}"] for i in range(20)} == {1} and read.value <= 2 * len(rows)
    h.removal_plan(c, d, "app", 2).collect()
    assert read.value <= 4 * len(rows)
