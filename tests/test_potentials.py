"""Longest runs on arrays against a walk in the order of starts."""

import random
import time

import numpy as np
import pytest

from tracepath.operators.potentials import raised, solve_arrays


def walked(start, end, ids, links):
    n = range(len(ids))
    of = {x: i for i, x in enumerate(ids)}
    order = sorted(n, key=lambda i: start[i])
    head, came = {}, {}
    for i in order:
        runs = [(head[of[a]] + max(start[i] - end[of[a]], 0), -a) for a, b in links if of[b] == i]
        best = max(runs, default=(0, None))
        head[i], came[i] = best[0] + end[i] - start[i], None if best[1] is None else -best[1]
    latest = {}
    for i in reversed(order):
        latest[i] = min((latest[of[b]] - (end[of[b]] - start[of[b]]) for a, b in links if of[a] == i), default=max(end))
    free = {i: min((max(start[of[b]] - end[i], 0) for a, b in links if of[a] == i), default=None) for i in n}
    at, chain = max(n, key=lambda i: (end[i], head[i], ids[i])), []
    while at is not None:
        chain.append(at)
        at = of.get(came[at])
    step = {i: k for k, i in enumerate(reversed(chain))}
    return [(ids[i], head[i], came[i], latest[i], free[i], step.get(i)) for i in n]


@pytest.mark.parametrize("seed", range(150))
def test_equal_to_a_walk(seed):
    r = random.Random(seed)
    n = r.randint(1, 40)
    start = [r.randint(0, 60) for _ in range(n)]
    end = [s + r.randint(1, r.choice([4, 30])) for s in start]
    ids = r.sample(range(1000), n)

    def nested(i, j):
        return (start[i] <= start[j] and end[j] <= end[i]) or (start[j] <= start[i] and end[i] <= end[j])

    links = {(ids[i], ids[j]) for i in range(n) for j in range(n) if start[i] <= start[j] and not nested(i, j) and r.random() < r.choice([0.02, 0.1, 0.4])}
    links = sorted(links)
    out = solve_arrays(*(np.array(x) for x in (start, end, ids)), np.array([a for a, _ in links], np.int64), np.array([b for _, b in links], np.int64))
    assert list(zip(*(c.tolist() for c in out.values()))) == walked(start, end, ids, links)


def test_nothing_and_far_times():
    none = np.empty(0, np.int64)
    assert all(len(c) == 0 for c in solve_arrays(none, none, none, none, none).values())
    with pytest.raises(OverflowError):
        raised(np.array([0, 1 << 61]), np.array([0, 3]), none, none, none)


def test_many_rows_of_long_work():
    """A hundred thousand rows of works of years: what a row adds up to has no room 100,000 times in 64 bits."""
    rows, long = 100_000, 10**14
    start = np.concatenate([np.zeros(rows, np.int64), np.full(rows, 2 * long)])
    ids = np.arange(2 * rows)
    links = np.concatenate([ids[:rows], ids[: rows - 1]]), np.concatenate([ids[rows:], ids[rows + 1 :]])
    out = solve_arrays(start, start + long, ids, *links)
    assert (out["head"][rows:] == 3 * long).all() and (out["latest"][:rows] == 2 * long).all() and out["step"].count() == 2


@pytest.mark.parametrize("hops", [1, 2])
def test_a_million_in_a_row_and_links_to_and_fro(hops):
    n = 1_000_000
    ids = np.arange(n)
    start = ids * 10
    began = time.perf_counter()
    out = solve_arrays(start, start + 8, ids, ids[:-hops], ids[hops:])
    assert time.perf_counter() - began < 20
    assert out["head"][-1] == 10 * (n - 1) + 8 - (0 if hops == 1 else 10) and out["step"].count() == n // hops
    # two tracks that hand over to each other all the time: rows along the links, or a round for each
    a, b = ids[: n // 50], ids[: n // 50] + n
    to = np.concatenate([a[:-1:2], b[1:-1:2], a[:-1], b[:-1]]), np.concatenate([b[1::2], a[2::2], a[1:], b[1:]])
    out = solve_arrays(np.concatenate([a * 10, a * 10 + 3]), np.concatenate([a * 10 + 8, a * 10 + 11]), np.concatenate([a, b]), *to)
    assert out["head"].max() > 0
