import math

import numpy as np
import pytest

from tracepath.llm.whitening import components, deviations, differences, whiten, whole_numbers

SCHEMA = "label int, vec_id long, embedding array<float>, n string, v int"


def by_hand(vectors: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors.values()], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    centred = (n * x - s).astype(float) / n
    return deviation, centred, centred.T @ centred / n


@pytest.mark.parametrize("tile", [3, 128])
def test_whitening_equals_the_whole_matrix(spark, tile):
    r = np.random.default_rng(1)
    good = {i: (r.normal(size=40) @ np.diag(np.linspace(0.05, 0.6, 40))).astype(np.float32).tolist() for i in range(300)}
    good[300] = good[7]  # a repeated vector
    bad = [(0, 400, None, "", 1), (0, 401, [None] + good[0][1:], "", 1), (0, 402, [float("nan")] + good[0][1:], "", 1), (0, 403, [float("-inf")] + good[0][1:], "", 1), (0, 404, [], "", 1), (0, 405, good[0][:39], "", 1)]
    table = spark.createDataFrame([(None, i, v, "x", None) for i, v in good.items()] + bad, SCHEMA).repartition(7)
    rows = whiten(table, tile=tile).collect()
    deviation, centred, v = by_hand(good)
    e, vectors = np.linalg.eigh(v)
    assert len(rows) == 301 * 32 and {r.n for r in rows} == {301}
    w = np.zeros((301, 32))
    for row in rows:
        at = list(good).index(row.vec_id)
        assert row.deviation == deviation[at]
        assert row.explained == pytest.approx(e[-row.component] / v.trace(), rel=1e-9)
        w[at, row.component - 1] = row.whitened
    for k in range(32):
        mine = centred @ vectors[:, -1 - k] / math.sqrt(e[-1 - k])
        sign = np.sign(mine @ w[:, k])
        assert np.allclose(w[:, k], sign * mine, atol=1e-9)
    assert np.abs(w.T @ w / 301 - np.eye(32)).max() < 1e-9
    assert len({r.identity_error for r in rows}) == 1 and 0 <= rows[0].identity_error < 1e-9


def test_few_dimensions_null_ids_and_tables_without_directions(spark):
    some = spark.createDataFrame([(1, None, [0.1, 0.2], "", 0), (1, None, [0.9, -0.4], "", 0), (1, 5, [0.3, 0.3], "", 0)], SCHEMA)
    rows = whiten(some).collect()
    assert sorted(r.component for r in rows) == [1, 1, 1, 2, 2, 2] and sum(r.vec_id is None for r in rows) == 4
    assert whiten(some.where("label = 2")).collect() == []
    assert whiten(some.where("vec_id = 5")).collect() == []  # one vector has no direction
    flat = spark.createDataFrame([(1, i, [0.5, i / 8], "", 0) for i in range(4)], SCHEMA)
    assert {r.component for r in whiten(flat).collect()} == {1}  # one dimension doesn't vary


def test_integers_are_exact_at_any_size():
    import pyarrow as pa

    assert whole_numbers(pa.array([[0.5, -0.015625], [1e30, -1e30]])).tolist() == [[32, -1], [1 << 62, -(1 << 62)]]
    y = np.array([[1 << 40, 3], [5, 7]])
    d = differences(y, 2, [5 + (1 << 40), 10])
    assert d.tolist() == [[(1 << 40) - 5, -4], [5 - (1 << 40), 4]]
    assert deviations(d) == [None, None]
    assert deviations(np.array([[3_000_000_000, 1]])) == [9 * 10**18 + 1]
    assert differences(y, 1 << 30, [1, 1]).tolist()[0] == [(1 << 70) - 1, 3 * (1 << 30) - 1]


def test_eigenvalues_of_rounding_are_left_out():
    e, v = components(np.diag([4.0, 0.0, 9.0]), 32)
    assert e.tolist() == [9, 4] and np.allclose(np.abs(v), [[0, 1], [0, 0], [1, 0]])


def test_the_query_reads_every_vector(spark):
    from tracepath.llm.whitening import op11_whitening

    d = "/root/testdata/sf0.001"
    out = op11_whitening(spark, d)
    assert out.select("vec_id").distinct().count() == spark.read.parquet(f"{d}/embeddings.parquet").count()
