"""Overlaps by blocks against all pairs."""

import random

from pyspark.sql import functions as F

from tracepath.operators.overlaps import blocks_of, blocks_with, overlapping


def test_each_bucket_is_in_one_block(spark):
    r = random.Random(2)
    spans = [(x, x + r.choice([0, 1, 2, 7, 63, 5000])) for x in [0, 1, 2, 3, 60_000, *(r.randrange(60_000) for _ in range(60))]] + [(0, (1 << 16) - 1)]
    rows = spark.createDataFrame(spans, "lo long, hi long").select("lo", "hi", blocks_of(F.col("lo"), F.col("hi")).alias("b"), blocks_with(F.col("lo")).alias("w")).collect()
    for x in rows:
        covered = sorted(v for level, block in x.b for v in (block << level, (block + 1) << level))
        assert covered[0] == x.lo and covered[-1] == x.hi + 1 and covered[1:-1:2] == covered[2::2] and len(x.b) <= 32
        assert sum((level, block) in {tuple(y) for y in x.b} for level, block in x.w) == 1


def test_overlaps_equal_all_pairs(spark):
    r = random.Random(4)

    def some(n):
        out = []
        for i in range(n):
            s = r.choice([r.randint(-50, 50), r.randint(0, 10**12)])
            out.append((f"t{r.randint(0, 2)}", i, s, s + r.choice([1, 5, 40, 10**11])))
        return out

    a, b = some(60), some(80)
    got = overlapping(spark.createDataFrame(a, "trace_id string, i long, start long, end long"), spark.createDataFrame(b, "trace_id string, j long, start long, end long")).collect()
    expected = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    assert sorted((x.i, x.j) for x in got) == expected and expected
