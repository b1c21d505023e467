"""Running values in slices against a walk."""

import random

from pyspark.sql import functions as F

from tracepath.operators.scan import scan


def test_equal_to_a_walk(spark):
    r = random.Random(1)
    rows = [(g, i, r.choice([None, r.randint(-50, 50)])) for g, n in (("big", 900), ("a", 1), ("b", 30), (None, 12)) for i in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(5)
    out = scan(df, ("g",), [F.desc("i")], slices=7, top=("max", F.col("v")), low=("min", F.col("v")), n=("sum", F.lit(1).cast("long")), total=("sum", F.col("v")))
    got = {(x.g, x.i): (x.top, x.low, x.n, x.total) for x in out.collect()}
    assert out.columns == ["g", "i", "v", "top", "low", "n", "total"] and len(got) == len(rows)
    for g in ("big", "a", "b", None):
        seen, n = [], 0
        for _, i, v in sorted((x for x in rows if x[0] == g), key=lambda x: -x[1]):
            seen += [v] if v is not None else []
            n += 1
            expected = (max(seen), min(seen), n, sum(seen)) if seen else (None, None, n, None)
            if g is not None:
                assert got[g, i] == expected


def test_a_large_group_is_cut(spark):
    df = spark.range(20_000).selectExpr("'t' AS g", "id AS i")
    out = scan(df, ("g",), [F.col("i")], slices=8, n=("sum", F.lit(1).cast("long")))
    assert out.where("n = i + 1").count() == 20_000
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert scan(df.where("i < 0"), ("g",), [F.col("i")], n=("sum", F.lit(1))).count() == 0
    assert len(sizes) >= 1
