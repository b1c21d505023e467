"""Reach of several entries: what declares nothing takes no part in the rounds and still gets its bits."""

from tracepath.operators import reach


def test_ends_are_reached_outside_the_rounds(spark):
    d = spark.createDataFrame([("r", "a", "b"), ("r", "b", "a"), ("r", "b", "end"), ("r", "c", "end"), ("s", "a", "end")], "repo_id string, source string, target string")
    e = spark.createDataFrame([("r", "a"), ("r", "c"), ("r", "end"), ("s", "end")], "repo_id string, component string")
    inner = reach.between(d.withColumnRenamed("source", "component"))
    assert sorted(map(tuple, inner.collect())) == [("r", "a", "b"), ("r", "b", "a")]
    got = {(x["repo_id"], x["component"]): x["entries"] for x in reach.entries_reaching(reach.reached_from(d, e)).collect()}
    assert got == {("r", "a"): 1, ("r", "b"): 1, ("r", "c"): 1, ("r", "end"): 3, ("s", "end"): 1}
