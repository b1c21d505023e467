"""The order tables as routines: customers call their orders, orders the parts on their lines, a part the one of half its number.

Some parts call one of twice their number, which calls them; some share a name, so no call reaches them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepath.operators import growth
from tracepath.plans.session import cut, keep


def routines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """symbols and calls; symbol_id is the number times 3, and the kind's number."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")

    def symbol(key: str, kind: int, name, own):
        return F.col(key).cast("long") * 3 + kind, name, own.cast("long")

    def rows(df: DataFrame, *columns) -> DataFrame:
        return df.select(*columns)

    p_name = F.when(F.col("p_partkey") % 211 == 0, "dup").otherwise(F.concat(F.lit("p"), "p_partkey"))
    symbols = rows(orders.select("o_custkey").distinct(), *symbol("o_custkey", 0, F.concat(F.lit("c"), "o_custkey"), F.lit(0)))
    symbols = symbols.union(rows(orders, *symbol("o_orderkey", 1, F.concat(F.lit("o"), "o_orderkey"), F.col("o_orderkey") % 2)))
    symbols = symbols.union(rows(parts, *symbol("p_partkey", 2, p_name, F.col("p_size") % 3))).toDF("symbol_id", "name", "own")
    half, twice = F.floor(F.col("p_partkey") / 2).cast("long"), F.col("p_partkey") * 2 + 1
    calls = orders.select(F.col("o_custkey").cast("long") * 3, F.concat(F.lit("o"), "o_orderkey"), F.col("o_orderpriority").startswith("1").cast("long"), (F.col("o_orderkey") % 1000).cast("long"))
    calls = calls.union(lines.select(F.col("l_orderkey").cast("long") * 3 + 1, F.concat(F.lit("p"), "l_partkey"), (F.col("l_linenumber") % 2).cast("long"), F.col("l_linenumber").cast("long")))
    calls = calls.union(parts.where("p_partkey > 0").select(F.col("p_partkey").cast("long") * 3 + 2, F.concat(F.lit("p"), half), (F.col("p_partkey") % 2).cast("long"), F.lit(1).cast("long")))
    calls = calls.union(parts.where("p_partkey % 500 = 499").select(F.col("p_partkey").cast("long") * 3 + 2, F.concat(F.lit("p"), twice), F.lit(0).cast("long"), F.lit(2).cast("long"))).toDF("symbol_id", "callee", "depth", "line")
    return symbols, calls


def _solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.degrees(*routines(spark, sf_dir))


def routine_degrees(spark, d):
    return _solved(spark, d)


def growth_spots(spark, d):
    symbols, calls = routines(spark, d)
    return growth.growth_spots(symbols, growth.degrees(symbols, calls))


def growth_innermost(spark, d):
    return growth.innermost(cut(_solved(spark, d)))


def growth_chains(spark, d):
    return growth.chains(keep(_solved(spark, d)))


def never_called(spark, d):
    symbols, calls = routines(spark, d)
    return growth.never_called(symbols, calls, symbols.where("symbol_id % 7 = 0").select("name"))


QUERIES = {f.__name__: f for f in (routine_degrees, growth_spots, growth_innermost, growth_chains, never_called)}

_CALLS = """
s AS MATERIALIZED (
  SELECT o_custkey * 3 AS id, 'c' || o_custkey AS name, 0 AS own FROM (SELECT DISTINCT o_custkey FROM orders) UNION ALL SELECT o_orderkey * 3 + 1, 'o' || o_orderkey, o_orderkey % 2 FROM orders
  UNION ALL SELECT p_partkey * 3 + 2, CASE WHEN p_partkey % 211 = 0 THEN 'dup' ELSE 'p' || p_partkey END, p_size % 3 FROM part),
k AS MATERIALIZED (
  SELECT o_custkey * 3 AS id, 'o' || o_orderkey AS callee, (o_orderpriority[1] = '1')::INT AS depth, o_orderkey % 1000 AS line FROM orders
  UNION ALL SELECT l_orderkey * 3 + 1, 'p' || l_partkey, l_linenumber % 2, l_linenumber FROM lineitem
  UNION ALL SELECT p_partkey * 3 + 2, 'p' || (p_partkey // 2), p_partkey % 2, 1 FROM part WHERE p_partkey > 0
  UNION ALL SELECT p_partkey * 3 + 2, 'p' || (p_partkey * 2 + 1), 0, 2 FROM part WHERE p_partkey % 500 = 499)"""
_DEGREES = f"""{_CALLS},
e AS MATERIALIZED (SELECT k.id, s.id AS callee, depth, line FROM k JOIN (SELECT name, min(id) AS id FROM s GROUP BY 1 HAVING count(*) = 1) s ON s.name = k.callee),
pe AS MATERIALIZED (SELECT DISTINCT id, callee, depth FROM e WHERE id % 3 = 2),
reach(id, top) AS (SELECT id, callee FROM pe UNION SELECT r.id, pe.callee FROM reach r JOIN pe ON pe.id = r.top),
cyclic AS MATERIALIZED (SELECT id FROM reach WHERE id = top),
lost AS MATERIALIZED (SELECT id FROM cyclic UNION SELECT id FROM reach WHERE top IN (SELECT id FROM cyclic)),
paths(id, top, w) AS (SELECT id, id, 0 FROM s WHERE id % 3 = 2 AND id NOT IN (SELECT id FROM lost) UNION ALL SELECT p.id, pe.callee, p.w + pe.depth FROM paths p JOIN pe ON pe.id = p.top),
d2 AS MATERIALIZED (SELECT p.id, max(w + own) AS degree FROM paths p JOIN s ON s.id = p.top GROUP BY 1 UNION ALL SELECT id, NULL FROM lost),
d1 AS MATERIALIZED (
  SELECT s.id, CASE WHEN count(e.callee) > count(d2.degree) THEN NULL ELSE greatest(s.own, coalesce(max(e.depth + d2.degree), 0)) END AS degree FROM s LEFT JOIN e ON e.id = s.id LEFT JOIN d2 ON d2.id = e.callee WHERE s.id % 3 = 1 GROUP BY s.id, s.own),
d0 AS MATERIALIZED (
  SELECT s.id, CASE WHEN count(e.callee) > count(d1.degree) THEN NULL ELSE greatest(s.own, coalesce(max(e.depth + d1.degree), 0)) END AS degree FROM s LEFT JOIN e ON e.id = s.id LEFT JOIN d1 ON d1.id = e.callee WHERE s.id % 3 = 0 GROUP BY s.id, s.own),
d AS MATERIALIZED (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2),
b AS MATERIALIZED (SELECT e.id, arg_max({{'v': e.callee, 'l': e.line}}, (e.depth + d.degree, -e.line, -e.callee)) AS x, max(e.depth + d.degree) AS m FROM e JOIN d ON d.id = e.callee WHERE d.degree IS NOT NULL GROUP BY 1),
solved AS MATERIALIZED (
  SELECT s.id AS symbol_id, s.name, CAST(d.degree AS BIGINT) AS degree, CASE WHEN b.m > s.own AND d.degree IS NOT NULL THEN b.x.v END AS through, CASE WHEN b.m > s.own AND d.degree IS NOT NULL THEN b.x.l END AS line
  FROM s JOIN d USING (id) LEFT JOIN b USING (id)),
walk(symbol_id, step, top, line, through) AS (
  SELECT symbol_id, 0, symbol_id, line, through FROM solved WHERE degree IS NOT NULL UNION ALL SELECT w.symbol_id, w.step + 1, x.symbol_id, x.line, x.through FROM walk w JOIN solved x ON x.symbol_id = w.through)"""


def _sql(select: str) -> str:
    return f"WITH RECURSIVE {_DEGREES} {select}"


SQL = {
    "routine_degrees": _sql("SELECT symbol_id, degree, through, line FROM solved"),
    "growth_spots": _sql("SELECT symbol_id, name, CASE WHEN degree IS NULL THEN 'UnboundedGrowth' WHEN through IS NULL THEN 'NestedGrowth' ELSE 'HiddenGrowth' END AS rule, degree, through, line FROM solved WHERE degree IS NULL OR degree > 1"),
    "growth_innermost": _sql("SELECT symbol_id, top AS innermost, step AS hops FROM walk WHERE through IS NULL"),
    "growth_chains": _sql('SELECT symbol_id, step, top AS "at", line FROM walk'),
    "never_called": f"WITH {_CALLS} SELECT id AS symbol_id, name FROM s WHERE name NOT IN (SELECT callee FROM k) AND name NOT IN (SELECT name FROM s WHERE id % 7 = 0)",
}
