"""The events as work that states a place in code, and the parts as source maps.

One event in three states script, line, column and a symbol; one in three a script only, which is no place. Part p is what line p / 10 of
script p % 10 was made from; script 3 has no map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepath.functions import columns as C
from tracepath.operators import placement, tracks
from tracepath.plans.driver_tables import _A, _SWEPT, _with, activities
from tracepath.plans.session import cut

SYMBOLS = ("bolt", "ring", "widget", "gear")


def stated(acts: DataFrame) -> DataFrame:
    """The activities with the fields of a place in their subject."""
    k, nth = F.substring("subject", 3, 9).cast("long"), F.col("activity_id") % 3
    url = F.concat(F.lit('data.url="https://x/lib/s'), k % 10, F.lit('.js"'))
    symbol = F.element_at(F.array(*map(F.lit, SYMBOLS)), ((F.col("activity_id") + k) % len(SYMBOLS) + 1).cast("int"))
    whole = F.array(url, F.concat(F.lit("data.lineNumber="), k), F.concat(F.lit("data.columnNumber="), k % 4 + 1), F.concat(F.lit('data.functionName="app.'), symbol, F.lit('"')), F.col("subject"))
    told = F.when(nth == 0, whole).when(nth == 1, F.array(url, F.col("subject"))).otherwise(F.array("subject"))
    return acts.withColumn("subject", F.array_join(told, C.SEPARATOR))


def maps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 10 <> 3")
    name = F.concat(F.lit("s"), F.col("p_partkey") % 10, F.lit(".js.map")).alias("map_name")
    source = F.concat(F.when(F.col("p_size") % 3 == 0, "../node_modules/").otherwise("src/"), F.replace("p_brand", F.lit("#")), F.lit("/index.js")).alias("source")
    line, zero = F.col("p_size").cast("long"), F.lit(0).cast("long")
    at = F.floor(F.col("p_partkey") / 10).cast("long").alias("gen_line")
    segments = p.select(name, at, zero.alias("gen_column"), F.col("p_partkey").cast("long").alias("seq"), F.col("p_partkey").cast("long").alias("source_id"), source, line.alias("line"), zero.alias("column"), line.alias("last_line"))
    return segments, p.select(name, F.col("p_partkey").cast("long").alias("source_id"), line.alias("line"), F.col("p_name").alias("text"))


def isolation(spark: SparkSession, sf_dir: str) -> placement.Isolation:
    a = stated(activities(spark, sf_dir))
    swept = cut(tracks.sweep_tracks(a))
    return placement.isolate(a, swept, tracks.self_times(a, swept), *maps(spark, sf_dir))


def map_calibration(spark, d):
    a = stated(activities(spark, d))
    return placement.calibrate(cut(placement.stated_sites(a)), *maps(spark, d))


def placed_work(spark, d):
    return isolation(spark, d).at.select("trace_id", "activity_id", "depth", "source", "line", "package", "proved")


def cost_by_line(spark, d):
    return isolation(spark, d).places


def cost_by_package(spark, d):
    return isolation(spark, d).packages


def placement_counts(spark, d):
    return isolation(spark, d).counts


QUERIES = {f.__name__: f for f in (map_calibration, placed_work, cost_by_line, cost_by_package, placement_counts)}

#: The innermost work that holds a row entirely, by a walk along each track with what is open at hand.
ENCLOSED = """
tr AS MATERIALIZED (SELECT trace_id, tid, activity_id, "start", "end", row_number() OVER (PARTITION BY trace_id, tid ORDER BY "start", "end" DESC, activity_id) AS rn FROM a WHERE NOT concurrent),
walk(trace_id, tid, rn, activity_id, parent, open_) AS (
  SELECT trace_id, tid, rn, activity_id, NULL::BIGINT, [{'e': "end", 'id': activity_id}] FROM tr WHERE rn = 1
  UNION ALL
  SELECT trace_id, tid, rn, activity_id, CASE WHEN fits THEN kept[-1].id END, CASE WHEN fits OR len(kept) = 0 THEN list_append(kept, {'e': e, 'id': activity_id}) ELSE kept END
  FROM (SELECT *, len(kept) > 0 AND e <= kept[-1].e AS fits FROM (
    SELECT t.trace_id, t.tid, t.rn, t.activity_id, t."end" AS e, list_filter(w.open_, lambda x: x.e > t."start") AS kept FROM walk w JOIN tr t ON t.trace_id = w.trace_id AND t.tid = w.tid AND t.rn = w.rn + 1))),
enclosed AS MATERIALIZED (SELECT a.trace_id, a.activity_id, w.parent FROM a LEFT JOIN walk w USING (trace_id, activity_id))"""
_PLACES = f"""
sites AS MATERIALIZED (SELECT trace_id, activity_id, k, ['{"', '".join(SYMBOLS)}'][(activity_id + k) % {len(SYMBOLS)} + 1] AS symbol FROM (SELECT *, subject[3:]::BIGINT AS k FROM a) WHERE activity_id % 3 = 0),
parts AS MATERIALIZED (SELECT p_partkey % 10 AS script, p_partkey // 10 AS g, (CASE WHEN p_size % 3 = 0 THEN '../node_modules/' ELSE 'src/' END) || replace(p_brand, '#', '') || '/index.js' AS source,
  CASE WHEN p_size % 3 = 0 THEN replace(p_brand, '#', '') END AS package, p_size::BIGINT + 1 AS line, p_name AS text FROM part WHERE p_partkey % 10 <> 3),
votes AS MATERIALIZED (
  SELECT s.trace_id, s.activity_id, s.k % 10 AS script, (SELECT max(v.shift) FROM (VALUES (0), (1)) v(shift) JOIN parts p ON p.script = s.k % 10 AND p.g = s.k - v.shift AND contains(p.text, s.symbol)) AS agreed
  FROM sites s WHERE s.k % 10 IN (SELECT script FROM parts)),
folded AS (
  SELECT trace_id, script, list_reduce(list_prepend({{'v': NULL::INTEGER, 's': NULL::INTEGER, 'n': 0::BIGINT, 'x': 0::BIGINT}}, list({{'v': agreed::INTEGER, 's': NULL::INTEGER, 'n': 0::BIGINT, 'x': 0::BIGINT}} ORDER BY activity_id)),
    lambda acc, e: {{'v': NULL::INTEGER, 's': CASE WHEN e.v IS NULL THEN acc.s WHEN acc.s IS NOT NULL AND acc.s <> e.v THEN NULL ELSE e.v END,
      'n': acc.n + CASE WHEN e.v IS NULL THEN 0 ELSE 1 END, 'x': acc.x + CASE WHEN e.v IS NULL OR (acc.s IS NOT NULL AND acc.s <> e.v) THEN 1 ELSE 0 END}}) AS f
  FROM votes GROUP BY 1, 2),
cal AS MATERIALIZED (SELECT trace_id, script, f.s::BIGINT AS shift, f.n AS votes, f.x AS against FROM folded),
found AS MATERIALIZED (
  SELECT s.trace_id, s.activity_id, p.source, p.line, p.package, contains(p.text, s.symbol) AS proved
  FROM sites s JOIN cal ON cal.trace_id = s.trace_id AND cal.script = s.k % 10 JOIN parts p ON p.script = s.k % 10 AND p.g = s.k - cal.shift)"""


def _sql(select: str, *more: str) -> str:
    return _with(_A, _PLACES, *more, select=select)


SQL = {
    "enclosures": _with(_A, ENCLOSED, select="SELECT activity_id, parent FROM enclosed"),
    "map_calibration": _sql("SELECT trace_id, 's' || script || '.js.map' AS map_name, shift, votes, against FROM cal"),
    "placed_work": _sql(
        "SELECT u.trace_id, u.activity_id, u.depth, f.source, f.line, f.package, f.proved FROM (SELECT trace_id, activity_id, arg_min(top, depth) AS top, min(depth) AS depth FROM up WHERE EXISTS (SELECT 1 FROM found f WHERE f.trace_id = up.trace_id AND f.activity_id = up.top) GROUP BY 1, 2) u JOIN found f ON f.trace_id = u.trace_id AND f.activity_id = u.top",
        ENCLOSED,
        "up(trace_id, activity_id, top, depth) AS (SELECT trace_id, activity_id, activity_id, 0::BIGINT FROM enclosed UNION ALL SELECT u.trace_id, u.activity_id, e.parent, u.depth + 1 FROM up u JOIN enclosed e ON e.trace_id = u.trace_id AND e.activity_id = u.top WHERE e.parent IS NOT NULL)",
    ),
    "cost_by_line": _sql(
        "SELECT f.trace_id, source, line, package, CASE WHEN package IS NULL THEN 'Repository' ELSE 'Dependency' END AS fixable, CAST(sum(self_time) AS BIGINT) AS cost, count(*) AS calls, bool_or(proved) AS proved FROM found f JOIN selfs USING (trace_id, activity_id) GROUP BY ALL", _SWEPT
    ),
    "cost_by_package": _sql(
        "SELECT trace_id, package, CAST(sum(cost) AS BIGINT) AS cost, count(*) AS lines, CAST(sum(calls) AS BIGINT) AS calls FROM (SELECT f.trace_id, package, source, line, sum(self_time) AS cost, count(*) AS calls FROM found f JOIN selfs USING (trace_id, activity_id) WHERE package IS NOT NULL GROUP BY ALL) GROUP BY 1, 2",
        _SWEPT,
    ),
    "placement_counts": _sql("""
      SELECT s.trace_id, count(*) AS stated, count(f.source) AS placed, count(*) FILTER (f.proved) AS confirmed, max(c.agreements) AS agreements, max(c.disagreements) AS disagreements
      FROM sites s LEFT JOIN found f USING (trace_id, activity_id) JOIN (SELECT trace_id, CAST(sum(votes) AS BIGINT) AS agreements, CAST(sum(against) AS BIGINT) AS disagreements FROM cal GROUP BY 1) c ON c.trace_id = s.trace_id GROUP BY 1"""),
}
