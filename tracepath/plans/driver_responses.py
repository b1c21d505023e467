"""The events as interactions: clicks arrive and are handled, views are what the screen shows; half of the clicks state how long they took."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepath.operators import flows, responses, tracks
from tracepath.plans.driver_tables import _A, _EDGES, _with, activities, edges
from tracepath.plans.session import cut, keep

#: Latency of a stated click: so many microseconds for each of its key's units, and one more.
UNIT = 400_000_000


def interactions(acts: DataFrame) -> DataFrame:
    latency = (F.substring("subject", 3, 9).cast("long") + 1) * UNIT
    said = F.col("activity_id") % 2 == 0
    return acts.where("name = 'click'").select("trace_id", F.col("activity_id").alias("arrival_id"), F.col("start").alias("at"), F.lit("click").alias("kind"), "activity_id", F.when(said, latency).alias("latency"), F.when(said, F.struct(latency.alias("latency"))).alias("phases"))


def interaction_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = activities(spark, sf_dir)
    links = keep(flows.links(edges(a, cut(tracks.sweep_tracks(a))), a))
    shown = a.where("name = 'view'").select("trace_id", F.col("start").alias("at")).distinct()
    r = responses.responses(a, links, shown, interactions(a), a.where("name = 'click'").select("trace_id", "activity_id"))
    return r.select("trace_id", "arrival_id", "began", "presented", F.array_join("chain", ",").alias("chain"), "working", "waiting", "elapsed", "exact", F.col("place").cast("long").alias("place"))


QUERIES = {f.__name__: f for f in (interaction_responses,)}

_RESPONSES = f"""
v AS MATERIALIZED (SELECT DISTINCT trace_id, "start" AS at FROM a WHERE name = 'view'),
due AS MATERIALIZED (SELECT a.trace_id, a.activity_id, a."start", a."end", "end" > "start" AS decides, name, (SELECT min(v.at) FROM v WHERE v.trace_id = a.trace_id AND v.at > a."end") AS deadline FROM a),
inner_ AS MATERIALIZED (
  SELECT l.from_id, l.to_id, l.wait, x."end" - x."start" AS dur FROM l JOIN due x ON x.activity_id = l.from_id JOIN due y ON y.activity_id = l.to_id WHERE x.deadline = y.deadline),
t(id, tail) USING KEY (id) AS (
  SELECT activity_id, "end" - "start" FROM due WHERE decides AND deadline IS NOT NULL
  UNION
  SELECT i.from_id, max(i.dur + i.wait + t.tail) FROM t JOIN inner_ i ON i.to_id = t.id JOIN recurring.t AS r ON r.id = i.from_id WHERE i.dur + i.wait + t.tail > r.tail GROUP BY 1),
goes AS MATERIALIZED (SELECT i.from_id, min(i.to_id) AS goes_to FROM inner_ i JOIN t f ON f.id = i.from_id JOIN t n ON n.id = i.to_id WHERE f.tail = i.dur + i.wait + n.tail GROUP BY 1),
arr AS MATERIALIZED (
  SELECT trace_id, activity_id AS arrival_id, "start" AS began, activity_id % 2 = 0 AS said, CASE WHEN activity_id % 2 = 0 THEN (subject[3:]::BIGINT + 1) * {UNIT} END AS latency FROM a WHERE name = 'click'),
due2 AS MATERIALIZED (
  SELECT arr.*, CASE WHEN said THEN began + latency ELSE deadline END AS presented FROM arr JOIN due ON due.activity_id = arr.arrival_id WHERE said OR deadline IS NOT NULL),
seeds AS MATERIALIZED (
  SELECT d.arrival_id, arg_max(x.activity_id, (t.tail, -x."start", -x.activity_id)) AS seed
  FROM due2 d JOIN due x ON x.trace_id = d.trace_id AND x."start" >= d.began AND x."start" < d.presented AND x."end" <= d.presented AND x.name <> 'click' JOIN t ON t.id = x.activity_id WHERE said GROUP BY 1),
ch(arrival_id, k, id) AS (
  SELECT d.arrival_id, 0, coalesce(s.seed, d.arrival_id) FROM due2 d LEFT JOIN seeds s USING (arrival_id) UNION ALL SELECT ch.arrival_id, ch.k + 1, g.goes_to FROM ch JOIN goes g ON g.from_id = ch.id),
st AS (
  SELECT d.*, ch.k, ch.id, x."start", x."end", greatest(d.began, coalesce(max(x."end") OVER (PARTITION BY d.arrival_id ORDER BY ch.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), d.began)) AS reached
  FROM due2 d JOIN ch USING (arrival_id) JOIN a x ON x.activity_id = ch.id),
re AS (
  SELECT trace_id, arrival_id, began, presented, string_agg(id::VARCHAR, ',' ORDER BY k) AS chain, CAST(sum(greatest("end" - "start", 0)) AS BIGINT) AS working,
    CAST(sum(greatest("start" - reached, 0)) + greatest(presented - greatest(max("end"), began), 0) AS BIGINT) AS waiting, CASE WHEN said THEN latency ELSE greatest(presented - began, 0) END AS elapsed, said AS exact
  FROM st GROUP BY trace_id, arrival_id, began, presented, said, latency)"""
SQL = {
    "interaction_responses": _with(_A, _EDGES, _RESPONSES, select="SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY elapsed DESC, began, arrival_id) - 1 AS place FROM re"),
}
