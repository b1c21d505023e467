"""The tables of the test data read as traces, the queries over them, and the same queries as SQL.

An event is an activity of its user's track, in one of ``TRACES`` recordings; it lasts as long as its value says; what it
worked on is the key in its properties, and events with one key form a flow in order of time. Events of type signup
are concurrent work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepath.functions import columns as C
from tracepath.operators import chain, flows, marks, rules, tracks
from tracepath.plans.session import cut

TRACES = 16
BASE = 1_704_067_200_000_000


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = F.unix_micros(F.col("ts").cast("timestamp")) - BASE
    end = start + F.round(F.col("value") * 100).cast("long") * 6_000_000
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1)
    return e.select(
        F.concat(F.lit("t"), F.col("user_id") % TRACES).alias("trace_id"),
        F.col("event_id").alias("activity_id"),
        F.col("event_type").alias("name"),
        F.lit("event").alias("category"),
        F.lit(0).cast("long").alias("pid"),
        F.col("user_id").alias("tid"),
        start.alias("start"),
        end.alias("end"),
        F.when(end > start, 1.0).otherwise(0.0).alias("confidence"),
        (F.col("event_type") == "signup").alias("concurrent"),
        F.concat(F.lit("k="), k).alias("subject"),
        F.lit(False).alias("inferred"),
    )


def flow_points(acts: DataFrame) -> DataFrame:
    return acts.where("confidence > 0").select("trace_id", "pid", "tid", F.col("subject").alias("flow_id"), F.col("start").alias("at"), F.col("activity_id").alias("point_id"), F.col("activity_id").alias("bound"))


def edges(acts: DataFrame, swept: DataFrame) -> DataFrame:
    return flows.all_edges(flows.flow_edges(flow_points(acts)), tracks.serial_edges(swept))


def coverage(acts: DataFrame, e: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    c = acts.select("trace_id").distinct().join(flows.contradictions(e, acts), "trace_id", "left")
    return c.select("trace_id", zero.alias("unread"), zero.alias("unpaired"), zero.alias("unbound_flows"), F.coalesce("contradicted", zero).alias("contradicted"), zero.alias("censored"))


class Solved:
    """The tables that several queries start from, each computed when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.acts = activities(spark, sf_dir)
        self.swept = cut(tracks.sweep_tracks(self.acts))
        self.edges = cut(edges(self.acts, self.swept))
        self.solved = cut(chain.solve(self.acts, flows.links(self.edges, self.acts)))
        self.slack = chain.slack(self.solved, self.acts)
        self.steps = chain.chain_steps(self.solved, self.acts, self.edges)
        self.margin = chain.margin(self.solved, self.slack)

    def observation(self) -> rules.Observation:
        steps = cut(self.steps)
        return rules.Observation(self.acts, coverage(self.acts, self.edges), steps, cut(tracks.with_nested(self.acts, steps)), cut(tracks.self_times(self.acts, self.swept)), self.slack)

    def findings(self) -> DataFrame:
        return rules.ask(self.observation())[0]


def activity_intervals(spark, d):
    return activities(spark, d).select("trace_id", "activity_id", "tid", "start", "end", C.duration().alias("duration"), C.informative().alias("informative"), C.decides().alias("decides"))


def track_order(spark, d):
    return tracks.track_order(activities(spark, d)).select("activity_id", "place")


def running_max_end(spark, d):
    return tracks.track_order(activities(spark, d)).select("activity_id", "furthest")


def stack_parent(spark, d):
    return tracks.sweep_tracks(activities(spark, d)).select("activity_id", "open_parent", "inside")


def enclosures(spark, d):
    return tracks.sweep_tracks(activities(spark, d)).select("activity_id", "parent")


def self_time(spark, d):
    return tracks.self_times(activities(spark, d)).select("activity_id", "self_time")


def serial_edges(spark, d):
    return tracks.serial_edges(tracks.sweep_tracks(activities(spark, d))).select("from_id", "to_id")


def flow_edges(spark, d):
    return flows.flow_edges(flow_points(activities(spark, d))).select("from_id", "to_id")


def usable_links(spark, d):
    a = activities(spark, d)
    return flows.links(edges(a, cut(tracks.sweep_tracks(a))), a).select("from_id", "to_id", "kind", "wait")


def contradictions(spark, d):
    a = activities(spark, d)
    return flows.contradictions(edges(a, cut(tracks.sweep_tracks(a))), a)


def chain_head(spark, d):
    return Solved(spark, d).solved.select("activity_id", "head", "came_from")


def chain_steps(spark, d):
    return Solved(spark, d).steps.select("trace_id", "step", "activity_id", "wait_before", "waited_on", "stated")


def path_summary(spark, d):
    s = Solved(spark, d)
    return chain.path_summary(s.steps, s.margin)


def slack(spark, d):
    return Solved(spark, d).slack.select("activity_id", "total", "free")


def repeated_work(spark, d):
    return rules.RepeatedWork().derive(Solved(spark, d).observation()).select("trace_id", "name", "subject", "activity_id", "span_start", "span_end", "cost", "count")


def dead_wait(spark, d):
    return rules.DeadWait().derive(Solved(spark, d).observation()).select("trace_id", "activity_id", "waited_on", "stated", "cost")


def off_path(spark, d):
    return rules.OffPath().derive(Solved(spark, d).observation()).select("trace_id", "activity_id", "evidence", "room")


def in_flight(spark, d):
    return rules.WaitedWhileInFlight().derive(Solved(spark, d).observation()).select("trace_id", "activity_id", "evidence", "count")


def findings(spark, d):
    return rules.rank_findings(Solved(spark, d).findings()).select("trace_id", "place", "rule", "activity_id", "cost", "evidence")


def repair_choice(spark, d):
    s = Solved(spark, d)
    found = rules.choose_repairs(rules.rank_findings(s.findings()), s.margin, 3)
    spans = F.array_join(F.transform("support", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return found.select("trace_id", F.array_join("chosen", ",").alias("chosen"), "recovered", "trust", spans.alias("support"), "unweighable", "because")


def idle_gaps(spark, d):
    a = activities(spark, d)
    w = tracks.track_window()
    gaps = a.select("trace_id", F.col("activity_id").alias("step"), F.lag("end").over(w).alias("opened"), F.col("start").alias("closes")).where("closes > opened")
    return rules.idle_gaps(gaps, a).select(F.col("step").alias("activity_id"), "opened", "closes", "idle")


def _probes(a: DataFrame) -> DataFrame:
    return a.select("trace_id", "pid", "tid", (F.col("start") + 1_800_000_000).alias("at"), F.col("activity_id").alias("point_id"))


def next_after(spark, d):
    a = activities(spark, d)
    return flows.next_after(_probes(a), a).select("point_id", "at", "bound")


def enclosing(spark, d):
    a = activities(spark, d)
    return flows.enclosing(_probes(a), a).select("point_id", "at", "bound")


def first_after(spark, d):
    a = activities(spark, d)
    shown = a.where("name = 'view'").select("trace_id", F.col("start").alias("at"))
    return marks.first_after(a.select("trace_id", F.col("activity_id").alias("key"), F.col("end").alias("at")), shown).select("key", "at", "deadline")


def _marks(a: DataFrame) -> DataFrame:
    fields = F.array(F.struct(F.lit("k").alias("path"), F.substring("subject", 3, 99).alias("value")), F.struct(F.lit("type").alias("path"), F.col("name").alias("value")))
    return a.select("trace_id", F.col("activity_id").alias("pos"), F.concat(F.lit("u"), "tid").alias("scope"), F.col("name").alias("category"), "pid", "tid", F.col("start").alias("at"), fields.alias("fields"))


def mark_groups(spark, d):
    g = marks.mark_groups(_marks(activities(spark, d)))
    return g.select("trace_id", "scope", "field", "value", "first", "last", "marks", "category", "seen")


def inferred_intervals(spark, d):
    a = activities(spark, d)
    windows = a.groupBy("trace_id").agg(F.min("start").alias("opens"), F.max("end").alias("closes"))
    found = marks.inferred_intervals(marks.mark_groups(_marks(a)), windows)
    return found.select("trace_id", "name", "value", "seen", "category", "start", "end", F.replace("subject", F.lit(C.SEPARATOR), F.lit("|")).alias("subject"))


def fused_arrivals(spark, d):
    a = activities(spark, d).where("name = 'click'")
    some = a.select("trace_id", F.col("activity_id").alias("arrival_id"), F.col("start").alias("at"), F.when(F.col("trace_id") != "t3", F.substring("subject", 3, 99).cast("long")).alias("interaction"), C.duration().alias("latency"))
    return marks.fuse_arrivals(some)


def origin_counts(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select(C.origin_of(F.col("url")).alias("origin"))
    return p.where("origin IS NOT NULL").groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


def owner_partition(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    told = F.concat(F.lit("url="), F.coalesce("url", F.lit("")), F.lit(C.SEPARATOR + "size="), F.length("html").cast("string"))
    return p.select("page_id", C.owner_of(told, "https://m.therou.example.com").alias("owner"))


def package_of(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    path = F.concat(F.lit("app/node_modules/x/node_modules/"), F.when(F.col("page_id") % 3 == 0, F.lit("@")).otherwise(F.lit("")), F.substring_index("url", "//", -1))
    return p.select("page_id", C.package_of(path).alias("package"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        activity_intervals, track_order, running_max_end, stack_parent, enclosures, self_time, serial_edges, flow_edges, usable_links, contradictions,
        chain_head, chain_steps, path_summary, slack, repeated_work, dead_wait, off_path, in_flight, findings, repair_choice,
        idle_gaps, next_after, enclosing, first_after, mark_groups, inferred_intervals, fused_arrivals, origin_counts, owner_partition, package_of,
    )
}

_A = f"""
a AS MATERIALIZED (
  SELECT 't' || (user_id % {TRACES}) AS trace_id, event_id AS activity_id, event_type AS name, user_id AS tid, epoch_us(ts) - {BASE} AS "start",
    epoch_us(ts) - {BASE} + CAST(round(value * 100) AS BIGINT) * 6000000 AS "end", event_type = 'signup' AS concurrent,
    'k=' || regexp_extract(props, '"k": *([0-9]+)', 1) AS subject
  FROM events)"""
_DECIDES = '"end" > "start"'
_SWEPT = """
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trace_id, tid ORDER BY "start", "end" DESC, activity_id) AS rn FROM a WHERE NOT concurrent),
up AS MATERIALIZED (
  SELECT x.activity_id, arg_max(y.activity_id, y.rn) AS open_parent, arg_max(greatest(least(x."end", y."end") - x."start", 0), y.rn) AS inside
  FROM o x JOIN o y ON x.trace_id = y.trace_id AND x.tid = y.tid AND y.rn < x.rn AND y."end" > x."start" GROUP BY x.activity_id),
selfs AS MATERIALIZED (
  SELECT a.trace_id, a.activity_id, greatest(greatest("end" - "start", 0) - coalesce(s.inside, 0), 0)::BIGINT AS self_time
  FROM a LEFT JOIN (SELECT open_parent, sum(inside) AS inside FROM up GROUP BY 1) s ON s.open_parent = a.activity_id)"""
_EDGES = f"""
s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trace_id, tid ORDER BY "start", "end" DESC, activity_id) AS rn FROM a WHERE NOT concurrent AND {_DECIDES}),
nx AS MATERIALIZED (SELECT x.activity_id, min(y.rn) AS nrn FROM s x JOIN s y ON x.trace_id = y.trace_id AND x.tid = y.tid AND y.rn > x.rn AND y."start" >= x."end" GROUP BY 1),
se(trace_id, tid, rn, from_id, to_id) AS (
  SELECT trace_id, tid, rn, NULL::BIGINT, activity_id FROM s WHERE rn = 1
  UNION ALL SELECT s.trace_id, s.tid, s.rn, se.to_id, s.activity_id FROM se JOIN nx ON nx.activity_id = se.to_id JOIN s ON s.trace_id = se.trace_id AND s.tid = se.tid AND s.rn = nx.nrn),
fe AS MATERIALIZED (
  SELECT DISTINCT trace_id, from_id, to_id FROM (
    SELECT trace_id, activity_id AS from_id, lead(activity_id) OVER (PARTITION BY trace_id, subject ORDER BY "start", activity_id) AS to_id FROM a WHERE {_DECIDES})
  WHERE to_id IS NOT NULL AND from_id <> to_id),
e AS MATERIALIZED (
  SELECT trace_id, from_id, to_id, min(kind) AS kind FROM (
    SELECT trace_id, from_id, to_id, 'flow' AS kind FROM fe UNION ALL SELECT trace_id, from_id, to_id, 'serial' FROM se WHERE from_id IS NOT NULL) GROUP BY 1, 2, 3),
ue AS MATERIALIZED (
  SELECT e.*, x."start" <= y."start" AS forward, greatest(y."start" - x."end", 0) AS wait, y."end" - y."start" AS to_dur
  FROM e JOIN a x ON x.activity_id = e.from_id JOIN a y ON y.activity_id = e.to_id
  WHERE e.from_id <> e.to_id AND x."end" > x."start" AND y."end" > y."start"
    AND NOT ((x."start" <= y."start" AND y."end" <= x."end") OR (y."start" <= x."start" AND x."end" <= y."end"))),
l AS MATERIALIZED (SELECT * FROM ue WHERE forward)"""
_CHAIN = f"""
h(id, head) USING KEY (id) AS (
  SELECT activity_id, "end" - "start" FROM a WHERE {_DECIDES}
  UNION
  SELECT l.to_id, max(h.head + l.wait + l.to_dur) FROM h JOIN l ON l.from_id = h.id JOIN recurring.h AS r ON r.id = l.to_id
  WHERE h.head + l.wait + l.to_dur > r.head GROUP BY l.to_id),
heads AS MATERIALIZED (
  SELECT a.trace_id, h.id AS activity_id, a."start", a."end", h.head,
    (SELECT min(l.from_id) FROM l JOIN h AS p ON p.id = l.from_id WHERE l.to_id = h.id AND p.head + l.wait + l.to_dur = h.head AND h.head > l.to_dur) AS came_from
  FROM h JOIN a ON a.activity_id = h.id),
last AS (SELECT trace_id, arg_max(activity_id, ("end", head, activity_id)) AS id FROM heads GROUP BY 1),
back(trace_id, id, k) AS (SELECT trace_id, id, 0 FROM last UNION ALL SELECT b.trace_id, x.came_from, b.k + 1 FROM back b JOIN heads x ON x.activity_id = b.id WHERE x.came_from IS NOT NULL),
steps AS MATERIALIZED (
  SELECT c.trace_id, c.step, c.activity_id, c."start", c."end", CASE WHEN c.prev IS NULL THEN 0 ELSE greatest(c."start" - c.prev_end, 0) END AS wait_before, c.prev AS waited_on,
    EXISTS (SELECT 1 FROM e WHERE e.kind = 'flow' AND e.from_id = c.prev AND e.to_id = c.activity_id) AS stated
  FROM (SELECT b.trace_id, row_number() OVER w - 1 AS step, b.id AS activity_id, a."start", a."end", lag(a."end") OVER w AS prev_end, lag(b.id) OVER w AS prev
    FROM back b JOIN a ON a.activity_id = b.id WINDOW w AS (PARTITION BY b.trace_id ORDER BY b.k DESC)) c)"""
_SLACK = """
fin AS (SELECT trace_id, max("end") AS finish FROM heads GROUP BY 1),
lt(id, latest) USING KEY (id) AS (
  SELECT activity_id, finish FROM heads JOIN fin USING (trace_id)
  UNION
  SELECT l.from_id, min(lt.latest - l.to_dur) FROM lt JOIN l ON l.to_id = lt.id JOIN recurring.lt AS r ON r.id = l.from_id
  WHERE lt.latest - l.to_dur < r.latest GROUP BY l.from_id),
slacks AS MATERIALIZED (
  SELECT heads.trace_id, heads.activity_id, greatest(lt.latest - heads."end", 0) AS total, (SELECT min(wait) FROM l WHERE l.from_id = heads.activity_id) AS free
  FROM heads JOIN lt ON lt.id = heads.activity_id),
margins AS (SELECT trace_id, min(total) FILTER (activity_id NOT IN (SELECT activity_id FROM steps)) AS margin, count(*) FILTER (activity_id IN (SELECT activity_id FROM steps)) >= count(*) AS corridor FROM slacks GROUP BY 1)"""
_NESTED = """
nested(activity_id) AS (SELECT activity_id FROM steps UNION SELECT up.activity_id FROM nested JOIN up ON up.open_parent = nested.activity_id)"""
_FINDINGS = f"""
occ AS (
  SELECT a.trace_id, name, subject, a.activity_id, "start", "end", self_time, row_number() OVER (PARTITION BY a.trace_id, name, subject ORDER BY "start", a.activity_id) AS k
  FROM a JOIN nested USING (activity_id) JOIN selfs USING (activity_id) WHERE self_time > 0),
rw AS MATERIALIZED (
  SELECT trace_id, name, subject, arg_min(activity_id, k) AS activity_id, min("start") AS first, min("start") FILTER (k > 1) AS span_start, max("end") FILTER (k > 1) AS span_end,
    CAST(sum(self_time) FILTER (k > 1) AS BIGINT) AS cost, count(*) AS "count"
  FROM occ GROUP BY 1, 2, 3 HAVING count(*) > 1),
dw AS MATERIALIZED (
  SELECT * FROM steps WHERE wait_before > 0 AND NOT EXISTS (
    SELECT 1 FROM a WHERE a.trace_id = steps.trace_id AND {_DECIDES} AND a."start" < steps."start" AND a."end" > steps."start" - steps.wait_before)),
op AS MATERIALIZED (
  SELECT t.trace_id, t.id AS activity_id, t.self_time AS evidence, coalesce(slacks.total, 0) AS room
  FROM (SELECT trace_id, arg_max(activity_id, (self_time, activity_id)) AS id, max(self_time) AS self_time FROM selfs JOIN heads USING (trace_id, activity_id) GROUP BY 1) t
  LEFT JOIN slacks ON slacks.activity_id = t.id WHERE t.self_time > 0 AND t.id NOT IN (SELECT activity_id FROM nested)),
ov AS (
  SELECT s.trace_id, s.step, a.activity_id, least(a."end", s."start") - greatest(a."start", s."start" - s.wait_before) AS overlap
  FROM steps s JOIN a ON a.trace_id = s.trace_id AND a.concurrent AND a."end" > a."start" WHERE s.wait_before > 0),
bo AS (SELECT trace_id, step, arg_max(activity_id, (overlap, -activity_id)) AS activity_id, max(overlap) AS overlap FROM ov WHERE overlap > 0 GROUP BY 1, 2),
fl AS MATERIALIZED (SELECT trace_id, activity_id, CAST(sum(overlap) AS BIGINT) AS evidence, count(*) AS "count" FROM bo GROUP BY 1, 2),
bad AS (SELECT trace_id FROM ue WHERE NOT forward),
f AS (
  SELECT trace_id, 'repeated work' AS rule, 1 AS o, row_number() OVER (PARTITION BY trace_id ORDER BY first, activity_id) AS seq, activity_id, cost, cost AS evidence, span_end > span_start AS spans, span_start, span_end FROM rw
  UNION ALL SELECT trace_id, 'dead wait', 2, step, activity_id, wait_before, wait_before, true, "start" - wait_before, "start" FROM dw
  UNION ALL SELECT trace_id, 'off-path dominance', 3, 0, activity_id, 0, evidence, false, NULL, NULL FROM op WHERE trace_id NOT IN (SELECT trace_id FROM bad)
  UNION ALL SELECT trace_id, 'in flight while waiting', 4, row_number() OVER (PARTITION BY trace_id ORDER BY evidence DESC, activity_id), activity_id, 0, evidence, false, NULL, NULL FROM fl),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY cost DESC, evidence DESC, o, seq) - 1 AS place FROM f)"""
_M = """
m AS (SELECT trace_id, tid, 'u' || tid AS scope, activity_id AS pos, name AS category, "start" AS moment, subject[3:] AS k, name AS t FROM a),
fm AS (SELECT *, 'k' AS field, k AS value FROM m UNION ALL SELECT *, 'type', t FROM m),
g AS (
  SELECT trace_id, scope, field, value, min(moment) AS first, max(moment) AS last, count(*) AS marks, CASE WHEN min(category) = max(category) THEN min(category) END AS category, min(pos) AS seen,
    arg_min(k, (moment, pos)) AS k0, arg_max(k, (moment, -pos)) AS k1, arg_min(t, (moment, pos)) AS t0, arg_max(t, (moment, -pos)) AS t1
  FROM fm GROUP BY 1, 2, 3, 4)"""


def _with(*parts: str, select: str) -> str:
    return f"WITH RECURSIVE {', '.join(parts)} {select}"


_PROBE = '(SELECT trace_id, tid, activity_id AS point_id, "start" + 1800000000 AS at FROM a) p'
_SOLVED = (_A, _SWEPT, _EDGES, _CHAIN, _SLACK, _NESTED, _FINDINGS)
SQL: dict[str, str] = {
    "activity_intervals": _with(_A, select='SELECT trace_id, activity_id, tid, "start", "end", greatest("end" - "start", 0) AS duration, "end" > "start" AS informative, "end" > "start" AS decides FROM a'),
    "track_order": _with(_A, select='SELECT activity_id, row_number() OVER (PARTITION BY trace_id, tid ORDER BY "start", "end" DESC, activity_id) - 1 AS place FROM a'),
    "running_max_end": _with(_A, select='SELECT activity_id, max("end") OVER (PARTITION BY trace_id, tid ORDER BY "start", "end" DESC, activity_id ROWS UNBOUNDED PRECEDING) AS furthest FROM a'),
    "stack_parent": _with(_A, _SWEPT, select="SELECT a.activity_id, open_parent, inside FROM a LEFT JOIN up USING (activity_id)"),
    "self_time": _with(_A, _SWEPT, select="SELECT activity_id, self_time FROM selfs"),
    "serial_edges": _with(_A, _EDGES, select="SELECT from_id, to_id FROM se WHERE from_id IS NOT NULL"),
    "flow_edges": _with(_A, _EDGES, select="SELECT from_id, to_id FROM fe"),
    "usable_links": _with(_A, _EDGES, select="SELECT from_id, to_id, kind, wait FROM l"),
    "contradictions": _with(_A, _EDGES, select="SELECT trace_id, count(*) FILTER (NOT forward) AS contradicted FROM ue GROUP BY 1"),
    "chain_head": _with(_A, _EDGES, _CHAIN, select="SELECT activity_id, head, came_from FROM heads"),
    "chain_steps": _with(_A, _EDGES, _CHAIN, select="SELECT trace_id, step, activity_id, wait_before, waited_on, stated FROM steps"),
    "path_summary": _with(_A, _EDGES, _CHAIN, _SLACK, select='SELECT s.*, margin, corridor FROM (SELECT trace_id, count(*) AS steps, CAST(sum("end" - "start") AS BIGINT) AS work, CAST(sum(wait_before) AS BIGINT) AS wait, max("end") AS finish FROM steps GROUP BY 1) s JOIN margins USING (trace_id)'),
    "slack": _with(_A, _EDGES, _CHAIN, _SLACK, select="SELECT activity_id, total, free FROM slacks"),
    "repeated_work": _with(*_SOLVED, select='SELECT trace_id, name, subject, activity_id, span_start, greatest(span_start, span_end) AS span_end, cost, "count" FROM rw'),
    "dead_wait": _with(*_SOLVED, select="SELECT trace_id, activity_id, waited_on, stated, wait_before AS cost FROM dw"),
    "off_path": _with(*_SOLVED, select="SELECT trace_id, activity_id, evidence, room FROM op"),
    "in_flight": _with(*_SOLVED, select='SELECT trace_id, activity_id, evidence, "count" FROM fl'),
    "findings": _with(*_SOLVED, select="SELECT trace_id, place, rule, activity_id, cost, evidence FROM ranked"),
    "repair_choice": _with(*_SOLVED, select=f"""
      SELECT m.trace_id, CASE WHEN n > 0 THEN coalesce(chosen, '') END AS chosen, CASE WHEN n > 0 THEN coalesce(recovered, 0) END AS recovered, trust, CASE WHEN n > 0 THEN coalesce(support, '') END AS support,
        0::BIGINT AS unweighable, CASE WHEN coalesce(n, 0) = 0 THEN '{rules.NO_COST}' END AS because
      FROM margins m LEFT JOIN (SELECT trace_id, count(*) AS n FROM ranked WHERE cost > 0 GROUP BY 1) c USING (trace_id) LEFT JOIN (
        SELECT trace_id, string_agg(place::VARCHAR, ',' ORDER BY place) AS chosen, CAST(coalesce(least(sum(cost), max(margin)), sum(cost)) AS BIGINT) AS recovered, 1.0::DOUBLE AS trust,
          string_agg(span_start || '-' || span_end, ',' ORDER BY span_start, span_end) AS support
        FROM (SELECT r.*, margin, row_number() OVER w AS k, coalesce(sum(cost) OVER (PARTITION BY trace_id ORDER BY cost DESC, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM ranked r LEFT JOIN margins USING (trace_id) WHERE cost > 0 AND spans WINDOW w AS (PARTITION BY trace_id ORDER BY cost DESC, place))
        WHERE k <= 3 AND (margin IS NULL OR before < margin) GROUP BY 1) x USING (trace_id)"""),
    "idle_gaps": _with(_A, select="""
      SELECT activity_id, opened, closes, NOT EXISTS (SELECT 1 FROM a WHERE a.trace_id = g.trace_id AND a."end" > a."start" AND a."start" < g.closes AND a."end" > g.opened) AS idle
      FROM (SELECT trace_id, activity_id, lag("end") OVER (PARTITION BY trace_id, tid ORDER BY "start", "end" DESC, activity_id) AS opened, "start" AS closes FROM a) g WHERE closes > opened"""),
    "next_after": _with(_A, select=f"""
      SELECT p.point_id, p.at, arg_min(a.activity_id, (a."start", -a."end", a.activity_id)) AS bound
      FROM {_PROBE} LEFT JOIN a ON a.trace_id = p.trace_id AND a.tid = p.tid AND {_DECIDES} AND a."start" >= p.at GROUP BY 1, 2"""),
    "enclosing": _with(_A, select=f"""
      SELECT p.point_id, p.at, arg_max(a.activity_id, (a."start", -a."end", a.activity_id)) AS bound
      FROM {_PROBE} LEFT JOIN a ON a.trace_id = p.trace_id AND a.tid = p.tid AND {_DECIDES} AND a."start" <= p.at AND a."end" >= p.at GROUP BY 1, 2"""),
    "first_after": _with(_A, select="""
      SELECT x.activity_id AS key, x."end" AS at, min(v."start") AS deadline FROM a x LEFT JOIN a v ON v.trace_id = x.trace_id AND v.name = 'view' AND v."start" > x."end" GROUP BY 1, 2"""),
    "mark_groups": _with(_A, _M, select="SELECT trace_id, scope, field, value, first, last, marks, category, seen FROM g"),
    "inferred_intervals": _with(_A, _M, select="""
      SELECT trace_id, field AS name, value, seen, coalesce(category, '') AS category, first AS "start", last AS "end", 'k=' || k0 || '|type=' || t0 AS subject
      FROM g WHERE marks >= 2 AND last > first AND k0 = k1 AND t0 = t1"""),
    "fused_arrivals": _with(_A, select="""
      SELECT trace_id, arrival_id, "at", interaction, latency FROM (
        SELECT *, count(interaction) OVER (PARTITION BY trace_id) > 0 AS stated, row_number() OVER (PARTITION BY trace_id, interaction ORDER BY latency DESC, arrival_id) AS best
        FROM (SELECT trace_id, activity_id AS arrival_id, "start" AS "at", CASE WHEN trace_id <> 't3' THEN subject[3:]::BIGINT END AS interaction, greatest("end" - "start", 0) AS latency FROM a WHERE name = 'click'))
      WHERE NOT stated OR (interaction <> 0 AND best = 1)"""),
    "origin_counts": "SELECT origin, count(*) AS n FROM (SELECT regexp_extract(url, '([A-Za-z0-9-]+://[^/\"''\\s]+)', 1) AS origin FROM pages) WHERE origin <> '' GROUP BY 1",
    "owner_partition": "SELECT page_id, CASE WHEN o = 'https://m.therou.example.com' THEN 'UnderTest' WHEN o <> '' THEN 'Elsewhere' ELSE 'Unstated' END AS owner FROM (SELECT page_id, coalesce(regexp_extract(url, '([A-Za-z0-9-]+://[^/\"''\\s]+)', 1), '') AS o FROM pages)",
    "package_of": r"""
      SELECT page_id, nullif(regexp_extract('app/node_modules/x/node_modules/' || CASE WHEN page_id % 3 = 0 THEN '@' ELSE '' END || regexp_replace(url, '^.*//', ''), '^.*node_modules/((?:@[^/]+/)?[^/?]+)', 1), '') AS package FROM pages""",
}
