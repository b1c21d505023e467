"""The events read as source: what is open on a user's track when work begins is the block that it stands in.

Views repeat, purchases define, clicks are calls, errors assign; the place in the track is the line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepath.operators import blocks, tracks
from tracepath.plans.driver_tables import _A, _SWEPT, _with, activities

NAMES = 12


@dataclass
class Source:
    tree: DataFrame
    heads: DataFrame
    assigned: DataFrame
    calls: DataFrame
    mentions: DataFrame


def source(spark: SparkSession, sf_dir: str) -> Source:
    a = activities(spark, sf_dir).where("NOT concurrent")
    file = F.concat_ws("-", "trace_id", "tid").alias("file_id")
    k = F.substring("subject", 3, 9).cast("long").alias("k")
    kind = F.when(F.col("name") == "view", "Repeat").when(F.col("name") == "purchase", "Define").otherwise("Plain").alias("kind")
    # the order of a track; null, which comes first, for the file
    opened = F.struct("start", -F.col("end"), "activity_id").alias("opened")
    placed = a.select(file, F.col("activity_id").alias("node"), opened, kind, "name", k)
    up = tracks.sweep_tracks(a).select(F.col("activity_id").alias("node"), F.coalesce("open_parent", F.lit(-1)).alias("parent"))
    rows = placed.join(up, "node").select("file_id", "node", "parent", "opened", "kind", "name", "k")
    root = {"node": F.lit(-1), "kind": F.lit("File")}
    roots = a.select(file).distinct().select("file_id", *[root.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields[1:]])
    tree = blocks.block_tree(rows.unionByName(roots)).withColumns({"line": F.col("open"), "end_line": F.col("close")})
    said = F.concat(F.lit("k"), F.col("k") % NAMES).alias("name")
    calls = tree.where("name = 'click'").select("file_id", F.col("open").alias("call_id"), F.col("parent").alias("within"), F.concat(F.lit("f"), F.col("k") % 5).alias("name"), said.alias("args"), "line", (F.col("k") % 3 == 0).alias("fresh"), (F.col("k") % 4 == 0).alias("allocates"))
    return Source(tree, tree.where("kind = 'Repeat'").select("file_id", "node", said), tree.where("name = 'error'").select("file_id", "line", said), calls, calls.select("file_id", "call_id", F.col("args").alias("name")))


def block_labels(spark, d):
    return source(spark, d).tree.select("file_id", "node", "open", "close", "depth", "home", "repeats")


def loop_subtrees(spark, d):
    t = source(spark, d).tree
    return blocks.subtrees(t, t.where("kind = 'Repeat'"))


def loop_varying_names(spark, d):
    s = source(spark, d)
    return blocks.varying_names(s.tree, s.heads, s.assigned)


def loop_spots(spark, d):
    s = source(spark, d)
    return blocks.within_loops(blocks.calls_by_loop(s.tree, s.heads, s.assigned, s.calls, s.mentions))


def repeated_calls(spark, d):
    s = source(spark, d)
    return blocks.repeated_calls(s.calls, s.assigned)


QUERIES = {f.__name__: f for f in (block_labels, loop_subtrees, loop_varying_names, loop_spots, repeated_calls)}

_BLOCKS = f"""
b AS MATERIALIZED (
  SELECT trace_id || '-' || tid AS file_id, o.activity_id AS node, coalesce(up.open_parent, -1) AS parent, rn AS open, subject[3:]::BIGINT AS k, name,
    CASE name WHEN 'view' THEN 'Repeat' WHEN 'purchase' THEN 'Define' ELSE 'Plain' END AS kind, 'k' || (subject[3:]::BIGINT % {NAMES}) AS said
  FROM o LEFT JOIN up USING (activity_id)
  UNION ALL SELECT DISTINCT trace_id || '-' || tid, -1, NULL, 0, NULL, NULL, 'File', NULL FROM o),
anc(file_id, node, top, d) AS (
  SELECT file_id, node, node, 0 FROM b
  UNION ALL SELECT anc.file_id, anc.node, b.parent, anc.d + 1 FROM anc JOIN b ON b.file_id = anc.file_id AND b.node = anc.top WHERE b.parent IS NOT NULL),
above AS MATERIALIZED (SELECT anc.*, t.kind AS top_kind, t.open AS top_open, n.open, t.said AS top_said FROM anc JOIN b t ON t.file_id = anc.file_id AND t.node = anc.top JOIN b n ON n.file_id = anc.file_id AND n.node = anc.node),
home AS MATERIALIZED (SELECT file_id, node, arg_min(top, d) AS home, min(d) AS hd FROM above WHERE top_kind IN ('Define', 'File') GROUP BY 1, 2),
lab AS MATERIALIZED (
  SELECT b.file_id, b.node, b.open, (SELECT max(x.open) FROM above x WHERE x.file_id = b.file_id AND x.top = b.node) AS close,
    (SELECT count(*) FROM above x WHERE x.file_id = b.file_id AND x.node = b.node) AS depth, home,
    (SELECT count(*) FROM above x WHERE x.file_id = b.file_id AND x.node = b.node AND x.top_kind = 'Repeat' AND x.d < hd) AS repeats, b.kind, b.said
  FROM b JOIN home USING (file_id, node)),
sub AS MATERIALIZED (
  SELECT above.file_id, above.top AS root, above.node FROM above JOIN home h ON h.file_id = above.file_id AND h.node = above.node JOIN home t ON t.file_id = above.file_id AND t.node = above.top
  WHERE above.top_kind = 'Repeat' AND h.home = t.home),
vary AS MATERIALIZED (
  SELECT x.file_id, x.node AS root, x.top_said AS name FROM above x JOIN b ON b.file_id = x.file_id AND b.node = x.node WHERE b.kind = 'Repeat' AND x.top_kind = 'Repeat'
  UNION SELECT sub.file_id, sub.root, b.said FROM sub JOIN b ON b.file_id = sub.file_id AND b.node = sub.node WHERE b.kind = 'Repeat'
  UNION SELECT r.file_id, r.node, e.said FROM lab r JOIN b e ON e.file_id = r.file_id AND e.name = 'error' AND e.open BETWEEN r.open AND r.close WHERE r.kind = 'Repeat'),
calls AS MATERIALIZED (SELECT file_id, open AS line, parent AS within, 'f' || (k % 5) AS name, said AS args, k % 3 = 0 AS fresh, k % 4 = 0 AS allocates FROM b WHERE b.name = 'click')"""


def _sql(select: str) -> str:
    return _with(_A, _SWEPT, _BLOCKS, select=select)


SQL = {
    "block_labels": _sql("SELECT file_id, node, open, close, depth, home, repeats FROM lab"),
    "loop_subtrees": _sql("SELECT file_id, root, node FROM sub"),
    "loop_varying_names": _sql("SELECT file_id, root, name FROM vary"),
    "loop_spots": _sql("""
      SELECT DISTINCT rule, file_id, line, name FROM (
        SELECT c.file_id, c.line, c.name, CASE WHEN v THEN CASE WHEN fresh THEN 'IdentityChurn' END WHEN allocates THEN 'InvariantAllocation' ELSE 'InvariantCall' END AS rule
        FROM (SELECT c.*, sub.root, EXISTS (SELECT 1 FROM vary WHERE vary.file_id = c.file_id AND vary.root = sub.root AND vary.name IN (c.args, c.name)) AS v
          FROM calls c JOIN sub ON sub.file_id = c.file_id AND sub.node = c.within) c)
      WHERE rule IS NOT NULL"""),
    "repeated_calls": _sql("""
      SELECT DISTINCT 'RepeatedCall' AS rule, file_id, line, name FROM (SELECT *, min(line) OVER (PARTITION BY file_id, within, name, args) AS first FROM calls) c
      WHERE line > first AND NOT EXISTS (SELECT 1 FROM b e WHERE e.file_id = c.file_id AND e.name = 'error' AND e.open > c.first AND e.open < c.line)"""),
}
