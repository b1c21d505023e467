"""The order tables read as repositories: customers declare their orders, orders the parts on their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepath.operators import holdings, reach
from tracepath.plans.session import keep
from tracepath.sources import packages

REPOS = 64
ENTRY = "root"


def repositories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders of status P are declared by nobody. Lines are read once: those of one order and part are one row with their whole weight."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")
    o = orders.select(F.concat(F.lit("r"), F.col("o_custkey") % REPOS).alias("repo_id"), F.concat(F.lit("c"), "o_custkey").alias("customer"), F.concat(F.lit("o"), "o_orderkey").alias("order"), "o_orderkey", "o_orderstatus")
    l = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "l_partkey", "repo_id", "order").agg(F.sum(F.col("l_quantity").cast("long")).alias("weight"))
    l = keep(l.select("repo_id", "order", F.concat(F.lit("p"), "l_partkey").alias("part"), "weight"))
    zero, no, yes = F.lit(0).cast("long"), F.lit(False), F.lit(True)
    components = (
        o.select("repo_id").distinct().select("repo_id", F.lit(ENTRY).alias("component"), zero.alias("weight"), yes.alias("owned"))
        .union(o.select("repo_id", "customer").distinct().select("repo_id", "customer", zero, no))
        .union(o.select("repo_id", "order", zero, no))
        .union(l.groupBy("repo_id", "part").agg(F.sum("weight").alias("weight")).select("repo_id", "part", "weight", no))
    )
    declares = (
        o.select("repo_id", "customer").distinct().select("repo_id", F.lit(ENTRY).alias("source"), F.col("customer").alias("target"))
        .union(o.where("o_orderstatus <> 'P'").select("repo_id", "customer", "order"))
        .union(l.select("repo_id", "order", "part"))
    )
    return components, declares


def retained_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = holdings.hold(*repositories(spark, sf_dir), ENTRY)
    return held.where("reachable").select("repo_id", "component", F.coalesce("dominator", F.lit("")).alias("dominator"), "retained")


def unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdings.unreachable(holdings.reachable(*repositories(spark, sf_dir), ENTRY))


def removal_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdings.removal_plan(*repositories(spark, sf_dir), ENTRY, 5)


def entries_reaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third customer is an entry, and so is the root."""
    components, declares = repositories(spark, sf_dir)
    third = F.substring("component", 2, 19).try_cast("long") % 3 == 0
    entries = components.where((F.col("component") == ENTRY) | F.col("component").startswith("c") & third)
    return reach.entries_reaching(reach.reached_from(declares, entries))


def repository_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part in ten is declared and not there."""
    components, declares = repositories(spark, sf_dir)
    lost = F.col("target").startswith("p") & (F.substring("target", 2, 19).try_cast("long") % 10 == 0)
    there = keep(components.join(declares.where(lost).select("repo_id", F.col("target").alias("component")), ["repo_id", "component"], "left_anti"))
    return packages.census(there, declares.where(~lost), declares.where(lost).select("repo_id", "source", F.col("target").alias("need")))


QUERIES = {f.__name__: f for f in (retained_weight, unreachable, removal_plan, entries_reaching, repository_census)}

_REPOS = f"""
o AS MATERIALIZED (SELECT 'r' || (o_custkey % {REPOS}) AS repo_id, 'c' || o_custkey AS customer, 'o' || o_orderkey AS ord, o_orderkey, o_orderstatus <> 'P' AS told FROM orders),
l AS MATERIALIZED (SELECT repo_id, customer, ord, told, 'p' || l_partkey AS part, CAST(l_quantity AS BIGINT) AS weight FROM lineitem JOIN o ON l_orderkey = o_orderkey),
p AS MATERIALIZED (SELECT repo_id, part, CAST(sum(weight) AS BIGINT) AS weight FROM l GROUP BY 1, 2),
d AS MATERIALIZED (
  SELECT repo_id, part, p.weight, CASE WHEN count(DISTINCT ord) = 1 THEN min(ord) WHEN count(DISTINCT customer) = 1 THEN min(customer) ELSE 'root' END AS up
  FROM l JOIN p USING (repo_id, part) WHERE told GROUP BY 1, 2, 3)"""
_HELD = f"""{_REPOS},
oo AS MATERIALIZED (SELECT o.repo_id, o.ord, o.customer, CAST(coalesce(sum(d.weight), 0) AS BIGINT) AS retained FROM o LEFT JOIN d ON d.repo_id = o.repo_id AND d.up = o.ord WHERE told GROUP BY 1, 2, 3),
cc AS MATERIALIZED (
  SELECT c.repo_id, c.customer, CAST(coalesce((SELECT sum(retained) FROM oo WHERE oo.repo_id = c.repo_id AND oo.customer = c.customer), 0) + coalesce((SELECT sum(weight) FROM d WHERE d.repo_id = c.repo_id AND d.up = c.customer), 0) AS BIGINT) AS retained
  FROM (SELECT DISTINCT repo_id, customer FROM o) c)"""
#: Tables of what 0 to 6 cuts free and which they are, shared out among children in the order of their names.
_EMPTY = "[{'v': 0::BIGINT, 's': []::VARCHAR[]} for i in range(7)]"
_SHARED = f"""list_reduce(list_prepend({_EMPTY}, list(best ORDER BY comp)), lambda acc, c: list_transform(range(7), lambda k: struct_pack(
  v := list_max(list_transform(range(k + 1), lambda g: {{'v': acc[k - g + 1].v + c[g + 1].v, 'g': -g}})).v,
  s := list_max(list_transform(range(k + 1), lambda g: {{'v': acc[k - g + 1].v + c[g + 1].v, 'g': -g, 's': list_concat(acc[k - g + 1].s, c[g + 1].s)}})).s)))"""


def _cut(retained: str, comp: str, spread: str) -> str:
    return f"list_transform(range(7), lambda k: CASE WHEN k > 0 AND {retained} > {spread}[k + 1].v THEN struct_pack(v := {retained}, s := [{comp}]) ELSE {spread}[k + 1] END)"


_PLAN = f"""{_HELD},
parts AS MATERIALIZED (SELECT repo_id, part AS comp, up, {_cut("weight", "part", _EMPTY)} AS best FROM d),
spread1 AS MATERIALIZED (SELECT repo_id, up, {_SHARED} AS best FROM parts WHERE up[1] = 'o' GROUP BY 1, 2),
orders1 AS MATERIALIZED (SELECT repo_id, ord AS comp, customer AS up, {_cut("retained", "ord", "b")} AS best FROM (SELECT oo.*, coalesce(x.best, {_EMPTY}) AS b FROM oo LEFT JOIN spread1 x ON x.repo_id = oo.repo_id AND x.up = oo.ord)),
spread2 AS MATERIALIZED (SELECT repo_id, up, {_SHARED} AS best FROM (SELECT * FROM orders1 UNION ALL SELECT * FROM parts WHERE up[1] = 'c') GROUP BY 1, 2),
customers1 AS MATERIALIZED (SELECT repo_id, customer AS comp, 'root' AS up, {_cut("retained", "customer", "b")} AS best FROM (SELECT cc.*, coalesce(x.best, {_EMPTY}) AS b FROM cc LEFT JOIN spread2 x ON x.repo_id = cc.repo_id AND x.up = cc.customer)),
whole AS MATERIALIZED (SELECT repo_id, {_SHARED} AS best FROM (SELECT * FROM customers1 UNION ALL SELECT * FROM parts WHERE up = 'root') GROUP BY 1),
held AS MATERIALIZED (SELECT repo_id, part AS comp, weight AS frees FROM d UNION ALL SELECT repo_id, ord, retained FROM oo UNION ALL SELECT repo_id, customer, retained FROM cc)"""
_ENTRIES = f"""{_REPOS},
c AS MATERIALIZED (SELECT DISTINCT repo_id, customer FROM o),
ent AS MATERIALIZED (SELECT repo_id, customer FROM c WHERE customer[2:]::BIGINT % 3 = 0),
hits AS (
  SELECT repo_id, customer AS component, customer AS entry FROM ent UNION SELECT o.repo_id, ord, ent.customer FROM o JOIN ent USING (repo_id, customer) WHERE told
  UNION SELECT l.repo_id, part, ent.customer FROM l JOIN ent USING (repo_id, customer) WHERE told
  UNION SELECT repo_id, 'root', 'root' FROM c UNION SELECT repo_id, customer, 'root' FROM c UNION SELECT repo_id, ord, 'root' FROM o WHERE told UNION SELECT repo_id, part, 'root' FROM l WHERE told)"""
SQL = {
    "entries_reaching": f"WITH {_ENTRIES} SELECT repo_id, component, count(*) AS entries FROM hits GROUP BY 1, 2",
    "repository_census": f"""
WITH {_REPOS},
gone AS (SELECT repo_id, part FROM p WHERE part[2:]::BIGINT % 10 = 0),
dl AS MATERIALIZED (
  SELECT DISTINCT repo_id, 'root' AS source, customer AS target FROM o UNION SELECT repo_id, customer, ord FROM o WHERE told UNION SELECT repo_id, ord, part FROM l),
n AS (SELECT repo_id, count(*) FILTER (NOT lost) AS declared, count(*) FILTER (lost) AS missing FROM (SELECT *, target[1] = 'p' AND target[2:]::BIGINT % 10 = 0 AS lost FROM dl) GROUP BY 1),
ok AS (SELECT * FROM p WHERE part[2:]::BIGINT % 10 <> 0),
lost AS (
  SELECT repo_id, count(*) AS k, CAST(coalesce(sum(weight), 0) AS BIGINT) AS w FROM (
    SELECT repo_id, 0::BIGINT AS weight FROM o WHERE NOT told UNION ALL SELECT repo_id, weight FROM ok WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.repo_id = ok.repo_id AND l.part = ok.part AND told)) GROUP BY 1)
SELECT n.repo_id, declared, missing, declared / (declared + missing) AS confidence, CAST(coalesce((SELECT sum(weight) FROM ok WHERE ok.repo_id = n.repo_id), 0) AS BIGINT) AS installed, coalesce(k, 0) AS undeclared, coalesce(w, 0) AS undeclared_weight
FROM n LEFT JOIN lost USING (repo_id)""",
    "removal_plan": f"""
WITH {_PLAN}
SELECT w.repo_id, x.comp AS component, held.frees, best[6].v AS plan_frees, best[7].v - best[6].v AS margin FROM whole w, unnest(w.best[6].s) AS x(comp) JOIN held ON held.repo_id = w.repo_id AND held.comp = x.comp""",
    "retained_weight": f"""
WITH {_HELD}
SELECT repo_id, part AS component, up AS dominator, weight AS retained FROM d
UNION ALL SELECT repo_id, ord, customer, retained FROM oo
UNION ALL SELECT repo_id, customer, 'root', retained FROM cc
UNION ALL SELECT r.repo_id, 'root', '', CAST(coalesce((SELECT sum(weight) FROM d WHERE d.repo_id = r.repo_id), 0) AS BIGINT) FROM (SELECT DISTINCT repo_id FROM o) r
""",
    "unreachable": f"""
WITH {_REPOS}
SELECT repo_id, ord AS component, 0::BIGINT AS weight FROM o WHERE NOT told
UNION ALL SELECT repo_id, part, weight FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.repo_id = p.repo_id AND d.part = p.part)
""",
}
