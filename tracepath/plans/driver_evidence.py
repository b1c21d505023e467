"""The order tables as style sheets: a part is a rule of its brand's and type's sheet, suppliers are files that import sheets and read
classes by the lines they deliver. And a user's events as a file whose purchases bring names in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepath.operators import evidence


def sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """rules, classes, importers, reads."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size", F.concat_ws("/", "p_brand", "p_type").alias("sheet"))
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity").where("l_quantity <= 8 AND l_linenumber <= 2")
    rules = p.select("sheet", F.col("p_partkey").alias("rule_id"), F.col("p_size").cast("long").alias("line"), F.col("p_name").alias("selector"), (F.length("p_name") + F.col("p_size")).cast("long").alias("bytes"))
    classes = p.where("p_size % 5 > 0").select("sheet", F.col("p_partkey").alias("rule_id"), F.explode(F.split(F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" c"), "p_size")).otherwise(F.concat(F.lit("c"), "p_size")), " ")).alias("name"))
    told = l.join(p, F.col("l_partkey") == F.col("p_partkey")).withColumn("file", F.concat(F.lit("s"), "l_suppkey"))
    importers = told.where("l_linenumber = 1").select("sheet", "file", (F.col("l_suppkey") % 50 != 0).alias("bound"))
    reads = told.where("l_linenumber = 2").select("sheet", "file", F.when(F.col("l_suppkey") % 45 != 1, F.when(F.col("l_partkey") % 2 == 0, F.substring_index("p_name", " ", 1)).otherwise(F.concat(F.lit("c"), "p_size"))).alias("name"))
    return rules, classes, importers, reads


def sheets_judged(spark, d):
    rules, _, importers, reads = sheets(spark, d)
    return evidence.sheets_judged(rules, importers, reads)


def unused_rules(spark, d):
    return evidence.unused_rules(*sheets(spark, d))


def undecidable_sheets(spark, d):
    return evidence.undecidable(*sheets(spark, d))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.concat(F.lit("u"), "user_id").alias("file_id"), F.col("event_id").alias("line"), F.regexp_extract("props", r'"k": *([0-9]+)', 1).alias("name"), "event_type")


def unused_imports(spark, d):
    n = names(spark, d)
    return evidence.unused_imports(n.where("event_type = 'purchase'"), n)


def exported_names(spark, d):
    n = names(spark, d)
    return evidence.exported_names(n, n.where("event_type = 'signup'"))


QUERIES = {f.__name__: f for f in (sheets_judged, unused_rules, undecidable_sheets, unused_imports, exported_names)}

_SHEETS = """
p AS MATERIALIZED (SELECT p_partkey, p_name, p_size, p_brand || '/' || p_type AS sheet FROM part),
cl AS MATERIALIZED (SELECT sheet, p_partkey AS rule_id, unnest(string_split(CASE WHEN p_size % 2 = 0 THEN p_name || ' c' || p_size ELSE 'c' || p_size END, ' ')) AS name FROM p WHERE p_size % 5 > 0),
t AS MATERIALIZED (SELECT p.*, l_suppkey, l_linenumber, 's' || l_suppkey AS file FROM lineitem JOIN p ON l_partkey = p_partkey WHERE l_quantity <= 8 AND l_linenumber <= 2),
im AS MATERIALIZED (SELECT DISTINCT sheet, file, l_suppkey % 50 <> 0 AS bound FROM t WHERE l_linenumber = 1),
rd AS MATERIALIZED (SELECT sheet, file, CASE WHEN l_suppkey % 45 <> 1 THEN CASE WHEN p_partkey % 2 = 0 THEN string_split(p_name, ' ')[1] ELSE 'c' || p_size END END AS name FROM t WHERE l_linenumber = 2),
bad AS MATERIALIZED (
  SELECT sheet, file, CASE WHEN NOT bound THEN 'imports it without a name, so what is read can''t be listed' ELSE 'reads it in a way that may mean any class' END AS why
  FROM im WHERE NOT bound OR EXISTS (SELECT 1 FROM rd WHERE rd.sheet = im.sheet AND rd.file = im.file AND rd.name IS NULL)),
j AS MATERIALIZED (
  SELECT s.sheet, b.file, CASE WHEN s.sheet NOT IN (SELECT sheet FROM im) THEN 'no file here imports it, and files elsewhere may' ELSE b.why END AS reason
  FROM (SELECT DISTINCT sheet FROM p) s LEFT JOIN (SELECT * FROM bad QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY file) = 1) b USING (sheet))"""
_NAMES = """n AS MATERIALIZED (SELECT 'u' || user_id AS file_id, event_id AS line, regexp_extract(props, '"k": *([0-9]+)', 1) AS name, event_type FROM events)"""
SQL = {
    "sheets_judged": f"WITH {_SHEETS} SELECT sheet, file, reason FROM j",
    "unused_rules": f"""
WITH {_SHEETS} SELECT sheet, p_partkey AS rule_id, p_size::BIGINT AS line, p_name AS selector, CAST(length(p_name) + p_size AS BIGINT) AS bytes FROM p JOIN j USING (sheet)
WHERE reason IS NULL AND p_partkey IN (SELECT rule_id FROM cl) AND NOT EXISTS (
  SELECT 1 FROM cl JOIN rd ON rd.sheet = cl.sheet AND rd.name = cl.name JOIN im ON im.sheet = rd.sheet AND im.file = rd.file WHERE cl.rule_id = p_partkey AND cl.sheet = p.sheet)""",
    "undecidable_sheets": f"WITH {_SHEETS} SELECT sheet, file, reason, (SELECT count(*) FROM cl WHERE cl.sheet = j.sheet) AS classes FROM j WHERE reason IS NOT NULL",
    "unused_imports": f"WITH {_NAMES} SELECT DISTINCT 'UnusedImport' AS rule, file_id, line, name FROM n WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM n m WHERE m.file_id = n.file_id AND m.name = n.name AND m.line <> n.line)",
    "exported_names": f"WITH {_NAMES} SELECT DISTINCT file_id, name FROM n WHERE EXISTS (SELECT 1 FROM n m WHERE m.file_id = n.file_id AND m.line = n.line AND m.event_type = 'signup')",
}
