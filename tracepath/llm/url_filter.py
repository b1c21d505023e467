"""URL filters by host and path, with DataFrame expressions only.

A rule is a host and a path that begins and ends with ``/``. A URL is expanded into its host's suffixes, at dots, times
its path's prefixes, at slashes, no further than the rules go: what is longer than any rule fits none. Expressions meet
rules by an equi-join on a short prefix of their SHA-256; the full digest confirms a meeting, and the longest rule wins
(of equals the longer host, then block, then the text). Which side is sent where is left to the measured sizes.

Defined results: a null URL, or one without ``://``, has empty host and path and no rule; repeated rows and null ids give a
row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepath.llm.common import read_table

#: verdict, host, path
RULES: tuple[tuple[str, str, str], ...] = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SHORT = 8  # hexadecimal digits
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def _digested(df: DataFrame, expression: str) -> DataFrame:
    d = df.withColumn("digest", F.sha2(F.col(expression), 256))
    return d.withColumn("short", F.substring("digest", 1, SHORT))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row. ``rules``: verdict, host, path."""
    rules = rules.select("verdict", "host", "path").distinct()
    odd, labels, slashes = rules.agg(
        F.count(F.when(~F.coalesce(F.col("path").rlike("^/(.*/)?$") & (F.col("host") != "") & F.col("verdict").isin("allow", "block"), F.lit(False)), 1)),
        F.max(F.size(F.split("host", r"\."))),
        F.max(F.size(F.split("path", "/")) - 1),
    ).first()
    if odd:
        raise ValueError(f"{odd} rules lack a host, a path from / to /, or a verdict of allow or block")
    u = F.col(url_col)
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("page_id"),
        F.coalesce(F.translate(F.regexp_extract(u, URL, 1), UPPER, LOWER), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(u, URL, 2), F.lit("")).alias("path"),
    )
    if not labels:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    depth = F.least(F.length("path") - F.length(F.translate("path", "/", "")), F.lit(slashes))
    prefixes = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda n: F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), n), F.lit("/"))))
    expanded = rows.select("row", "page_id", "host", "path", F.explode_outer(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))).alias("expression"))
    table = _digested(rules.select("verdict", F.length("host").alias("host_chars"), F.concat("host", "path").alias("rule")), "rule")
    table = table.select(F.col("short").alias("rule_short"), F.col("digest").alias("rule_digest"), "verdict", "host_chars", "rule")
    met = _digested(expanded, "expression").join(table, F.col("short") == F.col("rule_short"), "left")
    rank = F.struct(F.length("rule").alias("chars"), "host_chars", (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")
    best = F.max(F.when(F.col("digest") == F.col("rule_digest"), rank)).alias("best")
    found = met.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), best)
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"), rule_table(spark, RULES))


#: By searching strings, without patterns.
OP6_SQL = """
WITH a AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url FROM pages),
b AS (SELECT rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM a),
c AS (SELECT rid, page_id, string_split(string_split(x, '?')[1], '#')[1] AS x FROM b),
u AS (
  SELECT rid, page_id, translate(string_split(x, '/')[1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN contains(x, '/') THEN substr(x, strpos(x, '/')) ELSE '' END AS path
  FROM c),
r(v, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (rid)
"""
