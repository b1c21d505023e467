"""What is used, unused, or can't be told: reads are evidence of three kinds, and what can't be told outranks unused.

sheets' rules: sheet, rule_id, line, selector, bytes; classes: sheet, rule_id, name; importers: sheet, file, bound (the file reads
the sheet by a name of its own); reads: sheet, file, name (null: any class may be meant). imported, mentioned: file_id, line, name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOBODY = "no file here imports it, and files elsewhere may"
UNBOUND = "imports it without a name, so what is read can't be listed"
OPEN = "reads it in a way that may mean any class"


def sheets_judged(rules: DataFrame, importers: DataFrame, reads: DataFrame) -> DataFrame:
    """sheet, file, reason for each sheet with rules: the first file that leaves open what is read, and why; a null reason if all that is
    read can be listed. A sheet that nobody imports is open, without a file."""
    i = importers.groupBy("sheet", "file").agg(F.bool_and("bound").alias("bound"))
    r = reads.groupBy("sheet", "file").agg(F.bool_or(F.col("name").isNull()).alias("open"))
    why = F.when(~F.col("bound"), UNBOUND).when(F.col("open"), OPEN)
    by_file = i.join(r, ["sheet", "file"], "left").withColumn("why", why)
    told = by_file.groupBy("sheet").agg(F.min(F.when(F.col("why").isNotNull(), F.struct("file", "why"))).alias("x"))
    s = rules.select("sheet").distinct().join(told.withColumn("there", F.lit(True)), "sheet", "left")
    return s.select("sheet", "x.file", F.when(F.col("there").isNull(), NOBODY).otherwise(F.col("x.why")).alias("reason"))


def unused_rules(rules: DataFrame, classes: DataFrame, importers: DataFrame, reads: DataFrame) -> DataFrame:
    """sheet, rule_id, line, selector, bytes of rules that name classes none of which is read, in sheets whose reads can be listed."""
    certain = sheets_judged(rules, importers, reads).where("reason IS NULL").select("sheet")
    named = classes.select("sheet", "rule_id", "name").distinct()
    bound = importers.where("bound").select("sheet", "file").distinct()
    seen = reads.where("name IS NOT NULL").join(bound, ["sheet", "file"], "left_semi").select("sheet", "name", F.lit(True).alias("seen")).distinct()
    used = named.join(seen, ["sheet", "name"], "left").groupBy("sheet", "rule_id").agg(F.count("seen").alias("n")).where("n = 0").select("sheet", "rule_id")
    return rules.join(used, ["sheet", "rule_id"]).join(certain, "sheet", "left_semi").select("sheet", "rule_id", "line", "selector", "bytes")


def undecidable(rules: DataFrame, classes: DataFrame, importers: DataFrame, reads: DataFrame) -> DataFrame:
    """sheet, file, reason, classes: the sheets of which nothing can be said, why, and how many classes their rules name."""
    open_ = sheets_judged(rules, importers, reads).where("reason IS NOT NULL")
    n = classes.groupBy("sheet").agg(F.count(F.lit(1)).alias("classes"))
    return open_.join(n, "sheet", "left").na.fill(0, ["classes"]).select("sheet", "file", "reason", "classes")


def unused_imports(imported: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Spots: names brought in that stand on no other line of their file. How many lines mention a name, and which the first and last
    are, is enough to tell, so hot names are counted before they meet."""
    lines = mentioned.groupBy("file_id", "name").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    elsewhere = (F.col("first") != F.col("line")) | (F.col("last") != F.col("line"))
    i = imported.select("file_id", "line", "name").distinct().join(lines, ["file_id", "name"], "left")
    return i.where(~F.coalesce(elsewhere, F.lit(False))).select(F.lit("UnusedImport").alias("rule"), "file_id", "line", "name")


def exported_names(mentioned: DataFrame, export_lines: DataFrame) -> DataFrame:
    """name, file_id of what stands on a line that exports."""
    return mentioned.join(export_lines.select("file_id", "line"), ["file_id", "line"], "left_semi").select("file_id", "name").distinct()
