"""Where in original source a recorded site is: calibrated, looked up and, if one line alone names the symbol, proved.

Producers count lines and columns from 0 or from 1. A map's convention is what its own sites' symbols vote for; a vote
against the convention so far withdraws it, and the next vote sets it anew. Work that states no place is placed at the nearest call around
it that does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracepath.functions import columns as C
from tracepath.operators.forest import nearest_marked
from tracepath.plans.session import cut

SHIFTS = (1, 0)


def lookup(sites: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds the segment at or before (map_name, gen_line, gen_column) on its generated line to sites; those that have none are
    left out. ``site`` names a row."""
    s = segments.select("map_name", "gen_line", F.col("gen_column").alias("at"), F.lit(0).alias("side"), "seq", F.struct("source_id", "source", "line", "column", "last_line").alias("found"), F.lit(None).cast("string").alias("site"))
    q = sites.select("map_name", "gen_line", F.col("gen_column").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast(s.schema["found"].dataType).alias("found"), "site")
    w = Window.partitionBy("map_name", "gen_line").orderBy("at", "side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    both = s.unionByName(q).withColumn("found", F.last("found", ignorenulls=True).over(w)).where("side = 1 AND found IS NOT NULL")
    return sites.join(both.select("site", "found"), "site").select(*sites.columns, "found.*")


def _shifted(sites: DataFrame) -> DataFrame:
    """sites: distinct map_name, line_number, column_number, symbol."""
    tried = F.explode(F.array(*map(F.lit, SHIFTS))).alias("shift")
    s = sites.select("*", tried).withColumns({"gen_line": F.col("line_number") - F.col("shift"), "gen_column": F.col("column_number") - F.col("shift")})
    return s.withColumn("site", F.concat_ws(":", "line_number", "column_number", "shift", F.length("map_name"), "map_name", "symbol"))


def settle_votes(votes: DataFrame) -> DataFrame:
    """trace_id, map_name, shift, votes, against from votes (trace_id, map_name, site_id, agreed) in the order of site_id. A run of two
    or more equal votes always ends with that convention, and runs of one set and withdraw it in turn; so what holds at a
    run follows from how many runs of one stand between it and the last longer one."""
    by_map = Window.partitionBy("trace_id", "map_name")
    cast = votes.where("agreed IS NOT NULL")
    turns = F.when(F.col("agreed") == F.lag("agreed").over(by_map.orderBy("site_id")), 0).otherwise(1)
    runs = cast.withColumn("turns", turns).withColumn("run", F.sum("turns").over(by_map.orderBy("site_id"))).groupBy("trace_id", "map_name", "run").agg(F.min("agreed").alias("agreed"), F.count(F.lit(1)).alias("n"))
    longer = F.max(F.when(F.col("n") > 1, F.col("run"))).over(by_map.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("longer", longer).withColumn("held", F.when(F.col("longer").isNull(), F.col("run") % 2 == 0).otherwise((F.col("run") - F.col("longer")) % 2 == 1))
    ends = F.when((F.col("n") > 1) | ~F.col("held"), F.col("agreed"))
    told = runs.groupBy("trace_id", "map_name").agg(F.max_by(ends, "run").cast("long").alias("shift"), F.sum("n").alias("votes"), F.count_if("held").alias("conflicts"))
    none = votes.groupBy("trace_id", "map_name").agg(F.count_if(F.col("agreed").isNull()).alias("silent"))
    both = none.join(told, ["trace_id", "map_name"], "left").na.fill(0, ["votes", "conflicts"])
    return both.select("trace_id", "map_name", "shift", "votes", (F.col("silent") + F.col("conflicts")).alias("against"))


def calibrate(sites: DataFrame, segments: DataFrame, lines: DataFrame) -> DataFrame:
    """sites: trace_id, site_id, script, line_number, column_number, symbol. trace_id, map_name, shift (null: not proved), votes,
    against, for maps that a recording's sites name and that are there."""
    named_map = sites.withColumn("map_name", C.map_name(F.col("script")))
    s = named_map.where("symbol <> ''")
    place = ["map_name", "line_number", "column_number", "symbol"]  # sites of one place vote alike
    named = lookup(_shifted(s.select(*place).distinct()), segments).join(lines, ["map_name", "source_id", "line"]).where(C.names_symbol(F.col("text"), F.col("symbol")))
    vote = named.groupBy(*place).agg(F.max("shift").alias("agreed"))  # the first of SHIFTS is the greater
    told = settle_votes(s.join(vote, place, "left").select("trace_id", "site_id", "map_name", "agreed"))
    there = named_map.select("trace_id", "map_name").distinct().join(segments.select("map_name").distinct(), "map_name", "left_semi")
    return there.join(told, ["trace_id", "map_name"], "left").na.fill(0, ["votes", "against"])


def resolve(sites: DataFrame, calibrated: DataFrame, segments: DataFrame, lines: DataFrame) -> DataFrame:
    """trace_id, site_id, status (Absent, Unproved, Unmapped, Derived, Proved), source, line, column (from 1), text, package,
    fixable (Repository or Dependency)."""
    s = sites.withColumn("map_name", C.map_name(F.col("script"))).join(calibrated.select("trace_id", "map_name", "shift", F.lit(True).alias("there")), ["trace_id", "map_name"], "left")
    q = s.where("shift IS NOT NULL").select("trace_id", "site_id", "map_name", "symbol", (F.col("line_number") - F.col("shift")).alias("gen_line"), (F.col("column_number") - F.col("shift")).alias("gen_column"), F.concat_ws(":", "trace_id", "site_id").alias("site"))
    found = lookup(q, segments)
    can = found.select("trace_id", "site_id", "map_name", "symbol", "source_id", "source", "column", F.col("line").alias("first"), F.explode(F.sequence("line", "last_line")).alias("line")).join(lines, ["map_name", "source_id", "line"], "left")
    can = can.withColumn("names", F.coalesce(C.names_symbol(F.col("text"), F.col("symbol")), F.lit(False)))
    best = can.groupBy("trace_id", "site_id").agg(F.count_if("names").alias("n"), F.min_by(F.struct("source", "line", "column", "text"), F.when(F.col("names"), F.col("line"))).alias("only"), F.min_by(F.struct("source", "line", "column", "text"), "line").alias("start"))
    placed = best.select("trace_id", "site_id", (F.col("n") == 1).alias("proved"), F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("start")).alias("x"))
    status = F.when(F.col("there").isNull(), "Absent").when(F.col("shift").isNull(), "Unproved").when(F.col("x").isNull(), "Unmapped").when(F.col("proved"), "Proved").otherwise("Derived")
    out = s.join(placed, ["trace_id", "site_id"], "left").withColumn("package", C.package_of(F.col("x.source")))
    return out.select("trace_id", "site_id", status.alias("status"), "x.source", (F.col("x.line") + 1).alias("line"), (F.col("x.column") + 1).alias("column"), "x.text", "package", F.when(F.col("x").isNotNull(), fixable()).alias("fixable"))


def fixable() -> Column:
    return F.when(F.col("package").isNull(), "Repository").otherwise("Dependency")


def stated_sites(activities: DataFrame) -> DataFrame:
    """The places in code that activities state, as sites; site_id is the activity's."""
    # generated, since an optimizer that pushes the filter down and prunes fields computes the parts once for each time they are named
    a = activities.select("trace_id", F.col("activity_id").alias("site_id"), F.inline_outer(F.array(C.site_parts(F.col("subject")))))
    a = a.select("trace_id", "site_id", "script", C.number(F.col("line")).alias("line_number"), C.number(F.col("column")).alias("column_number"), "symbol")
    return a.where("script <> '' AND line_number IS NOT NULL AND column_number IS NOT NULL")


def place_work(enclosed: DataFrame, resolved: DataFrame) -> DataFrame:
    """trace_id, activity_id, depth, source, line, column, text, package, proved: where each activity's code is. Work that states no
    place which could be found ran because the innermost call around it that does ran; depth says how many calls out that is.
    enclosed: trace_id, activity_id, parent."""
    there = resolved.where("source IS NOT NULL").select("trace_id", F.col("site_id").alias("found"), "source", "line", "column", "text", "package", (F.col("status") == "Proved").alias("proved"))
    marks = there.select("trace_id", F.col("found").alias("activity_id"), F.lit(True).alias("marked"))
    nodes = enclosed.join(marks, ["trace_id", "activity_id"], "left").select("trace_id", F.col("activity_id").alias("node"), "parent", F.coalesce("marked", F.lit(False)).alias("marked"))
    near = nearest_marked(nodes).where("found IS NOT NULL")
    return near.join(there, ["trace_id", "found"]).select("trace_id", F.col("node").alias("activity_id"), "depth", "source", "line", "column", "text", "package", "proved")


@dataclass
class Isolation:
    """What could be said about where recordings' work is in source. ``counts``: trace_id, stated, placed, confirmed, agreements,
    disagreements."""

    calibrated: DataFrame
    resolved: DataFrame
    at: DataFrame
    places: DataFrame
    packages: DataFrame
    counts: DataFrame


def isolate(activities: DataFrame, swept: DataFrame, self_times: DataFrame, segments: DataFrame, lines: DataFrame) -> Isolation:
    """Every stated place, looked up in its script's map; each line is charged the self time of the work that states it."""
    sites = cut(stated_sites(activities))
    calibrated = cut(calibrate(sites, segments, lines))
    resolved = cut(resolve(sites, calibrated, segments, lines))
    places = cut(by_line(resolved, self_times.select("trace_id", F.col("activity_id").alias("site_id"), F.col("self_time").alias("cost"))))
    counts = resolved.groupBy("trace_id").agg(F.count(F.lit(1)).alias("stated"), F.count("source").alias("placed"), F.count_if(F.col("status") == "Proved").alias("confirmed"))
    votes = calibrated.groupBy("trace_id").agg(F.sum("votes").alias("agreements"), F.sum("against").alias("disagreements"))
    return Isolation(calibrated, resolved, cut(place_work(swept.select("trace_id", "activity_id", "parent"), resolved)), places, by_package(places), counts.join(votes, "trace_id", "left").na.fill(0))


def by_line(resolved: DataFrame, costs: DataFrame) -> DataFrame:
    """costs: trace_id, site_id, cost. Cost, calls and whether any is proved, per recording and source line."""
    r = resolved.where("source IS NOT NULL").join(costs, ["trace_id", "site_id"])
    return r.groupBy("trace_id", "source", "line", "package", "fixable").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("calls"), F.bool_or(F.col("status") == "Proved").alias("proved"))


def by_package(places: DataFrame) -> DataFrame:
    """What is charged to lines of installed packages."""
    return places.where("package IS NOT NULL").groupBy("trace_id", "package").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("lines"), F.sum("calls").alias("calls"))
