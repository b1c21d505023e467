"""A directory of packages as components and declarations: manifests say who needs whom, files say what it weighs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepath.operators.reach import reached

INSTALLED = r"^(?:.*/)?node_modules/(?:@[^/]+/)?[^/]+$"
NAMES = "map<string,string>"


def _relative(root: str) -> Column:
    """The path below root, without a leading slash."""
    path = F.url_decode(F.regexp_replace("_metadata.file_path", "^[a-z]+:/+", "/"))
    return F.regexp_extract(path, "^.*?" + _quoted(root.rstrip("/")) + "/(.*)$", 1)


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def ancestors(directory: Column) -> Column:
    """A directory and all above it, the root being the empty text."""
    steps = F.when(directory == "", F.array().cast("array<string>")).otherwise(F.split(directory, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """dir, name, needs (dependencies and optional ones), members (workspace patterns), broken: it is no JSON object, and so says
    nothing."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "package.json").text(root, wholetext=True)
    t = text.select(F.regexp_replace(_relative(root), "/?package.json$", "").alias("dir"), F.col("value").alias("t"))

    def keys(field: str) -> Column:
        return F.coalesce(F.map_keys(F.from_json(F.get_json_object("t", f"$.{field}"), NAMES)), F.array().cast("array<string>"))

    members = F.coalesce(F.from_json(F.get_json_object("t", "$.workspaces"), "array<string>"), F.from_json(F.get_json_object("t", "$.workspaces.packages"), "array<string>"))
    return t.select("dir", F.get_json_object("t", "$.name").alias("name"), F.array_union(keys("dependencies"), keys("optionalDependencies")).alias("needs"), members.alias("members"), F.coalesce(~F.schema_of_variant(F.try_parse_json("t")).startswith("OBJECT"), F.lit(True)).alias("broken"))


def owned_members(manifests: DataFrame) -> DataFrame:
    """dir of the root and of what its workspace patterns name; ``prefix/*`` names the directories just below."""
    patterns = manifests.where("dir = ''").select(F.explode("members").alias("pattern")).select(F.regexp_replace("pattern", r"^\./|/$", "").alias("pattern"))
    m = manifests.where(~F.col("dir").rlike("(^|/)node_modules/")).select("dir", F.regexp_replace("dir", "/?[^/]+$", "").alias("parent"))
    hit = (F.col("pattern") == F.col("dir")) | (F.col("pattern") == F.concat(F.when(F.col("parent") != "", F.concat("parent", F.lit("/"))).otherwise(""), F.lit("*")))
    return m.where("dir = ''").select("dir").union(m.join(F.broadcast(patterns), hit).select("dir")).distinct()  # patterns: one file's list


def named(manifests: DataFrame) -> DataFrame:
    """Manifests that can be read and say a name."""
    return manifests.where("NOT broken AND coalesce(name, '') <> ''")


def problems(manifests: DataFrame, repo_id: str = "") -> DataFrame:
    """repo_id, dir, because: the root and workspace members that are no components, and why. A pattern that names one directory
    promises a manifest there; ``prefix/*`` promises nothing."""
    root = manifests.where("dir = ''")
    told = root.select(F.explode("members").alias("dir")).select(F.regexp_replace("dir", r"^\./|/$", "").alias("dir")).where("NOT endswith(dir, '*')")
    absent = told.join(manifests.select("dir"), "dir", "left_anti").select("dir", F.lit("there is no manifest").alias("because"))
    no_root = manifests.sparkSession.createDataFrame([("",)], "dir string").join(root.select("dir"), "dir", "left_anti").select("dir", F.lit("there is no manifest").alias("because"))
    members = manifests.join(owned_members(manifests), "dir", "left_semi")
    why = F.when(F.col("broken"), "its manifest can't be read").when(F.coalesce("name", F.lit("")) == "", "its manifest says no name")
    bad = members.select("dir", why.alias("because")).where("because IS NOT NULL")
    return absent.union(no_root).union(bad).distinct().select(F.lit(repo_id).alias("repo_id"), "dir", "because")


def entry_of(comps: DataFrame, name: str | None = None) -> DataFrame:
    """repo_id, entry, because: the owned component that is asked for by name, or the only one; else why there is none."""
    own = comps.where("owned").groupBy("repo_id").agg(F.count_distinct("name").alias("n"), F.array_sort(F.collect_set("name")).alias("names"), F.min(F.when(F.col("name") == name, F.col("component")) if name else F.col("component")).alias("at"))
    every = comps.select("repo_id").distinct().join(own, "repo_id", "left")
    none = F.when(F.coalesce("n", F.lit(0)) == 0, "nothing here is owned and named")
    why = none.when(F.col("at").isNull(), f"no owned component is named {name}") if name else none.when(F.col("n") > 1, F.concat(F.lit("several could be the entry: "), F.array_join("names", ", ")))
    return every.select("repo_id", "at", why.alias("because")).select("repo_id", F.when(F.col("because").isNull(), F.col("at")).alias("entry"), "because")


def components(manifests: DataFrame, files: DataFrame, repo_id: str = "") -> DataFrame:
    """repo_id, component (its directory), name, weight, owned. files: path, length. A file belongs to the innermost installed
    package or owned member that it is in, and no directory below another node_modules counts for the outer one."""
    good = named(manifests)
    owned = owned_members(manifests).join(good.select("dir"), "dir", "left_semi").withColumn("owned", F.lit(True))
    installed = good.where(F.col("dir").rlike(INSTALLED)).select("dir", F.lit(False).alias("owned"))
    every = owned.union(installed)
    inner = F.regexp_extract("path", r"^((?:.*/)?node_modules/(?:@[^/]+/)?[^/]+)/", 1)
    f = files.select("path", "length", inner.alias("inner"))
    near = f.where("inner = ''").select("path", "length", F.explode(ancestors(F.regexp_replace("path", "/?[^/]+$", ""))).alias("dir")).join(owned, "dir").groupBy("path").agg(F.max("length").alias("length"), F.max_by("dir", F.length("dir")).alias("dir"))
    weights = f.where("inner <> ''").select(F.col("inner").alias("dir"), "length").union(near.select("dir", "length")).groupBy("dir").agg(F.sum("length").alias("weight"))
    whole = every.join(manifests.select("dir", "name"), "dir").join(weights, "dir", "left")
    return whole.select(F.lit(repo_id).alias("repo_id"), F.col("dir").alias("component"), "name", F.coalesce("weight", F.lit(0)).alias("weight"), "owned")


def _needed(manifests: DataFrame, comps: DataFrame) -> DataFrame:
    """source, need, target (null: it resolves to nothing): a needed name is an owned member's, or the package of that name in the
    nearest node_modules at or above the one that needs it."""
    needs = manifests.join(comps.select(F.col("component").alias("dir")), "dir").select(F.col("dir").alias("source"), F.explode("needs").alias("need"))
    own = comps.where("owned").groupBy(F.col("name").alias("need")).agg(F.min("component").alias("member"))
    needs = needs.join(own, "need", "left")
    at = needs.where("member IS NULL").select("source", "need", F.explode(ancestors(F.col("source"))).alias("above"))
    at = at.withColumn("target", F.concat(F.when(F.col("above") != "", F.concat("above", F.lit("/"))).otherwise(""), F.lit("node_modules/"), "need"))
    found = at.join(comps.select(F.col("component").alias("target")), "target").groupBy("source", "need").agg(F.max_by("target", F.length("above")).alias("installed"))
    return needs.join(found, ["source", "need"], "left").select("source", "need", F.coalesce("member", "installed").alias("target"))


def declarations(manifests: DataFrame, comps: DataFrame, repo_id: str = "") -> DataFrame:
    """repo_id, source, target, without names that resolve to nothing."""
    found = _needed(manifests, comps).where("target IS NOT NULL AND target <> source")
    return found.select(F.lit(repo_id).alias("repo_id"), "source", "target").distinct()


def unresolved(manifests: DataFrame, comps: DataFrame, repo_id: str = "") -> DataFrame:
    """repo_id, source, need: what is declared and not there."""
    return _needed(manifests, comps).where("target IS NULL").select(F.lit(repo_id).alias("repo_id"), "source", "need").distinct()


def census(comps: DataFrame, declares: DataFrame, missing: DataFrame) -> DataFrame:
    """repo_id, declared, missing, confidence (the share of declarations that resolve; 1 if there are none), installed (weight of what is not
    owned), undeclared and undeclared_weight (what is installed and no owned component comes to need)."""
    needed = reached(declares, comps.where("owned"))
    extra = comps.where("NOT owned").join(needed, ["repo_id", "component"], "left_anti").groupBy("repo_id").agg(F.count(F.lit(1)).alias("undeclared"), F.sum("weight").alias("undeclared_weight"))
    out = comps.groupBy("repo_id").agg(F.coalesce(F.sum(F.when(~F.col("owned"), F.col("weight"))), F.lit(0)).alias("installed"))
    for part in (declares.groupBy("repo_id").agg(F.count(F.lit(1)).alias("declared")), missing.groupBy("repo_id").agg(F.count(F.lit(1)).alias("missing")), extra):
        out = out.join(part, "repo_id", "left")
    out = out.na.fill(0)
    n = F.col("declared") + F.col("missing")
    return out.select("repo_id", "declared", "missing", F.when(n == 0, 1.0).otherwise(F.col("declared") / n).alias("confidence"), "installed", "undeclared", "undeclared_weight")


def read_repository(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Components and declarations of the packages at root; the entry's component is the empty text."""
    manifests = read_manifests(spark, root)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = listed.select(_relative(root).alias("path"), "length")
    comps = components(manifests, files, root)
    return comps, declarations(manifests, comps, root)
