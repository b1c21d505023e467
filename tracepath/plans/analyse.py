"""The whole analysis of recordings: what decided the finish, what was wasted on the way, and what to repair first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracepath.operators import chain, flows, responses, rules, tracks
from tracepath.operators.placement import Isolation, isolate
from tracepath.operators.ingest import Recording, record
from tracepath.plans.session import cut
from tracepath.sources.source_maps import read_maps
from tracepath.sources.trace_events import read_traces


@dataclass
class Analysis:
    """Every table has a row or none for a recording; ``refusals`` says why a recording has none."""

    recording: Recording
    refusals: DataFrame
    steps: DataFrame
    summary: DataFrame
    slack: DataFrame
    findings: DataFrame
    withheld: DataFrame
    unattributed: DataFrame
    silences: DataFrame
    responses: DataFrame | None
    isolation: Isolation | None = None

    def placed(self, findings: DataFrame) -> DataFrame:
        """Findings with where in source they are, as far as maps say: depth, source, line, column, text, package, proved."""
        at = self.isolation.at.withColumnRenamed("activity_id", "speaks_of")
        return findings.withColumn("speaks_of", rules.speaks_of()).join(at, ["trace_id", "speaks_of"], "left").drop("speaks_of")

    def repair(self, budget: int) -> DataFrame:
        return rules.choose_repairs(self.findings, self.summary, budget)


def refusal(question: str, origin: str | None) -> Column:
    """Over the census, has_origin, n_deciding, n_tracks, n_flows: why the question can't be answered, or null."""
    why = F.when(~F.col("has_origin"), "the declared origin occurs nowhere among the event arguments") if origin else F.when(F.lit(False), "")
    if question == "response":
        why = why.when(F.col("stimuli") == 0, "zero user inputs recorded: a response needs one to start from")
        why = why.when((F.col("presentations") == 0) & (F.col("stated_interactions") == 0), "neither frames shown nor stated latencies are recorded, so responses have no end")
    why = why.when(F.col("n_deciding") == 0, "all intervals are empty, inferred or untrusted")
    return why.when((F.col("n_tracks") > 1) & (F.col("n_flows") == 0), "without flow events the tracks can't be put in an order")


def suggestions(origins: DataFrame, most: int = 4) -> DataFrame:
    """trace_id, suggestions: the origins that a recording names most often, with how often."""
    w = Window.partitionBy("trace_id").orderBy(F.desc("n"), "origin")
    top = origins.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    told = F.transform(F.array_sort(F.collect_list(F.struct("place", "origin", "n"))), lambda x: F.concat(x["origin"], F.lit(" ("), x["n"].cast("string"), F.lit(")")))
    return top.groupBy("trace_id").agg(F.array_join(told, ", ").alias("suggestions"))


def analyse_recording(r: Recording, question: str = "finish", origin: str | None = None, maps: tuple[DataFrame, DataFrame] | None = None) -> Analysis:
    """maps: segments and lines of source maps; without them nothing is placed in source and all else is the same."""
    a = r.activities
    facts = r.census.join(a.groupBy("trace_id").agg(F.count_if((F.col("confidence") > 0) & (F.col("end") > F.col("start")) & ~F.col("inferred")).alias("n_deciding"), F.count_distinct(F.when(~F.col("inferred"), F.struct("pid", "tid"))).alias("n_tracks")), "trace_id", "left")
    facts = facts.join(r.edges.where("kind = 'flow'").groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_flows")), "trace_id", "left")
    facts = facts.join(r.origins.where(F.col("origin") == (origin or "")).select("trace_id", F.lit(True).alias("has_origin")), "trace_id", "left").na.fill(0).na.fill(False)
    judged = cut(facts.select("trace_id", refusal(question, origin).alias("because")))
    refused = judged.where("because IS NOT NULL").join(suggestions(r.origins), "trace_id", "left")
    refusals = refused.unionByName(r.problems.select("trace_id", F.col("problem").alias("because"), F.lit(None).cast("string").alias("suggestions")))
    open_ = judged.where("because IS NULL").select("trace_id")

    links = cut(flows.links(r.edges, a).join(open_, "trace_id", "left_semi"))
    solved = cut(chain.solve(a.join(open_, "trace_id", "left_semi"), links))
    slack = cut(chain.slack(solved, a))
    steps = cut(chain.chain_steps(solved, a, r.edges))
    summary = cut(chain.path_summary(steps, chain.margin(solved, slack)))
    self_times = cut(tracks.self_times(a, r.swept))
    observed = rules.Observation(a.join(open_, "trace_id", "left_semi"), r.coverage.join(open_, "trace_id", "left_semi"), steps, cut(tracks.with_nested(a, steps)), self_times, slack)
    found, silences = rules.ask(observed)
    ranked = rules.rank_findings(found)
    owned = rules.attribute(ranked, a, origin) if origin else ranked.withColumns({"owner": F.lit("UnderTest"), "stated_origin": F.lit(None).cast("string")})
    owned = cut(owned)

    def of(owner: str) -> DataFrame:
        return owned.where(F.col("owner") == owner).drop("owner")

    under_test = of("UnderTest").drop("place", "stated_origin")
    answers = responses.responses(a, links, r.presentations, r.arrivals.join(open_, "trace_id", "left_semi"), r.envelopes) if question == "response" else None
    isolation = isolate(a, r.swept, self_times, *maps) if maps else None
    return Analysis(r, refusals, steps, summary, slack, rules.rank_findings(under_test), of("Elsewhere"), of("Unstated"), silences, answers, isolation)


def analyse(spark: SparkSession, path: str, producer: str = "chrome", question: str = "finish", origin: str | None = None, maps: str | None = None) -> Analysis:
    """path: files of recordings, one each; maps: a folder of source maps."""
    return analyse_recording(record(read_traces(spark, path, producer), producer), question, origin, tuple(map(cut, read_maps(spark, maps))) if maps else None)
