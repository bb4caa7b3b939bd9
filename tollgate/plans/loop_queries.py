"""Registered queries of check libraries and investigations over the alarms of a day, deployments and status entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialized
from ..operators import context as x
from ..operators import investigate as i
from ..operators import investigation as v
from .context_queries import deployments, status
from .investigate_queries import members
from .queries import add

COMPONENTS = ("authorization", "local_methods", "webhooks")
LOOK = 21_600


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alarms of a day as an incident: its most specific alarm, its causes by prior, and the best supported other values of that alarm's dimensions."""
    own = materialized(members(spark, sf_dir), "members")
    look = F.struct("metric", "direction", "locus", "scope", F.col("window_start").alias("onset"))
    anchor = own.groupBy("incident_id").agg(F.max_by(look, F.struct(F.size("locus"), "window_end", "candidate_id")).alias("a")).select("incident_id", "a.*")
    hyps = i.hypothesis_priors(own).groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("nth", "cause", "prior"))).alias("hyps"))
    values = own.select("incident_id", "metric", F.explode("locus").alias("pair")).groupBy("incident_id", "metric", "pair").agg(F.count("*").alias("n"))
    dim = lambda c: F.split_part(c, F.lit("="), F.lit(1))
    own_pairs = anchor.select("incident_id", "metric", F.explode("locus").alias("mine"))
    other = own_pairs.join(values, ["incident_id", "metric"]).where((dim(F.col("pair")) == dim(F.col("mine"))) & (F.col("pair") != F.col("mine")))
    best = other.groupBy("incident_id", dim(F.col("mine")).alias("dim")).agg(F.min_by("pair", F.struct((-F.col("n")).alias("n"), "pair")).alias("pair"))
    best = best.groupBy("incident_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", F.split_part("pair", F.lit("="), F.lit(2))))).alias("siblings"))
    none = F.create_map().cast("map<string,string>")
    found = anchor.join(hyps, "incident_id").join(best, "incident_id", "left").withColumn("siblings", F.coalesce("siblings", none))
    return found.withColumn("causes", F.transform("hyps", lambda h: h["cause"]))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.check_library(materialized(incidents(spark, sf_dir), "incidents"))


def investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every incident's loop: related metrics and siblings are held against the day's other alarms, side files against what was near the onset."""
    inc = materialized(incidents(spark, sf_dir), "incidents")
    checks = materialized(v.check_library(inc), "checks")
    own = materialized(members(spark, sf_dir).select("incident_id", F.col("metric").alias("m"), F.col("direction").alias("w"), "locus"), "alarms")
    asked = checks.where(F.col("kind").isin("related", "sibling")).select("incident_id", "check_id", "kind", F.col("args")[0].alias("metric"), F.when(F.col("kind") == "related", F.col("args")[2]).otherwise(F.col("args")[3]).alias("way"), F.split(F.col("args")[2], ",").alias("place"))
    met = asked.join(own, ["incident_id"]).where((F.col("m") == F.col("metric")) & (F.col("w") == F.col("way")))
    hit = (F.col("kind") == "related") | (F.size(F.array_except("place", "locus")) == 0)
    moved = met.where(hit).select("incident_id", "check_id").distinct().withColumn("moved", F.lit(True))

    at = inc.select("incident_id", "onset", (F.col("onset") + LOOK).alias("as_of"))
    near = x.deployments_near(at, deployments(spark, sf_dir)).groupBy("incident_id").agg(F.collect_set(F.concat(F.lit("present:"), "service")).alias("deployed"))
    asked = checks.where("kind = 'status'").select("incident_id", F.col("args")[0].alias("psp")).join(at, "incident_id")
    part = F.element_at(F.array(*map(F.lit, COMPONENTS)), (F.pmod(F.xxhash64("id"), F.lit(len(COMPONENTS))) + 1).cast("int"))
    told = x.status_near(asked, status(spark, sf_dir)).groupBy("incident_id", "psp").agg(F.collect_set(F.concat(F.lit("present:"), part)).alias("posted"))

    full = checks.withColumn("psp", F.when(F.col("kind") == "status", F.col("args")[0])).join(moved, ["incident_id", "check_id"], "left").join(near, "incident_id", "left").join(told, ["incident_id", "psp"], "left")
    observed = F.when(F.col("kind") == "channel", "insufficient").when(F.col("kind").isin("related", "sibling"), F.when(F.col("moved"), v.MOVED).otherwise(v.UNCHANGED))
    present = F.when(F.col("kind") == "deploy", F.col("deployed")).when(F.col("kind") == "status", F.col("posted"))
    per = full.groupBy("incident_id").agg(F.collect_list(F.struct("check_id", "kind", "predictions", observed.alias("observed"), F.coalesce(present, F.array().cast("array<string>")).alias("present"), F.lit(False).alias("failed"))).alias("checks"))
    hyps = F.transform("hyps", lambda h: F.struct(h["cause"].alias("cause"), h["prior"].alias("prior"), h["nth"].cast("int").alias("nth")))
    cases = inc.select("incident_id", hyps.alias("hyps"), F.size("locus").alias("narrowed")).join(per, "incident_id", "left")
    return v.run_checks(cases.withColumns({"picks": F.lit(None), "trouble": F.lit(None).cast("string")}))


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investigations with their lists as text."""
    steps = F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["kind"], s["observed"], s["leader_before"])), "|")
    hyps = F.array_join(F.transform("hypotheses", lambda h: F.concat_ws(":", h["cause"], h["supporting"].cast("string"), h["contradicting"].cast("string"), h["status"])), "|")
    return investigations(spark, sf_dir).withColumns({"steps": steps, "hypotheses": hyps})


add("i7_check_library", lambda s, sf: library(s, sf).select("incident_id", "check_id", "kind", "tool", F.array_join("args", "|").alias("args"), F.to_json("predictions").alias("predictions")))
add("i8_run_checks", _plain)
