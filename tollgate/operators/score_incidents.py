"""Scores of incidents against labelled truth: what each is mainly about, what was merged wrongly, and how each record fared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values.
RECOVERY_TOLERANCE = 21_600
CAMPAIGN = "correlated_unrelated_anomalies"


def incident_scores(links: DataFrame, incidents: DataFrame, matched: DataFrame, records: DataFrame) -> DataFrame:
    """incident_id, members, main, main_route, purity, wrong_merge, campaign_merge, detected_at and impact of every incident.

    links: incident_id, candidate_id. incidents: incident_id, detected_at, impact (value, low, high; null if none). matched:
    candidate_id, record_key. records: record_key, truth_id, scenario_kind, expected_route, start, unrelated_to (truth ids).
    The main record is that of most members among incident records, else among all; ties: the earlier start, then the later key.
    """
    r = records.select("record_key", "truth_id", "scenario_kind", "expected_route", "start", "unrelated_to")
    own = links.select("incident_id", "candidate_id").distinct().join(matched.select("candidate_id", "record_key"), "candidate_id", "left")
    size = own.groupBy("incident_id").agg(F.count("*").alias("members"))
    held = own.where("record_key is not null").groupBy("incident_id", "record_key").agg(F.count("*").alias("n")).join(r, "record_key")
    main = held.groupBy("incident_id").agg(F.max(F.struct((F.col("expected_route") == "incident").alias("i"), "n", (-F.col("start")).alias("s"), "record_key", "expected_route")).alias("m"))
    # records in one incident of which one says that it has nothing to do with the other
    says = held.select("incident_id", "record_key", "scenario_kind", F.explode("unrelated_to").alias("other_id"))
    other = held.select("incident_id", F.col("record_key").alias("other"), F.col("scenario_kind").alias("other_kind"), F.col("truth_id").alias("other_id"))
    wrong = says.join(other, ["incident_id", "other_id"]).where("record_key != other").groupBy("incident_id").agg(F.max((F.col("scenario_kind") == CAMPAIGN) | (F.col("other_kind") == CAMPAIGN)).alias("campaign"))
    every = incidents.join(size, "incident_id", "left").join(main, "incident_id", "left").join(wrong, "incident_id", "left")
    return every.select(
        "incident_id", F.coalesce("members", F.lit(0)).alias("members"), F.col("m.record_key").alias("main"), F.coalesce("m.expected_route", F.lit("unmatched")).alias("main_route"), F.coalesce(F.col("m.n") / F.col("members"), F.lit(0.0)).alias("purity"),
        F.col("campaign").isNotNull().alias("wrong_merge"), F.coalesce("campaign", F.lit(False)).alias("campaign_merge"), "detected_at", "impact",
    )


def record_scores(scores: DataFrame, links: DataFrame, matched: DataFrame, records: DataFrame, events: DataFrame) -> DataFrame:
    """How every incident record that could be detected fared: covered, duplicates, delay_h, recovered_in_time, impact_error and impact_covered.

    events: incident_id, event_time, status. records also: end, expected_recovery, oracle_detectable_at, true_lost.
    Recovery and impact are null where there is nothing to hold them against.
    """
    r = records.where("expected_route = 'incident' and oracle_detectable_at is not null")
    met = links.join(matched, "candidate_id").join(scores.select("incident_id", "detected_at"), "incident_id").groupBy("record_key").agg(F.min("detected_at").alias("created"))
    back = events.where("status = 'RECOVERING'").groupBy("incident_id").agg(F.min("event_time").alias("back"))
    mains = scores.where("main is not null").join(back, "incident_id", "left").groupBy(F.col("main").alias("record_key")).agg(
        F.count("*").alias("mains"), F.min("back").alias("back"), F.min_by("impact", F.when(F.col("impact").isNotNull(), F.struct((-F.col("members")).alias("m"), "incident_id"))).alias("impact")
    )
    j = r.join(met, "record_key", "left").join(mains, "record_key", "left")
    covered, truth = F.col("created").isNotNull(), F.coalesce("expected_recovery", "end")
    hit = F.when(covered & (F.col("mains") > 0) & truth.isNotNull(), F.coalesce(F.abs(F.col("back") - truth) <= RECOVERY_TOLERANCE, F.lit(False)))
    held = covered & F.col("impact").isNotNull() & (F.col("true_lost") != 0)
    return j.select(
        "record_key", "scenario_kind", covered.alias("covered"), F.when(covered, F.greatest(F.lit(0), F.coalesce("mains", F.lit(0)) - 1)).alias("duplicates"),
        F.when(covered, (F.col("created") - F.greatest("start", "oracle_detectable_at")) / 3600).alias("delay_h"), hit.alias("recovered_in_time"),
        F.when(held, F.abs(F.col("impact.value") - F.col("true_lost")) / F.col("true_lost")).alias("impact_error"), F.when(held, F.col("true_lost").between(F.col("impact.low"), F.col("impact.high"))).alias("impact_covered"),
    )


def summary(scores: DataFrame, records: DataFrame, events: DataFrame, digest_groups: int, days: float) -> DataFrame:
    """One row of incidents a day, coverage, duplicates, purity, merges, delays, recovery, impact and terminal states that no human set."""
    route = lambda *names: F.count_if(F.col("main_route").isin(*names)) / F.lit(days)
    share = lambda c: F.avg(F.col(c).cast("double"))
    i = scores.agg(
        F.count("*").alias("incidents"), (F.count("*") / F.lit(days)).alias("incidents_per_day"), route("unmatched", "suppress").alias("false_incidents_per_day"), route("watch").alias("watch_incidents_per_day"), F.lit(digest_groups / days).alias("digest_groups_per_day"),
        share("purity").alias("purity"), share("wrong_merge").alias("wrong_merge_rate"), F.count_if("wrong_merge").alias("wrong_merges"), F.count_if("campaign_merge").alias("campaign_merges"),
    )
    r = records.agg(
        F.count("*").alias("incident_records_scored"), F.count_if("covered").alias("covered"), share("covered").alias("coverage"), share("duplicates").alias("duplicates_per_covered"), F.sum("duplicates").alias("duplicates"),
        F.percentile("delay_h", F.lit(0.5)).alias("creation_delay_h_median"), share("recovered_in_time").alias("recovery_within_6h"), F.count("recovered_in_time").alias("recovery_scored"),
        F.percentile("impact_error", F.lit(0.5)).alias("lost_payments_median_rel_error"), share("impact_covered").alias("lost_payments_interval_coverage"),
    )
    late = records.where("delay_h is not null").groupBy("delay_h").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(W.orderBy("delay_h")))
    total = records.agg(F.count("delay_h").alias("of"))
    late = late.crossJoin(total).where(F.col("upto") > F.least(F.col("of") - 1, F.floor(F.col("of") * 0.9))).agg(F.min("delay_h").alias("creation_delay_h_p90"))
    t = events.agg(F.count_if(F.col("status").isin("RESOLVED", "DISMISSED") & (F.col("actor") != "human")).alias("terminal_by_system"))
    return i.crossJoin(r).crossJoin(late).crossJoin(t)  # single rows
