"""Scores of routes, answers, labels and joins against labelled truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The route that each status asks for, and kinds of records whose right label isn't a rate change.
EXPECTED = {"incident": "INCIDENT", "watch": "DIGEST", "suppress": "IGNORE"}
ADDED_TRAFFIC, NEW_COHORTS = "fraud_like_spike", "checkout_regression_app_version"
ROUTES = ("INCIDENT", "DIGEST", "IGNORE")


def route_scores(scored: DataFrame, incidents: DataFrame, days: float) -> DataFrame:
    """One row a system: routes a day, accuracy on matched candidates, recall of incidents at INCIDENT and false alarms a day.

    scored: candidate_id, status (incident, watch, suppress or unmatched), record_key and routes (map of system to route).
    incidents: record_key of those that can be detected at all.
    """
    counted = incidents.select("record_key").distinct().withColumn("counts", F.lit(True))
    rows = scored.join(counted, "record_key", "left").select("status", "record_key", "counts", F.explode("routes").alias("system", "route"))
    total = incidents.select("record_key").distinct().agg(F.count("*").alias("total"))
    loud, status = F.col("route") == "INCIDENT", F.col("status")
    wanted = F.create_map(*(F.lit(x) for pair in EXPECTED.items() for x in pair))[status]
    paged = F.when(loud & (status == "incident"), F.col("record_key"))
    a_day = lambda when: F.count_if(when) / days
    per = rows.groupBy("system").agg(
        F.count("*").alias("candidates"), *(a_day(F.col("route") == r).alias(f"{r.lower()}_per_day") for r in ROUTES), F.avg(F.when(status != "unmatched", (F.col("route") == wanted).cast("double"))).alias("route_accuracy_matched"),
        F.countDistinct(F.when(F.col("counts"), paged)).alias("incidents_routed_incident"), (F.count(paged) / F.nullif(F.countDistinct(paged), F.lit(0))).alias("routes_per_matched_incident"), *(a_day(loud & (status == s)).alias(f"{s}_incident_per_day") for s in ("unmatched", "suppress", "watch")),
    )
    # one row of a count
    return per.crossJoin(total).withColumn("incident_recall", F.col("incidents_routed_incident") / F.nullif("total", F.lit(0))).withColumnRenamed("total", "incidents_scored")


def routes_by_status(scored: DataFrame) -> DataFrame:
    """How often each system gave each route to candidates of each status."""
    return scored.select("status", F.explode("routes").alias("system", "route")).groupBy("system", "status", "route").agg(F.count("*").alias("n"))


def answer_scores(scored: DataFrame) -> DataFrame:
    """The share of verified answers, and how right those are: severity and category on incidents, probability on all.

    scored also has verified, incident_p, severity and category (maps to probabilities), true_severity and true_cause.
    """
    own = F.col("verified")
    hit = own & (F.col("status") == "incident")
    sure = F.element_at(F.map_keys("severity"), F.array_position(F.map_values("severity"), F.array_max(F.map_values("severity"))).cast("int"))
    p = F.col("category")[F.col("true_cause")]
    ahead = F.size(F.filter(F.map_entries("category"), lambda e: (e["value"] > p) | ((e["value"] == p) & (e["key"] < F.col("true_cause")))))
    share = lambda when, y: F.avg(F.when(when, F.coalesce(y, F.lit(False)).cast("double")))
    real = F.col("status").isin("incident", "watch").cast("double")
    return scored.agg(
        F.avg(own.cast("double")).alias("verified_share"), share(hit, sure == F.col("true_severity")).alias("severity_accuracy"), *(share(hit, p.isNotNull() & (ahead < k)).alias(f"category_top{k}") for k in (1, 3)),
        F.avg(F.when(own, F.pow(F.col("incident_p") - real, 2))).alias("brier"),
    )


def failure_reasons(scored: DataFrame) -> DataFrame:
    """How often each reason was given."""
    return scored.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def labels_by_checkpoint(decisions: DataFrame, matched: DataFrame) -> DataFrame:
    """nth (0 is the first look), n and accuracy of labels on candidates of incident records.

    decisions: candidate_id, as_of, change_type (null if the state is empty). matched: candidate_id, expected_route,
    scenario_kind.
    """
    nth = F.row_number().over(W.partitionBy("candidate_id").orderBy("as_of")) - 1
    kind, label = F.col("scenario_kind"), F.col("change_type")
    right = F.when(kind == ADDED_TRAFFIC, label.isin("mix_shift", "mixed")).when(kind == NEW_COHORTS, label.isin("new_cohort", "rate_change")).otherwise(label == "rate_change")
    rows = decisions.withColumn("nth", nth).where(label.isNotNull()).join(matched.where("expected_route = 'incident'"), "candidate_id")
    return rows.groupBy("nth").agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"))


def ingestion_hub_joins(links: DataFrame, infos: DataFrame, incidents: DataFrame) -> DataFrame:
    """Joins of other metrics by way of a late-data member, their incidents, and how many of those are wrong merges.

    links: incident_id, candidate_id, member, kind. infos: candidate_id, metric. incidents: incident_id, wrong_merge,
    campaign_merge.
    """
    late = infos.withColumn("late", F.col("metric") == "late_arrival_share").select("candidate_id", "late")
    joins = links.where("kind in ('join', 'support')").join(late.withColumnRenamed("late", "c_late"), "candidate_id").join(late.select(F.col("candidate_id").alias("member"), F.col("late").alias("m_late")), "member")
    hubs = joins.where("m_late and not c_late").groupBy("incident_id").agg(F.count("*").alias("n")).join(incidents, "incident_id", "left")
    return hubs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("joins"), F.count("*").alias("incidents"), F.count_if("wrong_merge").alias("wrong_merge_incidents"), F.count_if("campaign_merge").alias("campaign_merge_incidents"))


def attach_answers(requests: DataFrame, answers: DataFrame, most_bytes: int = 4_096) -> DataFrame:
    """Requests with what was recorded for them: response, or error_kind and detail; none is looked up for a request that is too large.

    requests: request_hash, size_bytes and more. answers: request_hash, response, error (JSON with kind and detail).
    """
    found = answers.select("request_hash", "response", "error", F.lit(True).alias("found"))
    large = F.col("size_bytes") > most_bytes
    at = lambda name: F.get_json_object("error", f"$.{name}")
    kind = F.when(large, "oversized_request").when(F.col("found").isNull(), "replay_miss").when(F.col("error").isNotNull(), at("kind"))
    detail = F.when(large, F.concat(F.col("size_bytes").cast("string"), F.lit(" bytes"))).when(F.col("found").isNull(), "no recorded response").when(F.col("error").isNotNull(), at("detail"))
    rows = requests.join(found, "request_hash", "left").withColumn("error_kind", kind).withColumn("detail", detail)
    return rows.withColumn("response", F.when(F.col("error_kind").isNull(), F.col("response"))).drop("found", "error")


def tune_call_budget(runs: DataFrame, slack: float = 0.01) -> DataFrame:
    """budget, the share top3 of investigations of real incidents with their cause among the first three, and chosen: the smallest budget
    whose share is within ``slack`` of the largest budget's.

    runs: budget, top3, false_positive. Only the row a budget goes into the window.
    """
    per = runs.groupBy("budget").agg(F.coalesce(F.avg(F.when(~F.col("false_positive"), F.col("top3").cast("double"))), F.lit(0.0)).alias("top3"))
    every = W.partitionBy(F.lit(0))
    most = F.max_by("top3", "budget").over(every)
    fits = per.withColumn("fits", F.col("top3") >= most - slack)
    return fits.withColumn("chosen", F.col("budget") == F.min(F.when(F.col("fits"), F.col("budget"))).over(every)).drop("fits")
