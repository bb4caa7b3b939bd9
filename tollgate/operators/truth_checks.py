"""Checks of labelled truth and of the side files beside it: rows of check and violations, one pass over the records where rows suffice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a record must have, the causes, routes and dimensions, and each dimension's known values.
REQUIRED = (
    "scenario_id", "incident_id", "start", "end", "true_cause", "root_cause", "expected_route", "affected_cohorts", "control_cohorts", "expected_metric_effect", "expected_impact",
    "expected_detection_window", "expected_recovery", "scenario_type", "seed", "is_incident", "onset_at", "end_at", "ramp", "affected_metrics", "injected_effect", "true_impact",
)
CAUSES = (
    "psp_degradation", "payment_method_degradation", "issuer_or_country_degradation", "checkout_regression", "renewal_job_failure", "dunning_failure", "refund_process_change",
    "duplicate_charging", "fraud_attack", "pricing_or_plan_change", "data_pipeline_issue", "normal_variation", "unknown",
)
ROUTES = ("incident", "watch", "suppress")
DIMENSIONS = ("customer_country", "psp", "payment_method_type", "card_brand", "platform", "app_version", "channel")
VALUES = {
    "customer_country": ("US", "GB", "DE", "FR", "ES", "NL", "BR", "MX", "JP"),
    "psp": ("psp_alpha", "psp_beta", "psp_gamma"),
    "payment_method_type": ("card", "sepa_debit", "ideal", "pix"),
    "card_brand": ("visa", "mastercard", "amex", "jcb"),
    "platform": ("web", "ios", "android"),
    "channel": ("checkout", "renewal"),
}
#: Metric, the measured figure and the one it must stay below; without the latter the figure must be there and not 0.
DIRECTIONS = (
    ("charge_approval_rate", "charge_approval_rate_actual", "charge_approval_rate_counterfactual"),
    ("payment_intent_conversion_rate", "pi_conversion_actual", "pi_conversion_counterfactual"),
    ("renewal_success_rate", "renewal_first_attempt_success_actual", "renewal_first_attempt_success_counterfactual"),
    ("refund_rate", "extra_refunds", ""),
    ("duplicate_charge_rate", "duplicate_charges", ""),
    ("charge_attempt_volume", "injected_attempts", ""),
)


def _summed(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """check and violations of every rule (a truth value or a number a row) in one pass."""
    per = {name: F.coalesce(F.sum(F.coalesce(rule.cast("bigint"), F.lit(0))), F.lit(0)).alias(name) for name, rule in rules.items()}
    pairs = F.array(*(F.struct(F.lit(name).alias("check"), F.col(name).alias("violations")) for name in per))
    return rows.agg(*per.values()).select(F.inline(pairs))


def _incident() -> Column:
    return ~F.col("expected_route").eqNullSafe("suppress")


def truth_record_rules(truth: DataFrame) -> DataFrame:
    """What is wrong within records and between them.

    truth: scenario_id, record_key, fields (the names a record has), true_cause, root_cause, expected_route, is_incident,
    incident_id, start, end, detection_start, detection_end, expected_recovery, oracle_detectable_at, affected_metrics,
    unchanged_metrics, affected_cohorts, control_cohorts (arrays of maps of dimension to values), unrelated_to.
    """
    none = F.array().cast("array<string>")
    incident, col = _incident(), F.col
    known = lambda c, xs: F.coalesce(col(c).isin(*xs), F.lit(False))
    has_id = F.coalesce(F.startswith(col("incident_id"), F.lit("inc_")), F.lit(False))
    window = F.coalesce((col("detection_end") > col("detection_start")) & (col("detection_start") == col("start")), F.lit(False))
    text = lambda c: F.transform(F.coalesce(c, F.array().cast("array<map<string,array<string>>>")), lambda m: F.to_json(F.array_sort(F.map_entries(m))))
    every = F.flatten(F.transform(F.concat(*(F.coalesce(c, F.array().cast("array<map<string,array<string>>>")) for c in ("affected_cohorts", "control_cohorts"))), lambda m: F.map_entries(m)))
    odd = lambda e: reduce(lambda chain, d: F.when(e["key"] == d, F.size(F.array_except(e["value"], F.array(*map(F.lit, VALUES[d])))) > 0).otherwise(chain), VALUES, F.lit(False))
    rules = {
        "missing_field": F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce("fields", none))),
        "cause_vocabulary": ~known("true_cause", CAUSES),
        "root_cause_differs": ~col("root_cause").eqNullSafe(col("true_cause")),
        "route_vocabulary": ~known("expected_route", ROUTES),
        "is_incident_differs": ~col("is_incident").eqNullSafe(incident),
        "incident_without_id": incident & ~has_id,
        "bad_detection_window": incident & ~window,
        "suppressed_with_incident": ~incident & (col("incident_id").isNotNull() | col("detection_start").isNotNull()),
        "end_before_start": col("end") < col("start"),
        "recovery_before_start": col("expected_recovery") < col("start"),
        "metric_both_ways": F.arrays_overlap(F.coalesce("affected_metrics", none), F.coalesce("unchanged_metrics", none)),
        "suppressed_with_oracle": ~incident & col("oracle_detectable_at").isNotNull(),
        "oracle_outside": (col("oracle_detectable_at") < col("start")) | F.coalesce(col("oracle_detectable_at") > col("end"), F.lit(False)),
        "cohorts_overlap": F.arrays_overlap(text(col("affected_cohorts")), text(col("control_cohorts"))),
        "unknown_dimension": F.size(F.filter(every, lambda e: ~e["key"].isin(*DIMENSIONS))),
        "unknown_value": F.size(F.filter(every, odd)),
    }
    own = truth.where(incident & has_id).groupBy("incident_id").agg((F.count("*") - 1).alias("more"))
    keys = truth.select(F.concat("scenario_id", F.lit(":"), "record_key").alias("to")).distinct()
    links = truth.select(F.explode("unrelated_to").alias("to")).where(~F.startswith("to", F.lit("inc_")))
    lost = links.join(keys, "to", "left_anti").withColumn("more", F.lit(1))
    return _summed(truth, rules).unionByName(_summed(own, {"duplicate_incident_id": col("more")})).unionByName(_summed(lost, {"unrelated_to_unknown": col("more")}))


def truth_effect_direction(truth: DataFrame, least: int = 200) -> DataFrame:
    """Incidents with enough attempts whose measured effect doesn't have the declared direction.

    truth also has primary_metric and measured (map of figures); a figure that is missing counts as a violation.
    """
    figure = lambda name: F.element_at("measured", F.lit(name))
    enough = _incident() & (F.coalesce(figure("charge_attempts"), F.lit(0.0)) >= least)
    fits = lambda a, b: F.coalesce(figure(a) < figure(b) if b else figure(a) != 0, F.lit(False))
    return _summed(truth, {f"direction_{m}": enough & (F.col("primary_metric") == m) & ~fits(a, b) for m, a, b in DIRECTIONS})


def truth_scenario_coverage(truth: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Scenarios (scenario_id) without a record."""
    bare = scenarios.select("scenario_id").join(truth.select("scenario_id").distinct(), "scenario_id", "left_anti")
    return _summed(bare, {"scenario_without_record": F.lit(1)})


def side_signal_rules(truth: DataFrame, deployments: DataFrame, status: DataFrame) -> DataFrame:
    """Cited side signals that no side file has, and causes that a side file names anywhere in its text."""
    cited = truth.select(F.explode("side_signals").alias("id"))
    lost = cited.join(deployments.select("id").union(status.select("id")).distinct(), "id", "left_anti")
    named = lambda df: df.select(F.explode(F.filter(F.array(*map(F.lit, CAUSES)), lambda c: F.contains(F.to_json(F.struct("*")), c))).alias("cause"))
    causes = named(deployments).union(named(status)).distinct()
    return _summed(lost, {"side_signal_missing": F.lit(1)}).unionByName(_summed(causes, {"cause_in_side_file": F.lit(1)}))
