"""Registered queries of labels and routes over tested cohorts, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decide as g
from .cohort_queries import RATE, tested
from .queries import add


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tested cohort as a state of closed labels; its own test stands in for an answer's probability."""
    t = tested(spark, sf_dir)
    hours = F.lit(72.0)
    lost = F.col("toward") * (F.col("k_d") / F.col("n_d") - F.col("k_b") / F.col("n_b")) * F.col("n_d")
    rel = (F.col("k_d") / F.col("n_d") - F.col("k_b") / F.col("n_b")) / F.nullif(F.col("k_b") / F.col("n_b"), F.lit(0.0))
    return t.select(
        "candidate_id", "cohort", g.relative_change(rel, F.col("direction")).alias("relative_change"), g.strength(F.col("z")).alias("strength"), g.sample_size(F.col("n_d")).alias("sample"), g.share(F.col("coverage")).alias("locus_share"), g.impact_rate(lost, hours).alias("impact"),
        F.when(F.col("discovery"), "rate_change").when(F.abs("composition_part") > F.abs("rate_part"), "mix_shift").otherwise("insufficient_data").alias("change_type"), F.when(F.col("coverage") > 0.1, "cohort").otherwise("none").alias("locus_kind"),
        F.round(1 - F.col("p"), 6).alias("incident_p"), F.round(F.col("q"), 6).alias("needs_human_p"), F.round(F.least(F.lit(1.0), F.abs("coverage")), 6).alias("p_severity_high"), F.when(F.abs("z") > 8, "critical").when(F.abs("z") > 4, "high").when(F.abs("z") > 2, "medium").otherwise("low").alias("severity_level"),
    )


def _edges(x: str, steps: tuple, last: str) -> str:
    return f"case when {x} is null then 'not_provided' " + " ".join(f"when {x} < {e} then '{n}'" for e, n in steps) + f" else '{last}' end"


_REL = "((k_d / n_d - k_b / n_b) / nullif(k_b / n_b, 0))"
LABELS = f"""{RATE}, labels as (select candidate_id, cohort, case when direction = 'down' then {_edges(f"abs({_REL})", g.DROP, "collapse")} when {_REL} is null then 'extreme' else {_edges(f"abs({_REL})", g.RISE, "extreme")} end as relative_change,
  {_edges("abs(z)", g.STRENGTH, "strong")} as strength, {_edges("n_d", g.SAMPLE, "large")} as sample, {_edges("coverage", g.SHARE, "nearly_all")} as locus_share, {_edges("(greatest(0.0, toward * (k_d / n_d - k_b / n_b) * n_d) / 72.0)", g.IMPACT, "large")} as impact,
  case when discovery then 'rate_change' when abs(composition_part) > abs(rate_part) then 'mix_shift' else 'insufficient_data' end as change_type, case when coverage > 0.1 then 'cohort' else 'none' end as locus_kind,
  round(1 - p, 6) as incident_p, round(q, 6) as needs_human_p, round(least(1.0, abs(coverage)), 6) as p_severity_high, case when abs(z) > 8 then 'critical' when abs(z) > 4 then 'high' when abs(z) > 2 then 'medium' else 'low' end as severity_level from tested)
"""
_ROUTE = """case when incident_p is null then 'r0_unverified' when incident_p < 0.30 and strength = 'strong' and impact in ('medium', 'large') then 'r2_safety_strong_signal' when incident_p < 0.30 then 'r1_not_incident' when incident_p < 0.70 then 'r3_uncertain'
  when needs_human_p >= 0.60 then 'r4_needs_human' when change_type in ('volume_only', 'mix_shift') and p_severity_high < 0.50 then 'r5_healthy_composition'
  when (locus_kind in ('none', 'not_provided') or change_type in ('insufficient_data', 'not_provided')) and not (severity_level = 'critical' and incident_p >= 0.85) then 'r6_weak_locus' when severity_level = 'low' then 'r7_low_severity' else 'r8_incident' end"""

add("g1_bucketize", labels, LABELS + "select * from labels")
add("g8_policy_route", lambda s, sf: g.policy_route(labels(s, sf)).select("candidate_id", "cohort", "route", "rule"), LABELS + f"select candidate_id, cohort, case rule when 'r1_not_incident' then 'IGNORE' when 'r8_incident' then 'INCIDENT' else 'DIGEST' end as route, rule from (select *, {_ROUTE} as rule from labels)")
add("g9_baseline_route", lambda s, sf: g.baseline_route(labels(s, sf)).select("candidate_id", "cohort", "baseline", "baseline_rule"), LABELS + """select candidate_id, cohort, case when strong then 'INCIDENT' when weak then 'IGNORE' else 'DIGEST' end as baseline, case when strong then 'b1_strong_localized_rate_change' when weak then 'b2_weak_composition' else 'b3_otherwise' end as baseline_rule
from (select *, strength = 'strong' and change_type in ('rate_change', 'new_cohort', 'mixed') and impact in ('negligible', 'small', 'medium', 'large') as strong, change_type in ('mix_shift', 'volume_only') and strength = 'weak' as weak from labels)""")
add("g4_state_hash", lambda s, sf: g.state_hash(labels(s, sf), ["strength", "sample", "locus_share", "impact", "change_type"]).select("candidate_id", "cohort", "state_hash"), LABELS + """select candidate_id, cohort, sha256('state_v1|{"change_type":"' || change_type || '","impact":"' || impact || '","locus_share":"' || locus_share || '","sample":"' || sample || '","strength":"' || strength || '"}') as state_hash from labels""")
