import pytest
from twins import same

from tollgate.plans import cohort_queries, decide_queries, detect_queries, evaluate_queries, impact_queries, incident_queries, investigate_queries, loop_queries, more_queries, pool_queries, queries, raw_queries, report_queries, score_queries, stream_queries, truth_queries, tune_queries, view_queries  # noqa: F401

FEW = ["norm_from_events", "d1_compute", "d4_first_look", "d7_densify", "d13_checkout_conversion_rate", "d14_checkout_conversion_rate_v2", "d20_late_arrival_share", "d22_duplicate_charge_rate", "d26_revenue_collected_minor", "c16_normalize_dirty", "c14_norm_rejects", "c14_norm_rejects_orders", "c2_norm_event_map", "b2_dangling_refs", "b14_envelope_shape", "b16_object_type_match", "b18_refs_seen_before", "b19_pi_lifecycle", "b20_charge_refund_rules", "b21_billing_object_rules", "b7_b10_norm_checks", "e8_point_flags", "f7_benjamini_hochberg", "f11_change_label", "f14_rank_top_cohorts", "f20_naive_locus", "e13_prefilter_low_volume", "e14_link_parent", "e15_as_of_view", "e16_concurrent_at", "h2_first_matches", "j2_candidate_classes", "j2_score_detection", "j3_match_status", "j6_localization_class", "g8_policy_route", "i5_narrow_select", "i6_hypothesis_priors", "i9_hypothesis_status", "i11_similar_incidents", "h7_impact_anchor", "h8_lost_successes", "b22_truth_record_rules", "b23_truth_effect_direction", "b24_truth_scenario_coverage", "b25_side_signal_rules", "j4_route_scores", "j4_answer_scores", "j9_labels_by_checkpoint", "j15_ingestion_hub_joins", "g5_attach_answers", "k4_tune_call_budget", "e2_lagged_baseline", "e4_stabilized_z_rate", "e5_stabilized_z_count", "e16_concurrent_counts", "f21_cohort_sweep", "k1_passing_grid", "k1_tune_baseline_route", "j8_incident_scores", "j8_record_scores", "j8_score_incidents", "h3_chains", "b5_b13_payload_checks", "a10_next_seq", "g7_assess", "g10_decision_records", "f19_link_related", "f4_z_count", "i1_measure", "i14_validate_claims", "i15_investigation_status", "h9_revenue_baseline", "h10_incident_impact", "j17_pool_scores", "j17_contrast", "i2_view_members", "i2_incident_views"]


@pytest.mark.parametrize("name", FEW)
def test_same_as_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.SQL[name])


def test_every_raw_rule_is_broken_somewhere(spark):
    """The envelopes made of customers give every check something to find (the smallest table lacks a few of them)."""
    from tollgate.operators import checks
    from tollgate.sources import raw_events

    flat = raw_events.raw_from_customers(spark, "/root/testdata/sf0.01").cache()
    found = checks.report(checks.dangling_refs(flat), checks.charge_amount_ne_pi(flat), checks.refunds_exceed_charge(flat), checks.object_type_match(flat), checks.creation_order(flat), checks.refs_seen_before(flat), checks.pi_lifecycle(flat), checks.charge_refund_rules(flat), checks.billing_object_rules(flat))
    silent = {r["check"] for r in found.collect() if not r["violations"]}
    assert silent <= {"pi_amount_positive", "dangling_charge_payment_intent", "dangling_subscription_customer", "creation_order"}
