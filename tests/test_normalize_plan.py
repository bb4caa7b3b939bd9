"""Normalization reads its input once, whatever the number of windows, and loses no row of an odd type."""

from pyspark.sql import functions as F

from tollgate.operators import checks, normalize
from tollgate.sources.raw_events import raw_from_orders
from twins import SMALL


def _written(spark, tmp_path):
    path = f"{tmp_path}/raw"
    raw_from_orders(spark, SMALL, True).write.parquet(path)
    return spark.read.parquet(path)


def _scans(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("FileScan")


def test_one_scan_for_all_windows(spark, tmp_path):
    raw = _written(spark, tmp_path)
    assert _scans(normalize.normalize_run(raw)) == 1
    assert _scans(normalize.norm_rejects(raw)) == 1
    assert _scans(checks.norm_checks(normalize.normalize_run(raw), raw)) <= 10


def test_rows_without_type_or_key_are_told(spark, tmp_path):
    raw = _written(spark, tmp_path)
    odd = raw.limit(3).withColumns({"type": F.lit(None).cast("string"), "seq": F.lit(-1).cast("bigint"), "payment_intent": F.lit(None).cast("string")})
    got = normalize.norm_rejects(raw.unionByName(odd)).where("seq = -1").collect()
    assert [r.reason for r in got] == ["unknown_type"] * 3


def test_two_shuffles_for_all_windows(spark, tmp_path):
    raw = _written(spark, tmp_path)
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(normalize.normalize_run(raw)) == 2
    assert shuffles(normalize.norm_rejects(raw)) <= 2


def test_a_charge_knows_the_plan_its_intent_had(spark):
    flat = "run_id string, seq long, type string, subscription string, invoice string, payment_intent string, plan string, psp string, channel string, idempotency_key string, status string, prev_period string, failure_code string, outcome_reason string"
    row = lambda seq, kind, sub=None, inv=None, pi=None, plan=None: ("r", seq, kind, sub, inv, pi, plan, "p", "renewal", None, "active", "1", None, None)
    rows = [
        row(1, "customer.subscription.created", "x", None, None, "gold"), row(2, "invoice.created", "x", "x"), row(3, "payment_intent.created", None, "x", "x"),
        row(4, "customer.subscription.created", "x", None, None, "iron"), row(5, "invoice.payment_failed", "x", "x"), row(6, "charge.succeeded", None, None, "x"),
        row(7, "payment_intent.created", None, "x", "x"), row(8, "charge.succeeded", None, None, "x"), row(9, "charge.succeeded", None, "x", "y"), row(10, "payment_intent.created", None, None, "z"), row(11, "charge.succeeded", None, "x", "z"),
    ]
    got = {r.seq: r for r in normalize.classified(spark.createDataFrame(rows, flat)).collect()}
    assert [got[i].pi_plan for i in (6, 8, 9, 11)] == ["gold", "iron", None, "unknown"]
    assert [got[i].attempt for i in (6, 8, 9, 11)] == [1, 2, 0, 1]
    assert [got[i].invoice_plan for i in (3, 7, 10)] == ["gold", "iron", None] and got[5].sub_plan == "iron" and got[5].invoice_psp == "p"
    assert got[9].reject == "before_payment_intent"
