import pandas as pd
import pytest
from pyspark.sql import functions as F

from tollgate.operators import checks, cohorts, decide, detect, metrics, normalize
from tollgate.sources import raw_events


@pytest.mark.parametrize("bad", [dict(metric="x"), dict(version=9), dict(grain="2h"), dict(start=1), dict(end=0), dict(group_by=["plan"]), dict(filters={"psp": []}), dict(filters={"psp": [1]}), dict(visibility="soon"), dict(end=10**10)])
def test_bad_requests(bad):
    with pytest.raises(metrics.MetricError):
        metrics.request(**(dict(metric="authorization_rate", version=1, start=0, end=86_400, grain="1h") | bad))


def _raw(spark, rows):
    names = raw_events.FLAT
    schema = ", ".join(f"{n} {'bigint' if n in ('seq', 'created', 'delivered_at', *raw_events.NUMBERS) else 'string'}" for n in names)
    return spark.createDataFrame([tuple(({"run_id": "r", "amount": 5, "currency": "eur", "created": 100 + r["seq"]} | r).get(n) for n in names) for r in rows], schema)


def test_normalize_rules(spark):
    rows = [
        dict(seq=1, id="a", type="customer.subscription.created", object_type="subscription", object_id="s1", subscription="s1", plan="gold"),
        dict(seq=2, id="b", type="invoice.created", object_type="invoice", object_id="i1", invoice="i1", subscription="s1"),
        dict(seq=3, id="c", type="payment_intent.created", object_type="payment_intent", object_id="p1", payment_intent="p1", invoice="i1", channel="renewal", psp="x", idempotency_key="k"),
        dict(seq=4, id="d", type="charge.failed", object_type="charge", object_id="c1", payment_intent="p1", failure_code="card_declined"),
        dict(seq=5, id="e", type="charge.failed", object_type="charge", object_id="c2", payment_intent="p1", failure_code="card_declined", outcome_reason="highest_risk_level"),
        dict(seq=6, id="f", type="invoice.payment_failed", object_type="invoice", object_id="i1", invoice="i1", subscription="s1"),
        dict(seq=7, id="g", type="charge.succeeded", object_type="charge", object_id="c3", payment_intent="p9"),
        dict(seq=8, id="h", type="refund.created", object_type="refund", object_id="r1", payment_intent="p1", status="pending", channel="renewal"),
        dict(seq=9, id="i", type="never.seen", object_type="x", object_id="x1"),
        dict(seq=10, id="j", type="customer.subscription.deleted", object_type="subscription", object_id="s1", subscription="s1", invoice="i1", prev_status="active"),
    ]
    raw = _raw(spark, rows)
    got = normalize.normalize_run(raw).orderBy("raw_seq", "event_type").toPandas()
    assert got.groupby("raw_seq").event_type.apply(list).to_dict() == {
        2: ["invoice.created"], 3: ["subscription.renewal_attempted"], 4: ["payment.declined"], 5: ["dunning.attempted", "fraud.flagged", "payment.declined"],
        6: ["invoice.payment_failed"], 8: ["refund.requested"], 10: ["subscription.canceled"],
    }
    by = got.set_index("event_id")
    assert by.loc["b/invoice.created", "psp"] == "unknown" and by.loc["f/invoice.payment_failed", "psp"] == "x"
    assert by.loc["d/payment.declined", "plan_id"] == "gold" and by.loc["e/payment.declined", "attempt_no"] == 2
    assert by.loc["j/subscription.canceled", "status"] == "canceled_voluntary"
    assert {(r.seq, r.reason) for r in normalize.norm_rejects(raw).collect()} == {(7, "before_payment_intent"), (9, "unknown_type")}
    with pytest.raises(ValueError):
        normalize.normalize_run(raw, strict=True)


def test_raw_json_round(spark, tmp_path):
    line = '{"id":"evt_1","object":"event","api_version":"v","created":7,"livemode":false,"type":"charge.succeeded","data":{"object":{"id":"ch_1","object":"charge","amount":12,"currency":"eur","payment_intent":"pi_1","payment_method_details":{"type":"card","card":{"brand":"visa","country":"DE"}},"metadata":{"psp":"x"}}},"request":{"id":null,"idempotency_key":"k"}}'
    (tmp_path / "e.json").write_text(line + "\n")
    got = raw_events.flatten_raw(raw_events.read_raw_events(spark, str(tmp_path / "e.json"), "r")).first()
    assert (got.seq, got.issuer_country, got.card_brand, got.psp, got.amount, got.payment_intent, got.idempotency_key) == (0, "DE", "visa", "x", 12, "pi_1", "k")


def test_payload_checks(spark):
    rows = spark.createDataFrame([('{"a":"4242424242424242"}',), ('{"email":"x"}',), ('{"b":"DE89370400440532013000"}',), ('{"c":"scn_1"}',), ("{}",)], "data string")
    got = {r["check"]: r["violations"] for r in checks.payload_checks(rows).collect()}
    assert got == {"pan_like_runs": 1, "token_leak": 1, "forbidden_keys": 1, "luhn_pan": 1, "iban_like": 1}


def test_created_monotone_across_blocks(spark):
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate([1, 5, 5, 4, 6, 2, 7])], "run_id string, seq bigint, created bigint")
    for block in (1, 2, 3, 100):
        assert checks.created_monotone(df, block).first()["violations"] == 2


def test_replace_run_and_append(spark, tmp_path):
    df, path = spark.range(5).toDF("x"), str(tmp_path / "t")
    raw_events.replace_run(df, path, "a", expected=5)
    raw_events.replace_run(df, path, "b")
    with pytest.raises(ValueError):
        raw_events.replace_run(df, path, "a")
    raw_events.replace_run(df.limit(2), path, "a", replace=True, expected=2)
    raw_events.append_log(df.withColumn("run_id", F.lit("b")), path)
    assert {r["run_id"]: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {"a": 2, "b": 10}


def _series(spark, values):
    rows = [("S", "m", 1, 86_400, "down", "rate", True, "", i * 86_400, n, d) for i, (n, d) in enumerate(values)]
    return spark.createDataFrame(rows, "series string, metric string, version int, grain_s int, direction string, kind string, cusum boolean, scope string, ts bigint, num bigint, den bigint")


def test_episode_opens_and_recovers_and_prefix_is_stable(spark):
    values = [(900 + i % 3, 1000) for i in range(14)] + [(600, 1000)] * 3 + [(900, 1000)] * 6
    whole = detect.episodes(detect.flagged_series(_series(spark, values)), 0).toPandas()
    assert len(whole) == 1 and whole.window_start[0] == 14 * 86_400 and whole.recovered_at[0] > 17 * 86_400
    flags = detect.flagged_series(_series(spark, values)).toPandas().set_index("ts")
    cut = detect.flagged_series(_series(spark, values[:17])).toPandas().set_index("ts")
    assert (flags.loc[cut.index, "fire_p"] == cut["fire_p"]).all()


def test_decomposition_sums_exactly(spark):
    rows = spark.createDataFrame([("c", "psp", f"psp={i}", "rate", "down", float(k), float(n), float(j), float(m)) for i, (k, n, j, m) in enumerate([(80, 100, 50, 90), (10, 40, 30, 60), (0, 0, 5, 9), (7, 9, 0, 0)])], "candidate_id string, combination string, cohort string, kind string, direction string, k_b double, n_b double, k_d double, n_d double")
    got = cohorts.decompose(rows).toPandas()
    total = got.k_d.sum() / got.n_d.sum() - got.k_b.sum() / got.n_b.sum()
    assert abs(got.rate_part.sum() + got.composition_part.sum() - total) < 1e-12


def test_benjamini_hochberg_worked_example(spark):
    p = [0.01, 0.02, 0.03, 0.04, 0.5]
    rows = spark.createDataFrame([("c", "x", str(i), v) for i, v in enumerate(p)], "candidate_id string, combination string, cohort string, p double")
    got = cohorts.benjamini_hochberg(rows).orderBy("p").toPandas()
    assert got.discovery.tolist() == [True] * 4 + [False]
    assert got.q.round(9).tolist() == [0.05, 0.05, 0.05, 0.05, 0.5]


def test_policy_rows(spark):
    base = dict(incident_p=0.9, needs_human_p=0.1, change_type="rate_change", p_severity_high=0.9, locus_kind="cohort", severity_level="high", strength="strong", impact="large")
    cases = [({}, "r8_incident"), (dict(incident_p=None), "r0_unverified"), (dict(incident_p=0.1), "r2_safety_strong_signal"), (dict(incident_p=0.1, strength="weak"), "r1_not_incident"), (dict(incident_p=0.5), "r3_uncertain"), (dict(needs_human_p=0.6), "r4_needs_human"), (dict(change_type="mix_shift", p_severity_high=0.1), "r5_healthy_composition"), (dict(locus_kind="none"), "r6_weak_locus"), (dict(locus_kind="none", severity_level="critical"), "r8_incident"), (dict(severity_level="low"), "r7_low_severity")]
    df = spark.createDataFrame(pd.DataFrame([base | c | {"want": w} for c, w in cases]))
    df = df.withColumn("incident_p", F.when(F.isnan("incident_p"), None).otherwise(F.col("incident_p")))
    assert decide.policy_route(df).where("rule != want").count() == 0


def test_verify_answers(spark):
    """Every reason code, alone where it can be, and a recorded error."""
    import json

    q = {"p_incident": (), "severity": ("low", "high")}
    fine = [("p_incident", {"p": 0.4}), ("severity", {"probs": {"low": 0.4, "high": 0.6}, "confidence": 0.9})]
    pick = lambda **x: [("p_incident", {"p": 0.4}), ("severity", x)]
    base = dict(request_hash="h", state_hash="s", schema_version="v1", question_set="q1", as_of=100, evaluated_at=100, state={"strength": "strong", "impact": "not_provided"}, provenance={"strength": ["evd_1"]}, error=None, r_request_hash="h", r_state_hash="s", r_schema_version="v1", r_question_set="q1", model="m", request_at=100, response_at=110, raw_bytes=50, answers=fine)
    cases = {
        "": {}, "missing_question": dict(answers=fine[:1]), "duplicate_question": dict(answers=[*fine, fine[0]]), "unknown_question": dict(answers=[*fine, ("other", {"p": 2})]), "invalid_option": dict(answers=pick(probs={"low": 0.4, "mid": 0.6}, confidence=1)), "cardinality": dict(answers=pick(probs={"low": 1.0}, confidence=1)),
        "inconsistent_choice": dict(answers=pick(probs={"low": 0.4, "high": 0.7}, confidence=1)), "out_of_range": dict(answers=[("p_incident", {"p": 1.4}), fine[1]]), "out_of_range ": dict(answers=pick(probs={"low": 0.4, "high": 0.6}, confidence=7)), "schema": dict(answers=[("p_incident", {"q": 0.4}), fine[1]]), "schema ": dict(answers=pick(probs=3, confidence=1)), "schema  ": dict(answers=None),
        "missing_provenance": dict(provenance={}), "state_hash_mismatch": dict(r_state_hash="x"), "state_hash_mismatch ": dict(r_request_hash="x"), "schema_version_mismatch": dict(r_schema_version=None), "question_set_mismatch": dict(r_question_set="x"), "model_mismatch": dict(model=""), "stale_response": dict(response_at=99),
        "stale_response ": dict(response_at=9_999), "stale_response  ": dict(request_at=90, response_at=95), "oversized_response": dict(raw_bytes=20_000), "error": dict(error="timeout", answers=None, model=None, r_state_hash=None),
    }
    schema = "request_hash string, state_hash string, schema_version string, question_set string, as_of long, evaluated_at long, state map<string,string>, provenance map<string,array<string>>, error string, r_request_hash string, r_state_hash string, r_schema_version string, r_question_set string, model string, request_at long, response_at long, raw_bytes long, answers array<struct<qid:string,payload:string>>"
    rows = []
    for name, change in cases.items():
        row = base | change | ({"request_hash": name, "r_request_hash": name} if "r_request_hash" not in change else {"request_hash": name})
        rows.append(tuple({**row, "answers": None if row["answers"] is None else [(i, json.dumps(x)) for i, x in row["answers"]]}[f.split(" ")[0]] for f in schema.split(", ")))
    got = {r.request_hash: (r.reasons, r.verified) for r in decide.verify_answers(spark.createDataFrame(rows, schema), q, "m").collect()}
    want = {n: ["timeout"] if n == "error" else [n.strip()] if n else [] for n in cases}
    want["schema  "] = ["schema"]
    assert {n: r for n, (r, _) in got.items()} == want and all(ok == (not r) for r, ok in got.values())
    assert {c.strip() for c in cases} - {"", "error"} == set(decide.REASONS)


def test_decision_records(spark):
    rows = [("c1", 5, "s", "h", True, [], "INCIDENT", "r8_incident"), ("c2", 5, "s", "h", False, ["schema", "cardinality"], "INCIDENT", "r8_incident"), ("c3", 5, "s", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "candidate_id string, as_of long, state_hash string, request_hash string, verified boolean, reasons array<string>, route string, rule string")
    got = {r.candidate_id: r for r in decide.decision_records(df).collect()}
    assert [(got[c].route, got[c].rule, got[c].reason) for c in ("c1", "c2", "c3")] == [("INCIDENT", "r8_incident", None), ("DIGEST", "r0_unverified", "schema"), ("DIGEST", "r0_unverified", "no_answer")]
    assert len({r.decision_id for r in got.values()}) == 3 and decide.decision_records(df).first().decision_id == got["c1"].decision_id


def test_lifecycle(spark):
    from tollgate.operators import context

    rows = [("a", 1, "DETECTED", "system"), ("a", 2, "INVESTIGATING", "system"), ("a", 3, "RESOLVED", "human"), ("b", 1, "DETECTED", "system"), ("b", 2, "RESOLVED", "policy"), ("b", 3, "INVESTIGATING", "system")]
    got = context.lifecycle_check(spark.createDataFrame(rows, "incident_id string, seq int, status string, actor string")).collect()
    assert {(r.incident_id, r.seq) for r in got} == {("b", 2), ("b", 3)}


def test_first_crossing_and_calibration(spark):
    from tollgate.operators import evaluate

    rows = [("s", 0, h, 100, 90 if h < 5 else 40, 100, 90) for h in range(10)] + [("t", 0, h, 100, 90, 100, 90) for h in range(10)]
    got = {r.series: r.detectable_at for r in evaluate.first_crossing(spark.createDataFrame(rows, "series string, start bigint, hour bigint, n bigint, k bigint, n_cf bigint, k_cf bigint"), "rate").collect()}
    assert got == {"s": 6 * 3600, "t": None}
    scored = spark.createDataFrame([(0.05, False), (1.0, True), (0.95, False)], "p double, y boolean")
    assert {r.bin: r.n for r in evaluate.calibration(scored).collect()} == {0: 1, 9: 2}


def test_status_near_by_buckets(spark):
    """Like all pairs, without a join of all ended entries on the provider alone."""
    import random

    from tollgate.operators import context

    rng = random.Random(4)
    inc = [(f"i{i}", rng.choice("ab"), t := rng.randrange(300_000), t + rng.choice((-30_000, 0, 3600, 90_000))) for i in range(80)]
    entries = [(f"s{i}", rng.choice("ab"), p := rng.randrange(300_000), rng.choice((None, p + 900, p + 50_000, p - 500))) for i in range(400)] + [("none", "a", None, None)]
    got = context.status_near(spark.createDataFrame(inc, "incident_id string, psp string, onset long, as_of long"), spark.createDataFrame(entries, "id string, psp string, posted_at long, resolved_at long"))
    want = set()
    for i, psp, onset, as_of in inc:
        near = sorted((p, s, r) for s, q, p, r in entries if q == psp and p is not None and p <= as_of and (r is None or r >= onset - 21_600))
        want |= {(i, s, psp, p, r if r is not None and r <= as_of else None) for p, s, r in near[:50]}
    rows = got.select("incident_id", "id", "psp", "posted_at", "resolved_at").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x]
    assert len(joins) == 2 and all("b#" in x or "broadcast" in x for x in joins)


def test_replace_run_with_nothing(spark, tmp_path):
    """Replacing a run by no rows leaves none; a wrong count changes nothing; files of several parts are numbered through."""
    path = str(tmp_path / "t")
    rows = spark.range(5).withColumn("x", F.lit(1))
    raw_events.replace_run(rows, path, "a")
    raw_events.replace_run(rows, path, "b")
    with pytest.raises(ValueError):
        raw_events.replace_run(rows, path, "a", replace=True, expected=4)
    assert spark.read.parquet(path).where("run_id = 'a'").count() == 5
    raw_events.replace_run(rows.limit(0), path, "a", replace=True)
    left = spark.read.parquet(path)
    assert left.where("run_id = 'a'").count() == 0 and left.where("run_id = 'b'").count() == 5
    for i in range(3):
        (tmp_path / f"l{i}.json").write_text("".join('{"id":"e%d_%d","type":"x"}' % (i, j) + chr(10) for j in range(4)))
    got = raw_events.read_raw_events(spark, str(tmp_path / "l*.json"), "r").collect()
    assert sorted(r.seq for r in got) == list(range(12))
    for i in range(3):
        own = sorted((r.seq, r.id) for r in got if r.id.startswith(f"e{i}_"))
        assert [x[1] for x in own] == [f"e{i}_{j}" for j in range(4)]


def test_first_fifty_near_however_many_there_are(spark):
    """Deployments and status entries like plain Python, where hours hold far more than fifty; an onset meets a hundred places at most."""
    import random

    from tollgate.operators import context

    rng = random.Random(9)
    inc = [(f"i{i}", "a", t := rng.randrange(40_000), t + rng.choice((-9_000, 0, 3600, 90_000))) for i in range(40)]
    deployed = [(f"d{i}", rng.choice(("ledger", "ledger", "other")), rng.choice((None, *[rng.randrange(50_000)] * 9))) for i in range(1500)]
    schema = "incident_id string, psp string, onset long, as_of long"
    got = context.deployments_near(spark.createDataFrame(inc, schema), spark.createDataFrame(deployed, "id string, service string, deployed_at long"))
    want = set()
    for i, _, onset, as_of in inc:
        near = sorted((t, d, s) for d, s, t in deployed if s == "ledger" and t is not None and onset - 7_200 <= t <= min(onset + 7_200, as_of))
        want |= {(i, d, s, t) for t, d, s in near[:50]}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "place" in got._jdf.queryExecution().optimizedPlan().toString()
    entries = [(f"s{i}", "a", p := rng.randrange(40_000), None if rng.random() < 0.3 else p + 10_800) for i in range(600)]
    found = context.status_near(spark.createDataFrame(inc, schema), spark.createDataFrame(entries, "id string, psp string, posted_at long, resolved_at long"))
    want = set()
    for i, psp, onset, as_of in inc:
        near = sorted((p, s, r) for s, q, p, r in entries if p <= as_of and (r is None or r >= onset - 21_600))
        want |= {(i, s, psp, p, r if r is not None and r <= as_of else None) for p, s, r in near[:50]}
    assert {tuple(r) for r in found.select("incident_id", "id", "psp", "posted_at", "resolved_at").collect()} == want
    assert "enough" in found._jdf.queryExecution().optimizedPlan().toString()
