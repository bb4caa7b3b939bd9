"""States, decisions and the event stream of candidates looked at several times."""

import random

from pyspark.sql import functions as F

from tollgate.operators import decide as g
from tollgate.operators import detect as d
from tollgate.operators import incidents as h
from tollgate.operators import stream_of_incidents as st
from tollgate.plans.queries import END, START, norm
from tollgate.sources.driver_tables import PLANTED

SMALL = "/root/testdata/sf0.01"
CAND = "anomaly_id string, system string, series string, metric string, version int, grain string, scope string, direction string, window_start bigint, window_end bigint, detected_at bigint, observed double, expected double, delta double, relative_delta double, score double, sample_size bigint, methods array<string>, evidence_ids array<string>, status string, recovered_at bigint, score_at_detection double, methods_at_detection array<string>, parent_id string"


def _cand(name, scope, start, end, recovered, rel=-0.5, score=9.0, status="recovered", metric="authorization_rate"):
    return (name, "main", "S", metric, 1, "1d", scope, "down", start, end, end, 0.3, 0.75, -0.45, rel, score, 500, ["z_persistence"], [f"evd_{name}", "evd_later"], status, recovered, score, ["z_persistence"], None)


def test_every_look_as_if_alone(spark):
    day = 86_400
    rows = [
        _cand("beta", "psp=psp_beta", PLANTED[0], PLANTED[0] + day, PLANTED[1]), _cand("whole", "", PLANTED[0], PLANTED[0] + day, None, status="promoted"),
        _cand("calm", "", START + 9 * day, START + 10 * day, START + 10 * day + 3_600, rel=-0.01, score=2.0), _cand("low", "", START + 9 * day, START + 10 * day, None, status="suppressed"),
    ]
    cand = spark.createDataFrame(rows, CAND)
    events = norm(spark, SMALL)
    got = {r.candidate_id: r.asDict(True) for r in st.decide_all(events, cand, START, END, source="baseline", looks=True).collect()}
    at = lambda name: sorted((r["nth"], r["as_of"]) for r in got.values() if r["anomaly_id"] == name)
    det = PLANTED[0] + day
    assert at("beta") == [(0, det), (1, det + 21_600), (2, det + day), (3, PLANTED[1])] or at("beta") == [(0, det), (1, det + 21_600), (2, det + day)] + ([(3, PLANTED[1])] if PLANTED[1] > det + day else [])
    assert at("calm") == [(0, START + 10 * day), (1, START + 10 * day + 3_600)] and at("low") == []
    alone = spark.createDataFrame([_cand("beta", "psp=psp_beta", PLANTED[0], PLANTED[0] + day, PLANTED[1]), *rows[1:3]], CAND)
    first = {r.candidate_id: r.asDict(True) for r in st.decide_all(events, alone, START, END, source="baseline").collect()}
    assert first and all(got[k] == x for k, x in first.items())
    beta, calm = got[f"beta@{det}@0"], got[f"calm@{START + 10 * day}@0"]
    assert (beta["metric_family"], beta["cadence"], beta["scope_dims"], beta["strength"], beta["relative_change"], beta["calendar_context"]) == ("approval", "daily", "psp", "strong", "collapse", "not_provided")
    assert beta["change_type"] != "not_provided" and beta["concurrent_alerts"] == "one" and calm["concurrent_alerts"] == "none" and calm["relative_change"] == "none"
    assert set(beta["provenance"]) == set(g.STATE) and beta["provenance"]["direction"] == ["evd_beta"] and not beta["provenance"]["calendar_context"]
    assert beta["route"] in ("INCIDENT", "DIGEST", "IGNORE") and not beta["verified"]

    decided = st.decide_all(events, cand, START, END, source="all", looks=True)
    stream = st.incident_event_stream(decided, cand)
    kinds = {(r.candidate_id, r.kind): r["count"] for r in stream.groupBy("candidate_id", "kind").count().collect()}
    assert kinds["beta", "detected"] == 1 and kinds["beta", "recovered"] == kinds["beta", "recovery_check"] == 1 and ("whole", "recovered") not in kinds
    fold = h.fold_incidents(stream)
    made = h.incident_events(fold).where("reason = 'incident_created'").count()
    assert made >= 2 and h.incident_links(fold).count() >= 3


def test_counts_of_concurrent_candidates(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        s = rng.randrange(40) * 43_200 + rng.randrange(3)
        e = s + rng.choice([3_600, 86_400])
        rows.append(_cand(f"c{i}", "", s, e, rng.choice([None, e, e + 7_200, e + 200_000]), status=rng.choice(["recovered", "promoted", "suppressed"])))
    cand = spark.createDataFrame(rows, CAND)
    listed = {r.anomaly_id: len(r.others) for r in d.concurrent_at(cand).collect()}
    got = {r.id: r.concurrent for r in d.concurrent_counts(cand).collect()}
    live = {r[0] for r in rows if r[19] != "suppressed"}
    assert set(got) == live and all(got[i] == listed.get(i, 0) for i in live)


def test_concurrent_candidates_like_plain_python(spark):
    """Lists of candidates of many days, some never over, some told of late; no shuffle carries a pair."""
    rng = random.Random(11)
    rows = []
    for i in range(250):
        s = rng.randrange(60 * 96) * 900
        at = s + rng.choice([900, 3_600, 86_400, 9 * 86_400, -86_400])
        rows.append(_cand(f"c{i}", "", s, at, rng.choice([None, at + 900, at + 86_400, at + 30 * 86_400, at - 900])))
    cand = spark.createDataFrame(rows, CAND)
    live = [(r.anomaly_id, r.window_start, r.detected_at, 2**40 if r.recovered_at is None else r.recovered_at) for r in d.decidable(cand).collect()]
    want = {a: sorted(o for o, ws, det, until in live if o != a and det <= at and until > since and ws < at) for a, since, at, _ in live}
    found = d.concurrent_at(cand)
    assert {r.anomaly_id: r.others for r in found.collect()} == {a: others for a, others in want.items() if others}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Aggregate" not in plan[: plan.index("Join")]  # the lists are whole when the join gives them


def test_states_that_cannot_be_told(spark):
    cand = spark.createDataFrame([_cand("odd", "", 0, 3_600, None, metric="no_such_metric")], CAND).withColumn("as_of", F.col("detected_at")).withColumn("candidate_id", F.col("anomaly_id"))
    found = spark.createDataFrame([], "candidate_id string, label string, locus string, found_by string, discoveries bigint, locus_coverage double, calm array<string>, top array<string>, related array<struct<metric:string,before:double,during:double,z:double>>, impact double")
    near = spark.createDataFrame([("odd", 0)], "id string, concurrent bigint")
    state = g.build_state(cand, found, near).first()
    assert state.invalid == "unknown_metric" and state.change_type == "not_provided" and state.locus_dims == ""
    record = g.decide_views(cand, found, near, source="all").first()
    assert (record.route, record.reason) == ("DIGEST", "state_unknown_metric")
