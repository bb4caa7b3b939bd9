"""Reports against a plain reading of the rules, with every fault of citing planted and found."""

import json
import random

from pyspark.sql import functions as F
from twins import SMALL

from tollgate.operators import reports as r
from tollgate.plans import report_queries

EVIDENCE = "investigation_id string, evidence_id string, tool string, payload string, labels map<string,string>"
CLAIMS = f"investigation_id string, nth int, template string, cause string, slots {r.SLOT}, text string"


def _at(payload, path):
    cur = payload
    for part in path.split("."):
        if isinstance(cur, list) and part.isdigit() and int(part) < len(cur):
            cur = cur[int(part)]
        elif isinstance(cur, dict) and part in cur:
            cur = cur[part]
        else:
            return None, False
    return cur, True


def _shown(v):
    return v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def _plain(runs, hyps, evidence):
    known = {(e[0], e[1]): (e[2], json.loads(e[3])) for e in evidence}
    out = []
    for run, impact in runs:
        claims = []

        def say(template, ids, cause=None, run=run, claims=claims):
            values = []
            for eid, field in ids:
                if (run, eid) not in known:
                    values.append("?")
                    continue
                v, there = _at(known[run, eid][1], field)
                values.append(_shown(v) if there else None)
            text = "" if None in values else r.TEMPLATES[template].format(*values, cause=cause)
            claims.append((run, len(claims), template, cause, tuple(e for e, _ in ids), text))

        inc = min((e for (i, e), (tool, _) in known.items() if i == run and tool == "get_incident"), default=None)
        if inc:
            say("summary", [(inc, "incident_id"), (inc, "started_at"), (inc, "detected_at")])
            say("locus", [(inc, "locus")])
        for _, _, cause, status, good, bad in sorted((h for h in hyps if h[0] == run), key=lambda h: h[1]):
            for e in good[:3]:
                payload = known.get((run, e), (None, {}))[1]
                if "outcome" in payload:
                    say("consistent", [(e, "metric"), (e, "cohort"), (e, "outcome")], cause)
                elif "present" in payload or "components" in payload:
                    say("side_support", [(e, "present" if "present" in payload else "components")], cause)
            for e in bad[:3]:
                say("against", [(e, "metric"), (e, "cohort"), (e, "outcome")], cause)
            if status == "insufficient_evidence" and inc:
                say("insufficient", [(inc, "incident_id")], cause)
        if known.get((run, impact), (None, {}))[1].get("lost_successful_payments") is not None:
            say("impact", [(impact, "lost_successful_payments")])
        out += claims
    return out


def test_reports_say_what_the_rules_say(spark):
    rnd = random.Random(3)
    runs, hyps, evidence = [], [], []
    for i in range(60):
        run = f"inv{i}"
        ids = [f"e{k}" for k in range(rnd.randrange(7))]
        for e in ids:
            kind = rnd.randrange(4)
            payload = [{"metric": "m", "cohort": [["psp", "a{1}"]], "outcome": rnd.choice(["moved", None])}, {"present": ["x"]}, {"components": []}, {"metric": "m", "outcome": "moved"}][kind]
            evidence.append((run, e, "check", json.dumps(payload), {}))
        for k in range(rnd.randrange(3)):
            evidence.append((run, f"inc{k}", "get_incident", json.dumps({"incident_id": run, "started_at": 5, "detected_at": 1.5, "locus": [["psp", "ü"]]} | ({} if rnd.random() < 0.8 else {"locus": None})), {}))
        evidence.append((run, "imp", "impact", json.dumps({"lost_successful_payments": rnd.choice([None, 0, 12])}), {}))
        runs.append((run, rnd.choice(["imp", "nowhere", None])))
        for n in range(rnd.randrange(4)):
            some = lambda: [rnd.choice([*ids, "lost"]) for _ in range(rnd.randrange(6))]
            hyps.append((run, n, f"cause{n}", rnd.choice(["open", "insufficient_evidence"]), some(), some()))
    e = spark.createDataFrame(evidence + evidence[:5], EVIDENCE)
    got = r.report_claims(spark.createDataFrame(runs, "investigation_id string, impact_evidence string"), spark.createDataFrame(hyps, "investigation_id string, nth int, cause string, status string, supporting array<string>, contradicting array<string>"), e).collect()
    have = sorted((x.investigation_id, x.nth, x.template, x.cause, tuple(s.evidence_id for s in x.slots), x.text) for x in got)
    assert have == sorted(_plain(runs, hyps, evidence))
    assert {x[2] for x in have} == set(r.TEMPLATES) - {"next"} and any(x[5] == "" for x in have) and any("?" in x[5] for x in have)


def test_every_planted_fault_is_found(spark):
    e = spark.createDataFrame([("i", "a", "t", '{"x":{"y":[1,null]},"z":null,"n":2,"0":{"1":3}}', {"x": "observed", "z": "estimated"})], EVIDENCE)
    cases = [
        ([("a", "x.y.0", "observed")], None), ([("a", "x.y.1", "observed")], None), ([("a", "z", "estimated")], None), ([("a", "n", "inferred")], None), ([("a", "0.1", "inferred")], None),
        ([("b", "x", "observed")], "unknown_evidence"), ([(None, "x", "observed")], "unknown_evidence"), ([("a", "x.y.2", "observed")], "missing_field"), ([("a", "x.q", "observed")], "missing_field"), ([("a", None, "observed")], "missing_field"),
        ([("a", "n.k", "observed")], "missing_field"), ([("a", "x", "sure")], "label_outside"), ([("a", "x", None)], "label_outside"), ([("a", "x", "inferred")], "label_differs"), ([("a", "n", "estimated")], "not_an_estimate"), ([], "no_evidence"), (None, "no_evidence"),
    ]
    claims = [("i", n, "impact", None, slots, "text") for n, (slots, _) in enumerate(cases)] + [("i", 99, "impact", None, [("a", "n", "observed")], ""), ("other", 0, "impact", None, [("a", "n", "observed")], "text")]
    got = {(x.investigation_id, x.nth): x.error for x in r.validate_claims(spark.createDataFrame(claims, CLAIMS), e).collect()}
    want = {("i", n): error for n, (_, error) in enumerate(cases) if error} | {("i", 99): "not_rendered", ("other", 0): "unknown_evidence"}
    assert got == want


def test_empty_tables(spark):
    e = spark.createDataFrame([], EVIDENCE)
    none = r.report_claims(spark.createDataFrame([], "investigation_id string, impact_evidence string"), spark.createDataFrame([], "investigation_id string, nth int, cause string, status string, supporting array<string>, contradicting array<string>"), e)
    assert none.count() == 0 and r.validate_claims(none, e).count() == 0


def test_reports_of_the_loop_may_be_shown(spark):
    known, recorded, claims = report_queries.reported(spark, SMALL)
    assert r.validate_claims(claims, recorded).count() == 0
    kinds = {x.template for x in claims.select("template").distinct().collect()}
    assert {"summary", "locus", "consistent", "against", "insufficient"} <= kinds
    status = r.investigation_status(known, r.validate_claims(claims, recorded))
    events = r.investigation_events(status).collect()
    assert len(events) == 2 * known.count() and {x.command for x in events} == {"start", "finish"}


def test_fields_of_odd_payloads(spark):
    """A number is a place of a list or a key of an object, in whatever quotes; without a parent nothing is there."""
    cases = [
        ('{"a":[{"b":1}]}', "a.0.b", "1", True), ('{"a":[{"b":1}]}', "a.1.b", None, False), ('{"a":{"0":{"b":2}}}', "a.0.b", "2", True), ('{"a":{"\\u0030":{"b":3}}}', "a.0.b", "3", True), ("{'a':{'0':{'b':4}}}", "a.0.b", "4", True),
        ('{"a":{"0":null}}', "a.0", None, True), ('{"a":[null]}', "a.0", "null", True), ('{"0":5}', "0", "5", True), ('{"a":null}', "a.b", None, False), ('{"a":null}', "a", None, True), ('{"a":"0"}', "b.0.c", None, False), ("not json", "a", None, False), ('{"a":{"b":{"c":null}}}', "a.b.c", None, True),
    ]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, payload string, path string, value string, there boolean")
    value, there = r.field_at(F.col("payload"), F.col("path"))
    got = df.select("i", value.alias("v"), there.alias("t")).orderBy("i").collect()
    assert [(x.v, x.t) for x in got] == [x[2:] for x in cases]


def test_a_fault_is_worked_out_once(spark):
    """No filter repeats what the check reads from a payload, and payloads are sorted on one side of the shuffle only."""
    claims = spark.createDataFrame([], f"investigation_id string, nth int, template string, slots {r.SLOT}, text string")
    evidence = spark.createDataFrame([], "investigation_id string, evidence_id string, tool string, payload string, labels map<string,string>")
    plan = r.validate_claims(claims, evidence)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("json_object_keys" in x or "JsonExpressionUtils" in x for x in plan) == 1
