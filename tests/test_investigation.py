"""The check loop against a sequential version, and the library on hand-built incidents."""

import random

from tollgate.operators import investigation as v

CAUSES = ["psp_degradation", "fraud_attack", "checkout_regression", "data_pipeline_issue", "duplicate_charging", "normal_variation", "unknown"]
CASES = f"incident_id int, hyps array<struct<cause:string,prior:int,nth:int>>, checks array<{v._CHECK}>, narrowed int, picks array<{v._PICK}>, trouble string"


def _case(rng, i):
    causes = rng.sample(CAUSES[:5], rng.randrange(0, 5)) + CAUSES[5:]
    hyps = [(c, rng.choice([0, 1, 1, 3]), n) for n, c in enumerate(causes)]
    checks = []
    for k in range(rng.randrange(0, 14)):
        kind = rng.choice(["sibling", "channel", "related", "related", "status", "deploy"])
        some = rng.sample(causes, rng.randrange(1, len(causes) + 1))
        side = kind in ("status", "deploy")
        told = {c: f"present:{c[:3]}" if side else rng.choice(["moved", "unchanged"]) for c in some}
        present = [f"present:{c[:3]}" for c in causes if rng.random() < 0.4] if side else None
        checks.append((f"chk_{rng.randrange(10**6):06d}", kind, told, None if side else rng.choice(["moved", "moved", "unchanged", "unchanged", "opposite", "ambiguous", "insufficient"]), present, rng.random() < 0.08))
    picks = None
    if rng.random() < 0.4:
        ids = [c[0] for c in checks] or ["none"]
        picks = [(None if rng.random() < 0.05 else rng.choice(ids), rng.choice([0.2, 0.7, 0.9, 0.9, 1.0]), rng.random() < 0.05) for _ in range(rng.randrange(0, 9))]
    return (i, hyps, checks, rng.choice([0, 5, 20, 55, 60]), picks, rng.choice([None] * 12 + ["tool_failure", "model_failure"]))


def _plain(hyps, checks, narrowed, picks, trouble, most=9, items=60):
    """One incident after the rules, step by step."""
    hs = [{"cause": c, "prior": p, "nth": n, "s": 0, "c": 0} for c, p, n in hyps]
    score = lambda h: h["prior"] + h["s"] - 2 * h["c"]
    status = lambda h: "contradicted" if h["c"] >= 1 and h["c"] > h["s"] else "supported" if h["s"] >= 2 and h["c"] == 0 else "open"
    rank = lambda: sorted(hs, key=lambda h: (-score(h), -h["prior"], h["nth"], h["cause"]))
    used, held, steps, done, failures, opposing = 2, narrowed + 2, [], set(), 0, 0
    reason = trouble
    while not reason:
        lead = rank()[0]
        if used >= most or held >= items:
            reason = "budget_exhausted"
        elif any(h["cause"] == "normal_variation" and status(h) == "supported" for h in hs):
            reason = "false_positive"
        elif any(h["prior"] > 0 for h in hs) and all(status(h) == "contradicted" for h in hs if h["prior"] > 0):
            reason = "strong_contradiction"
        elif status(lead) == "supported" and (status(rank()[1]) == "contradicted" or score(lead) - score(rank()[1]) >= 2):
            reason = "sufficient_evidence"
        if reason:
            break
        opposes = lambda c: c[1] in ("sibling", "channel", "related") and lead["cause"] in c[2]  # noqa: B023,E731
        key = lambda c: (-len({c[2][h["cause"]] for h in rank()[:3] if h["cause"] in c[2]}), lead["cause"] not in c[2], {"status": 2, "deploy": 3, "related": 1}.get(c[1], 0), c[0])  # noqa: B023,E731
        pool = sorted((c for c in checks if c[0] not in done), key=key)
        short = pool[:5]
        if short and not any(map(opposes, short)):
            short = short[:-1] + [c for c in pool[5:] if opposes(c)][:1] if any(map(opposes, pool[5:])) else short
        if not short:
            reason = "no_checks_left"
        elif not any(map(opposes, short)):
            reason = "no_disconfirming_check"
        if reason:
            break
        pick, sure = short[0], 1.0
        if picks is not None:
            name, sure, lost = picks[len(steps)] if len(steps) < len(picks) else (None, 0.0, True)
            if lost:
                reason = "model_failure"
            elif name is None or sure < 0.5:
                reason = "low_confidence"
            elif name in done:
                reason = "tool_failure"
            elif name not in [c[0] for c in short]:
                reason = "model_failure"
            if reason:
                break
            pick = next(c for c in short if c[0] == name)
        done.add(pick[0])
        used += 1
        _, kind, told, seen, present, failed = pick
        steps.append((pick[0], failed, lead["cause"]))
        if failed:
            failures += 1
            reason = "tool_failure" if failures == 2 else None
            continue
        held += 1
        opposing += opposes(pick)
        for h in hs:
            p = told.get(h["cause"])
            if p and p.startswith("present:"):
                h["s"] += p in present
            elif p and seen in ("moved", "unchanged", "opposite"):
                h["s" if seen == p else "c"] += 1
    lead = rank()[0]
    said = "unknown" if reason == "strong_contradiction" else "normal_variation" if reason == "false_positive" else lead["cause"] if status(lead) == "supported" else "insufficient_evidence"
    impact = used < most and held < items
    return reason, said, used + impact, held + impact, opposing, steps, [(h["cause"], h["s"], h["c"], "insufficient_evidence" if status(h) == "open" and not h["s"] + h["c"] else status(h)) for h in rank()]


def test_loop_like_a_sequential_one(spark):
    rng = random.Random(11)
    cases = [_case(rng, i) for i in range(900)]
    got = {r.incident_id: r for r in v.run_checks(spark.createDataFrame(cases, CASES)).collect()}
    for i, *case in cases:
        r = got[i]
        mine = (r.stop_reason, r.conclusion, r.tool_calls, r.evidence, r.disconfirming_checks, [(s.check_id, s.failed, s.leader_before) for s in r.steps], [(h.cause, h.supporting, h.contradicting, h.status) for h in r.hypotheses])
        assert mine == _plain(*case), i
    assert {r.stop_reason for r in got.values()} == set(v.STOPS)
    assert v.run_checks(spark.createDataFrame([], CASES)).count() == 0


def test_library(spark):
    rows = [
        (1, "authorization_rate", "down", ["psp=psp_beta", "platform=ios"], ["psp=psp_beta"], ["psp_degradation", "checkout_regression", "fraud_attack", "normal_variation", "unknown"], {"psp": "psp_alpha"}),
        (2, "refund_count", "up", [], [], ["refund_process_change", "normal_variation"], {}),
    ]
    found = v.check_library(spark.createDataFrame(rows, "incident_id int, metric string, direction string, locus array<string>, scope array<string>, causes array<string>, siblings map<string,string>")).collect()
    kinds = lambda i: sorted((r.kind, r.args[0]) for r in found if r.incident_id == i)
    assert kinds(1) == [("channel", "authorization_rate"), ("deploy", "mobile_ios"), ("related", "attempt_volume"), ("related", "checkout_conversion_rate"), ("related", "fraud_flag_rate"), ("related", "late_arrival_share"), ("sibling", "authorization_rate"), ("status", "psp_beta")]
    assert kinds(2) == [("deploy", "refund_service"), ("related", "authorization_rate"), ("related", "duplicate_charge_rate")]
    sib = next(r for r in found if r.kind == "sibling")
    assert sib.args == ["authorization_rate", "platform=ios,psp=psp_beta", "platform=ios,psp=psp_alpha", "down"]
    assert sib.predictions == {"psp_degradation": "unchanged", "normal_variation": "unchanged"}
    assert next(r for r in found if r.kind == "channel").args[1] == "channel=checkout,psp=psp_beta"
    assert len({r.check_id for r in found}) == len(found)
