"""The incident fold against a plain fold of whole runs, hand-built streams, and snapshots."""

import hashlib
import json
import random

import pytest

from tollgate.operators import incidents as h
from tollgate.operators.context import TRANSITIONS

H = 3_600
NAMES = [x.split()[0] for x in h.EVENT.split(", ")]
METRICS = [("authorization_rate", "down"), ("checkout_conversion_rate", "down"), ("attempt_volume", "up"), ("refund_rate", "up"), ("renewal_success_rate", "down"), ("late_arrival_share", "up"), ("no_such_metric", "up")]
GROUP = {"authorization_rate": "payments", "checkout_conversion_rate": "payments", "attempt_volume": "fraud", "refund_rate": "refunds", "renewal_success_rate": "subscriptions", "late_arrival_share": "ingestion"}


def _id(prefix, c):
    return prefix + hashlib.sha256(c.encode()).hexdigest()[:16]


def look(t, c, kind="detected", route="INCIDENT", locus=("psp=b",), metric="authorization_rate", direction="down", start=0, verified=True, parent=(), run="r"):
    return dict.fromkeys(NAMES) | {"run_id": run, "time": t, "kind": kind, "candidate_id": c, "metric": metric, "direction": direction, "start": start, "locus": list(locus), "parent": list(parent), "route": route, "verified": verified, "decision_id": f"dec_{c}_{t}"}


def told(t, kind, c, run="r"):
    return dict.fromkeys(NAMES) | {"run_id": run, "time": t, "kind": kind, "candidate_id": c, "verified": False}


def order(t, c, command, kind="human", actor="human", reason="checked", target=None, run="r"):
    return dict.fromkeys(NAMES) | {"run_id": run, "time": t, "kind": kind, "incident_id": _id("inc_", c), "command": command, "actor": actor, "reason": reason, "target_id": target and _id("inc_", target)}


def plain(events, gap=6 * H, hysteresis=0, ingestion_anchors=False, renewal_with_approval=False, parent_locus=False):
    """The rules read one by one over a whole run: every group is looked at by every candidate."""
    groups, home, info, recovered, through, out = [], {}, {}, {}, {}, []

    def kinds(x):
        if renewal_with_approval and (x["metric"], x["direction"]) == ("authorization_rate", "down"):
            return {"payments", "subscriptions"}
        return {GROUP[x["metric"]]} if x["metric"] in GROUP else set()

    def nests(a, b):
        a, b = set(a), set(b)
        return bool(a) and bool(b) and (a <= b or b <= a)

    def find(x, t, kind):
        specific, unsure, related = [], [], []
        for g in sorted((g for g in groups if g["kind"] == kind and not g["gone"] and g["status"] not in ("RESOLVED", "DISMISSED")), key=lambda g: (g["at"], g["id"])):
            low = min(g["start"].values())
            high = max((recovered.get(c, 1 << 60) for c in g["members"]))
            high = t if high > t else high
            if not (x["start"] <= high + gap and low <= t + gap):
                continue
            time, best = ("overlap" if x["start"] < high and low < t else "gap"), None
            for c, m in g["members"].items():
                a, b = kinds(x), kinds(m)
                if b == {"ingestion"} and "ingestion" not in a and not ingestion_anchors:
                    continue
                shared = (a | b) if "ingestion" in a | b else a & b
                if not shared:
                    continue
                why = {"time": time, "group": sorted(shared), "member": c}
                if nests(x["locus"], m["locus"]):
                    best = (specific, {**why, "cohort": "nested"})
                    break
                if parent_locus and (nests(x["locus"], m["parent"]) or nests(x["parent"], m["locus"]) or nests(x["parent"], m["parent"])):
                    best = (specific, {**why, "cohort": "parent"})
                    break
                best = best or ((related, {**why, "cohort": "not_nested"}) if x["locus"] else (unsure, {**why, "cohort": "global"}))
            if best:
                best[0].append((g, best[1]))
        if specific:
            return specific[0][0], [], specific[0][1]
        if len(unsure) == 1:
            return unsure[0][0], [], {**unsure[0][1], "cohort": "global_unambiguous"}
        if unsure:
            return None, [g["id"] for g, _ in unsure], {"cohort": "global_ambiguous"}
        return None, [g["id"] for g, _ in related], {"cohort": "not_nested" if related else "none"}

    def new(kind, x, t):
        groups.append({"kind": kind, "id": _id("inc_" if kind == "incident" else "dg_", x["candidate_id"]), "at": t, "members": {}, "start": {}, "gone": False, "status": "DETECTED", "seq": 0})
        return groups[-1]

    def link(g, x, t, kind, why):
        c = x["candidate_id"]
        g["members"][c], g["start"][c], home[c] = x, x["start"], g
        if "member" in why and why["member"] != c:
            through[c] = why["member"]
        out.append(("link", g["id"], c, t, kind, json.dumps(why, sort_keys=True)) if g["kind"] == "incident" else ("digest", g["id"], c, t, x["decision_id"], None))

    def row(g, t, actor, reason, status=None):
        g["status"], g["seq"] = status or g["status"], g["seq"] + 1
        out.append(("event", g["id"], g["seq"], t, g["status"], actor, reason))

    def promote(d, x, t, why):
        cs = sorted(d["members"], key=lambda c: (d["start"][c], c))
        g = new("incident", info[cs[0]], t)
        for c in cs:
            link(g, info[c], t, "promote", {"digest_group": d["id"]})
            out.append(("digest", d["id"], c, t, info[c]["decision_id"], g["id"]))
        d["gone"] = True
        if x:
            link(g, x, t, "join", why)
        row(g, t, "policy", "digest_promoted")

    for e in sorted(events, key=lambda e: (e["time"], h.KINDS.index(e["kind"]), e["candidate_id"] or e["incident_id"], e["command"] or "")):
        t, c = e["time"], e["candidate_id"]
        if e["kind"] in ("detected", "checkpoint"):
            info[c], g = e, home.get(c)
            if g:
                a = g["members"].get(through.get(c))
                if a is None or nests(e["locus"], a["locus"]):
                    g["members"][c] = e
                if g["kind"] == "incident":
                    if e["verified"]:
                        row(g, t, "policy", "checkpoint_update")
                elif e["route"] == "INCIDENT":
                    promote(g, None, t, {})
            elif e["route"] != "IGNORE":
                g, related, why = find(e, t, "incident")
                if g:
                    link(g, e, t, "join" if e["route"] == "INCIDENT" else "support", why)
                    row(g, t, *(("system", "signal_returned", "INVESTIGATING") if g["status"] == "RECOVERING" else ("policy", "candidate_linked")))
                    continue
                d, _, d_why = find(e, t, "digest")
                if e["route"] == "INCIDENT" and d:
                    promote(d, e, t, d_why)
                elif e["route"] == "INCIDENT":
                    g = new("incident", e, t)
                    link(g, e, t, "create", why)
                    for r in related:
                        out.append(("link", g["id"], c, t, "related_to", json.dumps({**why, "related_incident": r}, sort_keys=True)))
                    row(g, t, "policy", "incident_created")
                else:
                    link(d or new("digest", e, t), e, t, "digest", d_why if d else {})
        elif e["kind"] == "recovered":
            recovered[c] = t
        elif e["kind"] == "recovery_check":
            g = home.get(c)
            if g and g["kind"] == "incident" and g["status"] not in ("RECOVERING", "RESOLVED", "DISMISSED") and all(m in recovered and recovered[m] + hysteresis <= t for m in g["members"]):
                row(g, t, "system", "signals_recovered", "RECOVERING")
        else:
            by = {g["id"]: g for g in groups if g["kind"] == "incident"}
            g, to, cmd = by.get(e["incident_id"]), by.get(e["target_id"]), e["command"]
            if e["kind"] != "human":
                if not g:
                    out.append(("rejected", e["incident_id"], t, e["kind"], "unknown incident"))
                elif e["kind"] == "impact":
                    row(g, t, "system", "impact_estimated")
                else:
                    row(g, t, "system", "investigation_started" if cmd == "start" else "investigation_finished", "INVESTIGATING" if cmd == "start" and g["status"] == "DETECTED" else None)
                continue
            status = {"acknowledge": "ACKNOWLEDGED", "escalate": "ESCALATED", "resolve": "RESOLVED", "dismiss": "DISMISSED", "merge": "DISMISSED"}.get(cmd)
            why = "unknown incident" if not g or (cmd == "merge" and not to) else "unknown command" if not status else "no reason" if cmd != "merge" and not e["reason"] else "not allowed" if (g["status"], status, e["actor"]) not in TRANSITIONS else None
            if why:
                out.append(("rejected", e["incident_id"], t, cmd, why))
            elif cmd == "merge":
                for m in sorted(g["members"]):
                    link(to, info[m], t, "merge", {"by": e["actor"], "from": g["id"]})
                row(to, t, e["actor"], f"merged from {g['id']}: {e['reason'] or ''}")
                row(g, t, e["actor"], f"merged into {to['id']}: {e['reason'] or ''}", "DISMISSED")
            else:
                row(g, t, e["actor"], e["reason"], status)
    return out


def _spark_rows(spark, events, **rules):
    fold = h.fold_incidents(spark.createDataFrame([[e[n] for n in NAMES] for e in events], h.EVENT), **rules)
    shape = {
        "event": lambda r: (r.incident_id, r.seq, r.time, r.status, r.actor, r.reason), "link": lambda r: (r.incident_id, r.candidate_id, r.time, r.kind, r.evidence),
        "digest": lambda r: (r.group_id, r.candidate_id, r.time, r.decision_id, r.promoted_to), "rejected": lambda r: (r.incident_id, r.time, r.kind, r.reason),
    }
    rows = fold.collect()
    return {run: sorted(((r.part, *shape[r.part](r)) for r in rows if r.run_id == run), key=str) for run in {r.run_id for r in rows}}, fold


def _stream(rng, run, commands):
    """Alarms of all metrics, near and far in time, with refined loci, recoveries or none, and what people did."""
    events, t = [], 0
    names = [f"{run}c{i:02d}" for i in range(rng.randrange(12, 40))]
    for c in names:
        t += rng.choice([0, H // 2, H, 3 * H, 9 * H, 30 * H])
        metric, direction = rng.choice(METRICS)
        pick = lambda: tuple(sorted(rng.sample(["psp=a", "psp=b", "platform=web", "customer_country=DE"], rng.choice([0, 1, 1, 2]))))  # noqa: B023,E731
        at = t + rng.choice([H, 2 * H])
        more = {"metric": metric, "direction": direction, "start": t, "run": run}
        events.append(look(at, c, route=rng.choice(["INCIDENT", "DIGEST", "DIGEST", "IGNORE"]), locus=pick(), parent=pick(), verified=rng.random() < 0.8, **more))
        if rng.random() < 0.9:
            end = at + rng.choice([H, 5 * H, 20 * H])
            events += [look(end, c, "checkpoint", route=rng.choice(["INCIDENT", "DIGEST", "IGNORE"]), locus=pick(), parent=pick(), verified=rng.random() < 0.8, **more), told(end, "recovered", c, run), told(end + commands, "recovery_check", c, run)]
        if commands and rng.random() < 0.4:
            events.append(order(at + rng.randrange(20 * H), c, rng.choice(["acknowledge", "escalate", "resolve", "dismiss", "explode"]), actor=rng.choice(["human", "human", "policy"]), reason=rng.choice(["checked", "checked", ""]), run=run))
            events.append(order(at + rng.randrange(40 * H), c, "merge", target=rng.choice(names), run=run))
            events.append(order(at + rng.randrange(9 * H), c, *rng.choice([("start", "investigation"), ("finish", "investigation"), ("estimate", "impact")]), actor="system", run=run))
    return events


@pytest.mark.parametrize(
    "rules, commands",
    [({}, 0), ({"hysteresis": 2 * H}, 2 * H), ({"ingestion_anchors": True, "parent_locus": True}, H), ({"renewal_with_approval": True, "gap": 0}, 0)],
)
def test_fold_like_a_plain_one(spark, rules, commands):
    rng = random.Random(str(rules))
    runs = {f"r{i}": _stream(rng, f"r{i}", commands) for i in range(12)}
    events = [e for es in runs.values() for e in es]
    rng.shuffle(events)
    got, fold = _spark_rows(spark, events, **rules)
    for run, es in runs.items():
        assert got.get(run, []) == sorted(plain(es, **rules), key=str), run
    # runs are cut, and every island's rows count on from one
    assert fold.select("run_id", "island").distinct().count() > len(runs)
    parts = {r.part for r in fold.select("part").distinct().collect()}
    assert parts == {"event", "link", "digest"} | ({"rejected"} if commands else set())


def test_hand_built_streams(spark):
    de, fr = ("customer_country=DE", "psp=b"), ("customer_country=FR",)
    runs = {
        "nested and not": [look(H, "c1"), look(2 * H, "c2", locus=de, start=H), look(2 * H, "c3", locus=fr, start=H)],
        "promoted": [look(H, "d1", route="DIGEST"), look(2 * H, "d2", route="DIGEST", locus=de, start=H), look(8 * H, "d2", "checkpoint", locus=de, start=H)],
        "returned": [look(H, "c1"), told(2 * H, "recovered", "c1"), told(2 * H, "recovery_check", "c1"), look(4 * H, "c2", route="DIGEST", start=3 * H)],
        "late": [look(H, "c1", metric="late_arrival_share", direction="up", locus=()), look(2 * H, "c2", start=H)],
        "far": [look(H, "c1"), told(2 * H, "recovered", "c1"), look(9 * H + 1, "c2", start=8 * H + 1)],
        "ignored": [look(H, "c1", route="IGNORE"), told(2 * H, "recovery_check", "c1")],
    }
    got, _ = _spark_rows(spark, [e | {"run_id": run} for run, es in runs.items() for e in es])
    reasons = lambda run: [r[-1] for r in sorted((x for x in got.get(run, []) if x[0] == "event"), key=lambda x: (x[3], x[1], x[2]))]
    assert sorted(reasons("nested and not")) == ["candidate_linked", "incident_created", "incident_created"]
    assert [r[4] for r in got["nested and not"] if r[0] == "link"].count("related_to") == 1
    assert reasons("promoted") == ["digest_promoted"]
    assert reasons("returned") == ["incident_created", "signals_recovered", "signal_returned"]
    assert reasons("late") == ["incident_created"] * 2
    assert reasons("far") == ["incident_created"] * 2
    assert "ignored" not in got


def test_snapshots(spark):
    events = [look(H, "c1"), look(2 * H, "c2", locus=("customer_country=DE", "psp=b"), start=H), order(3 * H, "c1", "start", "investigation", "system"), order(4 * H, "c1", "finish", "investigation", "system"), look(5 * H, "c1", "checkpoint", verified=False)]
    _, fold = _spark_rows(spark, events)
    seen = [(e["run_id"], e["candidate_id"], e["time"], h.KINDS.index(e["kind"]), e["metric"], e["direction"], e["start"], e["locus"], e["time"], e["verified"], e["time"] / H / 10, "high", [e["candidate_id"], "x", "y", "z"], ["evd_" + e["candidate_id"]], e["decision_id"], "policy", "policy_v1") for e in events if e["metric"]]
    looks = spark.createDataFrame(seen, "run_id string, candidate_id string, time long, nth int, metric string, direction string, start long, locus array<string>, window_end long, verified boolean, incident_p double, severity_level string, categories array<string>, evidence_ids array<string>, decision_id string, route_source string, policy_version string")
    notes = spark.createDataFrame([("r", _id("inc_", "c1"), 3 * H, 6, None, "running", None), ("r", _id("inc_", "c1"), 4 * H, 6, None, "completed", "rep_1")], "run_id string, incident_id string, time long, nth int, impact string, status string, report string")
    rows = h.incident_snapshots(h.incident_events(fold), h.incident_links(fold), looks, notes).orderBy("seq").collect()
    assert [r.title for r in rows] == ["approval down in psp=b"] + ["approval down in customer_country=DE, psp=b"] * (len(rows) - 1)
    assert [r.investigation_status for r in rows] == ["not_started", "not_started", "running", "completed"]
    assert [r.category for r in rows] == ["c1", "c2", "c2", "c2"] and rows[1].hypotheses == ["c2", "x", "y"]
    assert rows[-1].linked_anomalies == ["c1", "c2"] and "rep_1" in rows[-1].evidence_ids and "rep_1" not in rows[2].evidence_ids
    assert (rows[0].started_at, rows[0].detected_at, rows[1].last_updated_at) == (0, H, 2 * H)
    last = h.latest(h.incident_events(fold))
    assert last.count() == 1 and last.first().seq == len(rows)
    empty = h.fold_incidents(spark.createDataFrame([], h.EVENT))
    assert empty.count() == 0


def test_stream_like_batch_over_restarts(spark, tmp_path):
    """Three batches, each a query that goes on from the state of the last, give the rows of the batch fold; a late event is told."""
    from tollgate.streaming.incidents import stream_incidents

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(21)
    runs = {f"r{i}": _stream(rng, f"r{i}", H) for i in range(5)}
    events = [e for es in runs.values() for e in es]
    rng.shuffle(events)
    want, _ = _spark_rows(spark, events, hysteresis=H)
    times = sorted(e["time"] for e in events)
    cuts = [-1, times[len(times) // 3], times[2 * len(times) // 3], times[-1]]
    (tmp_path / "in").mkdir()
    for low, high in zip(cuts, cuts[1:]):
        part = [[e[n] for n in NAMES] for e in events if low < e["time"] <= high]
        late = [[(look(0, "early", run="r0") | {"time": 0})[n] for n in NAMES]] if high == times[-1] else []
        spark.createDataFrame(part + late, h.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = stream_incidents(spark.readStream.schema(h.EVENT).parquet(str(tmp_path / "in")), hysteresis=H)
        found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.run_id, r.candidate_id, r.kind) for r in rows if r.reason == "late"] == [("r0", "early", "detected")]
    shape = {"event": ("incident_id", "seq", "time", "status", "actor", "reason"), "link": ("incident_id", "candidate_id", "time", "kind", "evidence"), "digest": ("group_id", "candidate_id", "time", "decision_id", "promoted_to"), "rejected": ("incident_id", "time", "kind", "reason")}
    for run in runs:
        assert sorted(((r.part, *(r[c] for c in shape[r.part])) for r in rows if r.run_id == run and r.reason != "late"), key=str) == want[run], run


def test_stream_makes_few_objects_at_a_time(monkeypatch):
    """A run's events of a batch stay in columns: the fold's rows come in chunks, the same as in one."""
    import pandas as pd
    import pyarrow as pa

    from tollgate.streaming import incidents as stream

    names = {x.split()[0]: x.split()[1] for x in h.EVENT.split(", ")} | {"island": "string", "nth": "int", "by_id": "string", "groups": "array<string>", "as_incident": "string", "as_digest": "string"}
    look = lambda i: {"run_id": "r", "time": 100 * i, "kind": "detected", "candidate_id": f"c{i}", "metric": "refund_rate", "direction": "up", "start": 100 * i, "locus": [f"psp={i}"], "parent": [], "route": "INCIDENT", "verified": True, "decision_id": f"d{i}", "island": "", "nth": 0, "by_id": f"c{i}", "groups": ["refunds"], "as_incident": f"inc_{i}", "as_digest": f"dg_{i}"}
    rows = pd.DataFrame([look(i) for i in reversed(range(25))], columns=list(names))

    class Held:
        get = lambda self: None
        update = lambda self, value: None

    def told(chunk):
        monkeypatch.setattr(stream, "CHUNK", chunk)
        run = stream._Run({"gap": 10, "hysteresis": 0, "mode": "pairs", "ingestion_anchors": False, "parent_locus": False}, stream.HORIZON, pa.schema([(n, stream._TYPES[t]) for n, t in names.items()]))
        run.held = Held()
        return list(run.handleInputRows(("r",), iter([rows[:10], rows[10:]]), None))

    few, one = told(4), told(1_000)
    assert len(few) == 7 and len(one) == 1
    assert pd.concat(few, ignore_index=True).equals(one[0])


def _one_open(n):
    """A run of n looks, of which the first never recovers and the others do; every third is on another provider than the first."""
    for i in range(n):
        look = {"run_id": "r", "island": "i", "candidate_id": f"c{i}", "by_id": f"c{i}", "groups": frozenset(["payments"]), "locus": frozenset([f"psp={i % 3}"]), "parent": frozenset(), "start": 900 * i, "ahead": 900 * i, "as_incident": f"i{i}", "as_digest": f"d{i}", "decision_id": "d", "route": "INCIDENT", "verified": True}
        yield look | {"kind": "detected", "nth": 0, "time": 900 * i}
        if i >= 3:
            yield look | {"kind": "recovered", "nth": 2, "time": 900 * i + 1}


def test_a_look_meets_a_kind_of_member_once(monkeypatch):
    """A group that never ends grows with the run; its members aren't looked at one by one for every new candidate."""
    met, real = [0], h.Fold._verdict
    monkeypatch.setattr(h.Fold, "_verdict", lambda *a: (met.__setitem__(0, met[0] + 1), real(*a))[1])
    fold = h.Fold(3600, 0, "pairs", False, False)
    rows = [r for e in _one_open(900) for r in fold.apply(e)]
    assert met[0] <= 3 * 900 and sum(r["part"] == "link" and r["kind"] == "join" for r in rows) == 897
    again = h.Fold(3600, 0, "pairs", False, False)
    again.resume(fold.state())
    assert [(g.open, g.last, g.since, g.firsts()) for g in again.groups.values()] == [(g.open, g.last, g.since, g.firsts()) for g in fold.groups.values()]


def test_what_someone_joined_is_drawn_once(spark, monkeypatch):
    """Chains of runs with merges were drawn anew, with all their islands, until none grew."""
    drawn, real = [], h.materialized
    monkeypatch.setattr(h, "materialized", lambda df, label: (drawn.append(label), real(df, label))[1])
    fees, late = {"metric": "refund_rate", "direction": "up"}, {"metric": "late_arrival_share", "direction": "up"}
    ends = lambda t, c: [told(t, "recovered", c)]
    events = [look(H, "a1"), *ends(2 * H, "a1"), look(50 * H, "b1", start=49 * H, **fees), *ends(51 * H, "b1"), look(25 * H, "c1", start=24 * H, **late), *ends(26 * H, "c1"), look(200 * H, "d1", start=199 * H)]
    events += [order(60 * H, "b1", "merge", target="a1"), look(61 * H, "b2", start=52 * H, **fees), *ends(62 * H, "b2")]
    got, fold = _spark_rows(spark, events)
    assert got["r"] == sorted(plain(events), key=str)
    assert drawn.count("chains") == 1
    # what the merge spans is one island, what lies after it another
    assert fold.select("island").distinct().count() == 2


def test_state_keeps_little_of_a_look():
    """A run's state held every column of each last look."""
    import pickle

    fold = h.Fold(3600, 0, "pairs", False, False)
    for e in _one_open(900):
        fold.apply(e)
    assert len(pickle.dumps(fold.state())) < 110 * 900
