"""Tuning and incident scores against plain Python."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tollgate.operators import score_incidents as z
from tollgate.operators import tune as t


def test_tuned_like_brute_force(spark):
    for seed in range(4):
        rng = random.Random(seed)
        rows = [
            (rng.choice([*t.STRENGTHS, "not_provided"]), rng.choice(["rate_change", "mixed", "new_cohort", "insufficient_data", "mix_shift"]), rng.choice([None, round(rng.random() * 90, 3)]), rng.choice(t.SHARES), s := rng.choice(["incident", "incident", "unmatched", "suppress", "watch"]), f"r{rng.randrange(12)}" if s == "incident" else None)
            for _ in range(rng.choice([3, 40, 150]))
        ]
        incidents, days = [f"r{i}" for i in range(9)], 25.0
        rates = sorted(r[2] for r in rows if r[2] is not None)
        edges = tuple(float(f"{rates[min(len(rates) - 1, int(q * len(rates)))]:.2g}") for q in (0.25, 0.5, 0.75)) if rates else ()
        best = None
        for s in t.STRENGTHS:
            for name, types in t.TYPES:
                for i in t.IMPACTS:
                    for share in t.LEAST_SHARES:
                        ok = [r for r in rows if r[0] in t.STRENGTHS[t.STRENGTHS.index(s) :] and r[1] in types and r[2] is not None and sum(r[2] >= e for e in edges) >= t.IMPACTS.index(i) and t.SHARES.index(r[3]) >= t.SHARES.index(share)]
                        other = sum(r[4] in ("unmatched", "suppress") for r in ok) / days
                        key = (len({r[5] for r in ok if r[4] == "incident"} & set(incidents)) / len(incidents), -len(ok) / days)
                        if other <= 0.1 and (best is None or key > best[0]):
                            best = key, (s, name, i, share), other
        df = spark.createDataFrame(rows, "strength string, change_type string, impact_rate double, locus_share string, status string, record_key string")
        got = t.tune_baseline_route(df, spark.createDataFrame([(x,) for x in incidents], "record_key string"), days).collect()
        assert [(r.strength_min, r.change_types, r.impact_min, r.locus_share_min) for r in got] == ([best[1]] if best else [])
        assert all(abs(r.recall - best[0][0]) < 1e-9 and abs(r.non_incident_per_day - best[2]) < 1e-9 for r in got)
    empty = df.limit(0)
    assert t.passing_grid(empty, spark.createDataFrame([], "record_key string"), 1.0, ()).where("recall != 0").count() == 0


def test_incident_scores_like_plain_python(spark):
    rng = random.Random(5)
    records = [(f"k{i}", f"t{i}", z.CAMPAIGN if i % 5 == 0 else "outage", rng.choice(["incident", "incident", "watch", "suppress"]), i * 7_000, None if i % 6 == 0 else i * 7_000 + 50_000, None, i * 7_000 + 3_600 if i % 4 else None, [f"t{rng.randrange(14)}" for _ in range(rng.randrange(3))], rng.choice([None, 0.0, 20.0])) for i in range(14)]
    links = [(f"i{rng.randrange(20)}", f"c{j}") for j in range(120)]
    matched = [(f"c{j}", f"k{rng.randrange(14)}") for j in range(120) if rng.random() < 0.8]
    names = sorted({a for a, _ in links}) + ["lonely"]
    incidents = [(n, rng.randrange(200_000), (float(rng.randrange(50)), 5.0, 30.0) if rng.random() < 0.7 else None) for n in names]
    events = [(n, rng.randrange(300_000), s, rng.choice(["human", "system"])) for n in names for s in ("DETECTED", "RECOVERING", "RESOLVED") if rng.random() < 0.7]
    df = spark.createDataFrame
    R = df(records, "record_key string, truth_id string, scenario_kind string, expected_route string, start long, end long, expected_recovery long, oracle_detectable_at long, unrelated_to array<string>, true_lost double")
    L, M = df(links, "incident_id string, candidate_id string"), df(matched, "candidate_id string, record_key string")
    I = df(incidents, "incident_id string, detected_at long, impact struct<value:double,low:double,high:double>")
    E = df(events, "incident_id string, event_time long, status string, actor string")
    scores = z.incident_scores(L, I, M, R)
    got = {r.incident_id: r for r in scores.collect()}
    of, by = dict(matched), {r[0]: r for r in records}
    for n, at, impact in incidents:
        cs = [c for a, c in links if a == n]
        ks = [of[c] for c in cs if c in of]
        pool = [k for k in ks if by[k][3] == "incident"] or ks
        count = Counter(pool)
        main = max(count, key=lambda k: (count[k], -by[k][4], k)) if pool else None
        bad = {(a, b) for a in set(ks) for b in set(ks) if a != b and by[b][1] in by[a][8]}
        want = (len(cs), main, by[main][3] if main else "unmatched", sum(k == main for k in ks) / len(cs) if cs and main else 0.0, bool(bad), any(z.CAMPAIGN in (by[a][2], by[b][2]) for a, b in bad))
        r = got[n]
        assert (r.members, r.main, r.main_route, r.purity, r.wrong_merge, r.campaign_merge) == want, n
    per = {r.record_key: r for r in z.record_scores(scores, L, M, R, E).collect()}
    assert set(per) == {r[0] for r in records if r[3] == "incident" and r[7] is not None}
    for k, r in per.items():
        holding = {a for a, c in links if of.get(c) == k}
        own = [n for n in names if got[n].main == k]
        assert r.covered == bool(holding)
        if holding:
            made = min(at for n, at, _ in incidents if n in holding)
            assert r.duplicates == max(0, len(own) - 1) and abs(r.delay_h - (made - max(by[k][4], by[k][7])) / 3600) < 1e-9
            back = [t for n, t, s, _ in events if n in own and s == "RECOVERING"]
            assert r.recovered_in_time == (None if not own or by[k][5] is None else bool(back) and abs(min(back) - by[k][5]) <= z.RECOVERY_TOLERANCE)
    one = z.summary(scores, z.record_scores(scores, L, M, R, E), E, 3, 10.0).first()
    assert one.incidents == len(names) and one.digest_groups_per_day == 0.3 and one.terminal_by_system == sum(s == "RESOLVED" and a == "system" for _, _, s, a in events)
    nothing = z.summary(scores.limit(0), z.record_scores(scores.limit(0), L.limit(0), M.limit(0), R.limit(0), E.limit(0)), E.limit(0), 0, 1.0).first()
    assert nothing.incidents == 0 and nothing.coverage is None and nothing.creation_delay_h_p90 is None
    assert scores.where(F.col("incident_id") == "lonely").first().main_route == "unmatched"
