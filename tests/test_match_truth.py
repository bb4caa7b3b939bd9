"""Candidates and labelled records against plain Python, records of one day and of many blocks of days."""

import random
import re

from pyspark.sql import functions as F

from tollgate.operators import evaluate as v

DAY = v.DAY
METRICS = [*(m for m, _ in v.FAMILIES), "no_family", None]
NAMES = sorted({n for _, family in v.FAMILIES for n in family})
CANDIDATE = "anomaly_id string, metric string, scope string, window_start bigint, window_end bigint, detected_at bigint"
RECORD = "record_key string, start bigint, `end` bigint, expected_recovery bigint, affected_cohorts array<map<string,array<string>>>, affected_metrics array<string>, unchanged_metrics array<string>"


def _drawn(rng, n):
    world_end = 400 * DAY
    cand, truth = [], []
    for i in range(n):
        start = rng.randrange(500 * DAY // 900) * 900
        end = start + rng.choice([900, 3600, DAY, 3 * DAY, 0])
        cand.append((f"a{i}", rng.choice(METRICS), rng.choice(["", "psp=x", "psp=y", "psp=x,platform=web"]), start, end, rng.choice([start, end, end + DAY])))
    for i in range(n // 2):
        start = rng.randrange(450 * DAY // 900) * 900
        end = rng.choice([None, start + DAY, start + (v.LONG - 1) * DAY, start + v.LONG * DAY, start + 200 * DAY])
        some = lambda k: rng.choice([None, rng.sample(NAMES, k)])
        truth.append((f"r{i}", start, end, rng.choice([None, start + 2 * DAY]), rng.choice([None, [{"psp": ["x"]}], [{"psp": ["y"]}, {"platform": ["web"]}], [{}]]), some(2), some(3)))
    return cand, truth, world_end


def _plain(cand, truth, world_end):
    family = dict(v.FAMILIES)
    for a, metric, scope, ws, we, at in cand:
        pairs = [p.split("=") for p in scope.split(",") if p]
        for r, start, end, recovery, cohorts, affected, unchanged in truth:
            until = max(world_end if end is None else end, recovery or 0)
            if not (ws < until and start < we and at >= start):
                continue
            if pairs and not any(all(d not in c or x in c[d] for d, x in pairs) for c in cohorts or []):
                continue
            names = set(family.get(metric, ()))
            if names & set(affected or []) or "ingestion_delay" in (affected or []):
                yield a, r, "affected"
            elif names & set(unchanged or []):
                yield a, r, "unchanged"


def test_matches_like_plain_python(spark):
    for seed in range(3):
        cand, truth, world_end = _drawn(random.Random(seed), 120)
        found = v.match_truth(spark.createDataFrame(cand, CANDIDATE), spark.createDataFrame(truth, RECORD), world_end)
        assert sorted(map(tuple, found.collect())) == sorted(_plain(cand, truth, world_end))


def test_records_are_not_broadcast_by_day(spark):
    """An open record stands in blocks of days, and its cells are shuffled: as days they packed to little and filled the driver."""
    cand, truth, world_end = _drawn(random.Random(7), 60)
    found = v.match_truth(spark.createDataFrame(cand, CANDIDATE), spark.createDataFrame(truth, RECORD), world_end)
    assert found.where(F.col("relation").isNotNull()).count() and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_matches_are_not_broadcast_to_candidates(spark, tmp_path):
    """Matches of open records repeat few keys: millions of them are a small file, and as a broadcast they filled the driver."""
    cand, truth, world_end = _drawn(random.Random(7), 60)
    c = spark.createDataFrame(cand, CANDIDATE)
    t = spark.createDataFrame(truth, RECORD).withColumns({"expected_route": F.lit("incident"), "scenario_kind": F.lit("kind"), "oracle_detectable_at": F.col("start")})
    v.match_truth(c, t, world_end).write.parquet(f"{tmp_path}/matches")
    matches = spark.read.parquet(f"{tmp_path}/matches")
    found = v.record_outcomes(c, t, matches, 0, world_end)
    assert not re.search(r"BroadcastHashJoin \[anomaly_id", found._jdf.queryExecution().executedPlan().toString())
    hits = {r: [x[5] for x in cand if (x[0], r, "affected") in set(map(tuple, matches.collect()))] for r, *_ in truth}
    assert {r.record_key: (r.n_candidates, r.latency_s) for r in found.collect()} == {r: (len(hits[r]), min(hits[r]) - start if hits[r] else None) for r, start, *_ in truth}


def test_localized_matches_are_not_broadcast(spark):
    """The matches of open records filled the driver as a broadcast to their candidates."""
    from tollgate.plans import evaluate_queries, queries  # noqa: F401  the first registers

    found = queries.QUERIES["j6_localization_class"](spark, "/root/testdata/sf0.001")
    assert found.count() and not re.search(r"BroadcastHashJoin \[anomaly_id", found._jdf.queryExecution().executedPlan().toString())
