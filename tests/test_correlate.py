"""Pairs of candidates against a plain look at every two of them."""

import itertools
import random

import pytest

from tollgate.operators import correlate as c

CAND = "anomaly_id string, metric string, direction string, locus string, window_start long, window_end long, detected_at long"


def _groups(metric, direction, with_approval):
    if metric == "authorization_rate" and with_approval and direction == "down":
        return {"payments", "subscriptions"}
    return {g for m, way, g in c.GROUPS if m == metric and way in ("", direction)}


@pytest.mark.parametrize("anchors, with_approval", [(False, False), (True, False), (False, True), (True, True)])
def test_a_pair_counts_once(spark, anchors, with_approval):
    """Pairs that share several groups are found once without a shuffle of pairs; where ids repeat they still count once."""
    rng = random.Random(11)
    metrics = ["authorization_rate", "late_arrival_share", "renewal_success_rate", "attempt_volume", "refund_rate", "no_such_metric"]
    rows = []
    for i in range(60):
        start = rng.randrange(0, 4 * c.DAY)
        rows.append((f"a{i}", rng.choice(metrics), rng.choice(["up", "down"]), rng.choice(["", "psp=x", "psp=x,platform=web"]), start, start + rng.randrange(1, 2 * c.DAY), start + 60))
    want = set()
    for x, y in itertools.permutations(rows, 2):
        mine, theirs = _groups(*x[1:3], with_approval), _groups(*y[1:3], with_approval)
        late, other = "ingestion" in mine, "ingestion" in theirs
        met = (late or bool(mine & theirs) or (not mine and not theirs)) if not other or late else anchors
        shared = sorted(mine | theirs) if late or other else sorted(mine & theirs)
        if met and shared and (y[6], y[0]) < (x[6], x[0]) and x[4] <= y[5] + c.GAP and y[4] <= x[5] + c.GAP:
            want.add((x[0], y[0], ",".join(shared)))
    of = lambda rows: c.correlate_pairs(spark.createDataFrame(rows, CAND), ingestion_anchors=anchors, renewal_with_approval=with_approval)
    found = of(rows)
    got = [(r.candidate, r.member, r.shared) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and any("," in x[2] for x in want)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    twice = [(r.candidate, r.member, r.shared) for r in of(rows + rows[::2]).collect()]
    assert sorted(twice) == sorted(got)


def test_first_matches_with_and_without_since(spark):
    rows = [(f"a{i}", "authorization_rate", "down", ["", "psp=x", "psp=x,platform=web"][i % 3], i * 900, i * 900 + 3600, i * 900 + 60 * (i % 4)) for i in range(40)]
    cand = spark.createDataFrame(rows, CAND)
    one, two = (c.first_matches(c.correlate_pairs(cand, since=x), cand).orderBy("candidate").collect() for x in (False, True))
    assert one == two and len(one) == 40
