"""Views of incidents against a plain reading of their history."""

import random

from tollgate.operators import views as w


def test_views_equal_a_plain_reading(spark):
    rnd = random.Random(2)
    events, links, looks = [], [], []
    for i in range(40):
        t, n = rnd.randrange(100), rnd.randrange(1, 6)
        for seq in range(1, n + 1):
            events.append(("r", f"i{i}", seq, t, rnd.choice("AB"), 10 * seq))
            t += rnd.randrange(40)
        for _ in range(rnd.randrange(6)):
            links.append(("r", f"i{i}", f"c{rnd.randrange(50)}", rnd.choice(["create", "join", "related_to"]), rnd.randrange(5, 30)))
    for c in range(50):
        start = rnd.randrange(50)
        for nth, time in enumerate(sorted(rnd.randrange(90) for _ in range(rnd.randrange(4)))):
            looks.append(("r", f"c{c}", time, nth, rnd.choice(["authorization_rate", "refund_count"]), "down", ["psp=a", "platform=web"][: rnd.randrange(3)], start, start + rnd.randrange(3), rnd.choice([None, 1.0])))
    df = spark.createDataFrame
    members = w.view_members(df(events, "run_id string, incident_id string, seq int, event_time bigint, status string, step bigint"), df(links, "run_id string, incident_id string, candidate_id string, kind string, step bigint"), df(looks, "run_id string, candidate_id string, time bigint, nth int, metric string, direction string, locus array<string>, start bigint, window_end bigint, impact double"), (0, 30)).cache()
    want, views = set(), set()
    for i in {e[1] for e in events}:
        own = sorted((e for e in events if e[1] == i), key=lambda e: e[2])
        for offset in (0, 30):
            as_of = own[0][3] + offset
            row = [e for e in own if e[3] <= as_of][-1]
            inside = []
            for c in {x[2] for x in links if x[1] == i and x[3] != "related_to" and x[4] <= row[5]}:
                known = [x for x in looks if x[1] == c and x[2] <= as_of]
                if known:
                    inside.append(max(known, key=lambda x: (x[2], x[3])))
            want |= {(i, offset, row[2], row[4], x[1], x[2], x[4]) for x in inside}
            cost = [x for x in inside if x[4] == "authorization_rate" and x[9]]
            if inside:
                a = max(cost, key=lambda x: (len(x[6]), x[8], x[1])) if cost else max(inside, key=lambda x: (len(x[6]), -x[7], x[1]))
                views.add((i, offset, len(inside), min(x[7] for x in inside), a[1]))
    assert {(r.incident_id, r.offset_s, r.seq, r.status, r.candidate_id, r.seen_at, r.metric) for r in members.collect()} == want and len(want) > 20
    assert {(r.incident_id, r.offset_s, r.members, r.started_at, r.anchor) for r in w.incident_views(members).collect()} == views
    assert w.incident_views(members.limit(0)).count() == 0
