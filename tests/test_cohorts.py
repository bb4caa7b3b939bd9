"""Localization against a slow plain version on random cohorts, and named cases."""

import math
import random
from itertools import combinations

import pytest

from tollgate.operators import cohorts as c

SETS = ("psp", "customer_country", "platform", "psp,customer_country", "psp,customer_country,platform")
SCHEMA = "candidate_id string, combination string, cohort string, kind string, direction string, n_days int, k_b double, n_b double, k_d double, n_d double, ref_days array<struct<lag:int,k:double,n:double>>"


def world(seed, kind):
    """Base cells of psp x country x platform with a change planted in one of several ways."""
    rng = random.Random(seed)
    psps, lands, apps = ("a", "b", "c"), ("DE", "US"), ("web", "ios")
    way = seed % 5
    cells = {}
    for p in psps:
        for l in lands:
            for w in apps:
                n_b, n_d, rate = rng.randrange(200, 900), rng.randrange(200, 900), rng.uniform(0.75, 0.9)
                now = rate
                if way == 0 and p == "b":
                    now = rate - 0.4
                if way == 1 and p == "b" and l == "US":
                    now = rate - 0.5
                if way == 2 and w == "ios":
                    n_b, now = 0, 0.3
                if way == 3:
                    rate = now = 0.9 if p == "a" else 0.3
                    n_d = n_d * (3 if p == "b" else 1)
                cells[p, l, w] = (round(n_b * rate), n_b, round(n_d * now), n_d)
    rows = []
    for dims in SETS:
        at = [("psp", "customer_country", "platform").index(d) for d in dims.split(",")]
        sums = {}
        for key, v in cells.items():
            name = ",".join(f"{d}={key[i]}" for d, i in zip(dims.split(","), at))
            sums[name] = [x + y for x, y in zip(sums.get(name, (0, 0, 0, 0)), v)]
        for name, (kb, nb, kd, nd) in sums.items():
            rows.append((f"w{seed}", dims, name, kind, "down", 0, *map(float, (kb / 10, 1, kd / 10, 1) if kind == "count" else (kb, nb, kd, nd)), []))
    return rows


def plain(rows):
    """label, locus, top and controls of one candidate, by loops."""
    kind, table = rows[0][3], {}
    for r in rows:
        table.setdefault(r[1], {})[r[2]] = r[6:10]
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    arc = lambda k, n: math.asin(math.sqrt(min(1, k / n)))
    rate_z = lambda kb, nb, kd, nd: 2 * (arc(kd, nd) - arc(kb, nb)) / math.sqrt(1 / nb + 1 / nd)
    parts, tests, news, share = {}, [], [], {}
    for dims, own in table.items():
        sb, sn, db, dn = (sum(v[i] for v in own.values()) for i in range(4))
        for name, (kb, nb, kd, nd) in own.items():
            if kind == "count":
                parts[dims, name] = (kd - kb, 0.0)
                continue
            rb = kb / nb if nb else kd / nd if nd else 0.0
            rd = kd / nd if nd else rb
            parts[dims, name] = ((nb / sn + nd / dn) / 2 * (rd - rb), ((rb + rd) / 2 - (sb / sn + db / dn) / 2) * (nd / dn - nb / sn))
        total = sum(sum(parts[dims, n]) for n in own)
        for name, (kb, nb, kd, nd) in own.items():
            if kind == "count" and kb + kd >= 5:
                z = 2 * (math.sqrt(kd + 0.375) - math.sqrt(kb + 0.375)) / math.sqrt(2)
            elif kind == "rate" and min(nb, nd) >= 30:
                z = rate_z(kb, nb, kd, nd)
            else:
                if kind == "rate" and nb < 30 <= nd and dn - nd >= 30:
                    z = rate_z(db - kd, dn - nd, kd, nd)
                    news.append([tail(-z), dims, name, (kd / nd - (db - kd) / (dn - nd)) * nd / dn / total])
                continue
            tests.append([tail(-z), dims, name, z, parts[dims, name][0] / total if total else 0.0])
        if kind == "rate" and sum(min(v[1], v[3]) >= 30 for v in own.values()) >= 2:
            r, m = (abs(sum(parts[dims, n][i] for n in own)) for i in (0, 1))
            share[dims] = r / (r + m)

    def found(items):
        items = sorted(items)
        passed = [i for i, x in enumerate(items) if x[0] <= 0.05 * (i + 1) / len(items)]
        return items[: passed[-1] + 1] if passed else []

    hits, fresh = found(tests), [x for x in found(news) if x[3] >= 0.6]
    people = lambda v: v[0] if kind == "count" else v[1]
    whole = max(sum(people(v) for v in own.values()) for own in table.values())
    now = max(sum(v[3] for v in own.values()) for own in table.values())
    by_name = {x[2]: x for x in tests}

    def dense(x):
        mine, size = parts[x[1], x[2]][0], people(table[x[1]][x[2]])
        above = [(sum(sum(parts[x[1], n]) for n in table[x[1]]), whole)]
        pairs = x[2].split(",")
        for k in range(1, len(pairs)):
            for sub in combinations(pairs, k):
                if (p := by_name.get(",".join(sub))) is not None:
                    above.append((parts[p[1], p[2]][0], people(table[p[1]][p[2]])))
        return all(-part <= 0 or of <= 0 or size <= 0 or (mine / part) / (size / of) >= 1.25 for part, of in above)

    fit = [x for x in hits if x[4] >= 0.6 and dense(x)]
    best = min(share.items(), key=lambda s: (s[1], s[0])) if share else None
    label = "rate_change" if kind == "count" else "new_cohort" if fresh else "insufficient_data" if best is None else "rate_change" if best[1] >= 0.7 else "mix_shift" if best[1] <= 0.3 else "mixed"
    if fresh:
        locus = max((x[3], x[2]) for x in fresh)[1]
    elif label == "mix_shift":
        own, dims = table[best[0]], best[0]
        locus = max(own, key=lambda n: (round(-parts[dims, n][1], 12), own[n][3] / sum(v[3] for v in own.values()) - own[n][1] / sum(v[1] for v in own.values()), n))
    elif fit:
        x = min(fit, key=lambda x: (table[x[1]][x[2]][2 if kind == "count" else 3], len(x[2].split(",")), SETS.index(x[1]), x[2]))
        locus = "" if kind == "rate" and table[x[1]][x[2]][3] >= 0.98 * now else x[2]
    else:
        locus = "" if tests else None
    ranked = sorted(hits, key=lambda x: (parts[x[1], x[2]][0], -abs(x[3]), x[2]))
    top = ([locus] if fresh else []) + [x[2] for x in ranked]
    return label, locus, top[:5]


@pytest.mark.parametrize("kind", ["rate", "count"])
def test_localization_matches_plain_python(spark, kind):
    worlds = {f"w{s}": world(s, kind) for s in range(15)}
    rows = spark.createDataFrame([r for w in worlds.values() for r in w], SCHEMA).cache()
    tested, new = c.tested_cohorts(rows).cache(), c.new_cohorts(rows).cache()
    labels = c.change_label(rows, new).cache()
    said = {r.candidate_id: r.label for r in labels.collect()}
    loci = {r.candidate_id: r.locus for r in c.locus(tested, rows, new, labels).collect()}
    top = {}
    for r in c.rank_top_cohorts(tested, new).orderBy("nth").collect():
        top.setdefault(r.candidate_id, []).append(r.cohort)
    for name, w in worlds.items():
        label, locus, best = plain(w)
        assert (said[name], loci.get(name), top.get(name, [])) == (label, locus, best), name
    if kind == "rate":
        assert {"new_cohort", "mix_shift", "rate_change"} <= set(said.values())


def test_canonical_locus_and_naive_tie(spark):
    """psp=b is all sepa: one of the two says nothing; of equal moves the first name wins."""
    one = lambda comb, name, *v: ("x", comb, name, "rate", "down", 0, *map(float, v), [])
    rows = spark.createDataFrame([one("psp", "psp=a", 90, 100, 90, 100), one("psp", "psp=b", 90, 100, 30, 100), one("customer_country", "customer_country=DE", 90, 100, 30, 100), one("customer_country", "customer_country=US", 90, 100, 90, 100), one("psp,customer_country", "psp=b,customer_country=DE", 90, 100, 30, 100), one("psp,customer_country", "psp=a,customer_country=US", 90, 100, 90, 100)], SCHEMA)
    loci = spark.createDataFrame([("x", "psp=b,customer_country=DE", "concentrated")], "candidate_id string, locus string, found_by string")
    assert c.canonical_locus(loci, rows).first().locus == "customer_country=DE"
    assert c.naive_locus(c.tested_cohorts(rows)).first().naive_locus == "customer_country=DE"


def test_cohorts_inside_a_scope(spark):
    """A candidate with a scope sees its own traffic only and names its own dimensions."""
    from tollgate.plans.cohort_queries import START, norm

    events = norm(spark, "/root/testdata/sf0.001")
    ask = [("g", "down", START + 10 * 86_400, START + 11 * 86_400, ""), ("s", "down", START + 10 * 86_400, START + 11 * 86_400, "psp=psp_beta")]
    got = c.cohort_tables(events, spark.createDataFrame(ask, "candidate_id string, direction string, window_start bigint, window_end bigint, scope string"), "authorization_rate", 1, "1d", START, START + 30 * 86_400).collect()
    assert not [r for r in got if r.candidate_id == "s" and (r.combination == "psp" or "psp=" in r.cohort)]
    pick = lambda cand, comb: {r.cohort: (r.n, r.d) for r in got if (r.candidate_id, r.combination, r.lag) == (cand, comb, 0)}
    assert {f"psp=psp_beta,{k}": v for k, v in pick("s", "psp,customer_country").items()} == {k: v for k, v in pick("g", "psp,customer_country").items() if "psp_beta" in k}
