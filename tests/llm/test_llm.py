"""Every training-data operator on awkward rows, and against brute force or the reference library where SQL can't say it."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tollgate.llm import byte_bpe, language_id, license_scan, line_dedup, mixing, near_dedup, oracles, quality_rules, queries, sharding, url_filter, vector_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(3)
VOCAB = ["river", "stone", "cloud", "tree", "light", "house", "road", "bird", "wind", "field", "glass", "paper"]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) + str(rng.randrange(40)) for _ in range(n)) + "."


LONG = prose(30_000)
TEXTS = [None, "", " \t\n", "a", "a b", "12 34 !!", prose(80), prose(80) + "\n" + prose(10), LONG, "é ß ñ 漢字 🙂", "#|#|#|#\nx | y | z | w", "x" * 20_000]
TEXTS += [TEXTS[6]] * 3 + [LONG]
CLASH = "key string, pos int, n int, w int, h int, comp int, cls int, copies int, line string, size int, base int, p double, k int, text_key int, score double, cell int"


@pytest.fixture(scope="module")
def nasty(spark):
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2"][i % 3], len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [(6, TEXTS[6], "en", "s1", 1), (6, TEXTS[6], "en", "s1", 1), (None, "no id here", None, None, None)]
    clash = [None] * len(CLASH.split(", "))
    return spark.createDataFrame([(*r, *clash) for r in rows], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}")


def words(t):
    return WORD.findall(t or "")


def test_quality_rules(nasty):
    got = quality_rules.clean(nasty).collect()
    assert len(got) == nasty.count()
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        w = words(t)
        grams = defaultdict(list)
        for j in range(len(w) - 2):
            grams[tuple(w[j : j + 3])].append(j)
        covered = {j + d for at in grams.values() if len(at) > 1 for j in at for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert by[6].kept and not by[0].kept and not by[10].kept
    assert quality_rules.clean(nasty.limit(0)).count() == 0


def test_lines_of_all_scripts(spark):
    """Prose lines stay and menu entries go, whatever marks or spaces a script has."""
    good = [
        "यह एक पूरा वाक्य है।", "هل هذه جملة كاملة؟", "Սա ամբողջական նախադասություն է։", "これは完全な文です。", "这是一个没有结束标点但是足够长的中文句子因此它应该留在文本里面",
        "นี่คือประโยคภาษาไทยที่ยาวพอสมควรและไม่มีเครื่องหมายวรรคตอน", "She said “yes.”", "(as above)", "Quoi ?", "a b c d e f g h i j k l",
    ]
    bad = ["首页", "หน้าแรก", "मुख्य पृष्ठ", "الصفحة الرئيسية", "Home", "See chapter 4 *", "100 %", "start here •", "a | b | c | d", "Read more."]
    rows = spark.createDataFrame([(x,) for x in good + bad], "line string")
    fails = {r.line: r.fails for r in rows.select("line", quality_rules.line_fails(F.col("line"), quality_rules.Rules()).alias("fails")).collect()}
    assert [x for x in good if fails[x]] == [] and [x for x in bad if not fails[x]] == []


def test_license_scan(spark, nasty):
    rows = [(1, "Intro.\nReleased under the MIT License.\nReleased under the MIT License"), (2, "licensed under CC BY-NC 4.0!"), (3, "Released by nobody under a tree")]
    got = {(r.doc_id, r.line_no): (r.licence, r.dice) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1): ("MIT", 1.0), (1, 2): ("MIT", 1.0), (2, 0): ("CC-BY-NC-4.0", 1.0)}
    assert license_scan.scan(nasty).count() == 0 and license_scan.scan(nasty.limit(0)).count() == 0


def test_license_scan_is_exhaustive(spark):
    """Anchors and size bounds lose no line that reaches a template."""
    rng, notices = random.Random(5), sorted(license_scan.TEMPLATES.items())
    norm = lambda t: [w for w in re.sub(r"[^\w]+|_", " ", t.lower()).split(" ") if w]
    lines = []
    for _ in range(150):
        w = rng.choice(notices)[1].split(" ")
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        lines.append(" ".join(w[rng.randrange(2) :]))
    grams = lambda t: set(zip(norm(t), norm(t)[1:]))
    want = {i for i, x in enumerate(lines) if any(200 * len(grams(x) & grams(n)) >= 80 * (len(grams(x)) + len(grams(n))) for _, n in notices)}
    got = {r.doc_id for r in license_scan.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == want and 20 < len(want) < 150


def _passage(text, notice, t=80):
    """Whether any window of the text's words reaches the notice, by brute force."""
    norm = lambda x: [w for w in re.sub(r"[^\w]+|_", " ", x.lower()).split(" ") if w]
    w, n = norm(text), norm(notice)
    a, b = list(zip(w, w[1:])), set(zip(n, n[1:]))
    reach = (200 - t) * len(b) // t
    return any(200 * len(set(a[i:j]) & b) >= t * (len(set(a[i:j])) + len(b)) for i in range(len(a)) for j in range(i + 1, min(len(a), i + reach) + 1))


def test_license_passages(spark, nasty):
    """Notices wrapped over lines, inside longer lines, bare, in full, and twice in a text."""
    mit = license_scan.PASSAGES["MIT-full"]
    wrap = lambda t: "\n".join(t[i : i + 76] for i in range(0, len(t), 76))
    rows = [
        (1, "/*\n" + "\n * ".join(["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files, to deal in the", "Software without restriction"]) + "\n */"),
        (2, "Copyright 2020 Acme. Released under the MIT License."), (3, "Intro\n\nAll rights reserved."), (4, prose(30) + "\nMIT\n\n" + "\n".join(mit.split(", ")) + "\n" + prose(30)),
        (5, "Released under the MIT License. river stone\ncloud tree Licensed under CC BY 4.0. field"), (6, "all the rights are not reserved"), (None, "x All rights reserved"), (7, wrap(prose(20)))]
    got = defaultdict(list)
    for r in license_scan.passages(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "first_word").collect():
        got[r.doc_id].append((r.licence, r.line_no))
    assert got == {1: [("MIT-header", 1)], 2: [("MIT", 0)], 3: [("All-rights-reserved", 2)], 4: [("MIT-full", 3)], 5: [("MIT", 0), ("CC-BY-4.0", 1)], None: [("All-rights-reserved", 0)]}
    assert license_scan.passages(nasty).count() == 0 and license_scan.passages(nasty.limit(0)).count() == 0


def test_license_passages_ties_and_long_lines(spark):
    """Equal templates: the first name; a notice inside a line of 400,000 letters; full licences wrapped anywhere; a repeated row."""
    rng = random.Random(7)
    same = {"B": "one two three four five", "A": "one two three four five"}
    got = license_scan.passages(spark.createDataFrame([(1, "x one two three four five y"), (1, "x one two three four five y")], "doc_id long, text string"), templates=same).collect()
    assert [(r.licence, r.dice, r.first_word) for r in got] == [("A", 1.0, 1)] * 2
    line = prose(60_000, rng)
    rows = [(1, f"{line} Released under the MIT License. {line}")]
    full = [n for n in license_scan.PASSAGES if n.endswith(("-full", "-notice"))]
    for i, n in enumerate(full):
        w = license_scan.PASSAGES[n].split(" ")
        rows.append((10 + i, prose(40, rng) + "\n" + "".join(x + rng.choice("  \n") for x in w) + "\n" + prose(40, rng)))
    got = {r.doc_id: (r.licence, r.dice) for r in license_scan.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 1.0)} | {10 + i: (n, 1.0) for i, n in enumerate(full)}


def test_license_passages_are_exhaustive(spark):
    rng, notices = random.Random(6), sorted(license_scan.TEMPLATES.items())
    texts = []
    for _ in range(60):
        w = rng.choice(notices)[1].split(" ")
        for _ in range(rng.randrange(len(w) // 3 + 1)):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        w = prose(rng.randrange(1, 8), rng).split(" ") + w + prose(rng.randrange(1, 8), rng).split(" ")
        texts.append("".join(x + rng.choice("  \n") for x in w))
    want = {i for i, x in enumerate(texts) if any(_passage(x, n) for _, n in notices)}
    got = {r.doc_id for r in license_scan.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=license_scan.TEMPLATES).collect()}
    assert got == want and 10 < len(want) < 60


def _picked(text, notices, t=80):
    """The passages by brute force: every window between two bigrams of a notice, the best first, none over another."""
    norm = lambda x: [w for w in re.sub(r"[^\w]+|_", " ", x.lower()).split(" ") if w]
    w = norm(text)
    a, found = list(zip(w, w[1:])), []
    for name, notice in notices.items():
        n = norm(notice)
        b = set(zip(n, n[1:]))
        reach = (200 - t) * len(b) // t
        for i in (i for i in range(len(a)) if a[i] in b):
            seen = set()
            for j in range(i, min(len(a), i + reach)):
                seen.add(a[j])
                shared = len(seen & b)
                if a[j] in b and 200 * shared >= t * (len(seen) + len(b)):
                    found.append((-2.0 * shared / (len(seen) + len(b)), -shared, name, i, j + 1, len(seen)))
    kept = []
    for x in sorted(found):
        if all(y[3] > x[4] or x[3] > y[4] for y in kept):
            kept.append(x)
    return sorted((x[2], x[3], x[4] - x[3] + 1, -x[1], x[5]) for x in kept)


def test_license_passages_of_long_templates(spark):
    """Perturbed full licences: the very windows of brute force, whatever follows them."""
    rng = random.Random(12)
    long = {n: x for n, x in license_scan.PASSAGES.items() if n in ("Zlib-full", "BSD-2-Clause-full", "ISC-full", "MIT-full")}
    plain = [f"t{i}" for i in range(101)]
    long["plain"] = " ".join(plain)
    texts = []
    w = list(plain)
    for i in rng.sample(range(5, 95), 7):
        w[i] = f"x{i}"
    texts.append(" ".join([*w[:52], *(f"n{i}" for i in range(6)), *w[52:], *(f"z{i}" for i in range(16)), "t1 t2"]))
    for _ in range(14):
        w = rng.choice(sorted(long.values())).split(" ")
        for _ in range(rng.randrange(len(w) // 9 + 1)):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        at = rng.randrange(len(w))
        w[at:at] = prose(rng.randrange(30), rng).split(" ")
        tail = rng.choice([[], w[3:9], w, w[20:70]])
        texts.append(" ".join(prose(rng.randrange(1, 8), rng).split(" ") + w + prose(rng.randrange(1, 20), rng).split(" ") + tail))
    got = defaultdict(list)
    for r in license_scan.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=long).collect():
        got[r.doc_id].append((r.licence, r.first_word, r.n_words, r.n_shared, r.n_window))
    want = {i: _picked(x, long) for i, x in enumerate(texts)}
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}
    assert len(got) > 8 and len(want[0]) == 1


def test_many_notices_in_one_text(spark):
    """Thousands of notices, back to back and apart: each once."""
    text = "Released under the MIT License. " * 3_000 + " ".join(f"w{i} Licensed under CC BY 4.0." for i in range(1_000))
    began = time.time()
    got = license_scan.passages(spark.createDataFrame([(1, text)], "doc_id long, text string")).groupBy("licence").count().collect()
    assert {r.licence: r["count"] for r in got} == {"MIT": 3_000, "CC-BY-4.0": 1_000} and time.time() - began < 120


def test_line_dedup(spark, nasty):
    shared, rows = "This very line stands everywhere.", []
    for i in range(12):
        rows.append((i, f"own line number {i}\n{shared}\n{'few sites line' if i < 5 else 'another own ' + str(i)}", f"s{i % 8}"))
    rows += [(50 + i, "same text on one site\nmore of it", "s1") for i in range(20)]
    rows += [(100, None, "s1"), (101, "", None)]
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].text == rows[0][1] and all(shared not in got[i].text and got[i].n_removed == 1 for i in range(1, 12))
    assert all(got[50 + i].n_removed == 0 for i in range(20)) and got[100].text is None and got[101].text == ""
    done = line_dedup.dedup(nasty, min_sites=2)
    assert done.count() == nasty.count() and set(nasty.columns) < set(done.columns)
    clash = nasty.withColumns({c: F.lit(i) for i, c in enumerate(("n_lines", "n_removed", "gone", "gone__", "id", "id__", "key__", "body", "row", "site", "pos", "of", "text_key__"))})
    same = line_dedup.dedup(clash, min_sites=2)
    assert sorted(same.columns) == sorted(clash.columns)
    value = lambda df: sorted(map(repr, df.select("doc_id", "text", "n_lines", "n_removed").collect()))
    assert value(same) == value(done) and same.select("gone__", "row", "pos").distinct().collect() == [(3, 8, 10)]
    by = {r.doc_id: r for r in done.collect()}
    assert by[0].text is None and by[0].n_lines == 0 and by[1].text == "" and by[8].text == LONG and by[6].n_removed == 0
    assert line_dedup.dedup(nasty.limit(0)).count() == 0


def test_line_dedup_without_spaces(spark):
    """Lines in scripts without spaces spread like others; a line of one word in a spaced script stays."""
    for line in ("版权所有未经许可不得转载", "すべての権利を保有します", "สงวนลิขสิทธิ์ทั้งหมด"):
        rows = [(i, f"{line}\nown line {i}\nHome", f"s{i}") for i in range(8)]
        got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        assert got == {i: t if i == 0 else f"own line {i}\nHome" for i, t, _ in rows}


@pytest.mark.parametrize("min_sites", [2, 5, 12])
def test_line_dedup_counts_exactly(spark, min_sites):
    rng = random.Random(min_sites)
    rows = [(i, "\n".join(f"common line {rng.randrange(1, 40)}" for _ in range(6)), f"site{rng.randrange(30)}") for i in range(150)]
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for j, x in enumerate(t.split("\n")):
            sites[x].add(s)
            first.setdefault(x, (i, j))
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=min_sites).collect()}
    for i, t, _ in rows:
        assert got[i] == "\n".join(x for j, x in enumerate(t.split("\n")) if len(sites[x]) < min_sites or first[x] == (i, j))


def test_mixing(spark, nasty):
    rng = random.Random(1)
    rows = [(i, prose(rng.randrange(1, 60), rng), f"s{min(rng.randrange(6), 3)}" if i % 50 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, bucket_rows=16).toPandas()
    again = mixing.mix(df.repartition(7), bucket_rows=16).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert (got.taken <= 2 * got["size"]).all() and len(got) == 1500
    per = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    # water filling by hand
    names = sorted(x for x in per.index if isinstance(x, str))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate([*names, None])}
    size = {n: per.loc[n, "size"] if isinstance(n, str) else per[per.index.isna()]["size"].iloc[0] for n in weight}
    left, open_, target = 1.5 * sum(size.values()), set(weight), {}
    while over := [n for n in open_ if left * weight[n] / sum(weight[k] for k in open_) > 2 * size[n]]:
        for n in over:
            target[n] = 2.0 * size[n]
        open_ -= set(over)
        left = 1.5 * sum(size.values()) - sum(target.values())
    target |= {n: left * weight[n] / sum(weight[k] for k in open_) for n in open_}
    for n in weight:
        row = per.loc[n] if isinstance(n, str) else per[per.index.isna()].iloc[0]
        assert math.isclose(row.target, target[n], rel_tol=1e-9) and abs(row.taken - row.target) <= 60
    odd = mixing.mix(nasty).toPandas()
    assert len(odd) == nasty.count() and (odd.taken <= 2 * odd["size"]).all()
    assert mixing.mix(nasty.limit(0)).count() == 0


def test_url_filter(spark):
    urls = ["http://A.example.COM/en/7x?q#f", "http://b.com/en/1", "ftp://x.net/de/1", "https://y.example.net/de/8", "no scheme", None, "", "http://com/en", "http://xcom/en/1", "://q.org/es/", "http://h?x", "http://h#/en/"]
    df = spark.createDataFrame([(i, u, None, "c") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", None, None, None, None, None, "org/es/", None, None]
    assert [got[i].verdict for i in (0, 1, 2, 3, 9)] == ["allow", "block", "allow", "block", "block"]
    assert [(got[i].host, got[i].path) for i in (0, 4, 5, 10, 11)] == [("a.example.com", "/en/7x"), ("", ""), ("", ""), ("h", ""), ("h", "")]
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_scores_match_plain_python(spark):
    rng = random.Random(2)
    name = lambda xs: "".join(rng.choice(xs) for _ in range(6))
    rows = [(i, f"http://{name('abc')}.com/en/{name('xyz')}" if i % 2 else f"http://{name('mno')}.net/de/{name('pqr')}") for i in range(200)] + [(900, "http://abcabc.org/xyzxyz"), (901, "http://mnomno.org/pqrpqr")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(df, cells=1 << 20).collect()}
    assert (got[900].verdict, got[901].verdict) == ("block", "allow") and got[900].score < 0 < got[901].score
    held = {r.url for r in df.where(F.crc32(F.col("url").cast("binary")) % 5 == 0).collect()}
    counts = {c: (defaultdict(int), defaultdict(int)) for c in (True, False)}
    for i, u in rows[:200]:
        if u in held:
            continue
        s = "    " + u
        for j in range(4, len(s)):
            for k in range(5):
                counts[i % 2 == 0][0][k, s[j - k : j], s[j]] += 1
                counts[i % 2 == 0][1][k, s[j - k : j]] += 1

    def score(u):
        s, total = "    " + u, 0.0
        for j in range(4, len(s)):
            p = {True: 1 / 64, False: 1 / 64}
            for k in range(5):
                for c in p:
                    p[c] = (counts[c][0].get((k, s[j - k : j], s[j]), 0) + 2 * p[c]) / (counts[c][1].get((k, s[j - k : j]), 0) + 2)
            total += math.log(p[True] / p[False])
        return total / len(u)

    for i in (900, 901):
        assert abs(got[i].score - score(dict(rows)[i])) < 0.1


def test_url_verdicts_of_the_given_table(spark):
    """Every page of sf0.01: host, path, rule, score and verdict against plain Python, with odd rows added."""
    odd = [(None, "http://no.id/x", None), (7, None, None), (7, "", None), (8, "http://a.b/" + "z" * 20_000, None), (9, "HTTP://Ä.COM/EN/1", None)]
    df = queries.table(spark, "/root/testdata/sf0.01", "pages")
    df = df.union(spark.createDataFrame(odd, df.schema))
    df = df.union(df.limit(5))
    got = url_filter.judge(df).collect()
    urls = [r.url for r in df.collect()]
    rules, lower = sorted(url_filter.RULES, key=lambda r: -len(r[0])), {i: i + 32 for i in range(65, 91)}

    def ruled(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"(?s)[^/?#]*", rest).group()
        path = re.match(r"(?s)[^?#]*", rest[len(host) :]).group()
        host = host.translate(lower)
        for rule, verdict in rules:
            at, _, start = rule.partition("/")
            if (host == at or host.endswith("." + at)) and path.startswith("/" + start):
                return host, path, rule, verdict
        return host, path, None, None

    held = {r.url for r in df.where(F.crc32(F.col("url").cast("binary")) % 5 == 0).collect()}
    pad = lambda u: "    " + re.sub("[0-9]", "0", u.lower())
    pairs, contexts = (defaultdict(lambda: [0, 0]) for _ in range(2))
    for u in urls:
        if u and ruled(u)[2] and u not in held:
            s, x = pad(u), int(ruled(u)[3] == "block")
            for j in range(4, len(s)):
                for k in range(5):
                    pairs[s[j - k : j], s[j]][x] += 1
                    contexts[s[j - k : j], k][x] += 1

    def score(u):
        s, total = pad(u), 0.0
        for j in range(4, len(s)):
            p = [1 / 64, 1 / 64]
            for k in range(5):
                p = [(pairs[s[j - k : j], s[j]][x] + 2 * p[x]) / (contexts[s[j - k : j], k][x] + 2) for x in (0, 1)]
            total += math.log(p[0] / p[1])
        return total / (len(s) - 4)

    tests = [(score(u), ruled(u)[3] == "allow") for u in urls if u and ruled(u)[2] and u in held]
    error = lambda at: sum(g and round(s / 0.001) < at for s, g in tests) / max(1, sum(g for _, g in tests)) + sum(not g and round(s / 0.001) >= at for s, g in tests) / max(1, sum(not g for _, g in tests))
    free = [r for r in got if r.rule is None and r.url]
    limit = max([r.score for r in free if r.verdict == "block"], default=-math.inf)
    assert all((r.score <= limit) == (r.verdict == "block") for r in free)
    bins = sorted({round(s / 0.001) for s, _ in tests})
    assert error(math.ceil(limit / 0.001)) <= min(map(error, [*bins, bins[-1] + 1])) + 1e-9 if limit > -math.inf else True
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = ruled(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and (rule is None or r.verdict == verdict)
        assert (r.score is None) if rule or not r.url else math.isclose(r.score, score(r.url), rel_tol=1e-9, abs_tol=1e-12)


def test_url_counts_are_exact(spark):
    """With more distinct grams than any fixed table would hold apart, the score is still the plain one."""
    rng = random.Random(9)
    some = lambda first, n: "".join(chr(first + rng.randrange(200)) for _ in range(n))
    rows = [(i, f"http://h.com/en/{some(0x4E00, 30)}" if i % 2 else f"http://h.net/de/{some(0x5000, 30)}") for i in range(1200)] + [(5000, f"http://h.org/{some(0x4E00, 20)}")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r.score for r in url_filter.judge(df, rules=(("com/en/", "block"), ("net/de/", "allow"))).collect()}
    held = {r.page_id for r in df.where(F.crc32(F.col("url").cast("binary")) % 5 == 0).collect()}
    pairs, contexts = (defaultdict(lambda: [0, 0]) for _ in range(2))
    for i, u in rows[:-1]:
        s = "    " + re.sub("[0-9]", "0", u.lower())
        for j in range(4, len(s)):
            for k in range(5) if i not in held else ():
                pairs[s[j - k : j], s[j]][i % 2] += 1
                contexts[s[j - k : j], k][i % 2] += 1
    s, total = "    " + rows[-1][1], 0.0
    for j in range(4, len(s)):
        p = [1 / 64, 1 / 64]
        for k in range(5):
            p = [(pairs[s[j - k : j], s[j]][x] + 2 * p[x]) / (contexts[s[j - k : j], k][x] + 2) for x in (0, 1)]
        total += math.log(p[0] / p[1])
    assert len(pairs) > 65_536 and math.isclose(got[5000], total / (len(s) - 4), rel_tol=1e-9)


def _components(texts, k, percent):
    sets = []
    for t in texts:
        w = words((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))], [len(s) for s in sets]


def _copies(seed):
    rng, texts = random.Random(seed), list(TEXTS)
    for _ in range(12):
        base = prose(rng.randrange(6, 120), rng).split(" ")
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("k,percent,block", [(3, 85, 384), (5, 80, 8)])
def test_near_components(spark, k, percent, block):
    texts = _copies(k)
    want, sizes = _components(texts, k, percent)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in near_dedup.near_components(df, k, percent, block).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (want[i] == i) for i in got)


def test_near_components_odd(spark, nasty):
    assert near_dedup.near_components(nasty.limit(0)).count() == 0
    assert near_dedup.near_components(nasty).count() == nasty.count()


def test_near_components_of_odd_ids(spark):
    """A null id among copies, only null ids, and one id of two texts lose neither links nor documents."""
    rng = random.Random(11)
    a, b, c, d = (prose(60, rng) for _ in range(4))
    near = a[:-1] + " more."
    rows = [(5, a), (None, a), (3, a), (8, near), (None, b), (None, b), (None, b + " more."), (7, c), (7, d), (9, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.key): (r.component_id, r.kept) for r in near_dedup.keyed_components(df, 5, 80).collect()}
    key = {t: k for t, k in df.select("text", near_dedup.text_key(F.col("text"))).collect()}
    assert [got[i, key[t]] for i, t in ((5, a), (None, a), (3, a), (8, near))] == [(3, False), (3, False), (3, True), (3, False)]
    assert sorted(got[None, key[t]][1] for t in (b, b + " more.")) == [False, True]
    assert [got[7, key[c]], got[7, key[d]], got[9, key[c]]] == [(7, True), (7, True), (7, False)]


def test_pipeline_keeps_odd_ids(spark):
    import corpus_pipeline

    rng = random.Random(12)
    a, b, c = (prose(60, rng) for _ in range(3))
    rows = [(None, a), (4, a), (None, b), (6, b + prose(80, rng)), (6, c), (None, prose(50, rng))]
    docs = spark.createDataFrame([(i, t, "en", "s1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted((i or 0, t) for i, t in rows[1:])
    mixed = corpus_pipeline.mixture(spark, spark.createDataFrame(kept), "").collect()
    assert {r.text for r in mixed} == {r.text for r in kept} and all(len([r for r in mixed if r.text == t]) in (1, 2) for _, t in rows[1:])


def test_pipeline_on_odd_rows(spark, nasty):
    """Nulls, repeated rows, very long texts and clashing columns go through every stage; so does an empty table."""
    import corpus_pipeline
    from tollgate.llm.common import durable

    for docs, some in ((nasty.withColumns({c: F.lit(1) for c in ("row_key", "id__", "key__", "copy", "copies", "row", "mixture")}), True), (nasty.limit(0), False)):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, durable(stage(spark, docs, ""), f"odd-{name}")
            if name != "byte_bpe":
                assert docs.columns == corpus_pipeline.COLUMNS
            if some and name == "near_dedup":
                left = docs.collect()
                assert len({r.text for r in left}) == len(left) > 0 and {(r.doc_id, r.text) for r in left} <= {(r.doc_id, r.text) for r in before.collect()}
        assert (docs.count() > 0) == some


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    orders = near_dedup._orders()
    for shared in (0, 300, 850, 1000):
        x = np.unique(rng.integers(0, 2**64, 1000 + 1000 - shared, dtype=np.uint64))
        a, b = np.sort(x[:1000]), np.sort(np.concatenate((x[:shared], x[1000:])))
        got = near_dedup.estimated(near_dedup.registers(a, orders)[None], near_dedup.registers(b, orders)[None])[0, 0]
        assert abs(got - shared / (2000 - shared)) < 0.15


def test_language_id(spark, nasty):
    pools = {"aa": "bakelo mitura", "bb": "xyzzy qwrty", "cc": "éàü öñç"}
    rng = random.Random(4)
    text = lambda c, n: " ".join("".join(rng.choice(pools[c].replace(" ", "")) for _ in range(5)) for _ in range(n))
    rows = [(i, text(c := rng.choice("aa bb cc".split()), 30), c) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df.where("doc_id < 200"))
    got = language_id.identify(df.where("doc_id >= 200"), model, ["doc_id", "lang"]).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    mixed = spark.createDataFrame([(1, text("aa", 60) + " " + text("cc", 20))], "doc_id long, text string")
    mix = language_id.identify(mixed, model, ["doc_id"]).first().mixture
    assert [m.lang for m in mix] == ["aa", "cc"] and abs(mix[0].share - 0.7) < 0.15
    odd = language_id.identify(nasty.withColumn("row", F.lit(5)).withColumn("lang_pred", F.lit("mine")), model, ["doc_id", "score", "lang_pred", "row", "text", "p"])
    assert odd.columns == ["doc_id", "row", "text", "p", "lang_pred", "score", "mixture"]
    odd = {r.doc_id: r for r in odd.collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 and odd[i].row == 5 and odd[i].text == TEXTS[i] for i in (0, 1, 2, 5)) and odd[8].lang_pred != "und"
    none = language_id.train(df.limit(0))
    assert language_id.identify(df, none, ["doc_id"]).where("lang_pred != 'und'").count() == 0
    assert language_id.identify(df.limit(0), model, ["doc_id"]).count() == 0


def test_language_mixtures_match_plain_python(spark):
    """Every document of sf0.001: proportions and chosen languages against a slow version without numpy."""
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.select("doc_id", "text", "lang", language_id.held_out(F.col("doc_id")).alias("out")).collect()
    cells = lambda t: [int(c) for c in language_id.grams(t)]
    langs = sorted({r.lang for r in rows if r.lang and not r.out and r.text})
    n = {l: [0.5] * language_id.CELLS for l in langs}
    for r in rows:
        for c in cells(r.text) if r.text and r.lang and not r.out else ():
            n[r.lang][c] += 1
    logp = {l: [math.log(x / total) for x in n[l]] for l in langs for total in [sum(n[l])]}

    def em(own, chosen):
        share = [1 / len(chosen)] * len(chosen)
        for _ in range(25 if len(chosen) > 1 else 0):
            new = [0.0] * len(chosen)
            for c in own:
                p = [s * math.exp(logp[l][c]) for s, l in zip(share, chosen)]
                new = [a + b / sum(p) / len(own) for a, b in zip(new, p)]
            moved, share = max(abs(a - b) for a, b in zip(new, share)), new
            if moved < 1e-4:
                break
        return share, sum(math.log(sum(s * math.exp(logp[l][c]) for s, l in zip(share, chosen))) for c in own)

    def plain(text):
        own = cells(text)
        chosen = [max(langs, key=lambda l: sum(logp[l][c] for c in own))]
        (share, likely), cost = em(own, chosen), 8.0 * 0.5 * math.log(max(2, len(own)))
        while len(chosen) < len(langs):
            tried = {l: em(own, [*chosen, l]) for l in langs if l not in chosen}
            best = max(tried, key=lambda l: tried[l][1])
            if tried[best][1] - likely <= cost:
                break
            chosen, (share, likely) = [*chosen, best], tried[best]
        top = max(range(len(chosen)), key=lambda i: share[i])
        return chosen[top], min(1.0, share[top]), set(chosen)

    got = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs.where(~language_id.held_out(F.col("doc_id")))), ["doc_id"]).collect()}
    short = sorted((r for r in rows if r.text and re.search(r"[^\W\d_]", r.text)), key=lambda r: (len(r.text), r.doc_id))[:80]
    for r in short:
        said, score, chosen = plain(r.text)
        assert got[r.doc_id].lang_pred == said and abs(got[r.doc_id].score - score) < 1e-6 and {m.lang for m in got[r.doc_id].mixture} == chosen
    held = [r for r in rows if r.out and r.lang and got[r.doc_id].lang_pred != "und"]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_vector_search(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 12))
    x = centres[rng.integers(0, 8, 900)] + rng.normal(size=(900, 12)) * 0.3
    x[100:400] = x[100]  # one common vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] * 12), (1060, [1.0] * 11 + [None]), (1080, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.search(df, df.where("vec_id % 20 = 0"), k=20, group_rows=128, block_rows=16).toPandas()
    hit = total = 0
    for q, g in got[got.query_id < 900].groupby("query_id"):
        g = g.sort_values("rank")
        s = x @ x[q]
        order = [j for j in np.lexsort((np.arange(len(x)), -np.round(s, 9))) if j != q][:20]
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g.score, s[g.vec_id])
        hit += np.isclose(np.sort(s[order]), np.sort(g.score)).sum()
        total += 20
    got = got[got.query_id != 1080]
    assert got.query_id.nunique() == 45 and hit / total >= 0.9
    common = [v for v in got[got.query_id == 200].sort_values("rank").vec_id if 100 <= v < 400]
    assert common == list(range(100, 100 + len(common)))
    other = spark.createDataFrame([(1100, [3.0, 1.0]), (1101, [1.0, 1.0]), (20, [9.0] * 12), (1102, [0.5, 0.5]), (1102, [7.0, 7.0])], df.schema)
    both = vector_search.search(df.union(other), df.where("vec_id % 20 = 0").union(other.where("vec_id = 1100")), k=20).toPandas()
    assert [(r.vec_id, r.score) for r in both[both.query_id == 1100].sort_values("rank").itertuples()] == [(1080, 5.0), (1101, 4.0), (1102, 2.0)]
    assert np.allclose(both[both.query_id == 1080].sort_values("rank").score, [5.0, 3.0, 1.5]) and not both[both.query_id == 20].empty
    few = vector_search.search(df.where("vec_id < 3"), df.where("vec_id = 0")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert vector_search.search(df.limit(0), df).count() == 0


def test_vector_search_recall_on_the_given_table(spark):
    """Against brute force over the whole table of sf0.01."""
    df = queries.table(spark, "/root/testdata/sf0.01", "embeddings")
    got = queries.op5_vector_search(spark, "/root/testdata/sf0.01").toPandas()
    rows = df.toPandas()
    ok = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in rows.embedding]
    rows = rows[ok]
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), np.float64)
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        order = [ids[j] for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 1 + len(order))) and (np.diff(mine.score) <= 0).all()
        hit += len(set(order) & set(mine.vec_id))
        total += len(order)
    assert hit / total >= 0.9


def test_heap_order():
    rng = np.random.default_rng(3)
    a, b = rng.random(7), rng.random(5)
    order = list(vector_search.cells_in_order(a, b))
    sums = [a[c // 5] + b[c % 5] for c in order]
    assert sorted(order) == list(range(35)) and all(x <= y for x, y in zip(sums, sums[1:]))


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_byte_bpe_like_the_library(spark, nasty, ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = ["a\x1cb \x1d x y　z​ \u0085 q", "don't I'll 're ", "é" * 300, "\U0001f600\U0001f3fd ok", "  \n\n\n  end  ", "١٢٣ ⅷ ²³ a1b2", "﻿bom\r\n\ttab", "ก็ ทำ हिन्दी"]
    rng = random.Random(8)
    more += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 0x2FFF), 10, 32))) for _ in range(60)) for _ in range(60)]
    more += ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (63, 64, 65, 66, 5_000)] + ["ab" * 900 + "a", " " * 3_000, "é漢" * 700, "=-" * 500]
    texts = TEXTS + more
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in byte_bpe.encode(df, ranks, public_tokenizers.PATTERN, block_bytes=2000).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].n_tokens == len(ids) and got[i].decoded == (t or "").encode()
    assert byte_bpe.encode(nasty.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_long_pieces_merge_in_rounds(ranks):
    """A piece of a million letters takes seconds; rounds give what the library gives."""
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tables = tuple(np.array(x, np.int64) for x in byte_bpe.perfect_hash(byte_bpe.pair_ranks(ranks)))
    single = np.array([ranks[bytes([b])] for b in range(256)])
    rng, began = random.Random(4), time.time()
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    assert len(byte_bpe.merged_long(single[np.frombuffer(letters.encode(), np.uint8)], tables)) < 600_000 and time.time() - began < 120
    for text in [letters[:30_000], "x" * 20_000, *("".join(rng.choice("theanidgr" if i % 2 else "abcABCéß") for _ in range(rng.randrange(2, 400))) for i in range(300))]:
        assert byte_bpe.merged_long(single[np.frombuffer(text.encode(), np.uint8)], tables).tolist() == library.encode_ordinary(text)


def test_sharding(spark, nasty, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), base_bytes=100, fan=3, target_bytes=400, least_files=1)
    assert store.version() == 0 and store.manifest().count() == 0 and store.read().count() == 0
    for start in (0, 9):
        rows = spark.createDataFrame([(i, "x" * 40, i) for i in range(start, start + 9)], "id long, text string, run int")
        store.append(rows, F.col("id"), F.octet_length("text"))
    assert store.version() == 2 and store.manifest().count() == 18
    before = {r.folder for r in store.manifest().collect()}
    store.compact()
    after = store.manifest().collect()
    assert store.version() == 3 and sum(r.n_rows for r in after) == 18 and {r.run for r in after} == {0, 9} and max(r.tier for r in after) == 2
    assert sorted(r.id for r in store.read().collect()) == list(range(18)) and not before & {r.folder for r in after}
    assert {(r.place.run, r.place.file) for r in store.located().collect()} <= {(r, f) for r in (0, 9) for f in range(1)}
    assert store.compact() == 3  # nothing to do
    store.append(spark.createDataFrame([(18, "y", 1), (19, "z", 2)], "id long, text string, run int"), F.col("id"), F.octet_length("text"))
    assert sorted(r.id for r in store.read().collect()) == list(range(20)) and store.manifest().where("not merged").count() == 2
    with pytest.raises(ValueError):
        store.append(rows, F.col("id"), F.octet_length("text"))


def test_sharding_keeps_every_row_and_name(spark, nasty, tmp_path):
    """Nulls, long texts, repeated rows and columns with the store's own names come back as they were, from several files."""
    odd = sharding.ShardStore(spark, str(tmp_path / "t"), base_bytes=64, fan=2, target_bytes=30_000, least_files=3)
    rows = nasty.withColumns({c: F.lit(i) for i, c in enumerate(("run", "arrival", "file", "row", "n_bytes", "folder", "slot", "files", "merged", "n_bytes__"))})
    odd.append(rows, F.col("doc_id"), F.octet_length("text"))
    odd.compact()
    key = lambda df: sorted(map(repr, df.select(*rows.columns).collect()))
    assert odd.read().columns == rows.columns and key(odd.read()) == key(rows)
    assert len({(r.place.run, r.place.file) for r in odd.located().collect()}) > 3
    none = sharding.ShardStore(spark, str(tmp_path / "u"))
    none.append(nasty.limit(0), F.col("doc_id"), F.lit(1))
    assert none.manifest().count() == 0 and none.compact() == 1


def test_racing_commits_lose_nothing(spark, tmp_path):
    """Of writers that saw the same version one wins; every other gets an error, and the winner's rows stay."""
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "r")
    stores = [sharding.ShardStore(spark, root) for _ in range(4)]

    def write(i):
        try:
            return stores[i].append(spark.createDataFrame([(i, "t")], "id long, text string"), F.col("id"), F.lit(1), after=0)
        except RuntimeError:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [i for i, v in enumerate(pool.map(write, range(4))) if v == 1]
    assert len(won) == 1 and stores[0].version() == 1 and [r.id for r in stores[0].read().collect()] == won
    stores[1].append(spark.createDataFrame([(9, "t")], "id long, text string"), F.col("id"), F.lit(1))
    assert sorted(r.id for r in stores[2].read().collect()) == [*won, 9]


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_same_as_sql(spark, name):
    from twins import same

    same(spark, queries.queries()[name], oracles.SQL[name])


def test_pipeline(spark):
    import corpus_pipeline

    from tollgate.llm.common import durable, table

    docs, seen = table(spark, "/root/testdata/sf0.001", "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        seen.append(docs.toPandas())
    kept = seen[2]
    label, _ = _components(seen[1].sort_values("doc_id").text.tolist(), 5, 80)
    assert sorted(kept.doc_id) == sorted(seen[1].sort_values("doc_id").doc_id.iloc[sorted(set(label))])
    assert seen[3].groupby("doc_id").size().max() <= 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").toPandas()
    texts = kept.set_index("doc_id").text
    assert len(last) == len(seen[3]) and all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in last.itertuples())
