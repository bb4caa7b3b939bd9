"""Fill-in-middle, embedding near-dedup and periodic runs on awkward rows and against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollgate.llm import embedding_dedup, fill_in_middle, periodic_runs, queries

from test_llm import CLASH, TEXTS, nasty  # noqa: F401  a fixture

LINE = re.compile(r"[^\n]*\n|[^\n]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize(
    "kind, offsets",
    [
        ("ArrayContainer", [3, 9, 70, 71, 900]),
        ("BitmapContainer", range(1, 60_000, 7)),
        ("RunContainer", [*range(5, 4000), *range(5000, 9000)]),
    ],
)
def test_containers_select(kind, offsets):
    offsets = np.array(offsets)
    found = fill_in_middle.BoundarySet(offsets)
    assert [type(c).__name__ for c in found.containers] == [kind]
    assert [found.select(k) for k in range(len(offsets))] == offsets.tolist()


def test_boundary_set_of_many_containers():
    rng = np.random.default_rng(1)
    dense, runs, sparse = rng.choice(65_536, 30_000, False), np.arange(65_536, 2 * 65_536), 5 * 65_536 + rng.choice(65_536, 50, False)
    offsets = np.sort(np.concatenate((dense, runs, sparse)))
    found = fill_in_middle.BoundarySet(offsets)
    assert {type(c).__name__ for c in found.containers} == {"ArrayContainer", "BitmapContainer", "RunContainer"}
    assert [found.select(k) for k in range(0, len(offsets), 97)] == offsets[::97].tolist()


def _fim(doc_id, text):
    text = text or ""
    lines = LINE.findall(text)
    n, d = len(lines), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    form = "spm" if h[3] % 100 < 50 else "psm"
    return (doc_id, n, form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text))


def test_fill_in_middle(spark, nasty, tmp_path):  # noqa: F811
    rng = random.Random(4)
    more = ["\n" * 70_000, "a\n" * 50_000, "é\n漢字 🙂\n\nx", "a <M> b\nc", "<P\n>S>\n<", "\r\n\x0b\x0c\n y"] + ["".join(rng.choice(["é", "b ", "\n", "<", "S>", "P"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id bigint, text string")
    docs = nasty.unionByName(rows, allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_fill_in_middle(spark, str(tmp_path)).collect()]
    want = [_fim(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(docs.limit(0)).count() == 0
    some = fill_in_middle.transform(docs, percent=30, spm_percent=0)
    assert {r.form for r in some.select("form").distinct().collect()} == {"plain", "psm"}
    assert some.where(fill_in_middle.restored(F.col("form"), F.col("output")).isNull()).count() == 0


def _runs(w):
    """Every run by trying every period at every word."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            s = i
            while i < n and w[i] == w[i - q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                found.setdefault((s - q, i), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _plain_runs(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = _runs(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def _loopy(rng):
    """Words with runs beside, across and inside each other."""
    w = []
    for _ in range(rng.randrange(1, 6)):
        unit = [rng.choice("abc") for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 30]))]
        w += (unit * 12)[: rng.randrange(1, 12 * len(unit))] + [rng.choice("abcde") for _ in range(rng.randrange(4))]
    return w * rng.choice([1, 1, 1, 4, 5])


def test_periodic_runs_of_loopy_words():
    rng = random.Random(8)
    texts = [_loopy(rng) for _ in range(400)] + [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 3, ["a", "b"] * 4, ["a"] * 400, (["x"] * 50 + ["y"]) * 9]
    got = periodic_runs._batch(list(range(len(texts))), [[x.encode() for x in w] for w in texts]).to_pylist()
    for w, row in zip(texts, got, strict=True):
        assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == _runs(w), w


def test_periodic_runs(spark, nasty, tmp_path):  # noqa: F811
    rng = random.Random(9)
    more = [" ".join(_loopy(rng)) for _ in range(150)] + ["a\x1cb a\x1cb  " * 9, "\x0b".join("é漢" * 3 + " 🙂") * 2, " ".join(f"w{i}" for i in range(300))]
    docs = nasty.unionByName(spark.createDataFrame([(2000 + i, t) for i, t in enumerate(more)], "doc_id bigint, text string"), allowMissingColumns=True)
    docs.where("length(text) < 100000 or text is null").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    want = [_plain_runs(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] for r in got) > 100
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_periodic_runs_of_very_long_texts():
    """Half a million words of one kind, of a loop and of a loop in a loop; work stays near linear."""
    n = 500_000
    loop = [f"w{i % 5}".encode() for i in range(100)] + [b"end"]
    texts = [[b"x"] * n, (loop * (n // 101 + 1))[:n], ([b"x"] * 100 + [b"y"]) * (n // 101)]
    first, second, third = (r["runs"] for r in periodic_runs._batch([0, 1, 2], texts).to_pylist())
    assert first == [{"start": 0, "length": n, "period": 1}]
    assert {"start": 0, "length": n, "period": 101} in second and {"start": 0, "length": 100, "period": 5} in second
    assert {"start": 0, "length": len(texts[2]), "period": 101} in third and len(third) == 1 + n // 101


def _near(rows, least=0.93):
    """Links and components by comparing all vectors of a label."""
    one = {}
    for vec_id, v, label in rows:
        sound = v is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if vec_id is not None and sound:
            one[vec_id] = min(one.get(vec_id, (label, v)), (label, v))
    ids = sorted({r[0] for r in rows if r[0] is not None})
    near = {i: set() for i in ids}
    for i in one:
        for j in one:
            if i < j and one[i][0] == one[j][0] and len(one[i][1]) == len(one[j][1]):
                x, y = (np.array(one[k][1], float) for k in (i, j))
                x, y = x / abs(x).max(), y / abs(y).max()
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                    near[i].add(j)
                    near[j].add(i)
    out, seen = {}, set()
    for i in ids:
        if i in seen:
            continue
        reach, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        seen |= reach
        out |= {j: (len(near[j]), i, i == j) for j in reach}
    return out


def _vectors(rng, groups=25, size=12, d=16):
    rows, at = [], 0
    for g in range(groups):
        base = rng.normal(size=d)
        for _ in range(rng.integers(1, size)):
            rows.append([int(at), (base + rng.normal(size=d) * rng.choice([0.05, 0.2, 0.27])).astype(np.float32).tolist(), int(g % 3)])
            at += 1
    rows += [[at + i, list(rows[i][1]), rows[i][2]] for i in range(15)]  # copies
    rows += [[at + 20 + i, [3.0 * x for x in rows[i][1]], rows[i][2]] for i in range(5)]  # the same direction
    return rows


def _same(spark, rows, kind="array<float>", **more):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding {kind}, label int").withColumn("rep", F.lit(1)).withColumn("v", F.lit("x")).withColumn("d", F.lit(None))
    got = embedding_dedup.near_components(df, **more).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == _near(rows)
    assert len(got) == len({r[0] for r in rows})
    return got


@pytest.mark.parametrize("block_rows, tile", [(8192, 1024), (256, 7), (40, 16)])
def test_embedding_dedup(spark, block_rows, tile):
    rows = _vectors(np.random.default_rng(2))
    rows += [[900, None, 1], [901, [0.0] * 16, 1], [902, rows[0][1], None], [903, [None] + rows[0][1][1:], 0], [904, [float("nan")] * 16, 0], [905, [float("inf")] * 16, 0], [906, rows[0][1][:8], 0], [907, [], 0]]
    rows += [[None, rows[0][1], 0], [None, rows[3][1], 0], list(rows[5]), [0, rows[40][1], 2]]
    got = _same(spark, rows, block_rows=block_rows, tile=tile)
    assert max(r.n_links for r in got) > 3
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


def test_embedding_dedup_of_doubles_and_nothing(spark):
    rng = np.random.default_rng(5)
    rows = [[i, (v * 10.0 ** int(rng.integers(-200, 200))).tolist(), 1] for i, v in enumerate(np.repeat(rng.normal(size=(8, 12)), 4, 0) + rng.normal(size=(32, 12)) * 0.1)]
    _same(spark, rows, "array<double>")
    assert embedding_dedup.near_components(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_bounds_hold_and_spare_work():
    """The integer estimate never misses by more than its bound, and few pairs are worked out again."""
    rng = np.random.default_rng(6)
    v = np.repeat(rng.normal(size=(60, 64)), 6, 0) + rng.normal(size=(360, 64)) * rng.uniform(0, 0.4, (360, 1))
    ints, scales, errors = embedding_dedup.quantised(v)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    est = embedding_dedup.products(ints, ints) * scales[:, None] * scales
    assert (np.abs(unit @ unit.T - est) <= (1 + errors[:, None]) * (1 + errors) - 1 + 1e-9).all()
    wide = np.tile(ints, 40)
    assert (embedding_dedup.products(wide, wide) == wide.astype(np.int64) @ wide.astype(np.int64).T).all()
    table = embedding_dedup.pa.table({"rep": np.arange(360), "copies": np.ones(360, np.int64), "v": list(v)})
    key = [embedding_dedup.pa.scalar(x) for x in ("a", 64, 0)]
    block = embedding_dedup.Block(embedding_dedup._pack(key, table).to_pylist())
    i, j, doubts = embedding_dedup.tile_links(block, slice(0, 360), slice(0, 360), 0.93)
    want = np.argwhere(np.triu(unit @ unit.T >= 0.93, 1))
    assert np.array_equal(np.array([i, j]).T, want) and 0 < doubts < len(want) / 2
