"""Detection on a stream against the batch scan on every prefix, over restarts, and against a plain scan."""

import numpy as np
import pytest

from tollgate.operators import detect as d
from tollgate.streaming.detect import episodes_so_far, stream_detect

SERIES = "series string, scope string, kind string, direction string, cusum boolean, grain_s bigint, ts bigint, num bigint, den bigint"
DAYS = 26


def _rows(seed, grain=21_600):
    """Rates and counts with drops, rises, thin windows and windows without a denominator."""
    rng, rows = np.random.default_rng(seed), []
    for name, kind, direction, cusum in (("r", "rate", "down", True), ("b", "rate", "both", False), ("c", "count", "up", True), ("v", "count", "both", False)):
        for scope in ("", "psp=a", "psp=b"):
            shift = 0.0
            for i in range(DAYS * d.DAY // grain):
                if rng.random() < 0.06:
                    shift = rng.choice([0.0, 0.0, -0.25, 0.1, -0.1])
                if kind == "rate":
                    den = int(rng.choice([0, 10, 200, 400, 400]))
                    num = int(rng.binomial(den, 0.8 + shift))
                else:
                    den, num = 1, int(rng.poisson(30 * (1 + 3 * abs(shift)) if direction == "up" else 30 * (1 + 2 * shift)))
                rows.append((name, scope, kind, direction, cusum, grain, i * grain, num, den))
    return rows


def _plain(rows, world_start=0):
    """The rules read one window after the other, from a list of them."""
    L, out = d.LIMITS, []
    by = {}
    for name, scope, kind, direction, cusum, grain, ts, num, den in rows:
        by.setdefault((name, scope), []).append((ts, num, den, kind, direction, cusum, grain))
    for (name, scope), windows in by.items():
        windows.sort()
        seen, past, flags, total, alarm, calm = {}, [], [], 0.0, None, 0
        for ts, num, den, kind, direction, cusum, grain in windows:
            seen[ts] = (num, den)
            refs = [(k, *seen[ts - k * d.DAY]) for k in L.lags if ts - k * d.DAY in seen]
            refs = [(k, n, m, n if kind == "count" else n / m) for k, n, m in refs if kind == "count" or m > 0]
            z = None
            if len(refs) >= 2:
                if len(refs) >= 4:
                    mid = np.median([r[3] for r in refs])
                    refs.sort(key=lambda r: (abs(r[3] - mid), r[0]))
                    refs.pop()
                w = len(refs) if kind == "count" else sum(r[2] for r in refs)
                mu = sum(r[1] for r in refs) / w
                if kind == "count" and mu >= 5:
                    z = 2 * (np.sqrt(num + 0.375) - np.sqrt(mu + 0.375)) / np.sqrt(1 + 1 / w)
                elif kind == "rate" and den >= 30:
                    z = 2 * np.sqrt(den) * (np.arcsin(np.sqrt(num / den)) - np.arcsin(np.sqrt(min(1, mu)))) / np.sqrt(1 + den / w)
            if z is None:
                flags.append(False)
                continue
            phi = 2.0 if len(past) < 6 else max(1.0, (np.median(np.abs(past[-168:])) / 0.6745) ** 2)
            past.append(z)
            u = z / np.sqrt(phi)
            a, side = {"down": (-u, "down"), "up": (u, "up"), "both": (abs(u), "up" if z > 0 else "down")}[direction]
            enough = abs(num - (mu if kind == "count" else den * mu)) >= 3
            flags.append(bool(enough and a >= 2.5))
            fires = {"z_persistence"} if enough and (a >= 4 or (flags[-1] and sum(flags[-3:]) >= 2)) else set()
            if cusum:
                total = max(0.0, total + a - 0.5)
                if total >= 4 and enough:
                    fires, total = fires | {"cusum"}, 0.0
            if ts < world_start + 3 * d.DAY:
                continue
            if alarm is None:
                if fires:
                    alarm, calm = {"key": (name, scope, ts), "side": side, "end": ts + grain, "score": a, "methods": fires, "n": 1, "over": None}, 0
                    out.append(alarm)
            elif (flags[-1] or "cusum" in fires) and side == alarm["side"]:
                calm = 0
                alarm.update(end=ts + grain, score=max(alarm["score"], a), methods=alarm["methods"] | fires, n=alarm["n"] + 1)
            elif a < 1:
                calm += 1
                if calm == 2:
                    alarm["over"], alarm, total = ts + grain, None, 0.0
    return {a["key"]: (a["side"], a["end"], round(a["score"], 6), tuple(sorted(a["methods"])), min(48, a["n"]), a["over"]) for a in out}


def _told(df):
    return {(r.series, r.scope, r.window_start): (r.direction, r.window_end, round(r.score, 6), tuple(r.methods), len(r.evidence_ts), r.recovered_at) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_scan_like_a_plain_one(spark, seed):
    rows = _rows(seed)
    got = _told(d.episodes(d.flagged_series(spark.createDataFrame(rows, SERIES)), 0))
    want = _plain(rows)
    assert got == want and len(want) > 10 and any("cusum" in x[3] for x in want.values())


def test_every_prefix_and_restart(spark, tmp_path):
    rows = _rows(3)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    cuts = [0, 5 * d.DAY, 12 * d.DAY, 12 * d.DAY + 21_600, 17 * d.DAY, DAYS * d.DAY]
    for nth, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = [r for r in rows if low <= r[6] < high]
        # windows without any event may be missing, and the last ones may come again
        part = [r for r in part if r[8] or r[0] in "cv"] + [r for r in rows if low - 43_200 <= r[6] < low]
        spark.createDataFrame(part[::-1], SERIES).coalesce(1).write.mode("append").parquet(str(source))
        # every prefix is a query of its own, that goes on from the state of the last
        stream = spark.readStream.schema(SERIES).parquet(str(source))
        write = lambda df, _: df.write.mode("append").parquet(str(out))
        stream_detect(stream, 0).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        got = _told(episodes_so_far(spark.read.parquet(str(out))))
        assert got == _plain([r for r in rows if r[6] < high]), nth
    assert len(got) > 10
