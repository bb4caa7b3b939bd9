"""Detection on a stream of closed windows: what the batch scan finds on every prefix, kept as state of each series.

State of a (series, scope): the windows that can still be a reference, up to 168 earlier scores, the running sum, the last
flags and the alarm that is open; its size is bounded by the grain, however long the stream runs.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.detect import DAY, EPISODE, KEYS, LIMITS, Limits

#: An episode as known after the window ``seen``; a later row of the same alarm replaces it.
UPDATE = EPISODE + ", seen bigint"
_COLUMNS = [x.split(" ")[0] for x in UPDATE.split(", ")]


def baseline(windows: dict[int, tuple[int, int]], ts: int, count: bool, limits: Limits) -> tuple[float, int] | None:
    """expected and weight from the same slot of earlier days, without the one furthest from their median."""
    refs = [(lag, *windows[ts - lag * DAY]) for lag in limits.lags if ts - lag * DAY in windows]
    refs = [(lag, n, d) for lag, n, d in refs if count or d > 0]
    if len(refs) < limits.min_refs:
        return None
    value = lambda r: float(r[1]) if count else r[1] / r[2]
    if len(refs) >= limits.trim_from:
        middle = median(map(value, refs))
        refs.remove(max(refs, key=lambda r: (abs(value(r) - middle), r[0])))
    total = sum(r[1] for r in refs)
    weight = len(refs) if count else sum(r[2] for r in refs)
    return total / weight, weight


def unit_z(num: int, den: int, mu: float, weight: int, count: bool, limits: Limits) -> float | None:
    """The stabilized difference from the baseline, null where a window can't be decided."""
    if count:
        return 2 * (math.sqrt(num + 0.375) - math.sqrt(mu + 0.375)) / math.sqrt(1 + 1 / weight) if mu >= limits.min_expected else None
    root = lambda x: math.asin(math.sqrt(min(1.0, x)))
    return 2 * math.sqrt(den) * (root(num / den) - root(mu)) / math.sqrt(1 + den / weight) if den >= limits.min_sample else None


class _Scan(StatefulProcessor):
    def __init__(self, world_start: int, limits: Limits):
        self.world_start, self.limits = world_start, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getListState("windows", "ts bigint, num bigint, den bigint")
        self.history = handle.getListState("history", "z double")
        self.now = handle.getValueState("now", "last bigint, total double, flags bigint, quiet int, open string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        limits = self.limits
        new = pd.concat(rows, ignore_index=True).sort_values("ts", ignore_index=True)
        spec = new.iloc[0]
        grain, count, direction, sums = int(spec["grain_s"]), spec["kind"] == "count", spec["direction"], bool(spec["cusum"])
        windows = {ts: (num, den) for ts, num, den in self.windows.get()}
        history = [z for (z,) in self.history.get()]
        last, total, flags, quiet, held = self.now.get() or (self.world_start - grain, 0.0, 0, 0, None)
        alarm, out = json.loads(held) if held else None, {}
        longest = max(limits.lags) * DAY

        arrived = [(int(r.ts), int(r.num), int(r.den)) for r in new.itertuples() if r.ts > last]
        for at, num, den in arrived:
            # windows without a row had no event; those too old to be a reference don't matter
            skipped = range(max(last + grain, at - (at - last) % grain - (longest // grain) * grain), at, grain)
            for ts, num, den in [*((t, 0, 0) for t in skipped), (at, num, den)]:
                last, windows[ts] = ts, (num, den)
                flags = flags << 1 & (1 << limits.persist_n) - 1
                base = baseline(windows, ts, count, limits)
                z = base and unit_z(num, den, *base, count, limits)
                if z is None:
                    continue
                phi = limits.phi_default if len(history) < limits.min_history else max(1.0, (median(map(abs, history)) / 0.6745) ** 2)
                history = [*history, z][-limits.history :]
                a = {"down": -1, "up": 1}.get(direction, math.copysign(1, z)) * z / math.sqrt(phi)
                side = direction if direction != "both" else "up" if z > 0 else "down"
                enough = abs(num - (base[0] if count else den * base[0])) >= limits.min_excess
                flagged = enough and a >= limits.z_persist
                flags |= flagged
                strong = enough and (a >= limits.z_single or (flagged and flags.bit_count() >= limits.persist_k))
                summed = False
                if sums:
                    total = max(0.0, total + a - limits.cusum_k)
                    summed = total >= limits.cusum_h and enough
                    total = 0.0 if summed else total
                if ts < self.world_start + limits.warmup_days * DAY:
                    continue
                fired = [n for n, on in (("cusum", summed), ("z_persistence", strong)) if on]
                if alarm is None:
                    if fired:
                        quiet = 0
                        alarm = dict(zip(KEYS, key, strict=True)) | {"direction": side, "window_start": ts, "window_end": ts + grain, "detected_at": ts + grain, "observed": float(num) if count else num / den, "expected": base[0]}
                        alarm |= {"score": a, "sample": num if count else den, "methods": fired, "evidence_ts": [ts], "recovered_at": None, "score_at_detection": a, "methods_at_detection": fired, "seen": ts}
                        out[ts] = alarm
                    continue
                if (flagged or summed) and side == alarm["direction"]:
                    quiet = 0
                    evidence = [*alarm["evidence_ts"], ts][: limits.most_evidence]
                    alarm = alarm | {"window_end": ts + grain, "score": max(alarm["score"], a), "methods": sorted({*alarm["methods"], *fired}), "evidence_ts": evidence, "seen": ts}
                    out[alarm["window_start"]] = alarm
                elif a < limits.quiet_z:
                    quiet += 1
                if quiet == limits.quiet_windows:
                    out[alarm["window_start"]] = alarm | {"recovered_at": ts + grain, "seen": ts}
                    total, quiet, alarm = 0.0, 0, None

        self.windows.put([(ts, *x) for ts, x in windows.items() if ts > last - longest])
        if history:  # a list state can't be empty
            self.history.put([(z,) for z in history])
        self.now.update((last, total, flags, quiet, json.dumps(alarm) if alarm else None))
        yield pd.DataFrame(list(out.values()), columns=_COLUMNS, dtype=object).astype({"recovered_at": "Int64"})

    def close(self) -> None:
        pass


def stream_detect(windows: DataFrame, world_start: int, limits: Limits = LIMITS) -> DataFrame:
    """UPDATE rows of a stream of closed windows (the columns of monitored_series): an alarm whenever a batch opened, carried or closed it.

    Windows of a series come in order over the batches, in any order within one; a window at or before the last one is a
    repeat and isn't counted again. Needs the RocksDB state store.
    """
    return windows.groupBy(*KEYS).transformWithStateInPandas(statefulProcessor=_Scan(world_start, limits), outputStructType=UPDATE, outputMode="Update", timeMode="None")


def episodes_so_far(updates: DataFrame) -> DataFrame:
    """The episodes that the updates amount to: of each alarm the last."""
    one = F.struct(*(c for c in _COLUMNS if c not in (*KEYS, "window_start", "seen")))
    last = updates.groupBy(*KEYS, "window_start").agg(F.max_by(one, F.struct("seen", F.col("recovered_at").isNotNull())).alias("x"))
    return last.select(*KEYS, "window_start", "x.*").select(*(c for c in _COLUMNS if c != "seen"))
