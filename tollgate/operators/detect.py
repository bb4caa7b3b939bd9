"""Anomaly detection over dense metric series.

Scores are columns: lagged baselines are an equi-join on shifted windows, overdispersion and persistence are window
functions. Only what resets as it goes (cumulative sums and episodes) is a function over one series, which holds at most
20,000 windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import materialized
from . import metrics as m

DAY = 86_400
#: Fixed value: days of a cell in which concurrent candidates meet.
CELL = 4
KEYS = ("series", "scope")


@dataclass(frozen=True)
class Series:
    key: str
    metric: str
    version: int
    grain: str
    group_by: tuple[str, ...]
    direction: str
    kind: str = "rate"
    cusum: bool = False


#: The monitored series.
SERIES = (
    Series("S1", "authorization_rate", 1, "15m", (), "down"),
    Series("S2", "authorization_rate", 1, "1h", ("psp",), "down"),
    Series("S3", "authorization_rate", 1, "1d", ("customer_country",), "down", cusum=True),
    Series("S3h", "authorization_rate", 1, "1h", ("customer_country",), "down"),
    Series("S4a", "checkout_conversion_rate", 2, "1h", (), "down"),
    Series("S4b", "checkout_conversion_rate", 2, "1h", ("platform",), "down"),
    Series("S5", "renewal_success_rate", 1, "1d", ("psp",), "down", cusum=True),
    Series("S5b", "dunning_recovery_rate", 1, "1d", ("psp",), "down", cusum=True),
    Series("S6", "refund_count", 1, "1d", ("customer_country",), "up", "count", True),
    Series("S7", "duplicate_charge_rate", 1, "1h", (), "up"),
    Series("S8", "attempt_volume", 1, "1h", ("psp",), "both", "count"),
    Series("S9", "fraud_flag_rate", 1, "1h", (), "up"),
    Series("S10", "subscription_cancellation_rate", 2, "1d", ("customer_country",), "up", cusum=True),
    Series("S11", "late_arrival_share", 1, "1h", (), "up"),
)


@dataclass(frozen=True)
class Limits:
    """Fixed values of the detectors."""

    lags: tuple[int, ...] = (2, 3, 4, 5, 6, 7, 8)
    min_refs: int = 2
    trim_from: int = 4
    warmup_days: int = 3
    history: int = 168
    min_history: int = 6
    phi_default: float = 2.0
    min_sample: int = 30
    min_expected: float = 5.0
    min_excess: int = 3
    z_single: float = 4.0
    z_persist: float = 2.5
    persist_k: int = 2
    persist_n: int = 3
    cusum_k: float = 0.5
    cusum_h: float = 4.0
    quiet_windows: int = 2
    quiet_z: float = 1.0
    static_drop: float = 0.15
    static_rise: float = 2.0
    static_factor: float = 2.0
    most_evidence: int = 48


LIMITS = Limits()


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id that is a hash of its content, so that a replay gives the same."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16))


def monitored_series(norm: DataFrame, start: int, end: int, series: Sequence[Series] = SERIES) -> DataFrame:
    """series, metric, version, grain_s, direction, kind, cusum, scope (dimension=value, or empty), ts, num, den: complete windows at first look.

    The events are derived once and written; every series reads the few columns it needs.
    """
    norm, found = materialized(norm, "norm"), []
    for s in series:
        r = m.request(s.metric, s.version, start, end, s.grain, s.group_by, visibility="window_close")
        scope = F.concat_ws(",", *(F.concat(F.lit(f"{d}="), F.col(d)) for d in s.group_by)) if s.group_by else F.lit("")
        spec = [F.lit(s.key).alias("series"), F.lit(s.metric).alias("metric"), F.lit(s.version).alias("version"), F.lit(r.seconds).alias("grain_s"), F.lit(s.direction).alias("direction"), F.lit(s.kind).alias("kind"), F.lit(s.cusum).alias("cusum")]
        found.append(m.compute(norm, r).where("is_complete").select(*spec, scope.alias("scope"), F.col("window_start").alias("ts"), F.col("numerator").alias("num"), F.col("denominator").alias("den")))
    return reduce(DataFrame.unionByName, found)


def _value(num: str, den: str) -> Column:
    return F.when(F.col("kind") == "count", F.col(num).cast("double")).when(F.col(den) > 0, F.col(num) / F.col(den))


def lagged_baseline(series: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """One row a window and reference window: the same slot on earlier days; rates without a denominator don't count."""
    lags = F.explode(F.array(*map(F.lit, limits.lags))).alias("lag")
    refs = series.select(*KEYS, "kind", F.col("ts").alias("ref_ts"), F.col("num").alias("ref_num"), F.col("den").alias("ref_den"), lags)
    refs = refs.where("kind = 'count' or ref_den > 0").withColumn("ts", F.col("ref_ts") + F.col("lag") * DAY).withColumn("ref_value", _value("ref_num", "ref_den"))
    return series.select(*KEYS, "ts").join(refs, [*KEYS, "ts"])


def trimmed_baseline(refs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """n_refs, expected and weight a window: of four or more references the one furthest from their median goes (ties: the later lag)."""
    own = W.partitionBy(*KEYS, "ts")
    middle = F.percentile("ref_value", F.lit(0.5)).over(own)
    away = refs.withColumn("away", F.abs(F.col("ref_value") - middle)).withColumn("n", F.count("*").over(own))
    ranked = away.withColumn("nth", F.row_number().over(own.orderBy(F.desc("away"), F.desc("lag"))))
    kept = ranked.where((F.col("n") >= limits.min_refs) & ~((F.col("n") >= limits.trim_from) & (F.col("nth") == 1)))
    pooled = kept.groupBy(*KEYS, "ts").agg(F.first("kind").alias("kind"), F.count("*").alias("n_refs"), F.sum("ref_num").alias("n"), F.sum("ref_den").alias("d"))
    count = F.col("kind") == "count"
    return pooled.select(*KEYS, "ts", "n_refs", F.when(count, F.col("n") / F.col("n_refs")).otherwise(F.col("n") / F.col("d")).alias("expected"), F.when(count, F.col("n_refs")).otherwise(F.col("d")).alias("weight"))


def stabilized_z(series: DataFrame, base: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The series with expected, weight, z (null where a window can't be decided) and excess."""
    num, den, mu, w = F.col("num"), F.col("den"), F.col("expected"), F.col("weight")
    root = lambda x: F.asin(F.sqrt(F.least(F.lit(1.0), x)))
    rate = 2 * F.sqrt(den) * (root(num / F.when(den > 0, den)) - root(mu)) / F.sqrt(1 + den / w)
    count = 2 * (F.sqrt(num + 0.375) - F.sqrt(mu + 0.375)) / F.sqrt(1 + 1 / w)
    counted = F.col("kind") == "count"
    z = F.when(counted & (mu >= limits.min_expected), count).when(~counted & (den >= limits.min_sample), rate)
    return series.join(base, [*KEYS, "ts"], "left").withColumn("z", z).withColumn("excess", F.when(counted, num - mu).otherwise(num - den * mu))


def robust_phi(scored: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Adds phi: the spread of up to 168 earlier decidable z of the series, 1 at least."""
    decided = scored.where("z is not null")
    past = W.partitionBy(*KEYS).orderBy("ts").rowsBetween(-limits.history, -1)
    spread = F.pow(F.percentile(F.abs("z"), F.lit(0.5)).over(past) / 0.6745, 2)
    phi = F.when(F.count("*").over(past) < limits.min_history, limits.phi_default).otherwise(F.greatest(F.lit(1.0), spread))
    return decided.withColumn("phi", phi)


def oriented(scored: DataFrame) -> DataFrame:
    """Adds a (the score towards the alarm direction) and side (the direction it speaks of)."""
    u = F.col("z") / F.sqrt("phi")
    a = F.when(F.col("direction") == "down", -u).when(F.col("direction") == "up", u).otherwise(F.abs(u))
    side = F.when(F.col("direction") != "both", F.col("direction")).when(F.col("z") > 0, "up").otherwise("down")
    return scored.withColumn("a", a).withColumn("side", side)


def point_flags(series: DataFrame, scored: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """All windows with flagged and fire_p; undecidable ones count as not flagged."""
    every = series.select(*KEYS, "ts").join(scored, [*KEYS, "ts"], "left")
    enough = F.coalesce(F.abs("excess") >= limits.min_excess, F.lit(False))
    flagged = enough & F.coalesce(F.col("a") >= limits.z_persist, F.lit(False))
    every = every.withColumn("enough", enough).withColumn("flagged", flagged)
    recent = F.sum(F.col("flagged").cast("int")).over(W.partitionBy(*KEYS).orderBy("ts").rowsBetween(1 - limits.persist_n, 0))
    fire = F.col("enough") & (F.coalesce(F.col("a") >= limits.z_single, F.lit(False)) | (F.col("flagged") & (recent >= limits.persist_k)))
    return every.withColumn("recent", recent).withColumn("fire_p", fire)


def flagged_series(series: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """From a series to its scores and flags, by the operators above."""
    base = trimmed_baseline(lagged_baseline(series, limits), limits)
    return point_flags(series, oriented(robust_phi(stabilized_z(series, base, limits), limits)), limits)


EPISODE = "series string, scope string, direction string, window_start bigint, window_end bigint, detected_at bigint, observed double, expected double, score double, sample bigint, methods array<string>, evidence_ts array<bigint>, recovered_at bigint, score_at_detection double, methods_at_detection array<string>"


@dataclass
class Span:
    """One alarm of a series as places in its rows: those that carried it, where it ended (or -1), and the sums that fired."""

    places: list[int]
    end: int
    summed: set[int]


def _spans(x: dict[str, np.ndarray], quiet_windows: int, step: float, level: float) -> list[Span]:
    """Carries what no window function can: the sum that starts anew, and whether an alarm is open.

    x holds an array a condition: gain (what a window adds to the sum, NaN where none is kept), enough, strong (opens by
    itself), holds (keeps open), calm, counts (past the warm-up) and side.
    """
    done: list[Span] = []
    total, quiet, now = 0.0, 0, None
    for i in range(len(x["side"])):
        summed = False
        if not np.isnan(x["gain"][i]):
            total = max(0.0, total + x["gain"][i] - step)
            summed = bool(total >= level and x["enough"][i])
            total *= not summed
        if not x["counts"][i]:
            continue
        if now is None:
            if summed or x["strong"][i]:
                now, quiet = Span([i], -1, {i} if summed else set()), 0
            continue
        if (summed or x["holds"][i]) and x["side"][i] == x["side"][now.places[0]]:
            quiet = 0
            now.places.append(i)
            now.summed |= {i} if summed else set()
        elif x["calm"][i]:
            quiet += 1
        if quiet == quiet_windows:
            now.end = i
            done.append(now)
            total, quiet, now = 0.0, 0, None
    return done if now is None else [*done, now]


def _table(rows: pd.DataFrame, spans: list[Span], methods, limits: Limits, peak: bool) -> pd.DataFrame:
    """The episodes of spans: rows has value, expected, score and sample; methods(span, place) names what fired there."""
    at = lambda column, places: rows[column].to_numpy()[places]
    ends = (rows["ts"] + rows["grain_s"]).to_numpy()
    out = []
    for s in spans:
        first = s.places[0]
        out.append({
            "series": rows["series"].iloc[0], "scope": rows["scope"].iloc[0], "direction": at("side", first), "window_start": at("ts", first), "window_end": ends[s.places[-1]], "detected_at": ends[first],
            "observed": at("value", first), "expected": at("expected", first), "score": at("score", s.places).max() if peak else at("score", first), "sample": at("sample", first),
            "methods": sorted({n for i in s.places for n in methods(s, i)}), "evidence_ts": at("ts", s.places)[: limits.most_evidence].tolist(), "recovered_at": None if s.end < 0 else ends[s.end],
            "score_at_detection": at("score", first), "methods_at_detection": sorted(methods(s, first)),
        })
    frame = pd.DataFrame(out, columns=[f.split(" ")[0] for f in EPISODE.split(", ")])
    return frame.astype({"recovered_at": "Int64"})


def _episodes(limits: Limits, world_start: int):
    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["z"].notna()].sort_values("ts", ignore_index=True)
        count = rows["kind"] == "count"
        rows = rows.assign(value=np.where(count, rows["num"], rows["num"] / rows["den"].where(~count, 1)), score=rows["a"], sample=np.where(count, rows["num"], rows["den"]))
        strong = rows["fire_p"].to_numpy(bool)
        x = {
            "gain": np.where(rows["cusum"].to_numpy(bool), rows["a"], np.nan).astype(float), "enough": rows["enough"].to_numpy(bool), "strong": strong, "holds": rows["flagged"].to_numpy(bool),
            "calm": (rows["a"] < limits.quiet_z).to_numpy(), "counts": (rows["ts"] >= world_start + limits.warmup_days * DAY).to_numpy(), "side": rows["side"].to_numpy(),
        }
        fired = lambda s, i: [n for n, on in (("cusum", i in s.summed), ("z_persistence", strong[i])) if on]
        return _table(rows, _spans(x, limits.quiet_windows, limits.cusum_k, limits.cusum_h), fired, limits, peak=True)

    return scan


def episodes(flags: DataFrame, world_start: int, limits: Limits = LIMITS) -> DataFrame:
    """Alarms of every series: opened by a fire after the warm-up, kept open by flags, closed by two quiet windows."""
    return flags.groupBy(*KEYS).applyInPandas(_episodes(limits, world_start), EPISODE)


def static_detector(series: DataFrame, world_start: int, limits: Limits = LIMITS) -> DataFrame:
    """The comparison system: a fixed band around the median of the warm-up windows."""
    warm_until = world_start + limits.warmup_days * DAY
    enough = (F.col("kind") == "count") | (F.col("den") >= limits.min_sample)
    ref = series.where(F.col("ts") < warm_until).where(enough).groupBy(*KEYS).agg(F.percentile(_value("num", "den"), F.lit(0.5)).alias("ref"))
    v, counted, r = _value("num", "den"), F.col("kind") == "count", F.col("ref")
    up = F.when(counted, v > r * limits.static_factor).otherwise(v > r * limits.static_rise)
    down = F.when(counted, v < r / limits.static_factor).otherwise(v < r * (1 - limits.static_drop))
    off = F.abs(F.col("num") - r * F.when(counted, 1).otherwise(F.col("den")))
    hit = ((up & F.col("direction").isin("up", "both")) | (down & F.col("direction").isin("down", "both"))) & (off >= limits.min_excess)
    after = series.where(F.col("ts") >= warm_until).where(enough).join(ref.where("ref is not null"), [*KEYS])
    score = F.when(r != 0, F.abs(v - r) / r).otherwise(off)
    marked = after.select(*KEYS, "ts", "grain_s", v.alias("value"), F.col("ref").alias("expected"), F.when(up, "up").otherwise("down").alias("side"), hit.alias("hit"), score.alias("score"), F.when(counted, F.col("num")).otherwise(F.col("den")).alias("sample"))

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", ignore_index=True)
        hits, every = rows["hit"].to_numpy(bool), np.ones(len(rows), bool)
        x = {"gain": np.full(len(rows), np.nan), "enough": every, "strong": hits, "holds": hits, "calm": every, "counts": every, "side": rows["side"].to_numpy()}
        return _table(rows, _spans(x, limits.quiet_windows, 0.0, 0.0), lambda s, i: ["static"], limits, peak=False)

    return marked.groupBy(*KEYS).applyInPandas(scan, EPISODE)


def candidate_rows(found: DataFrame, series: Sequence[Series] = SERIES, system: str = "main") -> DataFrame:
    """Episodes as candidates with deltas, status and ids."""
    spec = found.sparkSession.createDataFrame([(s.key, s.metric, s.version, s.grain, m.GRAINS[s.grain]) for s in series], "series string, metric string, version int, grain string, grain_s int")
    delta = F.col("observed") - F.col("expected")
    c = found.join(F.broadcast(spec), "series").withColumn("system", F.lit(system))
    evidence = F.transform("evidence_ts", lambda t: F.concat(F.lit("evd_"), F.substring(F.sha2(F.concat_ws("|", "metric", F.col("version").cast("string"), "scope", "grain", t.cast("string")), 256), 1, 16)))
    return c.select(
        stable_id("anom_", F.col("system"), F.col("series"), F.col("metric"), F.col("version"), F.col("scope"), F.col("window_start")).alias("anomaly_id"),
        "system", "series", "metric", "version", "grain", "scope", "direction", "window_start", "window_end", "detected_at", "observed", "expected", delta.alias("delta"), F.when(F.col("expected") != 0, delta / F.col("expected")).alias("relative_delta"), "score",
        F.col("sample").alias("sample_size"), "methods", evidence.alias("evidence_ids"), F.when(F.col("recovered_at").isNull(), "promoted").otherwise("recovered").alias("status"), "recovered_at", "score_at_detection", "methods_at_detection",
    )


def prefilter_low_volume(cand: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Candidates on too small a sample are suppressed; the volume metric is exempt."""
    low = (F.col("sample_size") < limits.min_sample) & (F.col("metric") != "attempt_volume")
    return cand.withColumn("status", F.when(low, "suppressed").otherwise(F.col("status"))).withColumn("reason", F.when(low, "insufficient_data"))


def link_parent(cand: DataFrame, series: Sequence[Series] = SERIES) -> DataFrame:
    """Adds parent_id: of the global candidates of the same metric and system whose interval overlaps a scoped one's, suppressed
    or not, the first in the order of series and window."""
    nth = F.array_position(F.array(*(F.lit(s.key) for s in series)), F.col("series"))
    days = lambda: F.explode(F.sequence(F.floor(F.col("window_start") / DAY), F.floor((F.col("window_end") - 1) / DAY)))
    whole = cand.where("scope = ''").select("system", "metric", F.col("anomaly_id").alias("parent"), nth.alias("nth"), F.col("window_start").alias("p_start"), F.col("window_end").alias("p_end"), days().alias("day"))
    own = cand.where("scope != ''").select("system", "metric", "anomaly_id", "window_start", "window_end", days().alias("day"))
    met = own.join(whole, ["system", "metric", "day"]).where("p_start < window_end and window_start < p_end")
    first = met.groupBy("anomaly_id").agg(F.min_by("parent", F.struct("nth", "p_start", "parent")).alias("parent_id"))
    return cand.join(first, "anomaly_id", "left")


def as_of_view(cand: DataFrame) -> DataFrame:
    """Candidates as known when they were detected: a recovery isn't known yet, a suppression is."""
    status = F.when(F.col("status") == "recovered", "promoted").otherwise(F.col("status"))
    seen = {"score": F.col("score_at_detection"), "methods": F.col("methods_at_detection"), "evidence_ids": F.slice("evidence_ids", 1, 1), "window_end": F.col("detected_at"), "recovered_at": F.lit(None).cast("bigint"), "status": status}
    return cand.withColumns(seen).drop("parent_id")


def decidable(cand: DataFrame) -> DataFrame:
    """Candidates of the main system that are promoted or recovered."""
    return cand.where("system = 'main' and status in ('promoted', 'recovered')")


def concurrent_at(cand: DataFrame) -> DataFrame:
    """anomaly_id and the other candidates known at its detection that were open at some time since its window began.

    All pairs are asked for, but none is shuffled: what is open in a cell of days, sorted by id, is one list that every
    candidate that begins there meets in one join and filters, so disk grows with candidates and open cells alone. What was
    known before a cell and outlasts it needs no filter. Cells are ``CELL`` days wide, doubled for candidates that were
    detected later than that. Ids are unique.
    """
    day = lambda c: F.floor(c / DAY)
    since, at = F.col("window_start"), F.col("detected_at")
    live = decidable(cand).select("anomaly_id", "window_start", "detected_at", F.coalesce("recovered_at", F.lit(2**40)).alias("until"))
    waited = F.abs(day(at) - day(since))
    live = live.withColumn("size", CELL * F.pow(2, F.ceil(F.log2(F.greatest(waited, F.lit(CELL)) / CELL))).cast("bigint"))
    live = materialized(live, "live")
    # a few numbers: open ends reach no further than the last detection, and the sizes of cells in use
    last, sizes = live.agg(F.max(day(at)), F.collect_set("size")).first()
    if not sizes:
        return live.select("anomaly_id", F.array("anomaly_id").alias("others")).limit(0)
    cell = lambda d, n: F.floor(d / n)
    n = F.col("size")
    known = live.drop("size").withColumn("size", F.explode(F.array(*(F.lit(x) for x in sorted(sizes)))))
    known = known.withColumn("cell", F.explode(F.sequence(cell(day(at), n) - 1, F.greatest(cell(day(at), n), cell(F.least(day(F.col("until")), F.lit(last)), n)))))
    begin, over = F.col("cell") * n * DAY, (F.col("cell") + 2) * n * DAY
    sure = (F.greatest(at, since) < begin) & (F.col("until") > over) & since.isNotNull()
    in_order = lambda when, x: F.sort_array(F.collect_list(F.when(when, x)))
    lists = known.groupBy("size", "cell").agg(in_order(sure, F.col("anomaly_id")).alias("sure"), in_order(~sure, F.struct("anomaly_id", "window_start", "detected_at", "until")).alias("known"))
    partitions = int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the work is in the lists, which the size of a partition doesn't show
    asked = live.withColumn("cell", cell(day(F.least(since, at)), n)).repartition(partitions, "size", "cell")
    fits = lambda x: (x["detected_at"] <= at) & (x["until"] > since) & (x["window_start"] < at) & (x["anomaly_id"] != F.col("anomaly_id"))
    met = asked.join(lists.hint("merge"), ["size", "cell"]).select("anomaly_id", F.sort_array(F.concat("sure", F.filter("known", fits)["anomaly_id"])).alias("others"))
    return met.where(F.size("others") > 0)


def counted_up_to(points: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (id, t) with n, the number of points (t) at or before t: a sweep inside days, with what earlier days hold carried over."""
    day = F.floor(F.col("t") / DAY).alias("day")
    every = points.select("t", F.lit(0).alias("ask"), F.lit(None).cast("string").alias("id")).unionByName(asked.select("t", F.lit(1).alias("ask"), "id")).select("*", day)
    days = every.groupBy("day").agg(F.count_if(F.col("ask") == 0).alias("own"))
    before = days.select("day", F.coalesce(F.sum("own").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a day
    swept = every.withColumn("n", F.count_if(F.col("ask") == 0).over(W.partitionBy("day").orderBy("t", "ask").rowsBetween(W.unboundedPreceding, W.currentRow)))
    return swept.where("ask = 1").join(before, "day").select("id", (F.col("n") + F.col("before")).alias("n"))


def concurrent_counts(cand: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """id and concurrent: how many other candidates were known at a time and open since the window began, without listing them.

    asked: id, anomaly_id, since (the window's begin) and at; each candidate at its own detection if not given. Whatever was
    over by ``since`` was known by ``at``, so it is the difference of two counts.
    """
    live = decidable(cand)
    asked = live.select(F.col("anomaly_id").alias("id"), "anomaly_id", F.col("window_start").alias("since"), F.col("detected_at").alias("at")) if asked is None else asked
    known = counted_up_to(live.select(F.col("detected_at").alias("t")), asked.select("id", F.col("at").alias("t")))
    over = counted_up_to(live.where("recovered_at is not null").select(F.col("recovered_at").alias("t")), asked.select("id", F.least("since", "at").alias("t")))
    return known.join(over.withColumnRenamed("n", "over"), "id").select("id", (F.col("n") - F.col("over") - 1).alias("concurrent"))


def detect(norm: DataFrame, start: int, end: int, system: str = "main", series: Sequence[Series] = SERIES, limits: Limits = LIMITS) -> DataFrame:
    """The whole detector, ``main`` or ``static``."""
    long = materialized(monitored_series(norm, start, end, series), "series")
    found = episodes(flagged_series(long, limits), start, limits) if system == "main" else static_detector(long, start, limits)
    return link_parent(prefilter_low_volume(candidate_rows(found, series, system), limits), series)
