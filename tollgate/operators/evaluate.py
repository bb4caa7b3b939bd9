"""Scores against labelled truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORACLE_Z = 3.0
DAY, WARM_UP = 86_400, 259_200
#: Fixed value: days of a block, and of the longest record that is met by days.
LONG = 64
#: What each metric can give evidence of.
FAMILIES = (
    ("authorization_rate", ("charge_approval_rate", "global_charge_approval_rate", "technical_failure_rate")), ("checkout_conversion_rate", ("payment_intent_conversion_rate",)), ("renewal_success_rate", ("renewal_success_rate", "dunning_recovery_rate", "renewal_first_attempt_success_rate")), ("dunning_recovery_rate", ("dunning_recovery_rate", "renewal_success_rate")),
    ("refund_rate", ("refund_rate",)), ("refund_count", ("refund_rate",)), ("duplicate_charge_rate", ("duplicate_charge_rate",)), ("attempt_volume", ("charge_attempt_volume", "checkout_volume", "ingestion_delay")), ("fraud_flag_rate", ("fraud_flag_rate",)), ("subscription_cancellation_rate", ("subscription_cancellation_rate",)), ("late_arrival_share", ("ingestion_delay",)),
)
ROUTE_RANK = {"incident": 0, "watch": 1, "suppress": 2}


def first_crossing(hourly: DataFrame, kind: str) -> DataFrame:
    """series and detectable_at: the end of the first hour at which the cumulative difference reaches z = 3, null if none.

    Rates (series, start, hour, n, k, n_cf, k_cf) are binomial against the counterfactual rate; counts (series, start,
    hour, excess, base) are Poisson against the organic baseline. ``hour`` counts hours since 1970.
    """
    rows = hourly.where((F.col("hour") + 1) * 3600 > F.col("start"))
    so_far = W.partitionBy("series").orderBy("hour").rowsBetween(W.unboundedPreceding, 0)
    total = lambda c: F.sum(c).over(so_far)
    if kind == "rate":
        p = F.when(total("n_cf") > 0, total("k_cf") / total("n_cf"))
        z = F.when((total("n") > 0) & (p > 0) & (p < 1), (p * total("n") - total("k")) / F.sqrt(total("n") * p * (1 - p)))
    else:
        z = F.when(total("excess") > 0, total("excess") / F.sqrt(F.greatest(total("base"), F.lit(1.0))))
    at = F.greatest(F.col("start"), (F.col("hour") + 1) * 3600)
    crossed = rows.withColumn("z", z).groupBy("series").agg(F.min(F.when(F.col("z") >= ORACLE_Z, at)).alias("detectable_at"))
    return hourly.select("series").distinct().join(crossed, "series", "left")


def calibration(scored: DataFrame) -> DataFrame:
    """bin, n, mean_p and observed of ten bins of probability, from rows of (p, y)."""
    binned = scored.withColumn("bin", F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("bigint"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("observed"))


def brier(scored: DataFrame) -> DataFrame:
    """The mean squared distance of p from what was observed."""
    return scored.agg(F.avg(F.pow(F.col("p") - F.col("y").cast("double"), 2)).alias("brier"))


def _end(world_end: int):
    """A record's end: its own or the world's, and no sooner than its expected recovery."""
    return F.greatest(F.coalesce("end", F.lit(world_end)), F.coalesce("expected_recovery", F.lit(0)))


def match_truth(cand: DataFrame, truth: DataFrame, world_end: int) -> DataFrame:
    """anomaly_id, record_key and relation (affected or unchanged) of candidates (scope as dimension=value, by comma) and records
    that overlap in time, the candidate detected no sooner than the record starts, on compatible cohorts and metrics.

    The overlap is an equi-join on metric and cells of time, each pair in the first cell both cover: days, and blocks of 64
    days for records that last longer than one. What a metric says of a record is settled before they meet.
    """
    day = lambda t: F.floor(t / DAY)
    last = cand.agg(F.max(day(F.col("window_end")))).first()[0] or 0  # one number: open records reach no further
    names = [m for m, _ in FAMILIES]
    # a metric without a family goes by an empty name
    c = cand.select("anomaly_id", F.when(F.col("metric").isin(names), F.col("metric")).otherwise("").alias("metric"), "detected_at", "window_start", "window_end", F.filter(F.split("scope", ","), lambda x: x != "").alias("scope"), day(F.col("window_start")).alias("c_day"), day(F.col("window_end") - 1).alias("c_last"))
    cells = lambda first, last, size: F.transform(F.sequence(F.floor(first / size), F.floor(last / size)), lambda x: F.struct(F.lit(size).alias("size"), x.alias("cell")))
    c = c.withColumn("at", F.explode(F.concat(*(cells(F.col("c_day"), F.col("c_last"), size) for size in (1, LONG))))).select("*", "at.*").drop("at", "c_last")

    def relation(family: tuple[str, ...]) -> Column:
        names = F.array(*map(F.lit, family)).cast("array<string>")
        # while events come late every metric moves at first look
        affected = F.arrays_overlap(names, "affected_metrics") | F.array_contains("affected_metrics", "ingestion_delay")
        return F.when(F.coalesce(affected, F.lit(False)), "affected").when(F.arrays_overlap(names, "unchanged_metrics"), "unchanged")

    said = F.array(*(F.struct(F.lit(m).alias("metric"), relation(family).alias("relation")) for m, family in (*FAMILIES, ("", ()))))
    r = truth.select("record_key", "start", _end(world_end).alias("until"), "affected_cohorts", F.explode(said).alias("x"), day(F.col("start")).alias("r_day")).select("*", "x.*").drop("x").where("relation is not null")
    r = r.withColumn("r_last", F.greatest("r_day", F.least(day(F.col("until")), F.lit(last))))
    r = r.withColumn("at", F.explode(F.when(F.col("r_last") - F.col("r_day") < LONG, cells(F.col("r_day"), F.col("r_last"), 1)).otherwise(cells(F.col("r_day"), F.col("r_last"), LONG)))).select("*", "at.*").drop("at", "r_last")
    # cells pack to little on disk and to much in memory: never broadcast
    met = c.join(r.hint("merge"), ["metric", "size", "cell"]).where(F.col("cell") == F.greatest(F.floor(F.col("c_day") / F.col("size")), F.floor(F.col("r_day") / F.col("size"))))
    met = met.where("window_start < until and start < window_end and detected_at >= start")
    fits = lambda cohort, pair: F.coalesce(F.array_contains(F.element_at(cohort, F.split_part(pair, F.lit("="), F.lit(1))), F.split_part(pair, F.lit("="), F.lit(2))), F.lit(True))
    inside = F.exists(F.coalesce("affected_cohorts", F.array().cast("array<map<string,array<string>>>")), lambda x: F.forall("scope", lambda p: fits(x, p)))
    return met.where((F.size("scope") == 0) | inside).select("anomaly_id", "record_key", "relation")


def record_outcomes(cand: DataFrame, truth: DataFrame, matches: DataFrame, world_start: int, world_end: int) -> DataFrame:
    """record_key, scenario_kind, outcome, latency_s and n_candidates of every record that is an incident."""
    # matches pack to little on disk and to much in memory: never broadcast
    hits = matches.where("relation = 'affected'").join(cand.select("anomaly_id", "detected_at").hint("merge"), "anomaly_id").groupBy("record_key").agg(F.min("detected_at").alias("first"), F.count("*").alias("n"))
    r = truth.where("expected_route = 'incident'").join(hits, "record_key", "left")
    outcome = F.when(F.col("oracle_detectable_at").isNull(), "oracle_null").when(F.col("first").isNotNull(), "detected").when(_end(world_end) <= world_start + WARM_UP, "warm_up").otherwise("missed")
    anchor = F.greatest("start", F.coalesce("oracle_detectable_at", "start"))
    return r.select("record_key", "scenario_kind", outcome.alias("outcome"), (F.col("first") - anchor).alias("latency_s"), F.coalesce("n", F.lit(0)).alias("n_candidates"))


def candidate_classes(cand: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """anomaly_id, class and detail (sorted keys or kinds, by comma) of every candidate."""
    m = matches.join(truth.select("record_key", "expected_route", "scenario_kind"), "record_key")
    of = lambda when, what: F.array_join(F.sort_array(F.collect_set(F.when(when, F.col(what)))), ",")
    hit = lambda route: (F.col("relation") == "affected") & (F.col("expected_route") == route)
    per = m.groupBy("anomaly_id").agg(of(hit("incident"), "record_key").alias("i"), of(hit("watch"), "record_key").alias("w"), of(hit("suppress"), "scenario_kind").alias("s"), of(F.col("relation") == "unchanged", "record_key").alias("u"))
    every = cand.select("anomaly_id", "series", "metric", "scope", "detected_at").join(per, "anomaly_id", "left").fillna("", ["i", "w", "s", "u"])
    pick = lambda i: F.when(F.col("i") != "", i[0]).when(F.col("w") != "", i[1]).when(F.col("s") != "", i[2]).when(F.col("u") != "", i[3]).otherwise(i[4])
    names = tuple(map(F.lit, ("true_positive", "watch", "fp_suppress", "fp_unchanged_metric", "fp_unmatched")))
    return every.select("anomaly_id", "series", "metric", "scope", "detected_at", pick(names).alias("class"), pick((F.col("i"), F.col("w"), F.col("s"), F.col("u"), F.lit(""))).alias("detail"))


def score_detection(records: DataFrame, classes: DataFrame, world_start: int, world_end: int) -> DataFrame:
    """One row: recall, latency (median and the value at nine tenths), false positives a day and the counts behind them."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    late = F.when(F.col("outcome") == "detected", F.col("latency_s"))
    scored = F.count_if(F.col("outcome") != "oracle_null")
    r = records.agg(scored.alias("incidents_scored"), n("oracle_null").alias("incidents_oracle_null"), n("detected").alias("detected"), n("warm_up").alias("missed_warm_up"), n("missed").alias("missed"), F.percentile(late, F.lit(0.5)).alias("latency_median_s"), F.percentile_approx(late, 0.9, 1_000_000).alias("about"))
    # the value at place floor(0.9 n), counted from 0, of the sorted latencies: one row a detected record
    ranked = records.where("outcome = 'detected'").groupBy("latency_s").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(W.orderBy("latency_s")))
    place = ranked.crossJoin(records.agg(n("detected").alias("of"))).where(F.col("upto") > F.least(F.col("of") - 1, F.floor(F.col("of") * 0.9))).agg(F.min("latency_s").alias("latency_p90_s"))
    fp = lambda c: F.count_if(F.col("class") == c)
    days = max(1e-9, (world_end - world_start - WARM_UP) / DAY)
    k = classes.agg(F.count("*").alias("candidates"), F.count_if(F.startswith("class", F.lit("fp_"))).alias("false_positives"), fp("fp_unmatched").alias("fp_unmatched"), fp("fp_suppress").alias("fp_suppress"), fp("fp_unchanged_metric").alias("fp_unchanged_metric"), fp("watch").alias("watch_hits"))
    one = r.drop("about").crossJoin(place).crossJoin(k)  # single rows
    return one.withColumn("recall", F.when(F.col("incidents_scored") > 0, F.col("detected") / F.col("incidents_scored"))).withColumn("false_positives_per_day", F.col("false_positives") / days)


def localization_class(rows: DataFrame) -> DataFrame:
    """Adds class of a locus (dimension=value, by comma; empty is the whole, null none) against root, a map of dimension to values.

    wrong: none, or a shared dimension disagrees, or neither holds the other's dimensions; else exact, over_specific (more
    dimensions than the root) or coarse (fewer).
    """
    pairs = F.filter(F.split("locus", ","), lambda x: x != "")
    cut = lambda p, i: F.split_part(p, F.lit("="), F.lit(i))
    d = rows.withColumn("pairs", pairs).withColumn("ours", F.transform("pairs", lambda p: cut(p, 1))).withColumn("theirs", F.map_keys("root"))
    apart = F.exists("pairs", lambda p: F.coalesce(~F.array_contains(F.element_at("root", cut(p, 1)), cut(p, 2)), F.lit(False)))
    more, fewer = F.size(F.array_except("ours", "theirs")) > 0, F.size(F.array_except("theirs", "ours")) > 0
    kind = F.when(F.col("locus").isNull() | apart | (more & fewer), "wrong").when(more, "over_specific").when(fewer, "coarse").otherwise("exact")
    return d.withColumn("class", kind).drop("pairs", "ours", "theirs")


def match_status(matches: DataFrame) -> DataFrame:
    """The best record of each candidate: incident before watch before suppress, then the earlier start, then the key."""
    rank = F.coalesce(*(F.when(F.col("expected_route") == r, i) for r, i in ROUTE_RANK.items()), F.lit(len(ROUTE_RANK)))
    order = W.partitionBy("candidate_id").orderBy(rank, "start", "record_key")
    return matches.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("candidate_id", "record_key", F.col("expected_route").alias("status"))
