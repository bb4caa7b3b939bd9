"""Localizing a change: before and during counts of cohorts, tests under false-discovery control, and decomposition.

All candidates are one job. The events are aggregated once to base cells (window by all dimensions); a candidate becomes
the windows it covers now and on its reference days, which meet the cells by an equi-join; one GROUPING SETS pass gives
every dimension combination.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import materialized
from . import metrics as m
from .detect import stable_id

DAY = 86_400
#: Fixed values.
COMBINATIONS = (("psp",), ("customer_country",), ("payment_method_type",), ("card_brand",), ("platform",), ("app_version",), ("psp", "customer_country"), ("psp", "card_brand"), ("customer_country", "payment_method_type"), ("psp", "customer_country", "platform"))
LAGS = (2, 3, 4, 5, 6, 7, 8)
SUPPORT, COUNT_EVENTS, BH_Q, COVERAGE, LIFT, HIGH, LOW, TOP, CONTROL_Z, MAX_CONTROLS, VOLUME_Z = 30, 5, 0.05, 0.6, 1.25, 0.7, 0.3, 5, 1.0, 3, 2.0
COHORT = ("candidate_id", "combination", "cohort")
COUNT_METRICS = ("attempt_volume", "refund_count")
#: Siblings to measure on a locus, at most two a metric.
RELATED = (
    ("authorization_rate", "checkout_conversion_rate", 2), ("authorization_rate", "attempt_volume", 1), ("checkout_conversion_rate", "authorization_rate", 1), ("checkout_conversion_rate", "attempt_volume", 1), ("attempt_volume", "authorization_rate", 1), ("attempt_volume", "checkout_conversion_rate", 2),
    ("refund_count", "authorization_rate", 1), ("refund_count", "attempt_volume", 1), ("renewal_success_rate", "dunning_recovery_rate", 1), ("renewal_success_rate", "authorization_rate", 1), ("dunning_recovery_rate", "renewal_success_rate", 1), ("dunning_recovery_rate", "authorization_rate", 1),
)


def dimensions(combinations=COMBINATIONS) -> tuple[str, ...]:
    return tuple(dict.fromkeys(d for c in combinations for d in c))


def cohort_tables(norm: DataFrame, candidates: DataFrame, metric: str, version: int, grain: str, world_start: int, world_end: int, combinations=COMBINATIONS) -> DataFrame:
    """candidate_id, kind, direction, combination, cohort, lag (0 is now), n, d from candidates of one metric and grain
    (candidate_id, direction, window_start, window_end and, if they have one, scope: dimension=value, by comma).

    A candidate with a scope is looked at inside it: cells of other values stay out, a cohort names its own dimensions
    only, and combinations that lie in the scope are left out.
    """
    allowed = m.METRICS[metric, version].dims
    sets = [c for c in combinations if all(d in allowed for d in c)]
    dims = tuple(d for d in dimensions(COMBINATIONS) if d in allowed)
    r = m.request(metric, version, world_start, world_end, grain, dims, visibility="window_close", dense=False)
    cells = m.counts(norm, r)
    lags = F.explode(F.array(F.lit(0), *map(F.lit, LAGS))).alias("lag")
    scope = F.str_to_map(F.nullif("scope", F.lit("")), F.lit(","), F.lit("=")) if "scope" in candidates.columns else F.lit(None).cast("map<string,string>")
    asked = candidates.select("candidate_id", "direction", "window_start", "window_end", F.coalesce(scope, F.create_map().cast("map<string,string>")).alias("within"), lags).where(F.col("window_start") - F.col("lag") * DAY >= world_start)
    asked = asked.select("candidate_id", "direction", *(F.element_at("within", d).alias(f"s_{d}") for d in dims), F.col("lag"), F.col("window_start"), F.col("window_end"))
    back = F.col("lag") * DAY
    asked = asked.withColumn("window_start", F.explode(F.sequence(F.col("window_start") - back, F.col("window_end") - back - 1, F.lit(r.seconds).cast("long")))).drop("window_end")
    met = asked.join(cells, "window_start").where(reduce(and_, (F.col(f"s_{d}").isNull() | (F.col(f"s_{d}") == F.col(d)) for d in dims)))
    own = ["candidate_id", "direction", "lag", *(f"s_{d}" for d in dims)]
    per = met.groupingSets([[*own, *c] for c in sets], *own, *dims).agg(F.sum("numerator").alias("n"), F.sum("denominator").alias("d"), *(F.grouping(d).alias(f"g_{d}") for d in dims))
    named = lambda value, free: F.concat_ws(",", *(F.when((F.col(f"g_{d}") == 0) & (F.col(f"s_{d}").isNull() | F.lit(not free)), value(d)) for d in dims))
    kind = "count" if metric in COUNT_METRICS else "rate"
    found = per.select("candidate_id", F.lit(kind).alias("kind"), "direction", named(F.lit, False).alias("combination"), named(lambda d: F.concat(F.lit(f"{d}="), F.col(d)), True).alias("cohort"), "lag", "n", "d")
    return found if () in sets else found.where("cohort != ''")


def pool_before_during(tables: DataFrame, candidates: DataFrame, world_start: int) -> DataFrame:
    """k_b, n_b, k_d, n_d and ref_days of every cohort: with four or more reference days the most extreme goes (ties: the later lag)."""
    lags = F.explode(F.array(*map(F.lit, LAGS))).alias("lag")
    valid = candidates.select("candidate_id", "window_start", lags).where(F.col("window_start") - F.col("lag") * DAY >= world_start).select("candidate_id", "lag")
    now = tables.groupBy(*COHORT).agg(F.first("kind").alias("kind"), F.first("direction").alias("direction"), F.coalesce(F.sum(F.when(F.col("lag") == 0, F.col("n"))), F.lit(0)).alias("k_now"), F.coalesce(F.sum(F.when(F.col("lag") == 0, F.col("d"))), F.lit(0)).alias("n_now"))
    days = now.select(*COHORT, "kind").join(valid, "candidate_id").join(tables.select(*COHORT, "lag", "n", "d"), [*COHORT, "lag"], "left").fillna(0, ["n", "d"])
    value = F.when(F.col("kind") == "count", F.col("n").cast("double")).when(F.col("d") > 0, F.col("n") / F.col("d")).otherwise(0.0)
    own = W.partitionBy(*COHORT)
    days = days.withColumn("v", value).withColumn("m", F.count("*").over(own)).withColumn("away", F.abs(F.col("v") - F.percentile("v", F.lit(0.5)).over(own)))
    kept = days.withColumn("nth", F.row_number().over(own.orderBy(F.desc("away"), F.desc("lag")))).where((F.col("m") < 4) | (F.col("nth") > 1))
    before = kept.groupBy(*COHORT).agg(F.count("*").alias("n_days"), F.sum("n").alias("kb"), F.sum("d").alias("nb"), F.sort_array(F.collect_list(F.struct("lag", F.col("n").cast("double").alias("k"), F.col("d").cast("double").alias("n")))).alias("ref_days"))
    count = F.col("kind") == "count"
    joined = now.join(before, [*COHORT], "left").fillna(0, ["n_days", "kb", "nb"])
    return joined.select(
        *COHORT, "kind", "direction", "n_days", F.when(count, F.when(F.col("n_days") > 0, F.col("kb") / F.col("n_days")).otherwise(0.0)).otherwise(F.col("kb").cast("double")).alias("k_b"), F.when(count, 1.0).otherwise(F.col("nb").cast("double")).alias("n_b"),
        F.col("k_now").cast("double").alias("k_d"), F.when(count, 1.0).otherwise(F.col("n_now").cast("double")).alias("n_d"), F.coalesce("ref_days", F.array().cast("array<struct<lag:int,k:double,n:double>>")).alias("ref_days"),
    )


def z_rate(k_b: Column, n_b: Column, k_d: Column, n_d: Column, phi: Column) -> Column:
    """Two-sample z on the arcsine scale; null without a denominator on both sides."""
    root = lambda k, n: F.asin(F.sqrt(F.least(F.lit(1.0), k / n)))
    return F.when((n_b > 0) & (n_d > 0), 2 * (root(k_d, F.when(n_d > 0, n_d)) - root(k_b, F.when(n_b > 0, n_b))) / F.sqrt(phi * (1 / F.when(n_b > 0, n_b) + 1 / F.when(n_d > 0, n_d))))


def z_count(mean_b: Column, days: Column, x_d: Column, phi: Column) -> Column:
    """Anscombe z of a count against the mean of some days."""
    return F.when(days > 0, 2 * (F.sqrt(x_d + 0.375) - F.sqrt(mean_b + 0.375)) / F.sqrt(phi * (1 + 1 / F.when(days > 0, days))))


def phi_reference_days(rows: DataFrame) -> DataFrame:
    """phi of every candidate and combination: each reference day against the others, per supported cohort."""
    enough = rows.where(F.size("ref_days") >= 3)
    total = lambda f: F.aggregate("ref_days", F.lit(0.0), lambda a, x: a + x[f])
    days = enough.select("candidate_id", "combination", "kind", total("k").alias("ks"), total("n").alias("ns"), F.size("ref_days").alias("m"), F.explode("ref_days").alias("x"))
    one = F.lit(1.0)
    k, n = F.col("x.k"), F.col("x.n")
    rate = F.when(n >= SUPPORT, z_rate(F.col("ks") - k, F.col("ns") - n, k, n, one))
    count = z_count((F.col("ks") - k) / (F.col("m") - 1), F.col("m") - 1, k, one)
    z = F.abs(F.when(F.col("kind") == "count", count).otherwise(rate))
    spread = F.pow(F.percentile(z, F.lit(0.5)) / 0.6745, 2)
    return days.groupBy("candidate_id", "combination").agg(F.when(F.count(z) < 6, 1.0).otherwise(F.greatest(F.lit(1.0), spread)).alias("phi"))


def p_value(z: Column) -> Column:
    """Upper tail of the normal distribution by a rational polynomial (largest error 7.5e-8); Spark has no erfc."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = 0.3989422804014327 * F.exp(-z * z / 2) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def benjamini_hochberg(tested: DataFrame, q: float = BH_Q) -> DataFrame:
    """Adds discovery and q per candidate: step-up at q; equal p keep the order of combination and cohort."""
    own = W.partitionBy("candidate_id")
    order = own.orderBy("p", "combination", "cohort")
    ranked = tested.withColumn("rank", F.row_number().over(order)).withColumn("of", F.count("*").over(own))
    cut = F.max(F.when(F.col("p") <= q * F.col("rank") / F.col("of"), F.col("rank"))).over(own)
    back = F.min(F.least(F.lit(1.0), F.col("p") * F.col("of") / F.col("rank"))).over(order.rowsBetween(0, W.unboundedFollowing))
    return ranked.withColumn("discovery", F.coalesce(F.col("rank") <= cut, F.lit(False))).withColumn("q", back)


def decompose(rows: DataFrame) -> DataFrame:
    """Adds rate_part and composition_part of every cohort, which sum to the combination's change; counts have deltas only."""
    own = W.partitionBy("candidate_id", "combination")
    s = lambda c: F.sum(c).over(own)
    both = (s("n_b") > 0) & (s("n_d") > 0)
    wb, wd = F.col("n_b") / s("n_b"), F.col("n_d") / s("n_d")
    own_rate = lambda k, n: F.when(F.col(n) > 0, F.col(k) / F.col(n))
    rb = F.coalesce(own_rate("k_b", "n_b"), own_rate("k_d", "n_d"), F.lit(0.0))
    rd = F.coalesce(own_rate("k_d", "n_d"), rb)
    middle = (s("k_b") / s("n_b") + s("k_d") / s("n_d")) / 2
    count = F.col("kind") == "count"
    rate = F.when(count, F.col("k_d") - F.col("k_b")).when(both, (wb + wd) / 2 * (rd - rb)).otherwise(0.0)
    mix = F.when(count, 0.0).when(both, ((rb + rd) / 2 - middle) * (wd - wb)).otherwise(0.0)
    return rows.withColumn("rate_part", rate).withColumn("composition_part", mix)


def tested_cohorts(rows: DataFrame, q: float = BH_Q) -> DataFrame:
    """Supported cohorts with z, p, discovery, q and coverage of their candidate's change."""
    with_phi = decompose(rows).join(phi_reference_days(rows), ["candidate_id", "combination"], "left").fillna(1.0, ["phi"])
    count = F.col("kind") == "count"
    supported = F.when(count, F.col("k_b") + F.col("k_d") >= COUNT_EVENTS).otherwise((F.col("n_b") >= SUPPORT) & (F.col("n_d") >= SUPPORT))
    z = F.when(count, z_count(F.col("k_b"), F.greatest(F.lit(1), F.size("ref_days")), F.col("k_d"), F.col("phi"))).otherwise(z_rate(F.col("k_b"), F.col("n_b"), F.col("k_d"), F.col("n_d"), F.col("phi")))
    total = F.sum(F.col("rate_part") + F.col("composition_part")).over(W.partitionBy("candidate_id", "combination"))
    t = with_phi.withColumn("z", z).withColumn("total", total).where(supported & F.col("z").isNotNull())
    toward = F.when(F.col("direction") == "down", -1.0).otherwise(1.0)
    t = benjamini_hochberg(t.withColumn("toward", toward).withColumn("p", p_value(toward * F.col("z"))), q)
    return t.withColumn("coverage", F.when(F.col("total") != 0, F.col("rate_part") / F.col("total")).otherwise(0.0))


def new_cohorts(rows: DataFrame) -> DataFrame:
    """Cohorts supported now but not before, against the rest of the scope in the same window, as a family of their own."""
    own = W.partitionBy("candidate_id", "combination")
    parts = decompose(rows.where("kind = 'rate'")).withColumn("total", F.sum(F.col("rate_part") + F.col("composition_part")).over(own))
    r = parts.join(phi_reference_days(rows), ["candidate_id", "combination"], "left").fillna(1.0, ["phi"])
    r = r.withColumn("all_k", F.sum("k_d").over(own)).withColumn("all_n", F.sum("n_d").over(own))
    r = r.where((F.col("n_b") < SUPPORT) & (F.col("n_d") >= SUPPORT) & (F.col("all_n") - F.col("n_d") >= SUPPORT))
    rest_k, rest_n = F.col("all_k") - F.col("k_d"), F.col("all_n") - F.col("n_d")
    toward = F.when(F.col("direction") == "down", -1.0).otherwise(1.0)
    z = z_rate(rest_k, rest_n, F.col("k_d"), F.col("n_d"), F.col("phi"))
    part = (F.col("k_d") / F.col("n_d") - rest_k / rest_n) * F.col("n_d") / F.col("all_n")
    tested = benjamini_hochberg(r.withColumn("toward", toward).withColumn("z", z).where("z is not null").withColumn("p", p_value(toward * F.col("z"))).withColumn("contribution", part))
    return tested.withColumn("rest_k", rest_k).withColumn("rest_n", rest_n).withColumn("coverage", F.when(F.col("total") != 0, F.col("contribution") / F.col("total")).otherwise(0.0))


def best_new(new: DataFrame) -> DataFrame:
    """candidate_id, combination and cohort of the new cohort that explains most of the change, if one explains enough."""
    hits = new.where(F.col("discovery") & (F.col("coverage") >= COVERAGE))
    return hits.groupBy("candidate_id").agg(F.max(F.struct("coverage", "cohort", "combination")).alias("b")).select("candidate_id", "b.cohort", "b.combination", "b.coverage")


def change_label(rows: DataFrame, new: DataFrame | None = None, approval: DataFrame | None = None) -> DataFrame:
    """candidate_id, label, combination and rate_share.

    Rates: the smallest rate share over combinations with two supported cohorts says rate_change, mixed or mix_shift; a
    new cohort that explains enough (new_cohorts) goes first. Counts are rate_change, and volume_only if the approval of
    their locus (approval: candidate_id, z) did not move.
    """
    d = decompose(rows.where("kind = 'rate'"))
    per = d.groupBy("candidate_id", "combination").agg(F.abs(F.sum("rate_part")).alias("r"), F.abs(F.sum("composition_part")).alias("c"), F.count_if((F.col("n_b") >= SUPPORT) & (F.col("n_d") >= SUPPORT)).alias("supported"))
    per = per.where("supported >= 2 and r + c > 0").withColumn("share", F.col("r") / (F.col("r") + F.col("c")))
    best = per.groupBy("candidate_id").agg(F.min(F.struct("share", "combination")).alias("b"))
    fresh = (best_new(new) if new is not None else best.select("candidate_id", F.lit("").alias("combination")).limit(0)).select("candidate_id", F.col("combination").alias("fresh"))
    moved = approval.select("candidate_id", F.col("z").alias("approval_z")) if approval is not None else best.select("candidate_id", F.lit(0.0).alias("approval_z")).limit(0)
    share = F.when(F.col("b.share") >= HIGH, "rate_change").when(F.col("b.share") <= LOW, "mix_shift").otherwise("mixed")
    every = rows.groupBy("candidate_id").agg(F.first("kind").alias("kind")).join(best, "candidate_id", "left").join(fresh, "candidate_id", "left").join(moved, "candidate_id", "left")
    count = F.when(F.abs("approval_z") < VOLUME_Z, "volume_only").otherwise("rate_change")
    label = F.when(F.col("kind") == "count", count).when(F.col("fresh").isNotNull(), "new_cohort").when(F.col("b").isNull(), "insufficient_data").otherwise(share)
    return every.select("candidate_id", label.alias("label"), F.coalesce("fresh", "b.combination").alias("combination"), F.col("b.share").alias("rate_share"))


def locus(tested: DataFrame, rows: DataFrame, new: DataFrame, labels: DataFrame) -> DataFrame:
    """candidate_id, locus (empty: the scope), locus_is_scope and how it was found, for every candidate with a test.

    In this order: the new cohort that explains enough; for a mix shift the cohort whose composition pushes hardest; the
    most specific concentrated discovery; else the scope. Then dimensions that leave the population as it is are dropped.
    """
    fresh = best_new(new).select("candidate_id", F.col("cohort").alias("fresh"))
    mix = _mix_shift(rows, labels)
    found = _concentrated(tested, rows)
    some = tested.select("candidate_id").distinct().withColumn("tested", F.lit(True))
    every = rows.select("candidate_id").distinct().join(fresh, "candidate_id", "left").join(mix, "candidate_id", "left").join(found, "candidate_id", "left").join(some, "candidate_id", "left")
    by = F.when(F.col("fresh").isNotNull(), "new_cohort").when(F.col("mix").isNotNull(), "mix_shift").when(F.col("found").isNotNull(), "concentrated").when(F.col("tested"), "scope")
    picked = every.select("candidate_id", F.coalesce("fresh", "mix", "found", F.when(F.col("tested"), "")).alias("locus"), by.alias("found_by")).where("locus is not null")
    return canonical_locus(picked, rows).withColumn("locus_is_scope", F.col("locus") == "")


def _mix_shift(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """candidate_id, mix: in the label's combination the cohort that pushes hardest in the alarm's direction; ties: the one whose share grew."""
    own = W.partitionBy("candidate_id", "combination")
    d = decompose(rows.where("kind = 'rate'")).withColumn("grew", F.col("n_d") / F.coalesce(F.nullif(F.sum("n_d").over(own), F.lit(0.0)), F.lit(1.0)) - F.col("n_b") / F.coalesce(F.nullif(F.sum("n_b").over(own), F.lit(0.0)), F.lit(1.0)))
    d = d.join(labels.where("label = 'mix_shift'").select("candidate_id", "combination"), ["candidate_id", "combination"])
    push = F.round(F.when(F.col("direction") == "down", -F.col("composition_part")).otherwise(F.col("composition_part")), 12)
    return d.groupBy("candidate_id").agg(F.max_by("cohort", F.struct(push, "grew", "cohort")).alias("mix"))


def canonical_locus(loci: DataFrame, rows: DataFrame, most: int = 3) -> DataFrame:
    """Loci without dimensions whose removal leaves the same counts before and now; a locus has at most ``most`` of its own.

    Every pass meets a locus's parents by an equi-join on their names and drops the first dimension that may go.
    """
    counts = ("k_b", "n_b", "k_d", "n_d")
    first = F.min(F.struct(F.array_position(F.array(*(F.lit(",".join(d for d in dimensions() if d in c)) for c in COMBINATIONS)), F.col("combination")).alias("nth"), "combination"))
    one = rows.groupBy("candidate_id").agg(first["combination"].alias("combination"))
    whole = rows.join(one, ["candidate_id", "combination"]).groupBy("candidate_id").agg(*(F.sum(c).alias(c) for c in counts)).withColumn("cohort", F.lit(""))
    known = rows.groupBy("candidate_id", "cohort").agg(*(F.first(c).alias(c) for c in counts)).unionByName(whole)
    alike = reduce(and_, (F.abs(F.col(c) - F.col(f"p_{c}")) <= F.greatest(F.lit(1e-9), F.lit(1e-9) * F.greatest(F.abs(c), F.abs(f"p_{c}"))) for c in counts))
    above = known.select("candidate_id", F.col("cohort").alias("parent"), *(F.col(c).alias(f"p_{c}") for c in counts))
    for _ in range(most):
        cut = loci.where("locus != ''").withColumn("parts", F.split("locus", ","))
        cut = cut.select("candidate_id", "locus", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.array_join(F.filter("parts", lambda x, j: j != i), ","))).alias("nth", "parent"))
        met = cut.join(known.withColumnRenamed("cohort", "locus"), ["candidate_id", "locus"]).join(above, ["candidate_id", "parent"]).where(alike)
        better = met.groupBy("candidate_id").agg(F.min_by("parent", "nth").alias("shorter"))
        loci = loci.join(better, "candidate_id", "left").withColumn("locus", F.coalesce("shorter", "locus")).drop("shorter")
    return loci


def _concentrated(tested: DataFrame, rows: DataFrame) -> DataFrame:
    """candidate_id, found: the most specific discovery that explains enough of the change and is concentrated against its parents.

    A cohort's parents are the whole scope and every tested cohort on a proper subset of its dimensions; both are met by
    an equi-join on the cohort's name, as a cohort has at most six proper subsets.
    """
    toward = F.col("toward")
    people = F.when(F.col("kind") == "count", F.col("k_b")).otherwise(F.col("n_b"))
    t = tested.withColumn("people", people)
    scope = rows.withColumn("people", people).groupBy("candidate_id", "combination").agg(F.sum("people").alias("people"), F.sum("n_d").alias("now")).groupBy("candidate_id").agg(F.max("people").alias("all_people"), F.max("now").alias("all_now"))
    ok = t.where((F.col("discovery")) & (F.col("coverage") >= COVERAGE)).join(scope, "candidate_id")
    lifts = lambda part, all_: F.coalesce((toward * part <= 0) | (all_ <= 0) | (F.col("people") <= 0) | ((F.col("rate_part") / part) / (F.col("people") / all_) >= LIFT), F.lit(True))
    ok = ok.where(lifts(F.nullif("total", F.lit(0.0)), F.nullif("all_people", F.lit(0.0))))
    parts = F.split("cohort", ",")
    subs = F.expr("filter(transform(sequence(1, cast(pow(2, size(parts)) as int) - 2), b -> array_join(filter(parts, (x, i) -> (shiftright(b, i) & 1) = 1), ',')), s -> s != '')")
    split = ok.withColumn("parts", parts)
    asked = split.where(F.size("parts") > 1).withColumn("parent", F.explode(subs))
    above = t.groupBy("candidate_id", F.col("cohort").alias("parent")).agg(F.first("rate_part").alias("p_part"), F.first("people").alias("p_people"))
    weak = asked.join(above, ["candidate_id", "parent"]).where(~lifts(F.nullif("p_part", F.lit(0.0)), F.nullif("p_people", F.lit(0.0)))).select("candidate_id", "cohort").distinct()
    left = ok.join(weak, ["candidate_id", "cohort"], "left_anti")
    size = F.when(F.col("kind") == "count", F.col("k_d")).otherwise(F.col("n_d"))
    rank = F.array_position(F.array(*(F.lit(",".join(d for d in dimensions() if d in c)) for c in COMBINATIONS)), F.col("combination"))
    best = left.withColumn("n", F.row_number().over(W.partitionBy("candidate_id").orderBy(size, F.size(F.split("cohort", ",")), rank, "cohort"))).where("n = 1")
    whole = (F.col("kind") == "rate") & (F.col("n_d") >= 0.98 * F.col("all_now"))
    return best.select("candidate_id", F.when(whole, "").otherwise(F.col("cohort")).alias("found"))


def rank_top_cohorts(tested: DataFrame, new: DataFrame) -> DataFrame:
    """candidate_id, cohort, nth: the new cohort that explains enough, if there is one, then the discoveries that contribute
    most in the alarm's direction, five in all."""
    fresh = best_new(new).select("candidate_id", "cohort", F.lit(0).alias("turn"), F.lit(0.0).alias("towards"), F.lit(0.0).alias("z"))
    ranked = tested.where("discovery").select("candidate_id", "cohort", F.lit(1).alias("turn"), (F.col("toward") * F.col("rate_part")).alias("towards"), F.abs("z").alias("z"))
    order = W.partitionBy("candidate_id").orderBy("turn", F.desc("towards"), F.desc("z"), "cohort")
    return fresh.unionByName(ranked).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= TOP).select("candidate_id", "cohort", "nth")


def controls(tested: DataFrame, loci: DataFrame) -> DataFrame:
    """Up to three calm cohorts on the locus's dimensions that differ from it in one value, largest first."""
    dims = lambda c: F.regexp_replace(c, "=[^,]*", "").alias("dims")
    l = loci.where("locus != ''").select("candidate_id", "locus", dims("locus"))
    size = F.when(F.col("kind") == "count", F.col("k_d")).otherwise(F.col("n_d"))
    calm = tested.where(F.abs("z") < CONTROL_Z).groupBy("candidate_id", "cohort").agg(F.first("z").alias("z"), F.first(size).alias("size")).select("*", dims("cohort"))
    apart = F.size(F.array_except(F.split("cohort", ","), F.split("locus", ",")))
    order = W.partitionBy("candidate_id").orderBy(F.desc("size"), "cohort")
    return calm.join(l, ["candidate_id", "dims"]).where(apart == 1).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= MAX_CONTROLS).select("candidate_id", "locus", "cohort", "z", "nth")


def impact_estimate(tested: DataFrame) -> DataFrame:
    """Lost successes or excess events of each cohort with a 95 % interval scaled by the overdispersion."""
    count = F.col("kind") == "count"
    rb, rd = (F.least(F.lit(1.0), F.col(k) / F.col(n)) for k, n in (("k_b", "n_b"), ("k_d", "n_d")))
    value = F.when(count, F.col("k_d") - F.col("k_b")).otherwise(F.col("toward") * (rd - rb) * F.col("n_d"))
    spread = F.when(count, F.sqrt(F.col("k_d") + F.col("k_b"))).otherwise(F.sqrt(rb * (1 - rb) / F.col("n_b") + rd * (1 - rd) / F.col("n_d")) * F.col("n_d"))
    half = 1.96 * F.sqrt("phi") * spread
    return tested.select(*COHORT, value.alias("value"), (value - half).alias("low"), (value + half).alias("high"))


def naive_locus(tested: DataFrame) -> DataFrame:
    """The comparison: the supported cohort with the largest relative move in the alarm's direction."""
    before = F.when(F.col("kind") == "count", F.col("k_b")).otherwise(F.col("k_b") / F.col("n_b"))
    now = F.when(F.col("kind") == "count", F.col("k_d")).otherwise(F.col("k_d") / F.col("n_d"))
    move = F.when(before > 0, F.col("toward") * (now - before) / before)
    return tested.withColumn("move", move).where("move > 0").groupBy("candidate_id").agg(F.min_by("cohort", F.struct((-F.col("move")).alias("m"), "cohort")).alias("naive_locus"), F.max("move").alias("move"))


def related_pairs(cand: DataFrame) -> DataFrame:
    """Candidates of one metric with overlapping windows and nested loci list each other, at most five, sorted (candidate_id, metric, window_start, window_end, locus)."""
    days = F.explode(F.sequence(F.floor(F.col("window_start") / DAY), F.floor((F.col("window_end") - 1) / DAY))).alias("day")
    a = cand.select("candidate_id", "metric", "window_start", "window_end", F.filter(F.split("locus", ","), lambda x: x != "").alias("l"), days)
    b = a.select(F.col("candidate_id").alias("other"), "metric", F.col("window_start").alias("s"), F.col("window_end").alias("e"), F.col("l").alias("m"), "day")
    met = a.join(b, ["metric", "day"]).where("candidate_id != other and window_start < e and s < window_end")
    nested = (F.size(F.array_except("l", "m")) == 0) | (F.size(F.array_except("m", "l")) == 0)
    return met.where(nested).groupBy("candidate_id").agg(F.slice(F.array_sort(F.collect_set("other")), 1, 5).alias("related"))


def measure(norm: DataFrame, asked: DataFrame, metric: str, version: int, grain: str, world_start: int, world_end: int) -> DataFrame:
    """candidate_id, metric, version, before, during and z of one metric on each candidate's cohort (column scope; empty is all traffic).

    Cohorts with a dimension that the metric doesn't have, and rates without support on both sides, give no row.
    """
    known = F.array(*map(F.lit, m.METRICS[metric, version].dims))
    fits = F.forall(F.filter(F.split("scope", ","), lambda x: x != ""), lambda x: F.array_contains(known, F.split_part(x, F.lit("="), F.lit(1))))
    fit = asked.where(fits)
    rows = pool_before_during(cohort_tables(norm, fit, metric, version, grain, world_start, world_end, combinations=((),)), fit, world_start)
    count = F.col("kind") == "count"
    z = F.when(count, z_count(F.col("k_b"), F.greatest(F.lit(1), F.size("ref_days")), F.col("k_d"), F.lit(1.0))).otherwise(z_rate(F.col("k_b"), F.col("n_b"), F.col("k_d"), F.col("n_d"), F.lit(1.0)))
    rows = rows.where(count | ((F.col("n_b") >= SUPPORT) & (F.col("n_d") >= SUPPORT)))
    value = lambda k, n: F.when(count, F.col(k)).otherwise(F.col(k) / F.col(n))
    return rows.select("candidate_id", F.lit(metric).alias("metric"), F.lit(version).alias("version"), value("k_b", "n_b").alias("before"), value("k_d", "n_d").alias("during"), z.alias("z"))


def related_metrics(norm: DataFrame, asked: DataFrame, metric: str, grain: str, world_start: int, world_end: int) -> DataFrame | None:
    """measure of the siblings of a metric on the loci of its candidates; None where it has none."""
    parts = [measure(norm, asked, other, version, grain, world_start, world_end) for own, other, version in RELATED if own == metric]
    return reduce(DataFrame.unionByName, parts) if parts else None


BUNDLE_BYTES = 8_192


def locus_impact(rows: DataFrame, new: DataFrame, loci: DataFrame) -> DataFrame:
    """candidate_id, impact, impact_low and impact_high of each locus: lost successes or excess events; a new cohort is held
    against the rest of its scope."""
    counts = ("k_b", "n_b", "k_d", "n_d")
    phi = phi_reference_days(rows).groupBy("candidate_id").agg(F.min_by("phi", "combination").alias("phi"))
    first = rows.groupBy("candidate_id").agg(F.min("combination").alias("combination"))
    whole = rows.join(first, ["candidate_id", "combination"]).groupBy("candidate_id", "kind", "direction").agg(*(F.sum(c).alias(c) for c in counts)).withColumn("cohort", F.lit(""))
    own = rows.groupBy("candidate_id", "cohort", "kind", "direction").agg(*(F.first(c).alias(c) for c in counts)).unionByName(whole)
    rest = new.groupBy("candidate_id", "cohort").agg(F.first("rest_k").alias("rest_k"), F.first("rest_n").alias("rest_n"))
    at = loci.select("candidate_id", F.col("locus").alias("cohort"), "found_by").join(own, ["candidate_id", "cohort"]).join(rest, ["candidate_id", "cohort"], "left").join(phi, "candidate_id", "left").fillna(1.0, ["phi"])
    fresh = F.col("found_by") == "new_cohort"
    at = at.withColumns({"k_b": F.when(fresh, F.col("rest_k")).otherwise(F.col("k_b")), "n_b": F.when(fresh, F.col("rest_n")).otherwise(F.col("n_b"))}).where("kind = 'count' or n_b > 0 and n_d > 0")
    at = at.withColumn("toward", F.when(F.col("direction") == "down", -1.0).otherwise(1.0)).withColumn("combination", F.lit(""))
    return impact_estimate(at).select("candidate_id", F.round("value", 2).alias("impact"), F.round("low", 2).alias("impact_low"), F.round("high", 2).alias("impact_high"))


def locus_coverage(tested: DataFrame, new: DataFrame, loci: DataFrame) -> DataFrame:
    """candidate_id and locus_coverage: the share of the change that the locus explains, by its own place among the top cohorts or
    that of the first which holds all its pairs; 1 for the whole scope."""
    known = tested.select("candidate_id", "cohort", "coverage").unionByName(new.select("candidate_id", "cohort", "coverage")).groupBy("candidate_id", "cohort").agg(F.first("coverage").alias("coverage"))
    top = rank_top_cohorts(tested, new).join(known, ["candidate_id", "cohort"])
    met = loci.where("locus != ''").select("candidate_id", "locus").join(top, "candidate_id").where(F.size(F.array_except(F.split("locus", ","), F.split("cohort", ","))) == 0)
    share = met.groupBy("candidate_id").agg(F.min_by("coverage", F.struct(F.col("cohort") != F.col("locus"), "nth")).alias("c"))
    return loci.join(share, "candidate_id", "left").select("candidate_id", F.when(F.col("locus") == "", 1.0).otherwise(F.col("c")).alias("locus_coverage"))


def evidence_bundle(found: DataFrame) -> DataFrame:
    """Adds bundle: one JSON document a candidate, each part with its epistemic label; an error above 8,192 bytes."""
    kind = lambda c, label: F.struct(c.alias("value"), F.lit(label).alias("epistemic"))
    document = F.to_json(F.struct(
        F.concat(F.lit("evb_"), F.substring(F.sha2("candidate_id", 256), 1, 16)).alias("bundle_id"),
        F.struct("candidate_id", "metric", "version", "scope", "direction", F.array("window_start", "window_end").alias("window"), F.lit("observed").alias("epistemic")).alias("candidate"),
        kind(F.struct("label", "combination"), "inferred").alias("label"), kind(F.col("locus"), "inferred").alias("locus"), kind(F.col("top"), "observed").alias("top_cohorts"), kind(F.col("calm"), "observed").alias("controls"), kind(F.col("related"), "observed").alias("related_metrics"),
        kind(F.struct("impact", "impact_low", "impact_high"), "estimated").alias("impact"),
    ))
    size = F.octet_length(document)
    return found.withColumn("bundle", F.when(size <= BUNDLE_BYTES, document).otherwise(F.raise_error(F.concat(F.lit("an evidence bundle of "), size, F.lit(" bytes is too large")))))


def analyze(norm: DataFrame, cand: DataFrame, metric: str, version: int, grain: str, world_start: int, world_end: int) -> DataFrame:
    """One row a candidate of one metric and grain: label, locus, top cohorts, controls, related metrics and impact."""
    cand = cand.select("candidate_id", "metric", "version", "scope", "direction", "window_start", "window_end")
    rows = materialized(pool_before_during(cohort_tables(norm, cand, metric, version, grain, world_start, world_end), cand, world_start), "pooled")
    tested, new = materialized(tested_cohorts(rows), "tested"), materialized(new_cohorts(rows), "new-cohorts")
    labels = change_label(rows, new)
    loci = materialized(locus(tested, rows, new, labels), "loci")
    asked = cand.join(loci.select("candidate_id", "locus"), "candidate_id").withColumn("scope", F.concat_ws(",", F.nullif("scope", F.lit("")), F.nullif("locus", F.lit(""))))
    near = related_metrics(norm, asked, metric, grain, world_start, world_end)
    items = cand.select("candidate_id").withColumn("related", F.array().cast("array<struct<metric:string,before:double,during:double,z:double>>"))
    if near is not None:
        near = materialized(near, "related")
        four = F.struct("metric", F.round("before", 6).alias("before"), F.round("during", 6).alias("during"), F.round("z", 3).alias("z"))
        items = near.groupBy("candidate_id").agg(F.sort_array(F.collect_list(four)).alias("related"))
        if metric == "attempt_volume":
            labels = change_label(rows, new, near.where("metric = 'authorization_rate'"))
    ordered = lambda df, name: df.groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.struct("nth", "cohort")))["cohort"].alias(name))
    moved = tested.groupBy("candidate_id").agg(F.count_if("discovery").alias("discoveries"))
    parts = (labels, loci, moved, locus_coverage(tested, new, loci), ordered(rank_top_cohorts(tested, new), "top"), ordered(controls(tested, loci), "calm"), items, locus_impact(rows, new, loci))
    return reduce(lambda a, b: a.join(b, "candidate_id", "left"), parts, cand)


def analyze_candidates(norm: DataFrame, cand: DataFrame, world_start: int, world_end: int) -> DataFrame:
    """analyze for candidates of all metrics (anomaly_id and the detector's columns) that aren't suppressed, with bundles and
    the candidates of the same metric on nested loci at the same time. Kinds of candidates, not candidates, are read by the driver."""
    live = materialized(cand.where("status != 'suppressed'").withColumnRenamed("anomaly_id", "candidate_id"), "live")
    kinds = [tuple(r) for r in live.select("metric", "version", "grain").distinct().orderBy("metric", "version", "grain").collect()]
    # with nothing to explain any kind gives the empty table of the right columns
    kinds = kinds or [("authorization_rate", 1, "1h")]
    norm = materialized(norm, "norm")
    of = lambda k: live.where((F.col("metric") == k[0]) & (F.col("version") == k[1]) & (F.col("grain") == k[2]))
    found = materialized(evidence_bundle(reduce(DataFrame.unionByName, (analyze(norm, of(k), *k, world_start, world_end) for k in kinds))), "analyses")
    linked = related_pairs(found.select("candidate_id", "metric", "window_start", "window_end", F.concat_ws(",", F.nullif("scope", F.lit("")), F.nullif("locus", F.lit(""))).alias("locus")))
    return found.join(linked.withColumnRenamed("related", "related_candidates"), "candidate_id", "left")


#: The pairs of dimensions that the daily sweep looks at, and its false-discovery rate a day.
SWEEP, SWEEP_Q, SWEEP_SERIES, MOST_EVIDENCE = (("psp", "customer_country"), ("customer_country", "payment_method_type")), 0.01, "S12", 48


def cohort_sweep(norm: DataFrame, world_start: int, world_end: int, warmup_days: int = 3, combinations=SWEEP, q: float = SWEEP_Q, metric: str = "authorization_rate", version: int = 1) -> DataFrame:
    """Candidates of cohorts whose rate dropped against the same days before, hidden from coarser series: every day after the
    warm-up is a family of tests over all cohorts of the combinations, and consecutive days of one cohort are one candidate."""
    spark = norm.sparkSession
    days = spark.range(world_start + warmup_days * DAY, world_end, DAY).select(F.concat(F.lit("day_"), "id").alias("candidate_id"), F.lit("down").alias("direction"), F.col("id").alias("window_start"), (F.col("id") + DAY).alias("window_end"))
    rows = materialized(pool_before_during(cohort_tables(norm, days, metric, version, "1d", world_start, world_end, combinations), days, world_start), "sweep")
    hits = tested_cohorts(rows, q).where("discovery").join(days.select("candidate_id", "window_start"), "candidate_id")
    own = W.partitionBy("cohort").orderBy("window_start")
    runs = hits.withColumn("island", F.col("window_start") - F.row_number().over(own) * DAY)
    evidence = stable_id("evd_", F.lit(metric), F.lit(version), F.col("cohort"), F.lit("1d"), F.col("window_start"))
    first = F.struct("window_start", "k_d", "n_d", "k_b", "n_b")
    per = runs.groupBy("cohort", "island").agg(F.min(first).alias("f"), F.max("window_start").alias("last"), F.max(F.abs("z")).alias("score"), F.array_sort(F.collect_list(F.struct("window_start", evidence.alias("id")))).alias("days"))
    observed, expected = F.col("f.k_d") / F.col("f.n_d"), F.col("f.k_b") / F.col("f.n_b")
    return per.select(
        stable_id("anom_", F.lit("main"), F.lit(SWEEP_SERIES), F.lit(metric), F.lit(version), F.col("cohort"), F.col("f.window_start")).alias("anomaly_id"), F.lit("main").alias("system"), F.lit(SWEEP_SERIES).alias("series"), F.lit(metric).alias("metric"), F.lit(version).alias("version"), F.lit("1d").alias("grain"),
        F.col("cohort").alias("scope"), F.lit("down").alias("direction"), F.col("f.window_start").alias("window_start"), (F.col("last") + DAY).alias("window_end"), (F.col("f.window_start") + DAY).alias("detected_at"), F.round(observed, 6).alias("observed"), F.round(expected, 6).alias("expected"),
        F.round(observed - expected, 6).alias("delta"), F.when(expected != 0, F.round((observed - expected) / expected, 6)).alias("relative_delta"), F.round("score", 3).alias("score"), F.col("f.n_d").cast("bigint").alias("sample_size"), F.array(F.lit("cohort_sweep")).alias("methods"),
        F.slice(F.transform("days", lambda x: x["id"]), 1, MOST_EVIDENCE).alias("evidence_ids"),
    )
