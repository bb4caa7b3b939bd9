"""Which earlier candidate a candidate belongs with: close in time, of one metric group, on nested cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Groups of metrics by (metric, direction); either direction where it is empty.
GROUPS = (
    ("authorization_rate", "", "payments"), ("checkout_conversion_rate", "", "payments"), ("attempt_volume", "down", "payments"), ("attempt_volume", "up", "fraud"), ("fraud_flag_rate", "", "fraud"), ("renewal_success_rate", "", "subscriptions"), ("dunning_recovery_rate", "", "subscriptions"),
    ("refund_count", "", "refunds"), ("refund_rate", "", "refunds"), ("duplicate_charge_rate", "", "refunds"), ("subscription_cancellation_rate", "", "cancellations"), ("late_arrival_share", "", "ingestion"),
)
#: Approved steps from a coarser to a finer set of dimensions.
STEPS = (("psp", "psp,customer_country"), ("psp,customer_country", "psp,customer_country,platform"), ("psp", "psp,card_brand"), ("customer_country", "psp,customer_country"), ("customer_country", "customer_country,payment_method_type"), ("platform", "platform,app_version"))
MORE_STEPS = (("app_version", "platform,app_version"), ("psp", "psp,platform"), ("psp,platform", "psp,customer_country,platform"), ("customer_country", "customer_country,platform"), ("psp,customer_country", "psp,customer_country,card_brand"))
GAP, DAY = 21_600, 86_400


def chains(steps: tuple[tuple[str, str], ...]) -> list[str]:
    """Every pair coarser>finer that follows from the steps, dimensions in alphabetical order."""
    named = lambda dims: ",".join(sorted(dims.split(",")))
    below: dict[str, set[str]] = {}
    for a, b in steps:
        below.setdefault(named(a), set()).add(named(b))

    def reach(a: str) -> set[str]:
        return {y for b in below.get(a, ()) for y in {b} | reach(b)}

    return sorted(f"{a}>{b}" for a in below for b in reach(a))


def metric_groups(metric: Column, direction: Column, renewal_with_approval: bool = False) -> Column:
    """The groups of a metric, an array."""
    found = F.lit(None)
    for name, way, group in GROUPS:
        fits = (metric == name) & ((direction == way) if way else F.lit(True))
        more = F.when(direction == "down", F.array(F.lit("payments"), F.lit("subscriptions"))).otherwise(F.array(F.lit("payments"))) if renewal_with_approval and name == "authorization_rate" else F.array(F.lit(group))
        found = F.when(fits, more).otherwise(found)
    return F.coalesce(found, F.array().cast("array<string>"))


def _nested(a: Column, b: Column, mode: str) -> Column:
    """Whether one of two loci (arrays of dimension=value, both with some) holds all pairs of the other, by an approved chain or any."""
    inside = lambda x, y: (F.size(F.array_except(x, y)) == 0) & (F.size(x) < F.size(y))
    same = F.array_sort(a) == F.array_sort(b)
    if mode == "pairs":
        return same | inside(a, b) | inside(b, a)
    dims = lambda x: F.array_join(F.array_sort(F.transform(x, lambda v: F.split_part(v, F.lit("="), F.lit(1)))), ",")
    known = chains(STEPS + (MORE_STEPS if mode == "chains_plus" else ()))
    step = lambda x, y: inside(x, y) & F.concat(dims(x), F.lit(">"), dims(y)).isin(known)
    return same | step(a, b) | step(b, a)


def correlate_pairs(cand: DataFrame, gap: int = GAP, mode: str = "pairs", ingestion_anchors: bool = False, renewal_with_approval: bool = False, parent_locus: bool = False, since: bool = False) -> DataFrame:
    """candidate, member, time (overlap or gap), shared groups and outcome (specific, parent, global or related) of every candidate against earlier ones.

    cand: anomaly_id, metric, direction, locus (dimension=value, by comma; empty is global), window_start, window_end,
    detected_at, and parent (another locus) for ``parent_locus``. Pairs meet by an equi-join on metric group and a bucket
    of time; each pair counts in the first bucket and the first group that both stand under, so pairs are not dealt again
    to find repeated ones, unless ids repeat. With ``since``, also when the member was detected.
    """
    bucket = lambda t: F.floor(t / DAY)
    parts = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    own = metric_groups(F.col("metric"), F.col("direction"), renewal_with_approval)
    every = cand.select("anomaly_id", "detected_at", "window_start", "window_end", parts(F.col("locus")).alias("locus"), parts(F.col("parent") if parent_locus else F.lit("")).alias("parent"), own.alias("groups"))
    # ingestion goes with every group, so its members stand under all; a metric without a group goes with ingestion alone
    names = sorted({g for *_, g in GROUPS})
    late = F.array_contains("groups", "ingestion")
    all_ = F.array(*map(F.lit, [*names, ""]))
    under = F.when(late, all_).when(F.size("groups") == 0, F.array(F.lit(""))).otherwise(F.col("groups"))
    a = every.withColumn("under", under).withColumn("group", F.explode("under"))
    b = a if ingestion_anchors else every.withColumn("under", F.when(late, F.array(F.lit("ingestion"))).otherwise(under)).withColumn("group", F.explode("under"))
    a = a.withColumn("first", bucket(F.col("window_start") - gap)).withColumn("b", F.explode(F.sequence("first", bucket(F.col("window_end") + gap))))
    b = b.withColumn("m_first", bucket(F.col("window_start"))).withColumn("b", F.explode(F.sequence("m_first", bucket(F.col("window_end")))))
    b = b.select("group", "b", "m_first", *(F.col(c).alias(f"m_{c}") for c in ("anomaly_id", "detected_at", "window_start", "window_end", "locus", "parent", "groups", "under")))
    once = (F.size("under") < 2) | (F.size("m_under") < 2) | (F.col("group") == F.array_min(F.array_intersect("under", "m_under")))
    met = a.join(b, ["group", "b"]).where((F.col("b") == F.greatest("first", "m_first")) & once)
    met = met.where((F.struct("m_detected_at", "m_anomaly_id") < F.struct("detected_at", "anomaly_id")) & (F.col("window_start") <= F.col("m_window_end") + gap) & (F.col("m_window_start") <= F.col("window_end") + gap))
    both = F.array_sort(F.array_distinct(F.concat("groups", "m_groups")))
    ingestion = late | F.array_contains("m_groups", "ingestion")
    shared = F.when(ingestion, both).otherwise(F.array_sort(F.array_intersect("groups", "m_groups")))
    overlap = (F.col("window_start") < F.col("m_window_end")) & (F.col("m_window_start") < F.col("window_end"))
    met = met.withColumn("shared", shared).where(F.size("shared") > 0)
    if not cand.groupBy("anomaly_id").count().where("count > 1").isEmpty():
        met = met.dropDuplicates(["anomaly_id", "m_anomaly_id"])
    some = lambda c: F.size(c) > 0
    nested = some("locus") & some("m_locus") & _nested(F.col("locus"), F.col("m_locus"), mode)
    outcome = F.when(nested, "specific")
    if parent_locus:
        near = lambda x, y: some(x) & some(y) & _nested(F.col(x), F.col(y), mode)
        outcome = outcome.when(near("locus", "m_parent") | near("parent", "m_locus") | near("parent", "m_parent"), "parent")
    # a member that alone is global anchors no specific candidate
    outcome = outcome.when(~some("locus"), "global").otherwise("related")
    return met.select(F.col("anomaly_id").alias("candidate"), F.col("m_anomaly_id").alias("member"), F.when(overlap, "overlap").otherwise("gap").alias("time"), F.array_join("shared", ",").alias("shared"), outcome.alias("outcome"), *([F.col("m_detected_at").alias("since")] if since else []))


def first_matches(pairs: DataFrame, cand: DataFrame) -> DataFrame:
    """candidate, match (specific, global_unambiguous, global_ambiguous, not_nested or none) and member: the oldest that decides it.

    Pairs without since (of correlate_pairs) look up in cand when their member was detected.
    """
    order = cand.select(F.col("anomaly_id").alias("member"), F.col("detected_at").alias("since"))
    p = (pairs if "since" in pairs.columns else pairs.join(order, "member")).withColumn("kind", F.when(F.col("outcome") == "parent", "specific").otherwise(F.col("outcome")))
    oldest = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("member")), F.when(F.col("kind") == kind, F.struct("since", "member")))
    per = p.groupBy("candidate").agg(oldest("specific").alias("specific"), oldest("global").alias("global"), F.count_if(F.col("kind") == "global").alias("n_global"), F.count_if(F.col("kind") == "related").alias("n_related"))
    match = F.when(F.col("specific").isNotNull(), "specific").when(F.col("n_global") == 1, "global_unambiguous").when(F.col("n_global") > 1, "global_ambiguous").when(F.col("n_related") > 0, "not_nested").otherwise("none")
    every = cand.select(F.col("anomaly_id").alias("candidate")).join(per, "candidate", "left")
    return every.select("candidate", match.alias("match"), F.when(F.col("specific").isNotNull(), F.col("specific")).when(F.col("n_global") == 1, F.col("global")).alias("member"))
