"""Where to look first in an incident: narrowed cohorts, causes by prior, what stands for its impact, and earlier ones like it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Metric, direction, causes that a dimension of the locus points to, causes of the family in order, and the cause that the metric itself names.
PRIORS = (
    ("authorization_rate", "down", (("psp", "psp_degradation"), ("payment_method_type", "payment_method_degradation"), ("customer_country", "issuer_or_country_degradation"), ("card_brand", "issuer_or_country_degradation")), ("psp_degradation", "payment_method_degradation", "issuer_or_country_degradation", "fraud_attack", "data_pipeline_issue", "renewal_job_failure", "dunning_failure"), ""),
    ("checkout_conversion_rate", "down", (("platform", "checkout_regression"), ("app_version", "checkout_regression")), ("checkout_regression", "psp_degradation", "data_pipeline_issue"), ""),
    ("renewal_success_rate", "down", (("psp", "renewal_job_failure"),), ("renewal_job_failure", "dunning_failure", "psp_degradation"), "renewal_job_failure"),
    ("dunning_recovery_rate", "down", (("psp", "dunning_failure"),), ("dunning_failure", "renewal_job_failure"), "dunning_failure"),
    ("refund_count", "up", (("customer_country", "refund_process_change"),), ("refund_process_change", "duplicate_charging"), "refund_process_change"),
    ("duplicate_charge_rate", "up", (("platform", "duplicate_charging"),), ("duplicate_charging",), "duplicate_charging"),
    ("fraud_flag_rate", "up", (), ("fraud_attack",), "fraud_attack"),
    ("attempt_volume", "up", (), ("fraud_attack", "normal_variation"), ""),
    ("attempt_volume", "down", (("psp", "psp_degradation"),), ("psp_degradation", "data_pipeline_issue"), ""),
    ("subscription_cancellation_rate", "up", (("customer_country", "pricing_or_plan_change"),), ("pricing_or_plan_change",), "pricing_or_plan_change"),
    ("late_arrival_share", "up", (("psp", "data_pipeline_issue"),), ("data_pipeline_issue",), "data_pipeline_issue"),
)
ALWAYS = ("normal_variation", "unknown")
SHIFTS = ("mix_shift", "volume_only")
IMPACT_METRICS = ("authorization_rate", "checkout_conversion_rate")
_ENTRY = "array<struct<pos:int,cause:string,weight:int>>"


def dims_of(locus: Column) -> Column:
    """The dimensions of an array of dimension=value."""
    return F.transform(locus, lambda x: F.split_part(x, F.lit("="), F.lit(1)))


def member_priors(members: DataFrame) -> DataFrame:
    """Every member's causes with their place and weight: 3 where its locus or its metric names the cause, else 1.

    members: incident_id, candidate_id, seen_at, metric, direction, locus (array), change_type. A member that points to
    nothing stays, with a null cause.
    """
    none = F.array().cast(_ENTRY)
    own = none
    for metric, direction, by_dim, family, direct in PRIORS:
        entries = []
        for pos, cause in enumerate(family):
            dims = [F.lit(d) for d, c in by_dim if c == cause]
            named = F.arrays_overlap(dims_of(F.col("locus")), F.array(*dims)) if dims else F.lit(False)
            weight = F.lit(3) if cause == direct else F.when(named, 3).otherwise(1)
            entries.append(F.struct(F.lit(pos).alias("pos"), F.lit(cause).alias("cause"), weight.alias("weight")))
        own = F.when((F.col("metric") == metric) & (F.col("direction") == direction), F.array(*entries)).otherwise(own)
    calm = F.array(F.struct(F.lit(len(PRIORS)).alias("pos"), F.lit("normal_variation").alias("cause"), F.lit(3).alias("weight")))
    every = F.concat(own, F.when(F.col("change_type").isin(*SHIFTS), calm).otherwise(none))
    return members.select("*", F.inline_outer(every))


def hypothesis_priors(members: DataFrame, most: int = 7) -> DataFrame:
    """hypothesis_id, nth (from 0), cause and prior of each incident: the strongest weight of all members, then the place in
    which a cause was first seen; normal_variation and unknown close every list.

    A list holds at most the closed vocabulary, however many members an incident has.
    """
    each = member_priors(members)
    per = each.groupBy("incident_id", "cause").agg(F.max("weight").alias("weight"), F.min(F.struct("seen_at", "candidate_id", "pos")).alias("first"))
    named = F.when(F.col("cause").isNotNull(), F.struct((-F.col("weight")).alias("w"), "first", "cause"))
    lists = per.groupBy("incident_id").agg(F.array_sort(F.collect_list(named)).alias("found"))
    ranked = F.slice(F.filter("found", lambda x: ~x["cause"].isin(*ALWAYS)), 1, most)
    entry = lambda cause, prior: F.struct(cause.alias("cause"), prior.cast("int").alias("prior"))
    of = lambda cause: F.coalesce(-F.get(F.filter("found", lambda x: x["cause"] == cause), F.lit(0))["w"], F.lit(0))
    whole = F.concat(F.transform(ranked, lambda x: entry(x["cause"], -x["w"])), F.array(*(entry(F.lit(c), of(c)) for c in ALWAYS)))
    rows = lists.select("incident_id", F.posexplode(whole).alias("nth", "x")).select("incident_id", "nth", "x.*")
    digest = F.sha2(F.concat_ws("|", "incident_id", "cause"), 256)
    return rows.select("incident_id", F.concat(F.lit("hyp_"), F.substring(digest, 1, 12)).alias("hypothesis_id"), "nth", "cause", "prior")


def hypothesis_status(found: DataFrame) -> DataFrame:
    """score, status and rank of hypotheses with their counts of supporting and contradicting evidence."""
    s, c = F.col("supporting"), F.col("contradicting")
    status = F.when((c >= 1) & (c > s), "contradicted").when((s >= 2) & (c == 0), "supported").otherwise("open")
    scored = found.withColumn("score", F.col("prior") + s - 2 * c).withColumn("status", status)
    order = W.partitionBy("incident_id").orderBy(F.desc("score"), F.desc("prior"), "nth", "cause")
    return scored.withColumn("rank", F.row_number().over(order))


def narrow_select(items: DataFrame, chunk: int = 40, split: int = 4, leaf: int = 10, keep: int = 4, depth: int = 3) -> DataFrame:
    """The items that survive the narrowing of each incident, ranked by their contribution.

    items: incident_id, combo, dims (text, dimensions in order) and contribution. Each combination is cut into chunks in
    order of contribution; the chunks that weigh most stay and are split, ``depth`` times. Once every chunk is a leaf,
    further rounds keep what is there, so all incidents go through the same rounds together.
    """
    weight = F.abs(F.col("contribution"))
    place = F.row_number().over(W.partitionBy("incident_id", "combo").orderBy(F.desc(weight), "dims")) - 1
    rows = items.select("incident_id", "combo", "dims", "contribution").withColumn("place", place)
    rows = rows.withColumn("path", F.array(F.floor(F.col("place") / chunk))).withColumn("place", F.col("place") % chunk)
    own = W.partitionBy("incident_id", "combo", "path")
    for nth in range(depth + 1):
        rows = rows.withColumns({"sum": F.sum(weight).over(own), "n": F.count("*").over(own), "head": F.min_by("dims", "place").over(own)})
        order = W.partitionBy("incident_id").orderBy(F.desc("sum"), "head", "combo", "path")
        rows = rows.withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= keep)
        if nth < depth:
            step = F.when(F.col("n") > leaf, F.ceil(F.col("n") / split)).otherwise(F.col("n"))
            rows = rows.withColumn("path", F.concat("path", F.array(F.floor(F.col("place") / step)))).withColumn("place", F.col("place") % step)
    # of one cohort under two combinations the later chunk's item counts
    last = F.row_number().over(W.partitionBy("incident_id", "dims").orderBy(F.desc("nth")))
    kept = rows.where(F.col("place") < leaf).withColumn("again", last).where("again = 1")
    rank = F.row_number().over(W.partitionBy("incident_id").orderBy(F.desc(weight), "dims"))
    return kept.select("incident_id", rank.alias("rank"), "combo", "dims", "contribution")


def impact_anchor(members: DataFrame) -> DataFrame:
    """anchor (null if no member has an impact), the episode and the cohort that are measured for each incident.

    members: incident_id, candidate_id, metric, change_type, scope and locus (arrays), window_start, window_end,
    episode_end, and impact (measure, value, low, high; null if none). A new cohort is measured on its scope.
    """
    m = F.struct("candidate_id", "change_type", "scope", "locus", "window_start", "window_end", "episode_end", "impact")
    fits = F.col("metric").isin(*IMPACT_METRICS) & F.col("impact").isNotNull()
    size = F.size("locus")
    best = F.max_by(F.when(fits, m), F.when(fits, F.struct(size, "window_end", "candidate_id")))
    per = members.groupBy("incident_id").agg(best.alias("a"), F.max_by(m, F.struct(size, "candidate_id")).alias("b"))
    per = per.withColumn("m", F.coalesce("a", "b"))
    cohort = F.when(F.col("m.change_type") == "new_cohort", F.col("m.scope")).otherwise(F.col("m.locus"))
    return per.select("incident_id", F.col("a.candidate_id").alias("anchor"), F.col("m.window_start").alias("start"), F.col("m.window_end").alias("window_end"), F.col("m.episode_end").alias("end"), cohort.alias("cohort"), F.col("a.impact").alias("impact"))


def lost_successes(anchors: DataFrame) -> DataFrame:
    """value, low and high of each incident's lost successes: its anchor's estimate over the whole episode, never less than once; null if
    the anchor estimates something else."""
    hours = lambda a, b: (F.col(b) - F.col(a)) / 3600.0
    scale = F.greatest(F.lit(1.0), hours("start", "end") / F.greatest(F.lit(1e-9), hours("start", "window_end")))
    counts = F.col("impact.measure") == "lost_successes"
    return anchors.select("incident_id", "anchor", "start", "end", *(F.when(counts, F.round(F.col(f"impact.{c}") * scale, 1)).alias(c) for c in ("value", "low", "high")))


def similar_incidents(incidents: DataFrame, history: DataFrame, offset_s: int = 0, most: int = 5) -> DataFrame:
    """The first ``most`` incidents created before each incident's time of view, of the same metric and with a dimension in common, with their
    status as known then.

    incidents: incident_id, created_at, started_at, metric (the anchor's), first_metric (the first member's) and locus_dims
    as at creation. Only the oldest of each metric and dimension can be among the first, so no incident meets more than
    ``most`` a dimension.
    """
    other = incidents.select(F.col("incident_id").alias("earlier_id"), F.col("created_at").alias("since"), "started_at", F.col("first_metric").alias("metric"), F.explode("locus_dims").alias("dim"))
    oldest = F.row_number().over(W.partitionBy("metric", "dim").orderBy("since", "earlier_id"))
    other = other.withColumn("nth", oldest).where(F.col("nth") <= most).drop("nth")
    view = incidents.select("incident_id", (F.col("created_at") + offset_s).alias("as_of"), "metric", F.explode("locus_dims").alias("dim"))
    met = view.join(other, ["metric", "dim"]).where("since < as_of").dropDuplicates(["incident_id", "earlier_id"])
    first = F.row_number().over(W.partitionBy("incident_id").orderBy("since", "earlier_id"))
    hits = met.withColumn("nth", first).where(F.col("nth") <= most)
    # all rows of one incident's history against the few views of it; views are grouped by (incident, time)
    known = hits.select("earlier_id", "as_of").distinct().join(history.select(F.col("incident_id").alias("earlier_id"), "event_time", "seq", "status"), "earlier_id").where("event_time <= as_of")
    known = known.groupBy("earlier_id", "as_of").agg(F.max_by("status", "seq").alias("status"))
    return hits.join(known, ["earlier_id", "as_of"], "left").select("incident_id", "nth", "earlier_id", "started_at", "status")
