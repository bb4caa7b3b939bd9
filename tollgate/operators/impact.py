"""What incidents cost: revenue in an episode against the same hours of earlier days, and the statement of an incident's impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.driver_tables import DAY
from .investigate import dims_of

#: The days back that an episode is held against, and when the furthest of them is left out.
LAGS = (2, 3, 4, 5, 6, 7, 8)
TRIM_FROM, FEWEST = 4, 2
CAPTURED = "payment.captured"


def _hour(at: Column) -> Column:
    return at - F.pmod(at, F.lit(3600))


def _key(pairs: Column) -> Column:
    return F.array_join(F.array_sort(pairs), ",")


def hourly_revenue(norm: DataFrame, sets: DataFrame) -> DataFrame:
    """cohort, currency, hour and minor of every cohort of the sets of dimensions (sets: one array column, dims).

    Events fold to hours and cells first; only cells, not events, are counted once a set.
    """
    names = sorted(set(norm.columns) & {"customer_country", "issuer_country", "currency", "psp", "payment_method_type", "card_brand", "platform", "app_version", "plan_id", "channel"})
    cells = norm.where(F.col("event_type") == CAPTURED).groupBy(*names, _hour(F.col("occurred_at")).alias("hour")).agg(F.sum("amount_minor").alias("minor"))
    value = F.create_map(*(x for n in names for x in (F.lit(n), F.col(n).cast("string"))))
    each = cells.withColumn("of", value).crossJoin(F.broadcast(sets.select("dims").distinct()))  # at most the subsets of ten dimensions
    place = _key(F.transform("dims", lambda d: F.concat_ws("=", d, F.col("of")[d])))
    return each.groupBy(place.alias("cohort"), "currency", "hour").agg(F.sum("minor").alias("minor"))


def revenue_baseline(targets: DataFrame, norm: DataFrame, world_start: int) -> DataFrame:
    """incident_id, currency, observed_minor, baseline_minor, lost_minor, low and high of every currency with revenue.

    targets: incident_id, start, end and cohort (array of dimension=value; empty is all traffic). The baseline is the mean
    of the same hours 2 to 8 days before, as far as they lie after world_start; of four or more the one furthest from
    their upper median (of equally far ones the most recent) is left out; with fewer than two a currency is left out.
    Times count as whole hours. Targets without a start or an end, or that end no later than they start, give no row.
    Targets meet cells by cohort and day, so a target costs as many rows as its days have hours.
    """
    first = _hour(F.lit(world_start).cast("bigint"))
    t = targets.where("end > start").select("incident_id", _hour(F.col("start")).alias("s"), (_hour(F.col("end") - 1) + 3600).alias("e"), _key("cohort").alias("cohort"), F.array_sort(dims_of(F.col("cohort"))).alias("dims"))
    t = t.withColumn("from", F.greatest(first, F.col("s") - max(LAGS) * DAY))
    cells = hourly_revenue(norm, t.select("dims")).withColumn("day", F.floor(F.col("hour") / DAY))
    days = t.where("from < e").withColumn("day", F.explode(F.sequence(F.floor(F.col("from") / DAY), F.floor((F.col("e") - 1) / DAY)))).drop("dims")
    met = days.join(cells, ["cohort", "day"]).where("hour >= from and hour < e")
    within = lambda k: F.coalesce(F.sum(F.when(F.col("hour").between(F.col("s") - k * DAY, F.col("e") - k * DAY - 1), F.col("minor"))), F.lit(0).cast("bigint"))
    per = met.groupBy("incident_id", "s", "e", "from", "currency").agg(within(0).alias("observed_minor"), *(within(k).alias(f"lag_{k}") for k in LAGS))
    refs = F.array_compact(F.array(*(F.when(F.col("s") - k * DAY >= F.col("from"), F.col(f"lag_{k}")) for k in LAGS)))
    per = per.withColumn("refs", refs).where(F.size("refs") >= FEWEST)
    per = per.withColumn("mid", F.get(F.array_sort("refs"), F.floor(F.size("refs") / 2).cast("int")))
    away = F.transform("refs", lambda x: F.abs(x - F.col("mid")))
    per = per.withColumn("out", F.when(F.size("refs") >= TRIM_FROM, F.array_position(away, F.array_max(away)) - 1))
    kept = F.filter("refs", lambda x, i: F.col("out").isNull() | (i != F.col("out")))
    per = per.withColumn("kept", F.transform(kept, lambda x: x.cast("double")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    per = per.withColumn("base", total("kept") / F.size("kept"))
    per = per.withColumn("sd", F.sqrt(total(F.transform("kept", lambda x: (x - F.col("base")) * (x - F.col("base")))) / F.size("kept")))
    whole = lambda c: F.bround(c).cast("bigint")
    gap, spread = F.col("base") - F.col("observed_minor"), 1.96 * F.col("sd")
    return per.select("incident_id", "currency", "observed_minor", whole(F.col("base")).alias("baseline_minor"), whole(gap).alias("lost_minor"), whole(F.col("base") - spread - F.col("observed_minor")).alias("low"), whole(F.col("base") + spread - F.col("observed_minor")).alias("high"))


def incident_impact(anchors: DataFrame, lost: DataFrame, revenue: DataFrame) -> DataFrame:
    """One row an incident: what was measured, the estimate of lost payments, and the revenue that was captured, by currency.

    anchors: impact_anchor's rows; lost: lost_successes' rows; revenue: revenue_baseline's rows. Lost revenue isn't told, as
    its estimate errs by more than itself; captured revenue is observed (an empty map where no currency has a baseline).
    """
    captured = revenue.groupBy("incident_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("currency", "observed_minor")))).alias("captured_revenue_minor"))
    told = lost.select("incident_id", F.col("value").alias("lost_payments"), F.col("low").alias("lost_low"), F.col("high").alias("lost_high"))
    none = F.create_map().cast("map<string,bigint>")
    every = anchors.join(told, "incident_id", "left").join(captured, "incident_id", "left")
    return every.select(
        "incident_id", "anchor", "start", "end", F.round((F.col("end") - F.col("start")) / 3600, 2).alias("hours"), "cohort", "lost_payments", "lost_low", "lost_high",
        F.lit("not_provided").alias("lost_revenue"), F.coalesce("captured_revenue_minor", none).alias("captured_revenue_minor"),
    )
