"""What else happened around an onset, outcomes of measured checks, and the incident lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import materialized

#: Fixed values.
SERVICES = ("api_gateway", "checkout_web", "renewal_job", "dunning_service", "refund_service", "pricing_service", "ledger", "mobile_ios", "mobile_android")
MOST_ROWS = 50
AROUND, STATUS_BEFORE = 7_200, 21_600
MOVED, UNCHANGED = 2.0, 1.0
TRANSITIONS = (
    ("DETECTED", "INVESTIGATING", "system"), ("DETECTED", "ACKNOWLEDGED", "human"), ("INVESTIGATING", "ACKNOWLEDGED", "human"), ("ACKNOWLEDGED", "ESCALATED", "human"), ("ACKNOWLEDGED", "ESCALATED", "policy"),
    ("INVESTIGATING", "ESCALATED", "human"), ("INVESTIGATING", "ESCALATED", "policy"), ("DETECTED", "RECOVERING", "system"), ("INVESTIGATING", "RECOVERING", "system"), ("ACKNOWLEDGED", "RECOVERING", "system"), ("ESCALATED", "RECOVERING", "system"), ("RECOVERING", "INVESTIGATING", "system"),
    *((s, t, "human") for s in ("DETECTED", "INVESTIGATING", "ACKNOWLEDGED", "ESCALATED", "RECOVERING") for t in ("RESOLVED", "DISMISSED")),
)


def _first_rows(met: DataFrame, at: str) -> DataFrame:
    return met.withColumn("nth", F.row_number().over(W.partitionBy("incident_id").orderBy(at, "id"))).where(F.col("nth") <= MOST_ROWS).drop("nth")


def _places(points: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of points (t, id) with their place in that order, from 1, and of asked (t, id) with the number of points before t.

    A sweep inside hours, with what earlier hours hold carried over.
    """
    cell = F.floor(F.col("t") / 3600)
    every = points.withColumn("point", F.lit(1)).unionByName(asked.withColumn("point", F.lit(0)), allowMissingColumns=True).withColumn("cell", cell)
    every = materialized(every.where("t is not null"), "sweep")
    held = every.groupBy("cell").agg(F.sum("point").alias("own"))
    before = held.select("cell", F.coalesce(F.sum("own").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row an hour
    own = F.sum("point").over(W.partitionBy("cell").orderBy("t", "point", "id").rowsBetween(W.unboundedPreceding, W.currentRow))
    return materialized(every.withColumn("own", own).join(before, "cell").withColumn("place", F.col("own") + F.col("before")).drop("cell", "own", "before"), "places")


def deployments_near(incidents: DataFrame, deployments: DataFrame) -> DataFrame:
    """Deployments within two hours of each onset, known at as_of, at most fifty.

    The first fifty after a time are fifty places in the order of all deployments: an onset meets two blocks of places,
    however many deployments its hours hold.
    """
    points = deployments.where(F.col("service").isin(*SERVICES)).select(F.col("deployed_at").alias("t"), "id", "service")
    asked = incidents.select((F.col("onset") - AROUND).alias("t"), F.col("incident_id").alias("id"), "onset", "as_of")
    placed = _places(points, asked)
    block = lambda p: F.floor(p / MOST_ROWS)
    n = F.col("skip")
    a = placed.where("point = 0").select(F.col("id").alias("incident_id"), "onset", "as_of", F.col("place").alias("skip")).withColumn("b", F.explode(F.sequence(block(n), block(n + MOST_ROWS - 1))))
    known = placed.where("point = 1").select("id", "service", F.col("t").alias("deployed_at"), "place", block(F.col("place") - 1).alias("b"))
    near = F.col("deployed_at") <= F.least(F.col("onset") + AROUND, F.col("as_of"))
    met = a.join(known, "b").where((F.col("place") > n) & (F.col("place") <= n + MOST_ROWS) & near)
    return _first_rows(met.select("incident_id", "id", "service", "deployed_at"), "deployed_at")


def status_near(incidents: DataFrame, status: DataFrame) -> DataFrame:
    """Provider status entries posted by as_of that reach into the six hours before an onset; a later resolution reads as unresolved.

    Of open ones a provider's first fifty are enough: any later one comes after fifty rows that match wherever it does, and
    so does any resolved one that was posted after them. The resolved ones before meet incidents by an equi-join on
    provider (psp) and time bucket, each pair in one bucket only.
    """
    since = F.col("onset") - STATUS_BEFORE
    bucket = lambda t: F.floor(t / STATUS_BEFORE)
    asked = incidents.select("incident_id", "psp", "onset", "as_of", F.least(since, "as_of").alias("i_low"), F.explode(F.sequence(bucket(F.least(since, "as_of")), bucket(F.greatest(since, "as_of")))).alias("b"))
    early = status.where("posted_at is not null and resolved_at is null").withColumn("nth", F.row_number().over(W.partitionBy("psp").orderBy("posted_at", "id"))).where(F.col("nth") <= MOST_ROWS)
    full = early.where(F.col("nth") == MOST_ROWS).select("psp", F.struct("posted_at", "id").alias("enough"))
    low, high = F.least("posted_at", "resolved_at"), F.greatest("posted_at", "resolved_at")
    ended = status.where("posted_at is not null and resolved_at is not null").join(F.broadcast(full), "psp", "left").where(F.col("enough").isNull() | (F.struct("posted_at", "id") < F.col("enough"))).select("id", "psp", "posted_at", "resolved_at", low.alias("s_low"), F.explode(F.sequence(bucket(low), bucket(high))).alias("b"))
    met = asked.join(ended, ["psp", "b"]).where((F.col("b") == bucket(F.greatest("i_low", "s_low"))) & (F.col("posted_at") <= F.col("as_of")) & (F.col("resolved_at") >= since))
    still = incidents.join(F.broadcast(early), "psp").where(F.col("posted_at") <= F.col("as_of"))
    columns = ("incident_id", "id", "psp", "posted_at", "resolved_at", "as_of")
    met = met.select(*columns).unionByName(still.select(*columns))
    seen = F.when(F.col("resolved_at") <= F.col("as_of"), F.col("resolved_at"))
    return _first_rows(met.select("incident_id", "id", "psp", "posted_at", seen.alias("resolved_at")), "posted_at")


def outcome(z: Column, direction: Column) -> Column:
    """moved, opposite, unchanged, ambiguous, or insufficient without a z."""
    toward = F.when(direction == "up", z).otherwise(-z)
    return F.when(z.isNull(), "insufficient").when(toward >= MOVED, "moved").when(toward <= -MOVED, "opposite").when(F.abs(z) < UNCHANGED, "unchanged").otherwise("ambiguous")


def lifecycle_check(events: DataFrame) -> DataFrame:
    """Transitions (incident_id, seq, before, status, actor) that the lifecycle doesn't allow for their actor."""
    allowed = events.sparkSession.createDataFrame(TRANSITIONS, "before string, status string, actor string")
    own = W.partitionBy("incident_id").orderBy("seq")
    moves = events.withColumn("before", F.lag("status").over(own)).where("before is not null and before != status")
    return moves.join(F.broadcast(allowed), ["before", "status", "actor"], "left_anti").select("incident_id", "seq", "before", "status", "actor")
