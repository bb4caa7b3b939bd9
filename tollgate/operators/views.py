"""Incidents as they were known at a time: at their creation, or so long after it, with each member's last look by then."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .investigate import IMPACT_METRICS

KEY = ["run_id", "incident_id", "offset_s"]


def view_members(events: DataFrame, links: DataFrame, looks: DataFrame, offsets: Sequence[int] = (0,)) -> DataFrame:
    """One row a view and a member known in it: the view's as_of, seq and status, and the columns of the member's last look by then.

    events: run_id, incident_id, seq, event_time, status and step. links: run_id, incident_id, candidate_id, kind and step; a
    link counts from its step on, related_to never. looks: run_id, candidate_id, time, nth (0 detected, 1 checkpoint: of one
    time the later counts) and what was known. A view stands an offset after the incident's first row; all offsets are one
    job. A member without a look by then isn't known and gives no row. Members stay rows, as an incident's may be many.
    """
    born = events.groupBy("run_id", "incident_id").agg(F.min_by("event_time", "seq").alias("created_at"))
    at = born.withColumn("offset_s", F.explode(F.array(*(F.lit(o).cast("bigint") for o in offsets)))).withColumn("as_of", F.col("created_at") + F.col("offset_s"))
    met = at.join(events.select("run_id", "incident_id", "seq", "event_time", "status", "step"), ["run_id", "incident_id"]).where("event_time <= as_of")
    then = met.groupBy(*KEY, "as_of").agg(F.max_by(F.struct("seq", "status", F.col("step").alias("until")), "seq").alias("e")).select(*KEY, "as_of", "e.*")
    own = links.where("kind != 'related_to'").groupBy("run_id", "incident_id", "candidate_id").agg(F.min("step").alias("since"))
    known = then.join(own, ["run_id", "incident_id"]).where("since <= until").drop("since", "until")
    rest = [c for c in looks.columns if c not in ("run_id", "candidate_id", "time", "nth")]
    seen = looks.select("run_id", "candidate_id", "time", "nth", F.struct(*rest).alias("look"))
    last = known.join(seen, ["run_id", "candidate_id"]).where("time <= as_of").groupBy(*KEY, "as_of", "seq", "status", "candidate_id").agg(F.max_by("look", F.struct("time", "nth")).alias("look"), F.max("time").alias("seen_at"))
    return last.select(*KEY, "as_of", "seq", "status", "candidate_id", "seen_at", "look.*")


def incident_views(members: DataFrame) -> DataFrame:
    """A row a view of view_members' rows: as_of, seq, status, started_at, members (their number) and the anchor's columns, anchor_*.

    The anchor is the member of the finest locus among those with an impact in payments or conversion (ties: the later window,
    then the id), or among all if there is none (ties: the earlier start, then the id). Members also have metric, direction,
    locus, start, window_end and impact (null if none). Views without a known member don't exist.
    """
    what = [c for c in ("candidate_id", "metric", "direction", "locus", "start", "window_end")]
    m = F.struct(*what)
    fits = F.col("metric").isin(*IMPACT_METRICS) & F.col("impact").isNotNull()
    size = F.coalesce(F.size("locus"), F.lit(0))
    per = members.groupBy(*KEY, "as_of", "seq", "status").agg(
        F.count("*").alias("members"), F.min("start").alias("started_at"), F.max_by(F.when(fits, m), F.when(fits, F.struct(size, "window_end", "candidate_id"))).alias("a"),
        F.max_by(m, F.struct(size, -F.col("start"), "candidate_id")).alias("b"),
    )
    anchor = F.coalesce("a", "b")
    return per.select(*KEY, "as_of", "seq", "status", "members", "started_at", *(anchor[c].alias("anchor" if c == "candidate_id" else f"anchor_{c}") for c in what))
