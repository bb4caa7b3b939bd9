"""Registered queries of incidents as known at their creation and later: those of a day, with DuckDB twins, and those of the fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import materialized
from ..operators import incidents as h
from ..operators import views as w
from ..operators.investigate import IMPACT_METRICS
from .incident_queries import folded
from .investigate_queries import MEMBERS, members
from .queries import add

OFFSETS = (0, 21_600, 86_400)


def by_day(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The alarms of a day as an incident of seven merchants: a row and a link whenever one is detected; its locus is known when it ends."""
    own = members(spark, sf_dir).withColumn("run_id", F.concat(F.lit("run_"), F.substring("incident_id", 5, 10).cast("bigint") % 7))
    own = materialized(own.withColumn("step", F.row_number().over(W.partitionBy("incident_id").orderBy("seen_at", "candidate_id"))), "members")
    events = own.select("run_id", "incident_id", F.col("step").alias("seq"), F.col("seen_at").alias("event_time"), F.when(F.col("step") > 1, "ACTIVE").otherwise("OPEN").alias("status"), "step")
    links = own.select("run_id", "incident_id", "candidate_id", F.when(F.col("sample_size") % 11 == 0, "related_to").otherwise("join").alias("kind"), "step")
    base = own.select("run_id", "candidate_id", "metric", "direction", "scope", "locus", F.col("window_start").alias("start"), "window_end", "impact", "seen_at", "episode_end")
    none = F.lit(None).cast(base.schema["impact"].dataType)
    first = base.withColumns({"time": F.col("seen_at"), "nth": F.lit(0), "locus": F.col("scope"), "impact": none})
    later = base.where("episode_end > seen_at").withColumns({"time": F.col("episode_end"), "nth": F.lit(1)})
    return events, links, first.unionByName(later).drop("seen_at", "episode_end", "scope")


def _day_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.view_members(*by_day(spark, sf_dir), OFFSETS)


def _of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold, seen = folded(spark, sf_dir)
    known = seen.select("run_id", "candidate_id", "time", "nth", "metric", "direction", "locus", "start", "window_end").withColumn("impact", F.when(F.col("metric").isin(*IMPACT_METRICS), F.lit(1)))
    found = w.incident_views(w.view_members(h.incident_events(fold), h.incident_links(fold), known, OFFSETS))
    return found.withColumn("anchor_locus", F.array_join("anchor_locus", ","))


VIEWS = MEMBERS + f""", own as (select *, 'run_' || (cast(incident_id[5:] as bigint) % 7) as run_id, row_number() over (partition by incident_id order by seen_at, candidate_id) as step from mem),
born as (select run_id, incident_id, arg_min(seen_at, step) as created_at from own group by 1, 2),
at_ as (select *, created_at + offset_s as as_of from born, (select unnest({list(OFFSETS)}) as offset_s)),
last as (select a.run_id, a.incident_id, offset_s, as_of, max(step) as seq from at_ a join own o on a.incident_id = o.incident_id and seen_at <= as_of group by 1, 2, 3, 4),
vm as (select l.*, case when seq > 1 then 'ACTIVE' else 'OPEN' end as status, candidate_id, metric, direction, window_start as start, window_end, episode_end > o.seen_at and episode_end <= as_of as ended,
  case when ended then episode_end else o.seen_at end as known_at, case when ended then locus else scope end as locus, ended and o."some" as costs from last l join own o on l.incident_id = o.incident_id and step <= seq and sample_size % 11 != 0 and o.seen_at <= as_of)
"""
_BY_KEY = "run_id, incident_id, offset_s, as_of, seq, status"
add("i2_view_members", lambda s, sf: _day_members(s, sf).select(*_BY_KEY.split(", "), "candidate_id", "seen_at", "metric", F.array_join("locus", ",").alias("locus"), F.col("impact").isNotNull().alias("costs")), VIEWS + f"select {_BY_KEY}, candidate_id, known_at as seen_at, metric, array_to_string(locus, ',') as locus, costs from vm")
add("i2_incident_views", lambda s, sf: w.incident_views(_day_members(s, sf)).withColumn("anchor_locus", F.array_join("anchor_locus", ",")), VIEWS + f""", views as (select {_BY_KEY}, count(*) as members, min(start) as started_at,
  coalesce(arg_max(v, {{'n': len(v.locus), 'w': v.window_end, 'c': v.candidate_id}}) filter (where v.costs and v.metric in {IMPACT_METRICS}), arg_max(v, {{'n': len(v.locus), 's': -v.start, 'c': v.candidate_id}})) as a from (select *, vm as v from vm) group by {_BY_KEY})
select {_BY_KEY}, members, started_at, a.candidate_id as anchor, a.metric as anchor_metric, a.direction as anchor_direction, array_to_string(a.locus, ',') as anchor_locus, a.start as anchor_start, a.window_end as anchor_window_end from views""")
add("i2_views_of_the_fold", _of_fold)
