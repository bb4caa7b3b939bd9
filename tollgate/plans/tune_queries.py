"""Registered queries of incident scores and tuning, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialized
from ..operators import decide as g
from ..operators import detect as d
from ..operators import incidents as h
from ..operators import score_incidents as z
from ..operators import tune as t
from ..sources.driver_tables import EPISODES_SQL, TRUTH_SQL, episodes_from_orders, truth_from_suppliers
from .incident_queries import folded
from .investigate_queries import MEMBERS, members
from .queries import QUERIES, SQL, add

DAYS = 27.0
KINDS = ("rate_change", "mix_shift", "insufficient_data", "mixed", "volume_only")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alarm with its strength, change type, impact rate, share and status."""
    cand = d.candidate_rows(episodes_from_orders(spark, sf_dir))
    status = QUERIES["j3_match_status"](spark, sf_dir)
    n = F.col("sample_size")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (n % len(KINDS)).cast("int") + 1)
    rate = F.when(n % 6 != 0, F.greatest(F.lit(0.0), n * F.abs("delta")) / ((F.col("window_end") - F.col("window_start")) / 3600))
    rows = cand.select(F.col("anomaly_id").alias("candidate_id"), g.strength(F.col("score_at_detection")).alias("strength"), kind.alias("change_type"), rate.alias("impact_rate"), g.share(F.col("observed")).alias("locus_share"))
    return rows.join(status, "candidate_id", "left").withColumn("status", F.coalesce("status", F.lit("unmatched")))


def _incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth_from_suppliers(spark, sf_dir).where("expected_route = 'incident' and oracle_detectable_at is not null").select("record_key")


def _case(x: str, steps: tuple, last: str) -> str:
    return f"case when {x} is null then 'not_provided' " + " ".join(f"when {x} < {e} then '{n}'" for e, n in steps) + f" else '{last}' end"


_PLACE = lambda c, names: f"(list_position({list(names)}, {c}) - 1)"
# the grid against every candidate: what the histograms stand for
GRID = f"""with {EPISODES_SQL}, {TRUTH_SQL}, st as ({SQL["j3_match_status"]}),
st2 as (select c.*, coalesce(st.status, 'unmatched') as matched, st.record_key, {_case("abs(score_at_detection)", g.STRENGTH, "strong")} as strength, {list(KINDS)}[sample_size % {len(KINDS)} + 1] as change_type,
  case when sample_size % 6 != 0 then greatest(0.0, sample_size * abs(delta)) / ((window_end - window_start) / 3600.0::double) end as impact_rate, {_case("observed", g.SHARE, "nearly_all")} as locus_share from candidates c left join st on st.candidate_id = c.anomaly_id),
inc as (select record_key from truth where expected_route = 'incident' and oracle_detectable_at is not null),
rk as (select impact_rate, row_number() over (order by impact_rate) - 1 as nth, count(*) over () as n from st2 where impact_rate is not null),
raw_edges as (select q, impact_rate as x from rk join (select unnest([0.25, 0.5, 0.75]) as q) on nth = least(n - 1, cast(floor(n * q) as bigint))),
edges as (select list(case when x = 0 then 0.0 else format('{{:.1e}}', x)::double end::double order by q) as e from raw_edges),
grid as (select s, tn, ts, i, l from (select unnest({list(t.STRENGTHS)}) as s) cross join (select * from (values {", ".join(str((n, list(x))) for n, x in t.TYPES)}) v(tn, ts)) cross join (select unnest({list(t.IMPACTS)}) as i) cross join (select unnest({list(t.LEAST_SHARES)}) as l)),
passed as (select s, tn, i, l, anomaly_id, matched, record_key from grid cross join edges join st2 on {_PLACE("strength", t.STRENGTHS)} >= {_PLACE("s", t.STRENGTHS)} and list_contains(ts, change_type) and {_PLACE("locus_share", t.SHARES)} >= {_PLACE("l", t.SHARES)}
  and impact_rate is not null and len(list_filter(e, lambda y: impact_rate >= y)) >= {_PLACE("i", t.IMPACTS)}),
cells as (select g.s as strength_min, g.tn as change_types, g.i as impact_min, g.l as locus_share_min, count(distinct record_key) filter (where matched = 'incident' and record_key in (select record_key from inc)) / (select count(*) from inc)::double as recall,
  count(anomaly_id) filter (where matched in ('unmatched', 'suppress')) / {DAYS}::double as non_incident_per_day, count(anomaly_id) / {DAYS}::double as incident_per_day from grid g left join passed p on p.s = g.s and p.tn = g.tn and p.i = g.i and p.l = g.l group by all)
"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialized(states(spark, sf_dir), "states")
    return t.passing_grid(rows, _incidents(spark, sf_dir), DAYS, t.impact_edges(rows))


def _tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms made of orders are many, so the budget is so many times the usual one."""
    rows = materialized(states(spark, sf_dir), "states")
    return t.tune_baseline_route(rows, _incidents(spark, sf_dir), DAYS, budget=3.0).drop("edges")


add("k1_passing_grid", _grid, GRID + "select * from cells")
add("k1_tune_baseline_route", _tuned, GRID + f"select * from cells where non_incident_per_day <= 3.0 order by recall desc, incident_per_day, {_PLACE('strength_min', t.STRENGTHS)}, change_types desc, {_PLACE('impact_min', t.IMPACTS)}, locus_share_min limit 1")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth with ids of its own, what a record says it has nothing to do with, and what it cost."""
    k = F.split_part("record_key", F.lit("_"), F.lit(2)).cast("int")
    return truth_from_suppliers(spark, sf_dir).withColumns({
        "truth_id": F.concat(F.lit("ti_"), k), "unrelated_to": F.when(k % 3 != 1, F.array(F.concat(F.lit("ti_"), k + 1), F.concat(F.lit("ti_"), k + 3))).otherwise(F.array().cast("array<string>")),
        "scenario_kind": F.when(k % 7 == 0, z.CAMPAIGN).otherwise(F.col("scenario_kind")), "true_lost": F.when(k % 4 != 0, (k % 50).cast("double")),
    })


def by_day(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """The alarms of a day as an incident that recovers with the last of them."""
    own = materialized(members(spark, sf_dir), "members")
    impact = F.max_by("impact", F.when(F.col("impact").isNotNull(), F.struct("sample_size", "candidate_id")))
    incidents = own.groupBy("incident_id").agg(F.min("seen_at").alias("detected_at"), impact.alias("impact"), F.max("episode_end").alias("over"))
    incidents = materialized(incidents, "incidents")
    events = incidents.select("incident_id", F.col("over").alias("event_time"), F.lit("RECOVERING").alias("status"), F.lit("system").alias("actor"))
    return own.select("incident_id", "candidate_id"), incidents.select("incident_id", "detected_at", "impact"), events


def _scores(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    links, incidents, events = by_day(spark, sf_dir)
    matched = materialized(QUERIES["j3_match_status"](spark, sf_dir).select("candidate_id", "record_key"), "status")
    truth = records(spark, sf_dir)
    scores = z.incident_scores(links, incidents, matched, truth)
    if which == "incidents":
        return scores.drop("impact").withColumn("purity", F.round("purity", 6))
    scores = materialized(scores, "scores")
    per = z.record_scores(scores, links, matched, truth, events)
    if which == "records":
        return per.withColumns({c: F.round(c, 6) for c in ("delay_h", "impact_error")})
    found = z.summary(scores, materialized(per, "record-scores"), events, 0, DAYS)
    return found.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes))


def _folded_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of the incidents that the fold makes of the alarms of all runs."""
    fold, seen = folded(spark, sf_dir)
    named = F.concat_ws("|", "run_id", "incident_id")
    events = h.incident_events(fold).withColumn("incident_id", named)
    links = h.incident_links(fold).where("kind != 'related_to'").select(named.alias("incident_id"), "candidate_id").distinct()
    incidents = events.where("seq = 1").select("incident_id", F.col("event_time").alias("detected_at"), F.lit(None).cast("struct<value:double,low:double,high:double>").alias("impact"))
    matched, truth = materialized(QUERIES["j3_match_status"](spark, sf_dir).select("candidate_id", "record_key"), "status"), records(spark, sf_dir)
    scores = materialized(z.incident_scores(links, incidents, matched, truth), "scores")
    groups = h.digest_items(fold).select("run_id", "digest_group_id").distinct().count()
    return z.summary(scores, materialized(z.record_scores(scores, links, matched, truth, events), "record-scores"), events, groups, DAYS)


_K = "cast(split_part(record_key, '_', 2) as int)"
SCORES = f"""{MEMBERS.rstrip().rstrip(",")}, {TRUTH_SQL}, st as ({SQL["j3_match_status"]}),
rec as (select *, 'ti_' || {_K} as truth_id, case when {_K} % 3 != 1 then ['ti_' || ({_K} + 1), 'ti_' || ({_K} + 3)] else [] end as unrelated_to, case when {_K} % 7 = 0 then '{z.CAMPAIGN}' else scenario_kind end as kind2, case when {_K} % 4 != 0 then ({_K} % 50)::double end as true_lost from truth),
inc as (select incident_id, min(seen_at) as detected_at, arg_max({{'v': sample_size::double, 'l': sample_size / 2.0::double, 'h': sample_size * 2.0::double}}, {{'n': sample_size, 'c': candidate_id}}) filter (where mem.some) as impact, max(episode_end) as over, count(*) as members from mem group by 1),
held as (select incident_id, record_key, count(*) as n from mem join st using (candidate_id) group by 1, 2),
hr as (select * from held join rec using (record_key)),
mains as (select incident_id, arg_max({{'key': record_key, 'route': expected_route, 'n': n}}, {{'i': expected_route = 'incident', 'n': n, 's': -start, 'k': record_key}}) as m from hr group by 1),
wrong as (select a.incident_id, bool_or('{z.CAMPAIGN}' in (a.kind2, b.kind2)) as campaign from hr a join hr b on a.incident_id = b.incident_id and a.record_key != b.record_key and list_contains(a.unrelated_to, b.truth_id) group by 1),
scores as (select i.incident_id, members, m.key as main, coalesce(m.route, 'unmatched') as main_route, coalesce(m.n / members::double, 0.0) as purity, w.campaign is not null as wrong_merge, coalesce(w.campaign, false) as campaign_merge, detected_at, impact, over from inc i left join mains using (incident_id) left join wrong w using (incident_id)),
own as (select main as record_key, count(*) as mains, min(over) as back, arg_min(impact, {{'m': -members, 'i': incident_id}}) filter (where impact is not null) as impact from scores where main is not null group by 1),
met as (select record_key, min(detected_at) as created from held join inc using (incident_id) group by 1),
recs as (select r.record_key, kind2 as scenario_kind, created is not null as covered, case when created is not null then greatest(0, coalesce(mains, 0) - 1) end as duplicates, case when created is not null then (created - greatest(start, oracle_detectable_at)) / 3600.0::double end as delay_h,
  case when created is not null and mains > 0 and coalesce(expected_recovery, stop) is not null then coalesce(abs(back - coalesce(expected_recovery, stop)) <= {z.RECOVERY_TOLERANCE}, false) end as recovered_in_time,
  case when created is not null and impact is not null and true_lost != 0 then abs(impact.v - true_lost) / true_lost end as impact_error, case when created is not null and impact is not null and true_lost != 0 then true_lost between impact.l and impact.h end as impact_covered
  from rec r left join met using (record_key) left join own using (record_key) where expected_route = 'incident' and oracle_detectable_at is not null)
"""
add("j8_incident_scores", lambda s, sf: _scores(s, sf, "incidents"), SCORES + "select * exclude (impact, over) replace (round(purity, 6) as purity) from scores")
add("j8_record_scores", lambda s, sf: _scores(s, sf, "records"), SCORES + "select * replace (round(delay_h, 6) as delay_h, round(impact_error, 6) as impact_error) from recs")
_FALSE = "count(*) filter (where main_route in ({}))"
add("j8_score_incidents", lambda s, sf: _scores(s, sf, "all"), SCORES + f"""select i.*, r.*, l.*, 0::bigint as terminal_by_system from
(select count(*) as incidents, round(count(*) / {DAYS}::double, 6) as incidents_per_day, round({_FALSE.format("'unmatched', 'suppress'")} / {DAYS}::double, 6) as false_incidents_per_day, round({_FALSE.format("'watch'")} / {DAYS}::double, 6) as watch_incidents_per_day, 0.0::double as digest_groups_per_day,
  round(avg(purity), 6) as purity, round(avg(wrong_merge::int), 6) as wrong_merge_rate, count(*) filter (where wrong_merge) as wrong_merges, count(*) filter (where campaign_merge) as campaign_merges from scores) i,
(select count(*) as incident_records_scored, count(*) filter (where covered) as covered, round(avg(covered::int), 6) as coverage, round(avg(duplicates), 6) as duplicates_per_covered, sum(duplicates)::bigint as duplicates, round(median(delay_h), 6) as creation_delay_h_median, round(avg(recovered_in_time::int), 6) as recovery_within_6h,
  count(recovered_in_time) as recovery_scored, round(median(impact_error), 6) as lost_payments_median_rel_error, round(avg(impact_covered::int), 6) as lost_payments_interval_coverage from recs) r,
(select round(min(delay_h), 6) as creation_delay_h_p90 from (select delay_h, row_number() over (order by delay_h) - 1 as nth, count(*) over () as n from recs where delay_h is not null) where nth = least(n - 1, cast(floor(n * 0.9) as bigint))) l""")
add("j8_scores_of_the_fold", _folded_summary)
