"""Registered queries of scoring and streaming, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialized
from ..operators import correlate as c
from ..operators import detect as d
from ..operators import evaluate as v
from ..operators import metrics as m
from ..sources.driver_tables import DAY, EPISODES_SQL, EPOCH_2024, NORM_SQL, PLANTED, TRUTH_SQL, episodes_from_orders, truth_from_suppliers
from ..streaming.first_look import stream_first_look
from .decide_queries import LABELS, labels
from .queries import END, START, add, norm


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of each provider by hour against another that nothing was planted in."""
    rows = norm(spark, sf_dir).where(m.ATTEMPTS).withColumn("hour", F.floor(F.col("occurred_at") / 3600))
    ok = F.count_if(F.col("event_type") == "payment.authorized")
    per = rows.groupBy("psp", "hour").agg(F.count("*").alias("n"), ok.alias("k"))
    other = per.where("psp = 'psp_alpha'").select("hour", F.col("n").alias("n_cf"), F.col("k").alias("k_cf"))
    return per.where("psp != 'psp_alpha'").join(other, "hour").select(F.col("psp").alias("series"), F.lit(PLANTED[0]).alias("start"), "hour", "n", "k", "n_cf", "k_cf")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select(F.col("incident_p").alias("p"), (F.col("candidate_id") == "planted").alias("y"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays normalized events through the stream; the windows that closed. Files land in no order here, so one batch takes them."""
    source = materialized(norm(spark, sf_dir), "delivered")
    folder = source.inputFiles()[0].rsplit("/", 1)[0]
    name = f"first_look_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(source.schema).parquet(folder)
    out = f"{folder}-out-{name}"
    found = stream_first_look(stream, m.METRICS["authorization_rate", 1], "1d", ("psp",))
    found.writeStream.format("parquet").option("checkpointLocation", f"{folder}-state-{name}").outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("window_start bigint, psp string, numerator bigint, denominator bigint").parquet(out)


WITH = f"with {NORM_SQL}"
add("j14_first_crossing", lambda s, sf: v.first_crossing(hourly(s, sf), "rate"), WITH + f""", per as (select psp, occurred_at // 3600 as hour, count(*) as n, count(*) filter (where event_type = 'payment.authorized') as k from norm where {m.ATTEMPTS} group by 1, 2),
h as (select a.psp as series, a.hour, a.n, a.k, b.n as n_cf, b.k as k_cf from per a join per b using (hour) where a.psp != 'psp_alpha' and b.psp = 'psp_alpha'),
c as (select series, hour, sum(n) over w as n, sum(k) over w as k, sum(n_cf) over w as n_cf, sum(k_cf) over w as k_cf from h where (hour + 1) * 3600 > {PLANTED[0]} window w as (partition by series order by hour)),
z as (select *, case when k_cf > 0 and k_cf < n_cf then (k_cf / n_cf * n - k) / sqrt(n * (k_cf / n_cf) * (1 - k_cf / n_cf)) end as z from c)
select series, min(case when z >= 3 then greatest({PLANTED[0]}, (hour + 1) * 3600) end) as detectable_at from (select distinct series from h) left join z using (series) group by 1""")
add("j5_calibration", lambda s, sf: v.calibration(scored(s, sf)).withColumns({"mean_p": F.round("mean_p", 6), "observed": F.round("observed", 6)}), LABELS + "select least(9, cast(floor(incident_p * 10) as bigint)) as bin, count(*) as n, round(avg(incident_p), 6) as mean_p, round(avg(case when candidate_id = 'planted' then 1.0 else 0.0 end), 6) as observed from labels group by 1")
add("j5_brier", lambda s, sf: v.brier(scored(s, sf)).withColumn("brier", F.round("brier", 6)), LABELS + "select round(avg(pow(incident_p - case when candidate_id = 'planted' then 1.0 else 0.0 end, 2)), 6) as brier from labels")
add("s2_stream_first_look", streamed)


WORLD_END = EPOCH_2024 + 10_000 * DAY


def _cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.link_parent(d.prefilter_low_volume(d.candidate_rows(episodes_from_orders(spark, sf_dir)))).where("status != 'suppressed'")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(v.match_truth(_cand(spark, sf_dir), truth_from_suppliers(spark, sf_dir), WORLD_END), "matches")


def _records(spark: SparkSession, sf_dir: str, matches: DataFrame) -> DataFrame:
    return v.record_outcomes(_cand(spark, sf_dir), truth_from_suppliers(spark, sf_dir), matches, START, WORLD_END)


def _classes(spark: SparkSession, sf_dir: str, matches: DataFrame) -> DataFrame:
    return v.candidate_classes(_cand(spark, sf_dir), truth_from_suppliers(spark, sf_dir), matches)


def _score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _matches(spark, sf_dir)
    records = materialized(_records(spark, sf_dir, found), "records")  # read three times
    one = v.score_detection(records, _classes(spark, sf_dir, found), START, WORLD_END)
    return one.withColumns({n: F.round(n, 6) for n in ("recall", "false_positives_per_day")})


_FAMILY = "case metric " + " ".join(f"when '{m_}' then {list(names)}" for m_, names in v.FAMILIES) + " else [] end"
MATCHES = f"""with {EPISODES_SQL}, {TRUTH_SQL}, c as (select *, {_FAMILY} as family from linked where status != 'suppressed'), t as (select *, greatest(coalesce(stop, {WORLD_END}), coalesce(expected_recovery, 0)) as until from truth),
met as (select anomaly_id, record_key, case when len(list_intersect(family, affected_metrics)) > 0 or list_contains(affected_metrics, 'ingestion_delay') then 'affected' when len(list_intersect(family, unchanged_metrics)) > 0 then 'unchanged' end as relation
  from c join t on window_start < until and start < window_end and detected_at >= start where scope = '' or len(list_filter(string_split(cohorts, '|'), lambda x: x != '' and (not contains(x, split_part(scope, '=', 1) || '=') or list_contains(string_split(x, ','), scope)))) > 0),
matches as (select * from met where relation is not null),
hits as (select record_key, min(detected_at) as first, count(*) as n from matches join c using (anomaly_id) where relation = 'affected' group by 1),
records as (select record_key, scenario_kind, case when oracle_detectable_at is null then 'oracle_null' when first is not null then 'detected' when until <= {START + v.WARM_UP} then 'warm_up' else 'missed' end as outcome, first - greatest(start, coalesce(oracle_detectable_at, start)) as latency_s, coalesce(n, 0) as n_candidates from t left join hits using (record_key) where expected_route = 'incident'),
per as (select anomaly_id, list_sort(list(distinct record_key) filter (where relation = 'affected' and expected_route = 'incident')) as i, list_sort(list(distinct record_key) filter (where relation = 'affected' and expected_route = 'watch')) as w, list_sort(list(distinct scenario_kind) filter (where relation = 'affected' and expected_route = 'suppress')) as s, list_sort(list(distinct record_key) filter (where relation = 'unchanged')) as u from matches join truth using (record_key) group by 1),
classes as (select anomaly_id, series, metric, scope, detected_at, case when len(i) > 0 then 'true_positive' when len(w) > 0 then 'watch' when len(s) > 0 then 'fp_suppress' when len(u) > 0 then 'fp_unchanged_metric' else 'fp_unmatched' end as class,
  case when len(i) > 0 then array_to_string(i, ',') when len(w) > 0 then array_to_string(w, ',') when len(s) > 0 then array_to_string(s, ',') when len(u) > 0 then array_to_string(u, ',') else '' end as detail from c left join per using (anomaly_id))
"""
add("j1_match_truth", _matches, MATCHES + "select * from matches")
add("j2_record_outcomes", lambda s, sf: _records(s, sf, _matches(s, sf)), MATCHES + "select * from records")
add("j2_candidate_classes", lambda s, sf: _classes(s, sf, _matches(s, sf)), MATCHES + "select * from classes")
add("j2_score_detection", _score, MATCHES + f"""select r.*, p.*, k.*, round(detected::double / incidents_scored, 6) as recall, round(false_positives / {(WORLD_END - START - v.WARM_UP) / DAY}, 6) as false_positives_per_day from
(select count(*) filter (where outcome != 'oracle_null') as incidents_scored, count(*) filter (where outcome = 'oracle_null') as incidents_oracle_null, count(*) filter (where outcome = 'detected') as detected, count(*) filter (where outcome = 'warm_up') as missed_warm_up, count(*) filter (where outcome = 'missed') as missed, quantile_cont(latency_s, 0.5) filter (where outcome = 'detected') as latency_median_s from records) r,
(select latency_s as latency_p90_s from (select latency_s, row_number() over (order by latency_s) - 1 as nth, count(*) over () as n from records where outcome = 'detected') where nth = least(n - 1, cast(floor(n * 0.9) as bigint))) p,
(select count(*) as candidates, count(*) filter (where class like 'fp%') as false_positives, count(*) filter (where class = 'fp_unmatched') as fp_unmatched, count(*) filter (where class = 'fp_suppress') as fp_suppress, count(*) filter (where class = 'fp_unchanged_metric') as fp_unchanged_metric, count(*) filter (where class = 'watch') as watch_hits from classes) k""")
add("j3_match_status", lambda s, sf: v.match_status(_matches(s, sf).where("relation = 'affected'").withColumnRenamed("anomaly_id", "candidate_id").join(truth_from_suppliers(s, sf).select("record_key", "expected_route", "start"), "record_key")), MATCHES + """select anomaly_id as candidate_id, record_key, expected_route as status from (select *, row_number() over (partition by anomaly_id order by case expected_route when 'incident' then 0 when 'watch' then 1 else 2 end, start, record_key) as nth from matches join truth using (record_key) where relation = 'affected') where nth = 1""")
_ROOT = "case when size(affected_cohorts) > 0 then element_at(affected_cohorts, 1) else cast(map() as map<string,array<string>>) end"


def _localized(spark: SparkSession, sf_dir: str) -> DataFrame:
    # matches pack to little on disk and to much in memory: never broadcast
    met = _matches(spark, sf_dir).join(_cand(spark, sf_dir).select("anomaly_id", F.col("scope").alias("locus")).hint("merge"), "anomaly_id")
    roots = truth_from_suppliers(spark, sf_dir).select("record_key", F.expr(_ROOT).alias("root"))
    return v.localization_class(met.join(roots, "record_key")).select("anomaly_id", "record_key", "locus", "class")


add("j6_localization_class", _localized, MATCHES + """, l as (select anomaly_id, record_key, scope as locus, string_split(cohorts, '|') as cs from matches join c using (anomaly_id) join truth using (record_key)),
m as (select *, case when len(cs) > 1 then string_split(cs[2], ',') else [] end as root from l), n as (select *, list_distinct(list_transform(root, lambda x: split_part(x, '=', 1))) as theirs from m)
select anomaly_id, record_key, locus, case when locus = '' then case when len(theirs) > 0 then 'coarse' else 'exact' end when list_contains(theirs, split_part(locus, '=', 1)) then case when not list_contains(root, locus) then 'wrong' when len(theirs) > 1 then 'coarse' else 'exact' end when len(theirs) > 0 then 'wrong' else 'over_specific' end as class from n""")


def _hourly_cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms of an hour or less; every third is on one platform of its scope."""
    c = d.candidate_rows(episodes_from_orders(spark, sf_dir)).where("grain != '1d'")
    return c.withColumn("locus", F.when((F.col("window_start") / 900 % 3 == 0) & ~F.col("scope").contains("platform"), F.concat_ws(",", F.when(F.col("scope") != "", F.col("scope")), F.lit("platform=web"))).otherwise(F.col("scope")))


def _pairs(spark: SparkSession, sf_dir: str, since: bool = False) -> DataFrame:
    return c.correlate_pairs(_hourly_cand(spark, sf_dir), since=since)


_GROUP = "case metric " + " ".join(f"when '{m_}' then '{g}'" for m_, w_, g in c.GROUPS if not w_) + " else case direction when 'up' then 'fraud' else 'payments' end end"
PAIRS = f"""with {EPISODES_SQL}, h as (select *, {_GROUP} as grp, string_split(case when window_start // 900 % 3 = 0 and not contains(scope, 'platform') then concat_ws(',', nullif(scope, ''), 'platform=web') else scope end, ',') as l0 from candidates where grain != '1d'),
k as (select *, list_filter(l0, lambda x: x != '') as l from h),
pairs as (select a.anomaly_id as candidate, b.anomaly_id as member, case when a.window_start < b.window_end and b.window_start < a.window_end then 'overlap' else 'gap' end as time,
  case when a.grp = b.grp then a.grp else array_to_string(list_sort([a.grp, b.grp]), ',') end as shared,
  case when len(a.l) > 0 and len(b.l) > 0 and (list_has_all(a.l, b.l) or list_has_all(b.l, a.l)) then 'specific' when len(a.l) = 0 then 'global' else 'related' end as outcome, b.detected_at as since
  from k a join k b on (b.detected_at < a.detected_at or (b.detected_at = a.detected_at and b.anomaly_id < a.anomaly_id)) and a.window_start <= b.window_end + {c.GAP} and b.window_start <= a.window_end + {c.GAP} and (a.grp = b.grp or a.grp = 'ingestion'))
"""
add("h2_correlate_pairs", _pairs, PAIRS + "select candidate, member, time, shared, outcome from pairs")
add("h2_first_matches", lambda s, sf: c.first_matches(materialized(_pairs(s, sf, True), "pairs"), _hourly_cand(s, sf)), PAIRS + """, per as (select candidate, arg_min(member, {'s': since, 'm': member}) filter (where outcome = 'specific') as specific, arg_min(member, {'s': since, 'm': member}) filter (where outcome = 'global') as global, count(*) filter (where outcome = 'global') as g, count(*) filter (where outcome = 'related') as r from pairs group by 1)
select anomaly_id as candidate, case when specific is not null then 'specific' when g = 1 then 'global_unambiguous' when g > 1 then 'global_ambiguous' when r > 0 then 'not_nested' else 'none' end as match, case when specific is not null then specific when g = 1 then global end as member from k left join per on candidate = anomaly_id""")
