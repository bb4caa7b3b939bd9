"""Registered queries of scores over alarms made of orders and truth made of suppliers, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect as d
from ..operators import score as z
from ..operators.correlate import correlate_pairs
from ..operators.truth_checks import CAUSES
from ..sources.driver_tables import DAY, EPISODES_SQL, TRUTH_SQL, episodes_from_orders, truth_from_suppliers
from . import evaluate_queries
from .queries import QUERIES, SQL, add

DAYS = 27.0
KINDS = (z.ADDED_TRAFFIC, z.NEW_COHORTS, "psp_outage")


def _alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.candidate_rows(episodes_from_orders(spark, sf_dir)).select(F.col("anomaly_id").alias("candidate_id"), "metric", "score", "sample_size", "window_start", "detected_at")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alarm with its status, two routes and a recorded answer, all of its own figures."""
    c = _alarms(spark, sf_dir).join(QUERIES["j3_match_status"](spark, sf_dir), "candidate_id", "left")
    n, s = F.col("sample_size").cast("int"), F.col("score")
    k = F.split_part("record_key", F.lit("_"), F.lit(2)).cast("int")
    route = lambda x, a, b: F.when(x >= a, "INCIDENT").when(x >= b, "DIGEST").otherwise("IGNORE")
    maps = lambda **xs: F.create_map(*(y for name, v in xs.items() for y in (F.lit(name), v / 4.0)))
    pick = F.element_at(F.array(*map(F.lit, CAUSES)), k % len(CAUSES) + 1)
    return c.select(
        "candidate_id", F.coalesce("status", F.lit("unmatched")).alias("status"), "record_key", F.create_map(F.lit("policy"), route(s, 5, 2), F.lit("baseline"), route(n, 50, 35)).alias("routes"), (n % 3 != 0).alias("verified"),
        F.when(n % 3 != 0, F.array().cast("array<string>")).when(n % 2 == 0, F.array(F.lit("schema"), F.lit("stale"))).otherwise(F.array(F.lit("schema"))).alias("reasons"), (s / 8).alias("incident_p"), maps(low=n % 4, high=n % 3).alias("severity"),
        maps(psp_degradation=n % 5, fraud_attack=n % 4, refund_process_change=n % 3, dunning_failure=n % 2).alias("category"), F.when(k % 2 == 0, "low").otherwise("high").alias("true_severity"), pick.alias("true_cause"),
    )


_K = "cast(split_part(record_key, '_', 2) as int)"
SCORED = f"""with {EPISODES_SQL}, {TRUTH_SQL}, st as ({SQL["j3_match_status"]}), sc as (select c.anomaly_id as candidate_id, coalesce(st.status, 'unmatched') as status, record_key, case when score >= 5 then 'INCIDENT' when score >= 2 then 'DIGEST' else 'IGNORE' end as policy,
  case when sample_size >= 50 then 'INCIDENT' when sample_size >= 35 then 'DIGEST' else 'IGNORE' end as baseline, sample_size as n, score, {_K} % 2 as odd, {list(CAUSES)}[{_K} % {len(CAUSES)} + 1] as true_cause from candidates c left join st on c.anomaly_id = st.candidate_id),
rt as (select 'policy' as system, policy as route, status, record_key from sc union all select 'baseline', baseline, status, record_key from sc), inc as (select record_key from truth where expected_route = 'incident' and oracle_detectable_at is not null)
"""
_INCIDENTS = lambda s, sf: truth_from_suppliers(s, sf).where("expected_route = 'incident' and oracle_detectable_at is not null").select("record_key")
_DAY = lambda when: f"count(*) filter (where {when}) / {DAYS}::double"
add("j4_route_scores", lambda s, sf: z.route_scores(scored(s, sf), _INCIDENTS(s, sf), DAYS), SCORED + f"""select system, count(*) as candidates, {", ".join(f"{_DAY(f"route = '{r}'")} as {r.lower()}_per_day" for r in z.ROUTES)},
avg((case status when 'incident' then route = 'INCIDENT' when 'watch' then route = 'DIGEST' when 'suppress' then route = 'IGNORE' end)::int) as route_accuracy_matched, count(distinct record_key) filter (where route = 'INCIDENT' and status = 'incident' and record_key in (select record_key from inc)) as incidents_routed_incident,
count(*) filter (where route = 'INCIDENT' and status = 'incident') / nullif(count(distinct record_key) filter (where route = 'INCIDENT' and status = 'incident'), 0)::double as routes_per_matched_incident, {", ".join(f"{_DAY(f"route = 'INCIDENT' and status = '{x}'")} as {x}_incident_per_day" for x in ("unmatched", "suppress", "watch"))},
(select count(*) from inc) as incidents_scored, incidents_routed_incident / nullif((select count(*) from inc), 0)::double as incident_recall from rt group by 1""")  # fmt: skip
add("j4_routes_by_status", lambda s, sf: z.routes_by_status(scored(s, sf)), SCORED + "select system, status, route, count(*) as n from rt group by 1, 2, 3")
_P = "case true_cause when 'psp_degradation' then n % 5 when 'fraud_attack' then n % 4 when 'refund_process_change' then n % 3 when 'dunning_failure' then n % 2 end"
_AHEAD = " + ".join(f"(n % {q} > p or (n % {q} = p and '{name}' < true_cause))::int" for name, q in (("psp_degradation", 5), ("fraud_attack", 4), ("refund_process_change", 3), ("dunning_failure", 2)))
add("j4_answer_scores", lambda s, sf: z.answer_scores(scored(s, sf)), SCORED + f""", a as (select *, n % 3 != 0 as verified, case when n % 4 >= n % 3 then 0 else 1 end as sure, {_P} as p from sc)
select avg(verified::int) as verified_share, avg((sure = odd)::int) filter (where verified and status = 'incident') as severity_accuracy, {", ".join(f"avg(coalesce(({_AHEAD}) < {k}, false)::int) filter (where verified and status = 'incident') as category_top{k}" for k in (1, 3))},
avg((score / 8 - (status in ('incident', 'watch'))::int) ** 2) filter (where verified) as brier from a""")  # fmt: skip
add("j4_failure_reasons", lambda s, sf: z.failure_reasons(scored(s, sf)), SCORED + "select 'schema' as reason, count(*) as n from sc where n % 3 = 0 union all select 'stale', count(*) from sc where n % 6 = 0")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four looks at every alarm, each with a label of its own."""
    looks = F.sequence(F.lit(0), (F.col("sample_size") % 4).cast("int"))
    rows = _alarms(spark, sf_dir).select("candidate_id", "sample_size", "detected_at", F.explode(looks).alias("look"))
    label = F.element_at(F.array(F.lit("rate_change"), F.lit("mix_shift"), F.lit("new_cohort"), F.lit(None)), ((F.col("sample_size") + F.col("look")) % 4).cast("int") + 1)
    return rows.select("candidate_id", (F.col("detected_at") + F.col("look") * 21_600).alias("as_of"), label.alias("change_type"))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.split_part("record_key", F.lit("_"), F.lit(2)).cast("int") % 3 + 1)
    return QUERIES["j3_match_status"](spark, sf_dir).select("candidate_id", F.col("status").alias("expected_route"), kind.alias("scenario_kind"))


add("j9_labels_by_checkpoint", lambda s, sf: z.labels_by_checkpoint(_decisions(s, sf), _matched(s, sf)), SCORED + f""", lk as (select candidate_id, status, n, unnest(range(0, n % 4 + 1)) as nth, {list(KINDS)}[{_K} % 3 + 1] as kind from sc),
lb as (select *, ['rate_change', 'mix_shift', 'new_cohort', null][(n + nth) % 4 + 1] as label from lk where status = 'incident')
select nth, count(*) as n, avg(case kind when '{z.ADDED_TRAFFIC}' then label = 'mix_shift' when '{z.NEW_COHORTS}' then label in ('new_cohort', 'rate_change') else label = 'rate_change' end::int) as accuracy from lb where label is not null group by 1""")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every correlated pair of alarms as a link, into an incident a day; late data may anchor any metric."""
    found = correlate_pairs(evaluate_queries._hourly_cand(spark, sf_dir), ingestion_anchors=True).select("candidate", "member")
    starts = _alarms(spark, sf_dir).select(F.col("candidate_id").alias("candidate"), F.floor(F.col("window_start") / DAY).alias("incident_id"), "sample_size")
    return found.join(starts, "candidate").select("incident_id", F.col("candidate").alias("candidate_id"), "member", F.when(F.col("sample_size") % 5 == 0, "create").otherwise("join").alias("kind"))


def _merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = _alarms(spark, sf_dir).select(F.floor(F.col("window_start") / DAY).alias("incident_id")).distinct()
    return day.withColumn("wrong_merge", F.col("incident_id") % 2 == 0).withColumn("campaign_merge", F.col("incident_id") % 3 == 0)


add("j15_ingestion_hub_joins", lambda s, sf: z.ingestion_hub_joins(_links(s, sf), _alarms(s, sf), _merges(s, sf)), evaluate_queries.PAIRS.replace("or a.grp = 'ingestion')", "or a.grp = 'ingestion' or b.grp = 'ingestion')") + f""", fm as (select candidate, member from pairs),
j as (select c.window_start // {DAY} as day from fm join candidates c on c.anomaly_id = candidate join candidates m on m.anomaly_id = member where c.sample_size % 5 != 0 and m.metric = 'late_arrival_share' and c.metric != 'late_arrival_share')
select count(*) as joins, count(distinct day) as incidents, count(distinct day) filter (where day % 2 = 0) as wrong_merge_incidents, count(distinct day) filter (where day % 3 = 0) as campaign_merge_incidents from j""")


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A request an alarm; some were never answered, some in error, some are too large."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("request_hash"))
    error = F.when(F.col("k") % 7 == 0, F.lit('{"kind":"timeout","detail":"late"}'))
    return o.select("request_hash", (F.col("k") % 5000).alias("size_bytes")), o.where("k % 5 != 0").select("request_hash", F.when(error.isNull(), F.concat(F.lit("r"), "k")).alias("response"), error.alias("error"))


add("g5_attach_answers", lambda s, sf: z.attach_answers(*_answers(s, sf)), """select sha256(o_orderkey::varchar) as request_hash, o_orderkey % 5000 as size_bytes, case when size_bytes > 4096 then 'oversized_request' when o_orderkey % 5 = 0 then 'replay_miss' when o_orderkey % 7 = 0 then 'timeout' end as error_kind,
case when error_kind is null then 'r' || o_orderkey end as response, case error_kind when 'oversized_request' then size_bytes || ' bytes' when 'replay_miss' then 'no recorded response' when 'timeout' then 'late' end as detail from orders""")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alarm as an investigation that finds its cause once it has enough calls; some alarms are false."""
    budgets = F.explode(F.array(*map(F.lit, (3, 5, 7, 9, 12, 40))))
    return _alarms(spark, sf_dir).select((F.col("sample_size") % 11 == 0).alias("false_positive"), "sample_size", budgets.alias("budget")).withColumn("top3", F.col("sample_size") % 9 < F.col("budget"))


add("k4_tune_call_budget", lambda s, sf: z.tune_call_budget(_runs(s, sf)), f"""with {EPISODES_SQL}, b as (select unnest([3, 5, 7, 9, 12, 40]) as budget, sample_size from candidates), t as (select budget, coalesce(avg((sample_size % 9 < budget)::int) filter (where sample_size % 11 != 0), 0.0) as top3 from b group by 1)
select budget, top3, budget = (select min(budget) from t where top3 >= (select arg_max(top3, budget) from t) - 0.01) as chosen from t""")
