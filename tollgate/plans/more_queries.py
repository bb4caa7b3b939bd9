"""Registered queries of payload checks, numbering, assessed answers, decision records and measures, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as k
from ..operators import cohorts as c
from ..operators import decide as g
from ..operators import detect as d
from ..sources.driver_tables import EPISODES_SQL, episodes_from_orders
from ..sources.raw_events import next_seq
from .cohort_queries import ASKED, COUNT, KEYS, RATE, pooled
from .queries import END, START, add, norm

#: A payload an order: every one holds a long number, some of them card numbers; few hold a token, a forbidden key or an account number.
PAYLOAD = f"""concat('{{"object":{{"id":"pi_', k, '","note":"', case when k % 5 = 0 then concat('4', lpad(cast(k * 104729 % 1000000000000000 as TEXT), 15, '0')) when k % 5 = 1 then concat('4242', lpad(cast(k * 7919 % 1000000 as TEXT), 6, '0')) else 'none' end,
  '"', case when k % 13 = 0 then ',"{k.FORBIDDEN_KEYS[0]}":1' else '' end, case when k % 17 = 0 then ',"hint":"{k.FORBIDDEN_TOKENS[0]}"' else '' end, case when k % 11 = 0 then concat(',"to":"DE', lpad(cast(k % 97 as TEXT), 2, '0'), lpad(cast(k * 31 % 1000000000 as TEXT), 18, '0'), '"') else '' end, '}}}}')"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as k").selectExpr(f"{PAYLOAD.replace('TEXT', 'string')} as data")


_HAS = " or ".join(f"contains(data, '{t}')" for t in k.FORBIDDEN_TOKENS)
_KEY = f"len(list_intersect(list_transform(regexp_extract_all(data, '\"(\\w+)\"\\s*:', 1), lambda x: lower(x)), {list(k.FORBIDDEN_KEYS)})) > 0"
# digits from the right, every second doubled, with the digits of two-digit products summed
_LUHN = "len(list_filter(list_filter(regexp_extract_all(data, '\\d+'), lambda x: length(x) between 13 and 19), lambda x: list_sum(list_transform(range(1, length(x) + 1), lambda i: case when i % 2 = 0 then (x[-i]::int * 2) // 10 + (x[-i]::int * 2) % 10 else x[-i]::int end)) % 10 = 0)) > 0"
_RULES = {"pan_like_runs": r"regexp_matches(data, '(^|\D)\d{13,19}(\D|$)')", "token_leak": _HAS, "forbidden_keys": _KEY, "luhn_pan": _LUHN, "iban_like": '''regexp_matches(data, '"[A-Z]{2}\\d{2}[A-Z0-9]{11,30}"')'''}
add("b5_b13_payload_checks", lambda s, sf: k.payload_checks(payloads(s, sf)), f"with p as (select {PAYLOAD.replace('TEXT', 'varchar')} as data from (select o_orderkey as k from orders)) " + " union all ".join(f"select '{n}' as check, count(*) filter (where {when}) as violations from p" for n, when in _RULES.items()))


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.candidate_rows(episodes_from_orders(spark, sf_dir)).select(F.col("anomaly_id").alias("candidate_id"), "metric", "scope", "window_start", "window_end", "detected_at", "score", F.col("sample_size").alias("n"))


WITH = f"with {EPISODES_SQL}, a as (select anomaly_id as candidate_id, metric, scope, window_start, window_end, detected_at, score, sample_size as n from candidates)"
add("a10_next_seq", lambda s, sf: next_seq(alarms(s, sf).select(F.col("metric").alias("run_id"), F.col("detected_at").alias("as_of"), "candidate_id"), 10), f"{WITH} select metric as run_id, detected_at as as_of, candidate_id, row_number() over (partition by metric order by detected_at, candidate_id) + 9 as seq from a")

_PARTS = {"low": 4, "medium": 5, "high": 3, "critical": 2}
_CAUSES = {"psp_degradation": 5, "fraud_attack": 4, "refund_process_change": 3}


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = lambda parts: F.create_map(*(x for name, m in parts.items() for x in (F.lit(name), F.col("n") % m / 10.0)))
    return g.assess(alarms(spark, sf_dir).select("candidate_id", (F.col("score") / 8).alias("incident_p"), (F.col("score") / 16).alias("needs_human_p"), maps(_PARTS).alias("severity"), maps(_CAUSES).alias("category")))


_PICK = lambda parts, tie: f"list_sort([{', '.join(f'''{{'p': n % {m}, 't': {tie(i, x)}, 'x': '{x}'}}''' for i, (x, m) in enumerate(parts.items()))}])[-1].x"
add("g7_assess", _assessed, f"{WITH} select candidate_id, score / 8 as incident_p, score / 16 as needs_human_p, {_PICK(_PARTS, lambda i, x: i)} as severity_level, (n % 3) / 10.0::double + (n % 2) / 10.0::double as p_severity_high, {_PICK(_CAUSES, lambda i, x: repr(x))} as category from a")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    route = F.when(F.col("score") >= 5, "INCIDENT").when(F.col("score") >= 2, "DIGEST").when(n % 7 != 0, "IGNORE")
    reasons = F.when(n % 3 != 0, F.array().cast("array<string>")).when(n % 2 == 0, F.array(F.lit("schema"), F.lit("stale_response")))
    return g.decision_records(alarms(spark, sf_dir).select("candidate_id", F.col("detected_at").alias("as_of"), F.sha2(F.col("score").cast("int").cast("string"), 256).alias("state_hash"), F.sha2("candidate_id", 256).alias("request_hash"), (n % 3 != 0).alias("verified"), reasons.alias("reasons"), route.alias("route"), F.concat(F.lit("r"), n % 9).alias("rule")))


add("g10_decision_records", _records, f"""{WITH}, r as (select *, sha256(cast(trunc(score) as int)::varchar) as state_hash, case when score >= 5 then 'INCIDENT' when score >= 2 then 'DIGEST' when n % 7 != 0 then 'IGNORE' end as want from a), q as (select *, n % 3 != 0 and want is not null as kept from r)
select 'dec_' || sha256(candidate_id || '|' || detected_at || '|' || state_hash || '|policy_v1')[1:16] as decision_id, candidate_id, detected_at as as_of, state_hash, sha256(candidate_id) as request_hash, case when kept then want else 'DIGEST' end as route,
  case when kept then 'r' || (n % 9) else 'r0_unverified' end as rule, case when not kept then case when n % 3 = 0 and n % 2 = 0 then 'schema' else 'no_answer' end end as reason, 'policy_v1' as policy from q""")
add("f19_link_related", lambda s, sf: c.related_pairs(alarms(s, sf).withColumn("locus", F.col("scope"))).withColumn("related", F.array_join("related", ",")), f"""{WITH}, met as (select distinct x.candidate_id, y.candidate_id as other from a x join a y on x.metric = y.metric and x.candidate_id != y.candidate_id and x.window_start < y.window_end and y.window_start < x.window_end and (x.scope = y.scope or x.scope = '' or y.scope = ''))
select candidate_id, array_to_string(list(other order by other)[1:5], ',') as related from met group by 1""")
_rounded = lambda df, *names: df.withColumns({n: F.round(n, 6) for n in names})
add("f4_z_count", lambda s, sf: _rounded(c.tested_cohorts(pooled(s, sf, "attempt_volume")).select(*KEYS.split(", "), "z"), "z"), COUNT + f"select {KEYS}, round(2 * (sqrt(k_d + 0.375) - sqrt(k_b + 0.375)) / sqrt(coalesce(phi, 1.0) * (1 + 1.0::double / greatest(1, n_days))), 6) as z from pooled left join phis using (candidate_id, combination) where k_b + k_d >= {c.COUNT_EVENTS}")
SCOPES = ("", "psp=psp_beta", "customer_country=DE,payment_method_type=card", "channel_of_no_metric=x")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window to explain on every scope."""
    rows = [(f"{name}|{scope}", way, s, e, scope) for name, way, s, e in ASKED for scope in SCOPES]
    asked = spark.createDataFrame(rows, "candidate_id string, direction string, window_start bigint, window_end bigint, scope string")
    return _rounded(c.measure(norm(spark, sf_dir), asked, "authorization_rate", 1, "1d", START, END), "before", "during", "z")


_Z1 = "2 * (asin(sqrt(least(1.0, k_d / n_d))) - asin(sqrt(least(1.0, k_b / n_b)))) / sqrt(1 / n_b + 1 / n_d)"
add("i1_measure", _measured, RATE + f"""select candidate_id || '|' || cohort as candidate_id, 'authorization_rate' as metric, 1 as version, round(k_b / n_b, 6) as before, round(k_d / n_d, 6) as during, round({_Z1}, 6) as z from pooled where cohort in {SCOPES[1:3]} and n_b >= {c.SUPPORT} and n_d >= {c.SUPPORT}
union all select candidate_id || '|', 'authorization_rate', 1, round(k_b / n_b, 6), round(k_d / n_d, 6), round({_Z1}, 6) from (
  select candidate_id, (sum(n) filter (where lag > 0))::double as k_b, (sum(d) filter (where lag > 0))::double as n_b, (sum(n) filter (where lag = 0))::double as k_d, (sum(d) filter (where lag = 0))::double as n_d from (
    select *, row_number() over (partition by candidate_id, lag > 0 order by abs(v - mid) desc, lag desc) as nth, count(*) over (partition by candidate_id, lag > 0) as m from (
      select *, case when d > 0 then n::double / d else 0.0 end as v, quantile_cont(case when d > 0 then n::double / d else 0.0 end, 0.5) over (partition by candidate_id, lag > 0) as mid from (select candidate_id, lag, sum(n) as n, sum(d) as d from tab where combination = 'psp' group by 1, 2)))
  where lag = 0 or m < 4 or nth > 1 group by 1) where n_b >= {c.SUPPORT} and n_d >= {c.SUPPORT}""")
