"""Registered queries of the checks of labelled truth, over records made of customers that break every rule, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import truth_checks as t
from ..sources.driver_tables import EPOCH_2024
from .context_queries import deployments, status
from .queries import add

_RAW = f"""k, concat('scn_', k % 40) as scenario_id, concat('r', k) as record_key, case when k % 17 = 0 then 'bogus' else {{causes}} end as true_cause, case when k % 23 = 0 then 'page' else {{routes}} end as expected_route, {EPOCH_2024} + k * 3600 as start"""
_REST = """k, scenario_id, record_key, true_cause, case when k % 19 = 0 then 'unknown' else true_cause end as root_cause, expected_route, (expected_route != 'suppress') != (k % 29 = 0) as is_incident,
case when expected_route = 'suppress' then case when k % 41 = 0 then 'inc_s' end when k % 31 = 0 then 'x' when k % 37 = 0 then 'inc_1' else concat('inc_', k) end as incident_id, start, case when k % 5 = 0 then null when k % 43 = 0 then start - 86400 else start + 86400 end as {end},
case when expected_route != 'suppress' then case when k % 47 = 0 then start + 1 else start end end as detection_start, case when expected_route != 'suppress' then start + 7200 end as detection_end, case when k % 53 = 0 then start - 5 else start + 90000 end as expected_recovery,
case when expected_route = 'suppress' then case when k % 4 = 0 then start + 60 end when k % 13 = 0 then start - 60 else start + 3600 end as oracle_detectable_at"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs: "element_at(array(" + ", ".join(f"'{x}'" for x in xs) + f"), cast(k % {len(xs)} as int) + 1)"
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    rows = c.selectExpr(*_split(_RAW.format(causes=pick(t.CAUSES), routes=pick(t.ROUTES)))).selectExpr(*_split(_REST.format(end="`end`")))
    k = F.col("k")
    gone = F.when(k % 22 == 0, F.array(F.lit("seed"), F.lit("ramp"))).when(k % 11 == 0, F.array(F.lit("seed"))).otherwise(F.array().cast("array<string>"))
    one = lambda **dims: F.array(F.create_map(*(x for d, v in dims.items() for x in (F.lit(d), F.array(F.lit(v))))))
    figures = {"charge_attempts": (k % 400).cast("double")} | {a: (k % 10) / 10.0 if b else (k % 5).cast("double") for _, a, b in t.DIRECTIONS} | {b: F.lit(0.45) for _, _, b in t.DIRECTIONS if b}
    return rows.select(
        "*", F.array_except(F.array(*map(F.lit, t.REQUIRED)), gone).alias("fields"), F.array(F.lit("charge_approval_rate")).alias("affected_metrics"), F.when(k % 21 == 0, F.array(F.lit("refund_rate"), F.lit("charge_approval_rate"))).otherwise(F.array(F.lit("refund_rate"))).alias("unchanged_metrics"),
        F.when(k % 9 == 0, one(psp="psp_zeta")).when(k % 10 == 0, one(city="x")).otherwise(one(psp="psp_alpha")).alias("affected_cohorts"), F.when(k % 14 == 0, one(psp="psp_alpha")).otherwise(one(psp="psp_beta", platform="web")).alias("control_cohorts"),
        F.array(F.when(k % 15 == 0, "scn_0:nope").when(k % 16 == 0, F.concat("scenario_id", F.lit(":"), "record_key")).otherwise("inc_z")).alias("unrelated_to"), F.array(F.when(k % 18 == 0, F.concat(F.lit("st_none_"), k)).otherwise(F.concat(F.lit("st_"), k))).alias("side_signals"),
        F.element_at(F.array(*(F.lit(m) for m, _, _ in t.DIRECTIONS)), (F.floor(k / 3) % 6).cast("int") + 1).alias("primary_metric"), F.create_map(*(x for name, v in figures.items() for x in (F.lit(name), v))).alias("measured"),
    )


def _split(columns: str) -> list[str]:
    """The columns of a select list, cut at the commas outside of brackets."""
    out, depth = [""], 0
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


_DUCK_PICK = lambda xs: f"{list(xs)}[k % {len(xs)} + 1]"
_ALLOWED = " ".join(f"when '{d}' then not list_contains({list(v)}, split_part(x, '=', 2))" for d, v in t.VALUES.items())
WITH = f"""with c as (select c_custkey as k from customer), r0 as (select {_RAW.format(causes=_DUCK_PICK(t.CAUSES), routes=_DUCK_PICK(t.ROUTES))} from c), r as (select {_REST.format(end="stop")},
  case when k % 9 = 0 then 'psp=psp_zeta' when k % 10 = 0 then 'city=x' else 'psp=psp_alpha' end as aff, case when k % 14 = 0 then 'psp=psp_alpha' else 'platform=web,psp=psp_beta' end as ctl from r0),
v as (select unnest(string_split(aff || ',' || ctl, ',')) as x from r), i as (select *, expected_route != 'suppress' as inc from r)
"""
_RULES = {
    "missing_field": "select coalesce(sum(case when k % 22 = 0 then 2 when k % 11 = 0 then 1 else 0 end), 0) from c",
    "cause_vocabulary": f"select count(*) from i where true_cause not in {t.CAUSES}", "root_cause_differs": "select count(*) from i where root_cause != true_cause", "route_vocabulary": f"select count(*) from i where expected_route not in {t.ROUTES}", "is_incident_differs": "select count(*) from i where is_incident != inc",
    "incident_without_id": "select count(*) from i where inc and incident_id not like 'inc\\_%' escape '\\'", "bad_detection_window": "select count(*) from i where inc and (detection_end <= detection_start or detection_start != start)", "suppressed_with_incident": "select count(*) from i where not inc and (incident_id is not null or detection_start is not null)",
    "end_before_start": "select count(*) from i where stop < start", "recovery_before_start": "select count(*) from i where expected_recovery < start", "metric_both_ways": "select count(*) from c where k % 21 = 0", "suppressed_with_oracle": "select count(*) from i where not inc and oracle_detectable_at is not null",
    "oracle_outside": "select count(*) from i where oracle_detectable_at < start or oracle_detectable_at > stop", "cohorts_overlap": "select count(*) from i where aff = ctl", "unknown_dimension": f"select count(*) from v where split_part(x, '=', 1) not in {t.DIMENSIONS}", "unknown_value": f"select count(*) from v where case split_part(x, '=', 1) {_ALLOWED} else false end",
    "duplicate_incident_id": "select count(incident_id) - count(distinct incident_id) from i where inc and incident_id != 'x'", "unrelated_to_unknown": "select count(*) from c where k % 15 = 0",
}
add("b22_truth_record_rules", lambda s, sf: t.truth_record_rules(records(s, sf)), WITH + " union all ".join(f"select '{name}' as \"check\", ({sql})::bigint as violations" for name, sql in _RULES.items()))
_BAD = lambda n, b: f"select 'direction_{t.DIRECTIONS[n][0]}' as \"check\", (select count(*) from i where inc and k % 400 >= 200 and k // 3 % 6 = {n} and {'(k % 10) / 10.0 >= 0.45' if b else 'k % 5 = 0'}) as violations"
add("b23_truth_effect_direction", lambda s, sf: t.truth_effect_direction(records(s, sf)), WITH + " union all ".join(_BAD(n, b) for n, (_, _, b) in enumerate(t.DIRECTIONS)))
add("b24_truth_scenario_coverage", lambda s, sf: t.truth_scenario_coverage(records(s, sf), s.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("scn_"), F.col("n_nationkey") * 2).alias("scenario_id"))), "select 'scenario_without_record' as \"check\", count(*) as violations from nation where n_nationkey * 2 not in (select c_custkey % 40 from customer)")
add("b25_side_signal_rules", lambda s, sf: t.side_signal_rules(records(s, sf), deployments(s, sf), status(s, sf).withColumn("note", F.when(F.split_part("id", F.lit("_"), F.lit(2)).cast("bigint") % 50 == 0, "no dunning_failure here"))), "select 'side_signal_missing' as \"check\", count(*) as violations from customer where c_custkey % 18 = 0 union all select 'cause_in_side_file', count(distinct 'dunning_failure') from customer where c_custkey % 50 = 0")
