"""Registered queries of context and outcomes over orders, customers and events, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context as x
from ..sources.driver_tables import EPOCH_2024, NORM_SQL
from .cohort_queries import RATE, tested
from .queries import add, norm

SPAN = 30 * 86_400
PSPS = ("psp_alpha", "psp_beta", "psp_gamma")


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return o.select(F.concat(F.lit("dep_"), "o_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, x.SERVICES)), (F.col("o_orderkey") % 9).cast("int") + 1).alias("service"), (EPOCH_2024 + (F.col("o_orderkey") * 7919) % SPAN).alias("deployed_at"))


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    posted = EPOCH_2024 + (F.col("c_custkey") * 104_729) % SPAN
    return c.select(F.concat(F.lit("st_"), "c_custkey").alias("id"), F.element_at(F.array(*map(F.lit, PSPS)), (F.col("c_custkey") % 3).cast("int") + 1).alias("psp"), posted.alias("posted_at"), F.when(F.col("c_custkey") % 10 != 0, posted + 10_800).alias("resolved_at"))


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every failed attempt as an onset, known an hour later."""
    return norm(spark, sf_dir).where("event_type = 'payment.failed'").select(F.col("event_id").alias("incident_id"), "psp", F.col("occurred_at").alias("onset"), (F.col("occurred_at") + 3600).alias("as_of"))


WITH = f"""with {NORM_SQL}, inc as (select event_id as incident_id, psp, occurred_at as onset, occurred_at + 3600 as as_of from norm where event_type = 'payment.failed'),
dep as (select 'dep_' || o_orderkey as id, {list(x.SERVICES)}[o_orderkey % 9 + 1] as service, {EPOCH_2024} + (o_orderkey * 7919) % {SPAN} as deployed_at from orders),
st as (select 'st_' || c_custkey as id, {list(PSPS)}[c_custkey % 3 + 1] as psp, {EPOCH_2024} + (c_custkey * 104729) % {SPAN} as posted_at, case when c_custkey % 10 != 0 then {EPOCH_2024} + (c_custkey * 104729) % {SPAN} + 10800 end as resolved_at from customer)
"""
add("i12_deployments_near", lambda s, sf: x.deployments_near(onsets(s, sf), deployments(s, sf)), WITH + "select incident_id, id, service, deployed_at from (select *, row_number() over (partition by incident_id order by deployed_at, id) as nth from inc, dep where deployed_at between onset - 7200 and least(onset + 7200, as_of)) where nth <= 50")
add("i12_status_near", lambda s, sf: x.status_near(onsets(s, sf), status(s, sf)), WITH + "select incident_id, id, psp, posted_at, resolved_at from (select incident_id, id, psp, posted_at, case when resolved_at <= as_of then resolved_at end as resolved_at, row_number() over (partition by incident_id order by posted_at, id) as nth from inc join st using (psp) where posted_at <= as_of and (resolved_at is null or resolved_at >= onset - 21600)) where nth <= 50")
add("i3_outcome", lambda s, sf: tested(s, sf).select("candidate_id", "cohort", x.outcome(F.col("z"), F.col("direction")).alias("outcome")), RATE + "select candidate_id, cohort, case when z is null then 'insufficient' when (case direction when 'up' then z else -z end) >= 2 then 'moved' when (case direction when 'up' then z else -z end) <= -2 then 'opposite' when abs(z) < 1 then 'unchanged' else 'ambiguous' end as outcome from tested")
