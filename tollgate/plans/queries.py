"""Registered queries of the billing operators over the given tables, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..sources.driver_tables import DAY, EPOCH_2024, NORM_SQL, norm_from_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
START, END = EPOCH_2024, EPOCH_2024 + 30 * DAY


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _metric(name: str, *args, **more) -> None:
    r = m.request(*args, **more)
    add(name, lambda spark, sf: m.compute(norm_from_events(spark, sf), r), f"with {NORM_SQL} {m.compute_sql(r)}")


def norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_from_events(spark, sf_dir)


add("norm_from_events", norm, f"with {NORM_SQL} select * from norm")
_metric("d1_compute", "authorization_rate", 1, START, END, "1h", ["psp"])
_metric("d2_grain_bucket", "attempt_volume", 1, START, START + 3 * DAY, "15m")
_metric("d3_as_of_range", "attempt_volume", 1, START + 5 * DAY, START + 5 * DAY + 5_400, "1h", ["psp"])
_metric("d4_first_look", "authorization_rate", 1, START, END, "1h", ["psp"], visibility="window_close")
_metric("d5_dim_filters", "authorization_rate", 1, START, END, "1d", ["platform"], {"psp": ["psp_beta", "psp_gamma"], "attempt_no": [1]})
_metric("d6_group_dims", "revenue_collected_minor", 1, START, END, "1d", ["psp", "currency"])
_metric("d7_densify", "duplicate_charge_rate", 1, START, END, "1h", ["app_version"])
_metric("d8_ratio_value", "dunning_recovery_rate", 1, START, END, "1h", ["psp"])
_metric("d9_completeness", "authorization_rate", 1, START, END - 7_000, "1d", ["customer_country"])
for _n, _name, _version, _by in (
    (11, "authorization_rate", 1, "psp"), (12, "first_attempt_authorization_rate", 1, "psp"), (13, "checkout_conversion_rate", 1, "platform"), (14, "checkout_conversion_rate", 2, "platform"),
    (15, "technical_failure_rate", 1, "psp"), (16, "subscription_cancellation_rate", 1, "customer_country"), (17, "subscription_cancellation_rate", 2, "customer_country"), (18, "dunning_recovery_rate", 1, "psp"),
    (19, "refund_count", 1, "customer_country"), (20, "late_arrival_share", 1, "psp"), (21, "renewal_success_rate", 1, "psp"), (22, "duplicate_charge_rate", 1, "psp"), (23, "refund_rate", 1, "psp"),
    (24, "fraud_flag_rate", 1, "psp"), (25, "attempt_volume", 1, "psp"), (26, "revenue_collected_minor", 1, "psp"),
):
    _metric(f"d{_n}_{_name}" + ("_v2" if _version == 2 else ""), _name, _version, START, END, "1d", [_by], visibility="window_close")


def _approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = norm(spark, sf_dir).where(m.ATTEMPTS).where("channel = 'checkout'")
    ok = F.when(F.col("event_type") == "payment.authorized", 1.0).otherwise(0.0)
    return rows.groupBy(m.window_of(F.col("occurred_at"), 3600).alias("hour"), "psp").agg(F.avg(ok).alias("approval"), F.count("*").alias("attempts"))


add("d10_approval_by_hour", _approval, f"with {NORM_SQL} select occurred_at - occurred_at % 3600 as hour, psp, avg(case when event_type = 'payment.authorized' then 1.0 else 0.0 end)::double as approval, count(*) as attempts from norm where {m.ATTEMPTS} and channel = 'checkout' group by 1, 2")
