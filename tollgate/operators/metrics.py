"""Versioned billing metrics over normalized events: numerator, denominator and value a time window and cohort.

A definition is a few SQL expressions over the event columns, so that one text serves Spark and its DuckDB twin.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.driver_tables import DIMS

GRAINS = {"5m": 300, "15m": 900, "1h": 3600, "1d": 86_400}
MAX_WINDOWS, MAX_FILTER_VALUES = 20_000, 100
ATTEMPTS = "event_type in ('payment.authorized', 'payment.declined', 'payment.failed')"
_CHECKOUT = tuple(d for d in DIMS if d not in ("plan_id", "attempt_no"))
_BILLING = ("merchant_id", "customer_country", "currency", "psp", "plan_id")
_REFUND = ("psp", "customer_country", "currency", "platform", "channel", "merchant_id")


class MetricError(ValueError):
    """A request that no job is started for."""


@dataclass(frozen=True)
class Metric:
    """``num`` and ``den`` are conditions that are counted; None counts every row, an int is a constant denominator."""

    name: str
    version: int
    where: str
    num: str | None
    den: str | int | None
    dims: tuple[str, ...] = DIMS
    source: str = "plain"
    total: str | None = None
    required: tuple[str, ...] = ()

    @property
    def empty(self) -> int:
        return self.den if isinstance(self.den, int) else 0


METRICS = {
    (m.name, m.version): m
    for m in (
        Metric("authorization_rate", 1, ATTEMPTS, "event_type = 'payment.authorized'", None),
        Metric("first_attempt_authorization_rate", 1, f"{ATTEMPTS} and attempt_no = 1", "event_type = 'payment.authorized'", None),
        Metric("technical_failure_rate", 1, ATTEMPTS, "event_type = 'payment.failed'", None),
        Metric("checkout_conversion_rate", 1, "event_type = 'checkout.started'", "authorized_in_range", None, _CHECKOUT, "authorized"),
        Metric("checkout_conversion_rate", 2, "event_type = 'checkout.started'", "first_known <= window_end", None, _CHECKOUT, "first_known"),
        Metric("subscription_cancellation_rate", 1, "event_type in ('subscription.canceled', 'subscription.renewal_attempted')", "event_type = 'subscription.canceled'", "event_type = 'subscription.renewal_attempted'", _BILLING),
        Metric("subscription_cancellation_rate", 2, "event_type in ('subscription.canceled', 'subscription.renewal_attempted')", "event_type = 'subscription.canceled' and status = 'canceled_voluntary'", "event_type = 'subscription.renewal_attempted' or status = 'canceled_voluntary'", _BILLING),
        Metric("dunning_recovery_rate", 1, "channel = 'renewal' and attempt_no > 1 and event_type in ('payment.authorized', 'dunning.attempted')", "event_type = 'payment.authorized'", "event_type = 'dunning.attempted'"),
        Metric("refund_count", 1, "event_type = 'refund.succeeded'", None, 1, _REFUND),
        Metric("late_arrival_share", 1, "true", "ingested_at - event_time > 900", None, ("psp", "customer_country", "channel", "merchant_id"), "by_delivery"),
        Metric("renewal_success_rate", 1, "event_type in ('subscription.renewed', 'subscription.renewal_attempted')", "event_type = 'subscription.renewed'", "event_type = 'subscription.renewal_attempted'", _BILLING),
        Metric("refund_rate", 1, "event_type in ('refund.succeeded', 'payment.captured')", "event_type = 'refund.succeeded'", "event_type = 'payment.captured'", _REFUND),
        Metric("duplicate_charge_rate", 1, "true", "is_duplicate", None, tuple(d for d in DIMS if d != "channel"), "duplicates"),
        Metric("fraud_flag_rate", 1, f"event_type = 'fraud.flagged' or {ATTEMPTS}", "event_type = 'fraud.flagged'", ATTEMPTS),
        Metric("attempt_volume", 1, ATTEMPTS, None, 1),
        Metric("revenue_collected_minor", 1, "event_type = 'payment.captured'", None, 1, total="amount_minor", required=("currency",)),
    )
}


@dataclass(frozen=True)
class Request:
    """A checked request; the reference point of both the Spark and the SQL form."""

    metric: Metric
    start: int
    end: int
    grain: str
    group_by: tuple[str, ...] = ()
    filters: tuple[tuple[str, tuple], ...] = ()
    visibility: str = "all"
    dense: bool = True

    @property
    def seconds(self) -> int:
        return GRAINS[self.grain]


def request(metric: str, version: int, start: int, end: int, grain: str, group_by: Sequence[str] = (), filters: Mapping[str, Sequence] | None = None, visibility: str = "all", dense: bool = True) -> Request:
    """Checks everything that can be wrong with a request before any job starts."""
    m = METRICS.get((metric, version))
    if m is None:
        raise MetricError(f"unknown metric {metric} v{version}")
    if grain not in GRAINS:
        raise MetricError(f"unknown grain {grain}; there are {sorted(GRAINS)}")
    if visibility not in ("all", "window_close"):
        raise MetricError(f"unknown visibility {visibility}")
    if start % GRAINS[grain]:
        raise MetricError("start does not lie on the grain")
    if end <= start:
        raise MetricError("end must come after start")
    if -(-(end - start) // GRAINS[grain]) > MAX_WINDOWS:
        raise MetricError(f"more than {MAX_WINDOWS} windows")
    dims = tuple(dict.fromkeys([*m.required, *group_by]))
    filters = {d: tuple([v] if isinstance(v, (str, int)) else v) for d, v in (filters or {}).items()}
    for d in [*dims, *filters]:
        if d not in m.dims:
            raise MetricError(f"{metric} v{version} has no dimension {d}")
    for d, values in filters.items():
        if not 1 <= len(values) <= MAX_FILTER_VALUES:
            raise MetricError(f"a filter takes 1 to {MAX_FILTER_VALUES} values: {d}")
        if any(isinstance(v, bool) or not isinstance(v, int if d == "attempt_no" else str) for v in values):
            raise MetricError(f"a value of the wrong type for {d}")
    return Request(m, start, end, grain, dims, tuple(sorted(filters.items())), visibility, dense)


def _source(norm: DataFrame, r: Request) -> DataFrame:
    """Events with what the metric's expressions need beside the plain columns."""
    before_end = F.col("occurred_at") < r.end
    if r.metric.source == "plain":
        return norm
    if r.metric.source == "by_delivery":
        return norm.withColumn("event_time", F.col("occurred_at")).withColumn("occurred_at", F.col("ingested_at"))
    if r.metric.source == "duplicates":
        # filtered before the window function, as nothing is pushed through it; the reach before start is for its first row
        own = norm.where("event_type = 'payment.captured' and channel = 'checkout'").where((F.col("occurred_at") >= r.start - 60) & before_end)
        last = F.lag("occurred_at").over(W.partitionBy("customer_id", "amount_minor", "currency").orderBy("occurred_at", "raw_seq"))
        return own.withColumn("is_duplicate", F.coalesce((F.col("idempotency_key_present") == 0) & (F.col("occurred_at") - last <= 60), F.lit(False)))
    paid = norm.where("event_type = 'payment.authorized' and channel = 'checkout'").where(before_end)
    started = norm.where("event_type = 'checkout.started'")
    if r.metric.source == "authorized":
        ids = paid.where(F.col("occurred_at") >= r.start).select("payment_intent_id", F.lit(True).alias("authorized_in_range")).distinct()
        return started.join(ids, "payment_intent_id", "left")
    known = paid.where(F.col("ingested_at") <= r.end).groupBy("payment_intent_id").agg(F.min("ingested_at").alias("first_known"))
    return started.join(known, "payment_intent_id", "left")


def window_of(at: Column, seconds: int) -> Column:
    """Start of the window of ``seconds`` that holds a time."""
    return at - at % seconds


def counts(norm: DataFrame, r: Request) -> DataFrame:
    """window_start, dimensions, numerator, denominator of the windows that have rows."""
    m = r.metric
    rows = _source(norm, r).where(m.where).where((F.col("occurred_at") >= r.start) & (F.col("occurred_at") < r.end))
    for d, values in r.filters:
        rows = rows.where(F.col(d).isin(*values))
    rows = rows.withColumn("window_start", window_of(F.col("occurred_at"), r.seconds)).withColumn("window_end", F.col("window_start") + r.seconds)
    if r.visibility == "window_close":
        rows = rows.where("ingested_at <= window_end")
    top = F.sum(m.total) if m.total else F.count("*") if m.num is None else F.count_if(F.expr(m.num))
    low = F.lit(m.den) if isinstance(m.den, int) else F.count("*") if m.den is None else F.count_if(F.expr(m.den))
    return rows.groupBy("window_start", *r.group_by).agg(top.cast("long").alias("numerator"), low.cast("long").alias("denominator"))


def densify(found: DataFrame, r: Request) -> DataFrame:
    """A row for every window of every group seen; an ungrouped series is dense even without rows."""
    spark = found.sparkSession
    last = r.start + (-(-(r.end - r.start) // r.seconds) - 1) * r.seconds
    starts = F.explode(F.sequence(F.lit(r.start).cast("long"), F.lit(last).cast("long"), F.lit(r.seconds).cast("long"))).alias("window_start")
    groups = found.select(*r.group_by).distinct() if r.group_by else spark.range(1).select()
    grid = groups.select(*r.group_by, starts)
    filled = grid.join(found, ["window_start", *r.group_by], "left")
    return filled.select("window_start", *r.group_by, F.coalesce("numerator", F.lit(0)).alias("numerator"), F.coalesce("denominator", F.lit(r.metric.empty)).alias("denominator"))


def compute(norm: DataFrame, r: Request) -> DataFrame:
    """window_start, dimensions, numerator, denominator, value (null over 0) and is_complete."""
    found = counts(norm, r)
    if r.dense:
        found = densify(found, r)
    value = F.when(F.col("denominator") != 0, F.col("numerator") / F.col("denominator"))
    return found.select("window_start", *r.group_by, "numerator", "denominator", value.alias("value"), (F.col("window_start") + r.seconds <= r.end).alias("is_complete"))


def compute_sql(r: Request) -> str:
    """The DuckDB twin of compute, as a select over ``norm``."""
    m, dims = r.metric, "".join(f", {d}" for d in r.group_by)
    source = {
        "plain": "norm",
        "by_delivery": "(select * replace (ingested_at as occurred_at), occurred_at as event_time from norm)",
        "duplicates": f"""(select *, coalesce(idempotency_key_present = 0 and occurred_at - lag(occurred_at) over (partition by customer_id, amount_minor, currency order by occurred_at, raw_seq) <= 60, false) as is_duplicate
            from norm where event_type = 'payment.captured' and channel = 'checkout' and occurred_at >= {r.start - 60} and occurred_at < {r.end})""",
        "authorized": f"""(select s.*, s.payment_intent_id in (select payment_intent_id from norm where event_type = 'payment.authorized' and channel = 'checkout' and occurred_at >= {r.start} and occurred_at < {r.end}) as authorized_in_range from norm s)""",
        "first_known": f"""(select s.*, a.first_known from norm s left join (select payment_intent_id, min(ingested_at) as first_known from norm
            where event_type = 'payment.authorized' and channel = 'checkout' and occurred_at < {r.end} and ingested_at <= {r.end} group by 1) a using (payment_intent_id))""",
    }[m.source]
    keep = [f"({m.where})", f"occurred_at >= {r.start}", f"occurred_at < {r.end}"]
    keep += [f"{d} in ({', '.join(map(repr, values))})" for d, values in r.filters]
    keep += ["ingested_at <= window_end"] * (r.visibility == "window_close")
    top = f"sum({m.total})" if m.total else "count(*)" if m.num is None else f"count(*) filter (where {m.num})"
    low = str(m.den) if isinstance(m.den, int) else "count(*)" if m.den is None else f"count(*) filter (where {m.den})"
    found = f"""select window_start{dims}, cast({top} as bigint) as numerator, cast({low} as bigint) as denominator
        from (select *, occurred_at - occurred_at % {r.seconds} as window_start, occurred_at - occurred_at % {r.seconds} + {r.seconds} as window_end from {source})
        where {" and ".join(keep)} group by window_start{dims}"""
    if r.dense:
        groups = f"(select distinct {', '.join(r.group_by)} from f)" if r.group_by else "(select 1 as one)"
        on = " and ".join(["f.window_start = g.window_start", *(f"f.{d} = g.{d}" for d in r.group_by)])
        last = r.start + -(-(r.end - r.start) // r.seconds) * r.seconds
        found = f"""with f as ({found}), g as (select *, unnest(range({r.start}, {last}, {r.seconds})) as window_start from {groups})
            select g.window_start{"".join(f", g.{d}" for d in r.group_by)}, coalesce(numerator, 0) as numerator, coalesce(denominator, {m.empty}) as denominator from g left join f on {on}"""
    return f"""select window_start{dims}, numerator, denominator, case when denominator != 0 then numerator::double / denominator end as value,
        window_start + {r.seconds} <= {r.end} as is_complete from ({found})"""
