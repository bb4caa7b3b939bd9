"""The given tables as billing events: normalized events from ``events``, raw envelopes from ``orders`` and ``lineitem``.

Times are whole epoch seconds. Each adapter has a DuckDB twin (``NORM_SQL``, ``RAW_SQL``): text of common table
expressions that end in ``norm`` or ``raw``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400
EPOCH_2024 = 1_704_067_200
PLANTED = (EPOCH_2024 + 18 * DAY, EPOCH_2024 + 21 * DAY)
NEW_APP = EPOCH_2024 + 15 * DAY
DIMS = ("merchant_id", "customer_country", "issuer_country", "currency", "psp", "payment_method_type", "card_brand", "platform", "app_version", "plan_id", "channel", "attempt_no")


def epoch(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def norm_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each business event that a source event stands for."""
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i.cast("int") + 1)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), epoch("ts").alias("t"))
    user, k, t = F.col("user_id"), F.col("k"), F.col("t")
    renewal = F.col("event_type") == "signup"
    country = F.floor(user / 3) % 4
    e = e.select(
        "event_id", "user_id", "k", "t", renewal.alias("renewal"), F.when(renewal, "renewal").otherwise("checkout").alias("channel"),
        pick(("psp_alpha", "psp_beta", "psp_gamma"), user % 3).alias("psp"), pick(("DE", "US", "BR", "GB"), country).alias("customer_country"), pick(("eur", "usd", "brl", "gbp"), country).alias("currency"),
        F.when(user % 5 == 0, "sepa_debit").otherwise("card").alias("payment_method_type"), F.when(user % 5 == 0, "unknown").otherwise(pick(("visa", "mastercard", "amex"), user % 7 % 3)).alias("card_brand"),
        F.when(renewal, "server").otherwise(pick(("web", "ios", "android"), F.col("event_id") % 3)).alias("platform"),
        F.when(k < 80, 1).otherwise(2).alias("attempt"), (100 * (1 + F.floor(F.col("value") / 25))).cast("long").alias("amount_minor"), F.when(renewal | (k % 20 == 5), 0).otherwise(1).alias("idempotency_key_present"),
        (F.col("event_type") == "error").alias("error"),
    )
    planted = (F.col("psp") == "psp_beta") & (t >= PLANTED[0]) & (t < PLANTED[1]) & (k % 2 == 1)
    outcome = F.when(F.col("error") & (k % 4 == 0), "payment.failed").when(F.col("error") | (k >= 98) | (F.col("renewal") & (k % 10 == 0)) | planted, "payment.declined").otherwise("payment.authorized")
    e = e.withColumn("outcome", outcome)
    paid, declined, ren = F.col("outcome") == "payment.authorized", F.col("outcome") == "payment.declined", F.col("renewal")

    def row(kind: Column | str, when: Column | None, after: int = 0, attempt: bool = True, status: Column | str = "") -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        made = F.struct(lit(kind).alias("event_type"), (t + after).alias("occurred_at"), (F.col("attempt") if attempt else F.lit(0)).alias("attempt_no"), lit(status).alias("status"))
        return made if when is None else F.when(when, made)

    canceled = F.when(declined & (k % 20 == 0), "canceled_involuntary").when(ren & (k == 51), "canceled_voluntary")
    rows = F.array(
        row(F.when(ren, "subscription.renewal_attempted").otherwise("checkout.started"), None, attempt=False), row(F.col("outcome"), None), row("payment.captured", paid), row("payment.captured", paid & ~ren & (k % 20 == 5), after=30),
        row("fraud.flagged", k >= 98), row("dunning.attempted", ren & (F.col("attempt") == 2)), row(F.when(paid, "subscription.renewed").otherwise("subscription.past_due"), ren, attempt=False), row("subscription.canceled", canceled.isNotNull(), attempt=False, status=canceled),
        row("refund.requested", paid & (k % 30 == 7), after=DAY, attempt=False), row("refund.succeeded", paid & (k % 30 == 7), after=DAY, attempt=False),
    )
    e = e.select("*", F.posexplode(rows).alias("ordinal", "r")).where("r is not null")
    app = F.when(F.col("platform").isin("web", "server"), F.col("platform")).when(t < NEW_APP, "5.13.0").otherwise("5.14.0")
    late = F.when(k % 25 == 13, 5400).otherwise(0)
    return e.select(
        F.lit("run").alias("run_id"), F.concat_ws("/", F.concat(F.lit("evt_"), "event_id"), F.col("ordinal").cast("string")).alias("event_id"), F.col("r.event_type").alias("event_type"),
        F.col("r.occurred_at").alias("occurred_at"), (F.col("r.occurred_at") + late).alias("ingested_at"), F.lit("merchant_1").alias("merchant_id"),
        F.concat(F.lit("cus_"), "user_id").alias("customer_id"), F.concat(F.lit("pi_"), F.col("event_id")).alias("payment_intent_id"), "customer_country", F.col("customer_country").alias("issuer_country"), "currency", "psp", "payment_method_type", "card_brand", "platform",
        app.alias("app_version"), F.when(ren, F.concat(F.lit("monthly_"), "currency")).otherwise("unknown").alias("plan_id"), "channel", F.col("r.attempt_no").alias("attempt_no"), "idempotency_key_present", "amount_minor",
        F.col("r.status").alias("status"), F.when(F.col("r.event_type") == "payment.declined", "card_declined").alias("decline_code"), F.when(F.col("r.event_type") == "payment.failed", "processing_error").alias("error_code"),
        F.concat(F.lit("evt_"), F.col("event_id")).alias("raw_event_id"), (F.col("event_id") * 16 + F.col("ordinal")).alias("raw_seq"),
    )


NORM_SQL = f"""
src as (
  select event_id, user_id, value, cast(json_extract_string(props, '$.k') as int) as k, cast(floor(epoch(ts)) as bigint) as t,
         event_type = 'signup' as renewal, event_type = 'error' as err, cast(floor(user_id / 3) as bigint) % 4 as c
  from events),
dims as (
  select *, case when renewal then 'renewal' else 'checkout' end as channel, ['psp_alpha', 'psp_beta', 'psp_gamma'][user_id % 3 + 1] as psp,
         ['DE', 'US', 'BR', 'GB'][c + 1] as customer_country, ['eur', 'usd', 'brl', 'gbp'][c + 1] as currency,
         case when user_id % 5 = 0 then 'sepa_debit' else 'card' end as payment_method_type,
         case when user_id % 5 = 0 then 'unknown' else ['visa', 'mastercard', 'amex'][user_id % 7 % 3 + 1] end as card_brand,
         case when renewal then 'server' else ['web', 'ios', 'android'][event_id % 3 + 1] end as platform,
         case when k < 80 then 1 else 2 end as attempt, cast(100 * (1 + floor(value / 25)) as bigint) as amount_minor,
         case when renewal or k % 20 = 5 then 0 else 1 end as idempotency_key_present
  from src),
outc as (
  select *, case when err and k % 4 = 0 then 'payment.failed'
                 when err or k >= 98 or (renewal and k % 10 = 0) or (psp = 'psp_beta' and t >= {PLANTED[0]} and t < {PLANTED[1]} and k % 2 = 1) then 'payment.declined'
                 else 'payment.authorized' end as outcome
  from dims),
parts as (
  select *, 0 as ordinal, case when renewal then 'subscription.renewal_attempted' else 'checkout.started' end as et, t as happened, 0 as att, '' as st from outc
  union all select *, 1, outcome, t, attempt, '' from outc
  union all select *, 2, 'payment.captured', t, attempt, '' from outc where outcome = 'payment.authorized'
  union all select *, 3, 'payment.captured', t + 30, attempt, '' from outc where outcome = 'payment.authorized' and not renewal and k % 20 = 5
  union all select *, 4, 'fraud.flagged', t, attempt, '' from outc where k >= 98
  union all select *, 5, 'dunning.attempted', t, attempt, '' from outc where renewal and attempt = 2
  union all select *, 6, case when outcome = 'payment.authorized' then 'subscription.renewed' else 'subscription.past_due' end, t, 0, '' from outc where renewal
  union all select *, 7, 'subscription.canceled', t, 0, case when outcome = 'payment.declined' and k % 20 = 0 then 'canceled_involuntary' else 'canceled_voluntary' end
            from outc where (outcome = 'payment.declined' and k % 20 = 0) or (renewal and k = 51)
  union all select *, 8, 'refund.requested', t + 86400, 0, '' from outc where outcome = 'payment.authorized' and k % 30 = 7
  union all select *, 9, 'refund.succeeded', t + 86400, 0, '' from outc where outcome = 'payment.authorized' and k % 30 = 7),
norm as (
  select 'run' as run_id, 'evt_' || event_id || '/' || ordinal as event_id, et as event_type, happened as occurred_at,
         happened + case when k % 25 = 13 then 5400 else 0 end as ingested_at, 'merchant_1' as merchant_id, 'cus_' || user_id as customer_id,
         'pi_' || event_id as payment_intent_id, customer_country, customer_country as issuer_country, currency, psp, payment_method_type, card_brand, platform,
         case when platform in ('web', 'server') then platform when t < {NEW_APP} then '5.13.0' else '5.14.0' end as app_version,
         case when renewal then 'monthly_' || currency else 'unknown' end as plan_id, channel, att as attempt_no, idempotency_key_present, amount_minor, st as status,
         case when et = 'payment.declined' then 'card_declined' end as decline_code, case when et = 'payment.failed' then 'processing_error' end as error_code,
         'evt_' || event_id as raw_event_id, event_id * 16 + ordinal as raw_seq
  from parts)
"""


#: series, metric, version, grain, seconds, scope's dimension and direction of the episodes made of orders.
EPISODE_SERIES = (
    ("S1", "authorization_rate", 1, "15m", 900, "", "down"), ("S2", "authorization_rate", 1, "1h", 3600, "psp", "down"), ("S3", "authorization_rate", 1, "1d", 86400, "customer_country", "down"), ("S3h", "authorization_rate", 1, "1h", 3600, "customer_country", "down"),
    ("S4a", "checkout_conversion_rate", 2, "1h", 3600, "", "down"), ("S4b", "checkout_conversion_rate", 2, "1h", 3600, "platform", "down"), ("S5", "renewal_success_rate", 1, "1d", 86400, "psp", "down"), ("S5b", "dunning_recovery_rate", 1, "1d", 86400, "psp", "down"),
    ("S6", "refund_count", 1, "1d", 86400, "customer_country", "up"), ("S7", "duplicate_charge_rate", 1, "1h", 3600, "", "up"), ("S8", "attempt_volume", 1, "1h", 3600, "psp", "both"), ("S9", "fraud_flag_rate", 1, "1h", 3600, "", "up"),
    ("S10", "subscription_cancellation_rate", 2, "1d", 86400, "customer_country", "up"), ("S11", "late_arrival_share", 1, "1h", 3600, "", "up"),
)
_VALUES = {"psp": ("psp_alpha", "psp_beta", "psp_gamma"), "customer_country": ("DE", "US", "BR", "GB"), "platform": ("web", "ios", "android")}


def _sql_list(xs) -> str:
    return "array(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in xs) + ")"


def episodes_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alarm an order, a quarter of an hour apart, in the form that the detectors' scans give."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    pick = lambda i: F.element_at(F.expr(_sql_list([s[i] for s in EPISODE_SERIES])), (F.col("k") % len(EPISODE_SERIES)).cast("int") + 1)
    value = lambda d: F.concat(F.lit(f"{d}="), F.element_at(F.expr(_sql_list(_VALUES[d])), (F.col("c") % len(_VALUES[d])).cast("int") + 1))
    o = o.withColumns({"series": pick(0), "grain_s": pick(4).cast("bigint"), "dim": pick(5), "towards": pick(6), "ts": EPOCH_2024 + F.col("k") * 900})
    scope = F.when(F.col("dim") == "psp", value("psp")).when(F.col("dim") == "customer_country", value("customer_country")).when(F.col("dim") == "platform", value("platform")).otherwise("")
    k, c, t, g = (F.col(x) for x in ("k", "c", "ts", "grain_s"))
    end = t + g * (1 + c % 3)
    return o.select(
        "series", scope.alias("scope"), F.when(F.col("towards") != "both", F.col("towards")).when(k % 2 == 0, "up").otherwise("down").alias("direction"), t.alias("window_start"), end.alias("window_end"), (t + g).alias("detected_at"),
        (k % 100 / 100.0).alias("observed"), (c % 50 / 100.0).alias("expected"), (k % 80 / 10.0).alias("score"), (k % 61).alias("sample"), F.when(k % 3 == 0, F.array(F.lit("cusum"), F.lit("z_persistence"))).otherwise(F.array(F.lit("z_persistence"))).alias("methods"),
        F.array(t, t + g).alias("evidence_ts"), F.when(k % 4000 != 0, end + 2 * g).alias("recovered_at"), (k % 40 / 10.0).alias("score_at_detection"), F.array(F.lit("z_persistence")).alias("methods_at_detection"),
    )


def _duck_pick(xs, i: str) -> str:
    return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in xs) + f"][{i} + 1]"


_N = len(EPISODE_SERIES)
EPISODES_SQL = f"""
src as (select o_orderkey as k, o_custkey as c, {_duck_pick([s[0] for s in EPISODE_SERIES], f"o_orderkey % {_N}")} as series, {_duck_pick([s[4] for s in EPISODE_SERIES], f"o_orderkey % {_N}")}::bigint as grain_s,
  {_duck_pick([s[5] for s in EPISODE_SERIES], f"o_orderkey % {_N}")} as dim, {_duck_pick([s[6] for s in EPISODE_SERIES], f"o_orderkey % {_N}")} as towards, {EPOCH_2024} + o_orderkey * 900 as ts from orders),
episodes as (select series, case dim {" ".join(f"when '{d}' then '{d}=' || {_duck_pick(v, f'c % {len(v)}')}" for d, v in _VALUES.items())} else '' end as scope, case when towards != 'both' then towards when k % 2 = 0 then 'up' else 'down' end as direction,
  ts as window_start, ts + grain_s * (1 + c % 3) as window_end, ts + grain_s as detected_at, (k % 100) / 100.0::double as observed, (c % 50) / 100.0::double as expected, (k % 80) / 10.0::double as score, k % 61 as sample,
  case when k % 3 = 0 then ['cusum', 'z_persistence'] else ['z_persistence'] end as methods, [ts, ts + grain_s] as evidence_ts, case when k % 4000 != 0 then ts + grain_s * (3 + c % 3) end as recovered_at, (k % 40) / 10.0::double as score_at_detection, ['z_persistence'] as methods_at_detection from src),
spec(series, metric, version, grain, grain_s) as (values {", ".join(str((s[0], s[1], s[2], s[3], s[4])) for s in EPISODE_SERIES)}),
candidates as (select 'anom_' || sha256(concat_ws('|', 'main', series, metric, version::varchar, scope, window_start::varchar))[1:16] as anomaly_id, 'main' as system, series, metric, version, grain, scope, direction, window_start, window_end, detected_at, observed, expected,
  observed - expected as delta, case when expected != 0 then (observed - expected) / expected end as relative_delta, score, sample as sample_size, methods,
  list_transform(evidence_ts, lambda t: 'evd_' || sha256(concat_ws('|', metric, version::varchar, scope, grain, t::varchar))[1:16]) as evidence_ids, case when recovered_at is null then 'promoted' else 'recovered' end as status, recovered_at, score_at_detection, methods_at_detection
  from episodes join spec using (series)),
filtered as (select * replace (case when sample_size < 30 and metric != 'attempt_volume' then 'suppressed' else status end as status), case when sample_size < 30 and metric != 'attempt_volume' then 'insufficient_data' end as reason from candidates),
linked as (select f.*, p.parent_id from filtered f left join (select c.anomaly_id, arg_min(g.anomaly_id, {{'n': list_position({[s[0] for s in EPISODE_SERIES]}, g.series), 'w': g.window_start, 'p': g.anomaly_id}}) as parent_id
  from filtered c join filtered g on g.scope = '' and c.scope != '' and g.metric = c.metric and g.system = c.system and g.window_start < c.window_end and c.window_start < g.window_end group by 1) p using (anomaly_id))
"""


def truth_from_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled record a supplier, in the form that read_truth gives."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    return s.selectExpr(
        "concat('rec_', k) as record_key", "concat('kind_', k % 4) as scenario_kind", "element_at(array('incident', 'watch', 'suppress'), cast(k % 3 as int) + 1) as expected_route", f"{EPOCH_2024} + k * 64000 as start",
        f"case when k % 25 != 0 then {EPOCH_2024} + k * 64000 + 86400 * (1 + k % 3) end as `end`", f"case when k % 2 = 0 then {EPOCH_2024} + k * 64000 + 86400 * (1 + k % 3) + 7200 end as expected_recovery", f"case when k % 5 != 0 then {EPOCH_2024} + k * 64000 + 3600 end as oracle_detectable_at",
        "case k % 4 when 0 then array(map('psp', array('psp_alpha'))) when 1 then array(map('customer_country', array('DE', 'US')), map('platform', array('ios'))) when 2 then array(map('psp', array('psp_beta'), 'customer_country', array('BR'))) else cast(array() as array<map<string,array<string>>>) end as affected_cohorts",
        "case k % 5 when 0 then array('charge_approval_rate') when 1 then array('payment_intent_conversion_rate', 'refund_rate') when 2 then array('ingestion_delay') when 3 then array('renewal_success_rate') else array('fraud_flag_rate') end as affected_metrics",
        "case k % 5 when 0 then array('refund_rate') when 4 then array('charge_approval_rate', 'charge_attempt_volume') else cast(array() as array<string>) end as unchanged_metrics",
    )


TRUTH_SQL = f"""
truth as (select 'rec_' || s_suppkey as record_key, 'kind_' || s_suppkey % 4 as scenario_kind, ['incident', 'watch', 'suppress'][s_suppkey % 3 + 1] as expected_route, {EPOCH_2024} + s_suppkey * 64000 as start,
  case when s_suppkey % 25 != 0 then {EPOCH_2024} + s_suppkey * 64000 + 86400 * (1 + s_suppkey % 3) end as stop, case when s_suppkey % 2 = 0 then {EPOCH_2024} + s_suppkey * 64000 + 86400 * (1 + s_suppkey % 3) + 7200 end as expected_recovery, case when s_suppkey % 5 != 0 then {EPOCH_2024} + s_suppkey * 64000 + 3600 end as oracle_detectable_at,
  case s_suppkey % 4 when 0 then '|psp=psp_alpha' when 1 then '|customer_country=DE,customer_country=US|platform=ios' when 2 then '|psp=psp_beta,customer_country=BR' else '' end as cohorts,
  case s_suppkey % 5 when 0 then ['charge_approval_rate'] when 1 then ['payment_intent_conversion_rate', 'refund_rate'] when 2 then ['ingestion_delay'] when 3 then ['renewal_success_rate'] else ['fraud_flag_rate'] end as affected_metrics,
  case s_suppkey % 5 when 0 then ['refund_rate'] when 4 then ['charge_approval_rate', 'charge_attempt_volume'] else [] end as unchanged_metrics from supplier)
"""
