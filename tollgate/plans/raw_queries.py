"""Registered queries of sources, quality checks and normalization over the order tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as c
from ..operators import normalize as n
from ..sources import raw_events as r
from .queries import add

COLUMNS = "run_id, seq, id, type, object_type, created, object_id, customer, payment_intent, channel, psp, customer_country, currency, amount, status, failure_code, outcome_reason, idempotency_key"
RAW = f"with {r.raw_sql()}"
DIRTY = f"with {r.raw_sql(True)}"
NORM = """,
pi as (select payment_intent, seq as pi_seq, channel as pi_channel, idempotency_key is not null as pi_key from raw where type = 'payment_intent.created'),
ch as (select raw.*, pi_channel, pi_key, pi_seq from raw left join pi using (payment_intent) where object_type = 'charge'),
ok as (select *, row_number() over (partition by payment_intent order by seq) as attempt, case when outcome_reason = 'highest_risk_level' then 'fraud' when failure_code = 'card_declined' then 'declined' when failure_code = 'processing_error' then 'failed' end as fc from ch where pi_seq < seq),
rows_ as (
  select *, case channel when 'checkout' then 'checkout.started' else 'subscription.renewal_attempted' end as et, 'started' as st, 0 as att, channel as chan, idempotency_key is not null as ikey, null as fc from raw where object_type = 'payment_intent'
  union all by name select *, 'payment.authorized' as et, 'authorized' as st, attempt as att, pi_channel as chan, pi_key as ikey from ok where type = 'charge.succeeded'
  union all by name select *, 'payment.captured' as et, 'captured' as st, attempt as att, pi_channel as chan, pi_key as ikey from ok where type = 'charge.succeeded'
  union all by name select *, 'fraud.flagged' as et, 'flagged' as st, attempt as att, pi_channel as chan, pi_key as ikey from ok where fc = 'fraud'
  union all by name select *, 'payment.declined' as et, 'declined' as st, attempt as att, pi_channel as chan, pi_key as ikey from ok where fc in ('fraud', 'declined')
  union all by name select *, 'payment.failed' as et, 'failed' as st, attempt as att, pi_channel as chan, pi_key as ikey from ok where fc = 'failed'
  union all by name select *, 'dunning.attempted' as et, 'attempted' as st, attempt as att, pi_channel as chan, pi_key as ikey from ok where pi_channel = 'renewal' and attempt > 1),
norm as (
  select run_id, id || '/' || et as event_id, et as event_type, created as occurred_at, created as ingested_at, 'merchant_1' as merchant_id, object_id as entity_id, customer as customer_id, payment_intent as payment_intent_id,
    customer_country, coalesce(issuer_country, 'unknown') as issuer_country, currency, psp, coalesce(payment_method_type, 'unknown') as payment_method_type, coalesce(card_brand, 'unknown') as card_brand, platform, 'unknown' as app_version, 'unknown' as plan_id, chan as channel,
    cast(att as int) as attempt_no, cast(ikey as int) as idempotency_key_present, amount as amount_minor, st as status, case when et in ('payment.declined', 'payment.failed', 'fraud.flagged') then outcome_reason end as decline_code,
    case when et in ('payment.declined', 'payment.failed', 'fraud.flagged') then failure_code end as error_code, id as raw_event_id, seq as raw_seq from rows_)
"""




add("a2_flat_raw_from_orders", lambda s, sf: r.raw_from_orders(s, sf).select(*COLUMNS.split(", ")), f"{RAW} select {COLUMNS} from raw")
add("a3_charge_attempts", lambda s, sf: r.charge_attempts(r.raw_from_orders(s, sf)), f"{RAW} select run_id, seq, object_id, psp, channel, customer_country, amount, created - created % 3600 as hour, type = 'charge.succeeded' as ok from raw where object_type = 'charge'")
add("a9_incidents_current", lambda s, sf: r.incidents_current(r.raw_from_orders(s, sf).select("run_id", F.col("payment_intent").alias("incident_id"), "status", F.col("id").alias("snapshot_json"), "seq")), f"{RAW} select run_id, payment_intent as incident_id, arg_max(status, seq) as status, arg_max(id, seq) as snapshot_json, max(seq) as seq from raw group by 1, 2")
add("b1_dup_ids", lambda s, sf: c.dup_ids(r.raw_from_orders(s, sf), "id"), f"{RAW} select 'dup_ids' as check, count(id) - count(distinct id) as violations from raw")
add("b3_charge_amount_ne_pi", lambda s, sf: c.charge_amount_ne_pi(r.raw_from_orders(s, sf)), f"{RAW} select 'charge_amount_ne_pi' as check, count(*) as violations from raw a join raw b on a.payment_intent = b.object_id where a.object_type = 'charge' and a.amount != b.amount")
add("b7_b10_norm_checks", lambda s, sf: c.norm_checks(n.normalize_run(r.raw_from_orders(s, sf, True)), r.raw_from_orders(s, sf, True)), f"""{DIRTY}{NORM}
select 'dup_ids' as check, count(event_id) - count(distinct event_id) as violations from norm
union all select 'norm_without_raw', count(*) from norm where raw_event_id not in (select id from raw)
union all select 'mapped_without_norm', count(*) from (select distinct id from raw) where id not in (select raw_event_id from norm)
union all select 'norm_from_unmapped', 0
union all select 'empty_dimension', count(*) filter (where psp = '' or app_version = '') from norm
union all select 'delivered_before', count(*) filter (where ingested_at < occurred_at) from norm
union all select 'attempt_without_number', count(*) filter (where event_type in ('payment.authorized', 'payment.declined', 'payment.failed') and attempt_no = 0) from norm
union all select 'authorized_ne_succeeded', abs((select count(*) from norm where event_type = 'payment.authorized') - (select count(*) from raw where type = 'charge.succeeded'))""")
add("b15_created_monotone", lambda s, sf: c.created_monotone(r.raw_from_orders(s, sf), 1000), f"{RAW} select 'created_monotone' as check, count(*) as violations from (select created < max(created) over (order by seq rows between unbounded preceding and 1 preceding) as bad from raw) where bad")
add("c11_failure_class", lambda s, sf: r.raw_from_orders(s, sf).where("type = 'charge.failed'").groupBy(n.failure_class(F.col("failure_code"), F.col("outcome_reason")).alias("failure_class")).agg(F.count("*").alias("n")), f"{RAW}{NORM} select fc as failure_class, count(*) as n from ok where fc is not null group by 1")
add("c14_norm_rejects_orders", lambda s, sf: n.norm_rejects(r.raw_from_orders(s, sf, True)), f"{DIRTY}, i as (select payment_intent, min(seq) as first from raw where type = 'payment_intent.created' group by 1) select run_id, seq, id, type, 'before_payment_intent' as reason from raw left join i using (payment_intent) where object_type = 'charge' and (first is null or first >= seq)")
add("c16_normalize_run", lambda s, sf: n.normalize_run(r.raw_from_orders(s, sf)), f"{RAW}{NORM} select * from norm")
add("c16_normalize_dirty", lambda s, sf: n.normalize_run(r.raw_from_orders(s, sf, True)), f"{DIRTY}{NORM} select * from norm")


def bills(spark, sf_dir):
    """Envelopes of every kind, made of customers."""
    return r.raw_from_customers(spark, sf_dir)


BILLS = f"with {r.customers_sql()}"
_n = lambda name, when, rows="raw": f"select '{name}' as check, count(*) filter (where {when}) as violations from {rows}"
_all = lambda *parts: BILLS + " " + " union all ".join(parts)
add("a2_raw_from_customers", bills, f"{BILLS} select {', '.join(r.FLAT)} from raw")
add("b2_dangling_refs", lambda s, sf: c.dangling_refs(bills(s, sf)), _all(*(f"select 'dangling_{a}_{b}' as check, count(distinct {b}) as violations from raw where object_type = '{a}' and {b} != '' and {b} not in (select object_id from raw where type = '{t}')" for a, b, t in c.PARENTS)))
add("b3_charge_amount_of_customers", lambda s, sf: c.charge_amount_ne_pi(bills(s, sf)), _all("select 'charge_amount_ne_pi' as check, count(*) as violations from raw a join raw b on a.payment_intent = b.object_id and b.type = 'payment_intent.created' where a.type in ('charge.succeeded', 'charge.failed') and a.amount != b.amount"))
add("b4_refunds_exceed_charge", lambda s, sf: c.refunds_exceed_charge(bills(s, sf)), _all("select 'refunds_exceed_charge' as check, count(*) as violations from (select charge, sum(amount) as back from raw where type = 'refund.created' group by 1) x join raw y on y.object_id = x.charge and y.type = 'charge.succeeded' where back > amount"))
add("b16_object_type_match", lambda s, sf: c.object_type_match(bills(s, sf)), BILLS + ", k2 as (select *, case when type in ({}) then case when type like 'customer.subscription%' then 'subscription' else split_part(type, '.', 1) end end as kind from raw), f as (select *, coalesce(object_type = kind and starts_with(object_id, case kind {} end || '_'), false) as fits, case type {} end as want from k2) ".format(", ".join(f"'{t}'" for t in (*n.MAPPED, *n.UNMAPPED)), " ".join(f"when '{k}' then '{v}'" for k, v in c.PREFIXES.items()), " ".join(f"when '{k}' then '{v}'" for k, v in c.STATUS.items())) + " union all ".join((_n("unknown_type", "kind is null", "f"), _n("object_mismatch", "kind is not null and not fits", "f"), _n("created_after_event", "fits and object_created > created", "f"), _n("status_mismatch", "fits and want is not null and status is distinct from want", "f"))))
add("b17_creation_order", lambda s, sf: c.creation_order(bills(s, sf)), BILLS + f", o as (select *, row_number() over (partition by object_id order by seq) as nth, type in {c.CREATIONS} as made from raw) " + _n("creation_order", "(nth = 1 and not made) or (nth > 1 and made and object_type != 'charge')", "o"))
add("b18_refs_seen_before", lambda s, sf: c.refs_seen_before(bills(s, sf)), BILLS + ", refs as (" + " union all ".join(f"select seq, '{p}' as parent, {p} as ref from raw where object_type = '{k}' and {p} != ''" for k, ps in c.REFERENCES.items() for p in ps) + "), seen as (select object_type, object_id, min(seq) as first from raw group by 1, 2) " + _n("refs_seen_before", "first is null or first >= seq", "refs left join seen on object_type = parent and object_id = ref"))
_BEFORE = "over (partition by payment_intent order by seq rows between unbounded preceding and 1 preceding)"
add("b19_pi_lifecycle", lambda s, sf: c.pi_lifecycle(bills(s, sf)), BILLS + f", p as (select *, last_value(case when object_type = 'payment_intent' then amount end ignore nulls) {_BEFORE} as before, coalesce(last_value(case when object_type = 'payment_intent' then status end ignore nulls) {_BEFORE} in ('succeeded', 'canceled'), false) as over_ from raw where object_type in ('payment_intent', 'charge') and payment_intent != '') " + " union all ".join((_n("pi_amount_positive", "object_type = 'payment_intent' and not coalesce(amount > 0, false)", "p"), _n("pi_amount_changed", "object_type = 'payment_intent' and before is not null and amount is distinct from before", "p"), _n("pi_event_after_terminal", "object_type = 'payment_intent' and over_", "p"), _n("pi_amount_received", "type = 'payment_intent.succeeded' and amount_received is distinct from amount", "p"), _n("charge_after_terminal", "object_type = 'charge' and over_ and type != 'charge.refunded'", "p"))))
add("b20_charge_refund_rules", lambda s, sf: c.charge_refund_rules(bills(s, sf)), BILLS + ", q as (select *, case when type = 'refund.created' then charge else object_id end as key from raw where type in ('charge.succeeded', 'charge.failed', 'charge.refunded', 'refund.created')), z as (select *, sum(case when type = 'refund.created' then amount end) over w as back, last_value(case when type in ('charge.succeeded', 'charge.failed') then amount end ignore nulls) over w as paid from q window w as (partition by key order by seq rows between unbounded preceding and current row)) " + " union all ".join((_n("failed_charge_without_code", "type = 'charge.failed' and coalesce(failure_code, '') = ''"), _n("running_refunds_exceed", "type = 'refund.created' and back > paid", "z"), _n("amount_refunded", "type = 'charge.refunded' and (coalesce(amount_refunded, 0) > coalesce(amount, 0) or amount_refunded is distinct from back)", "z"))))
add("b21_billing_object_rules", lambda s, sf: c.billing_object_rules(bills(s, sf)), _all(_n("payment_method_type", f"object_type = 'payment_method' and payment_method_type not in {c.METHOD_TYPES}"), _n("subscription_period", "object_type = 'subscription' and coalesce(period_end, 0) <= coalesce(period_start, 0)"), _n("invoice_amount_paid", "type = 'invoice.paid' and amount_paid is distinct from amount")))

_LINE = """concat('{"id":"', case when c % 50 = 0 then 'ev_' else 'evt_' end, c, '","object":"', case when c % 40 = 0 then 'thing' else 'event' end, '","api_version":"2026-09-01","request":{"id":null', case when c % 30 = 0 then ',"more":1' else '' end, case when c % 35 = 0 then '' else ',"idempotency_key":"k"' end, '}}')"""
add("b14_envelope_shape", lambda s, sf: c.envelope_shape(s.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey as c").selectExpr(f"{_LINE} as value")), "with k as (select c_custkey as c from customer) select 'event_id' as check, count(*) filter (where c % 50 = 0) as violations from k union all select 'envelope', count(*) filter (where c % 40 = 0) from k union all select 'request_block', count(*) filter (where c % 30 = 0 or c % 35 = 0) from k")

_UP = lambda key: f"over (partition by {key} order by seq rows between unbounded preceding and 1 preceding)"
_unknown = lambda x: f"coalesce(nullif({x}, ''), 'unknown')"
BILL_NORM = BILLS + f""",
s1 as (select *, case when type = 'customer.subscription.created' or type in {n.INVOICE} then last_value(case when type = 'customer.subscription.created' then {_unknown("plan")} end ignore nulls) {_UP("subscription")} end as sub_plan from raw),
s2 as (select *, case when type in {('payment_intent.created', *n.INVOICE, *n.SUBSCRIPTION)} and invoice != '' then last_value(case when type in {n.INVOICE} then coalesce(sub_plan, 'unknown') end ignore nulls) {_UP("invoice")} end as invoice_plan,
  case when type in {('payment_intent.created', *n.INVOICE, *n.SUBSCRIPTION)} and invoice != '' then last_value(case when type = 'payment_intent.created' then {_unknown("psp")} end ignore nulls) {_UP("invoice")} end as invoice_psp from s1),
s3 as (select *, type in {n.CHARGE} as charge_, last_value(case when type = 'payment_intent.created' then coalesce(channel, '') end ignore nulls) {_UP("payment_intent")} as pi_channel, last_value(case when type = 'payment_intent.created' then coalesce(invoice_plan, 'unknown') end ignore nulls) {_UP("payment_intent")} as pi_plan,
  last_value(case when type = 'payment_intent.created' then case when idempotency_key is not null then 1 else 0 end end ignore nulls) {_UP("payment_intent")} as pi_key from s2),
s4 as (select *, case when charge_ and pi_channel is not null then count(*) filter (where charge_ and pi_channel is not null) over (partition by payment_intent order by seq) else 0 end as attempt,
  case when type = 'charge.failed' then case when outcome_reason = 'highest_risk_level' then 'fraud' when failure_code in {n.ISSUER_CODES} then 'declined' when failure_code = 'processing_error' then 'failed' end end as fc from s3),
s5 as (select *, case when type not in {(*n.MAPPED, *n.UNMAPPED)} then 'unknown_type' when type = 'payment_intent.created' and coalesce(channel not in ('checkout', 'renewal'), true) then 'channel' when charge_ and pi_channel is null then 'before_payment_intent' when type = 'charge.failed' and fc is null then 'failure_code'
  when type = 'refund.created' and coalesce(status not in ('succeeded', 'pending'), true) then 'refund_status' when type = 'customer.subscription.updated' and not ((status = 'active' and prev_period is not null) or status = 'past_due') then 'subscription_shape' end as reject from s4),
s6 as (select *, unnest(list_filter([
  case when type = 'payment_intent.created' then {{'t': case channel when 'checkout' then 'checkout.started' else 'subscription.renewal_attempted' end, 's': 'started'}} end,
  case when type = 'charge.succeeded' then {{'t': 'payment.authorized', 's': 'authorized'}} end, case when type = 'charge.succeeded' then {{'t': 'payment.captured', 's': 'captured'}} end, case when fc = 'fraud' then {{'t': 'fraud.flagged', 's': 'flagged'}} end, case when fc in ('fraud', 'declined') then {{'t': 'payment.declined', 's': 'declined'}} end,
  case when fc = 'failed' then {{'t': 'payment.failed', 's': 'failed'}} end, case when charge_ and pi_channel = 'renewal' and attempt > 1 then {{'t': 'dunning.attempted', 's': 'attempted'}} end,
  case when type in {n.INVOICE} then {{'t': type, 's': split_part(type, '.', 2)}} end, case when type = 'customer.subscription.updated' and status = 'active' then {{'t': 'subscription.renewed', 's': 'renewed'}} end, case when type = 'customer.subscription.updated' and status = 'past_due' then {{'t': 'subscription.past_due', 's': 'past_due'}} end,
  case when type = 'customer.subscription.deleted' then {{'t': 'subscription.canceled', 's': case when prev_status = 'active' then 'canceled_voluntary' else 'canceled_involuntary' end}} end, case when type = 'refund.created' then {{'t': 'refund.requested', 's': 'requested'}} end, case when type = 'refund.created' and status = 'succeeded' then {{'t': 'refund.succeeded', 's': 'succeeded'}} end],
  lambda x: x is not null)) as r from s5 where reject is null),
norm as (select run_id, id || '/' || r.t as event_id, r.t as event_type, created as occurred_at, coalesce(delivered_at, created) as ingested_at, object_id as entity_id, case when object_type = 'refund' then 'unknown' else customer end as customer_id, case when object_type in ('charge', 'payment_intent', 'refund') then payment_intent else 'unknown' end as payment_intent_id,
  {_unknown("case when object_type in ('invoice', 'subscription') then invoice_psp else psp end")} as psp, {_unknown("case when charge_ then pi_plan when object_type = 'payment_intent' then invoice_plan when object_type = 'invoice' then sub_plan when object_type = 'subscription' then plan end")} as plan_id,
  {_unknown("case when charge_ then pi_channel when object_type in ('invoice', 'subscription') then 'renewal' else channel end")} as channel, cast(case when charge_ then attempt else 0 end as int) as attempt_no, cast(case when charge_ then pi_key when object_type = 'payment_intent' then case when idempotency_key is not null then 1 else 0 end else 0 end as int) as idempotency_key_present,
  coalesce(amount, 0) as amount_minor, r.s as status, id as raw_event_id, seq as raw_seq from s6)
"""
_COLS = "run_id, event_id, event_type, occurred_at, ingested_at, entity_id, customer_id, payment_intent_id, psp, plan_id, channel, attempt_no, idempotency_key_present, amount_minor, status, raw_event_id, raw_seq"
for _name, _when in (("c2_norm_event_map", "true"), ("c5_c6_c7_state_of_invoices", "event_type like 'invoice.%' or event_type like 'subscription.%'"), ("c8_c9_subscriptions", "event_type in ('subscription.renewed', 'subscription.past_due', 'subscription.canceled')"), ("c10_refund_rows", "event_type like 'refund.%'"), ("c12_dunning_rows", "event_type = 'dunning.attempted'"), ("c15_delivery_time", "ingested_at > occurred_at")):
    add(_name, lambda s, sf, w=_when: n.normalize_run(bills(s, sf)).where(w).select(*_COLS.split(", ")), f"{BILL_NORM} select {_COLS} from norm where {_when}")
add("c14_norm_rejects", lambda s, sf: n.norm_rejects(bills(s, sf)), f"{BILL_NORM} select run_id, seq, id, type, reject as reason from s5 where reject is not null")
