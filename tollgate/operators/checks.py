"""Data-quality checks: each is one row (check, violations), 0 where all is well; a table's checks form one report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import materialized
from .normalize import MAPPED, UNMAPPED

#: Fixed values.
PARENTS = (
    ("payment_method", "customer", "customer.created"), ("payment_intent", "customer", "customer.created"), ("payment_intent", "payment_method", "payment_method.attached"), ("charge", "payment_intent", "payment_intent.created"),
    ("refund", "charge", "charge.succeeded"), ("invoice", "subscription", "customer.subscription.created"), ("subscription", "customer", "customer.created"),
)
REFERENCES = {
    "payment_method": ("customer",), "subscription": ("customer", "payment_method", "invoice"), "invoice": ("customer", "subscription", "payment_intent"), "payment_intent": ("customer", "payment_method", "invoice"), "charge": ("customer", "payment_intent", "payment_method", "invoice"), "refund": ("charge", "payment_intent"),
}
FORBIDDEN_KEYS = (
    "number", "card_number", "pan", "cvc", "cvv", "cvc_check", "exp_month", "exp_year", "last4", "dynamic_last4", "iban", "account_number", "routing_number", "sort_code", "bsb_number", "bank_account", "track_data", "pin",
    "password", "secret", "client_secret", "api_key", "email", "phone", "name", "tax_id",
)
FORBIDDEN_TOKENS = ("scn_", "inc_", "fx_", "scenario", "incident", "ground_truth")
TERMINAL = ("succeeded", "canceled")
API_VERSION = "2026-09-01"
PREFIXES = {"customer": "cus", "payment_method": "pm", "payment_intent": "pi", "charge": "ch", "refund": "re", "invoice": "in", "subscription": "sub"}
CREATIONS = ("customer.created", "payment_method.attached", "customer.subscription.created", "invoice.created", "payment_intent.created", "charge.succeeded", "charge.failed", "refund.created")
STATUS = {
    "payment_intent.succeeded": "succeeded", "payment_intent.canceled": "canceled", "payment_intent.payment_failed": "requires_payment_method", "payment_intent.requires_action": "requires_action", "charge.succeeded": "succeeded", "charge.failed": "failed",
    "invoice.paid": "paid", "invoice.marked_uncollectible": "uncollectible", "customer.subscription.deleted": "canceled", "invoice.finalized": "open", "invoice.created": "draft",
}
METHOD_TYPES = ("card", "sepa_debit", "ideal", "pix")


def _count(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def _failing(name: str, rows: DataFrame, bad: Column) -> DataFrame:
    return rows.agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("violations")).select(F.lit(name).alias("check"), "violations")


def report(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dup_ids(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of an id."""
    return df.agg((F.count(key) - F.countDistinct(key)).alias("violations")).select(F.lit("dup_ids").alias("check"), "violations")


def dangling_refs(flat: DataFrame) -> DataFrame:
    """Distinct non-empty references to objects that no creation event shows, one row a kind of reference: one pass and one aggregate."""
    name = lambda child, parent: f"dangling_{child}_{parent}"
    entry = lambda label, ref, there, when: F.when(when, F.struct(F.lit(label).alias("check"), ref.alias("ref"), F.lit(there).alias("there")))
    refs = [entry(name(child, parent), F.col(parent), False, (F.col("object_type") == child) & (F.col(parent) != "")) for child, parent, _ in PARENTS]
    there = [entry(name(child, parent), F.col("object_id"), True, F.col("type") == made) for child, parent, made in PARENTS]
    each = flat.select(F.explode(F.array_compact(F.array(*refs, *there))).alias("x")).select("x.*")
    per = each.groupBy("check", "ref").agg(F.bool_or("there").alias("known")).groupBy("check").agg(F.count_if(~F.col("known")).alias("violations"))
    every = flat.sparkSession.createDataFrame([(name(child, parent),) for child, parent, _ in PARENTS], "check string")
    return every.join(per, "check", "left").fillna(0)


def envelope_shape(lines: DataFrame, api_version: str = API_VERSION) -> DataFrame:
    """JSON lines (value) whose id lacks the prefix, that aren't events, have another API version, or whose request block has not exactly its two keys."""
    at = lambda p: F.get_json_object("value", p)
    keys = F.array_sort(F.json_object_keys(at("$.request")))
    wrong = lambda c: F.coalesce(~c, F.lit(True))
    return report(_failing("event_id", lines, wrong(F.startswith(at("$.id"), F.lit("evt_")))), _failing("envelope", lines, wrong((at("$.object") == "event") & (at("$.api_version") == api_version))), _failing("request_block", lines, wrong(keys == F.array(F.lit("id"), F.lit("idempotency_key")))))


def object_type_match(flat: DataFrame) -> DataFrame:
    """Events of unknown type; of another object kind or id prefix than their type's; created before their object; of another status than their type's."""
    kind = reduce(lambda chain, k: F.when(F.col("type").isin(*(t for t in (*MAPPED, *UNMAPPED) if _kind(t) == k)), k).otherwise(chain), PREFIXES, F.lit(None).cast("string"))
    prefix = reduce(lambda chain, k: F.when(F.col("kind") == k, f"{PREFIXES[k]}_").otherwise(chain), PREFIXES, F.lit(None).cast("string"))
    want = reduce(lambda chain, t: F.when(F.col("type") == t, STATUS[t]).otherwise(chain), STATUS, F.lit(None).cast("string"))
    rows = flat.withColumn("kind", kind)
    fits = F.coalesce((F.col("object_type") == F.col("kind")) & F.startswith("object_id", prefix), F.lit(False))
    known = F.col("kind").isNotNull()
    return report(
        _failing("unknown_type", rows, ~known), _failing("object_mismatch", rows, known & ~fits), _failing("created_after_event", rows, known & fits & (F.col("object_created") > F.col("created"))),
        _failing("status_mismatch", rows, known & fits & want.isNotNull() & ~F.coalesce(F.col("status") == want, F.lit(False))),
    )


def _kind(event_type: str) -> str:
    """The object kind of an event type."""
    head, *rest = event_type.split(".")
    return rest[0] if head == "customer" and rest[0] == "subscription" else head


def billing_object_rules(flat: DataFrame) -> DataFrame:
    """Payment methods of an unknown type, empty subscription periods, and paid invoices paid in another amount than due."""
    t, kind = F.col("type"), F.col("object_type")
    return report(
        _failing("payment_method_type", flat, (kind == "payment_method") & ~F.coalesce(F.col("payment_method_type").isin(*METHOD_TYPES), F.lit(False))), _failing("subscription_period", flat, (kind == "subscription") & (F.coalesce("period_end", F.lit(0)) <= F.coalesce("period_start", F.lit(0)))),
        _failing("invoice_amount_paid", flat, (t == "invoice.paid") & ~F.col("amount_paid").eqNullSafe(F.col("amount"))),
    )


def charge_amount_ne_pi(flat: DataFrame) -> DataFrame:
    """Charges whose amount isn't their payment intent's."""
    pi = flat.where("type = 'payment_intent.created'").select("payment_intent", F.col("amount").alias("pi_amount"))
    return _count("charge_amount_ne_pi", flat.where("type in ('charge.succeeded', 'charge.failed')").join(pi, "payment_intent").where("amount != pi_amount"))


def refunds_exceed_charge(flat: DataFrame) -> DataFrame:
    """Charges refunded beyond their amount."""
    back = flat.where("type = 'refund.created'").groupBy(F.col("charge").alias("object_id")).agg(F.sum("amount").alias("back"))
    return _count("refunds_exceed_charge", flat.where("type = 'charge.succeeded'").join(back, "object_id").where("back > amount"))


def payload_checks(raw: DataFrame, column: str = "data") -> DataFrame:
    """Card-number-like runs, forbidden tokens and keys, numbers that pass Luhn, and IBAN-shaped values in the raw JSON."""
    text = F.col(column)
    keys = F.regexp_extract_all(text, F.lit(r'"(\w+)"\s*:'), F.lit(1))
    digits = F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{13,19})(?!\d)"), F.lit(1))
    return report(
        _failing("pan_like_runs", raw, text.rlike(r"(^|\D)\d{13,19}(\D|$)")),
        _failing("token_leak", raw, reduce(lambda a, b: a | b, (text.contains(t) for t in FORBIDDEN_TOKENS))),
        _failing("forbidden_keys", raw, F.arrays_overlap(F.transform(keys, F.lower), F.array(*map(F.lit, FORBIDDEN_KEYS)))),
        _failing("luhn_pan", raw, F.exists(digits, lambda d: F.call_function("luhn_check", d))),
        _failing("iban_like", raw, text.rlike(r'"[A-Z]{2}\d{2}[A-Z0-9]{11,30}"')),
    )


def norm_checks(norm: DataFrame, flat: DataFrame) -> DataFrame:
    """The checks between normalized and raw events and within the normalized ones; both are written once, as every check reads them."""
    dims = ("customer_country", "issuer_country", "currency", "psp", "payment_method_type", "card_brand", "platform", "app_version", "plan_id", "channel")
    norm = materialized(norm.select("event_id", "raw_event_id", "event_type", "occurred_at", "ingested_at", "attempt_no", *dims), "norm")
    flat = materialized(flat.select("id", "type"), "raw_ids")
    raw_ids = flat.select(F.col("id").alias("raw_event_id"), "type").distinct()
    mapped, other = raw_ids.where(F.col("type").isin(*MAPPED)), raw_ids.where(F.col("type").isin(*UNMAPPED))
    attempt = F.col("event_type").isin("payment.authorized", "payment.declined", "payment.failed")
    rules = norm.agg(
        F.count_if(reduce(lambda a, b: a | b, (F.col(d) == "" for d in dims))).alias("empty_dimension"), F.count_if(F.col("ingested_at") < F.col("occurred_at")).alias("delivered_before"), F.count_if(attempt & (F.col("attempt_no") == 0)).alias("attempt_without_number"),
        F.count_if(F.col("event_type") == "payment.authorized").alias("authorized"),
    )
    succeeded = flat.agg(F.count_if(F.col("type") == "charge.succeeded").alias("succeeded"))
    both = rules.crossJoin(succeeded)  # of two single rows
    four = both.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("empty_dimension", "delivered_before", "attempt_without_number", "authorized_ne_succeeded"))), F.array("empty_dimension", "delivered_before", "attempt_without_number", F.abs(F.col("authorized") - F.col("succeeded"))))).alias("check", "violations"))
    return report(dup_ids(norm, "event_id"), _count("norm_without_raw", norm.join(raw_ids, "raw_event_id", "left_anti")), _count("mapped_without_norm", mapped.join(norm, "raw_event_id", "left_anti")), _count("norm_from_unmapped", norm.join(other, "raw_event_id", "left_semi")), four)


def created_monotone(flat: DataFrame, block: int = 100_000) -> DataFrame:
    """Events created before an earlier one of their run: within blocks of seq by a window, between them by the blocks' maxima."""
    b = flat.select("run_id", "seq", "created", F.floor(F.col("seq") / block).alias("b"))
    tops = b.groupBy("run_id", "b").agg(F.max("created").alias("top"))
    ahead = tops.withColumn("ahead", F.max("top").over(W.partitionBy("run_id").orderBy("b").rowsBetween(W.unboundedPreceding, -1))).drop("top")
    inside = F.max("created").over(W.partitionBy("run_id", "b").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    rows = b.withColumn("inside", inside).join(ahead, ["run_id", "b"])
    return _failing("created_monotone", rows, F.col("created") < F.greatest("inside", "ahead"))


def creation_order(flat: DataFrame) -> DataFrame:
    """Objects whose first event doesn't create them, and second creations (charges may have one)."""
    created = F.col("type").isin(*CREATIONS)
    nth = F.row_number().over(W.partitionBy("run_id", "object_id").orderBy("seq"))
    rows = flat.withColumn("nth", nth)
    return _failing("creation_order", rows, ((F.col("nth") == 1) & ~created) | ((F.col("nth") > 1) & created & (F.col("object_type") != "charge")))


def refs_seen_before(flat: DataFrame) -> DataFrame:
    """References, of every kind and to every kind, to an object that no earlier event shows."""
    seen = flat.groupBy("run_id", F.col("object_type").alias("to"), F.col("object_id").alias("ref")).agg(F.min("seq").alias("first"))
    each = [F.when((F.col("object_type") == child) & (F.col(parent) != ""), F.struct(F.lit(parent).alias("to"), F.col(parent).alias("ref"))) for child, parents in REFERENCES.items() for parent in parents]
    refs = flat.select("run_id", "seq", F.explode(F.array_compact(F.array(*each))).alias("x")).select("run_id", "seq", "x.*")
    return _failing("refs_seen_before", refs.join(seen, ["run_id", "to", "ref"], "left"), F.col("first").isNull() | (F.col("first") >= F.col("seq")))


def pi_lifecycle(flat: DataFrame) -> DataFrame:
    """Payment intents with an amount that isn't positive or changes, events or charges after a terminal status (a refund's update may
    come), or another amount received than asked for."""
    rows = flat.where("object_type in ('payment_intent', 'charge') and payment_intent != ''")
    own = W.partitionBy("run_id", "payment_intent").orderBy("seq")
    intent = F.col("object_type") == "payment_intent"
    last = lambda c: F.last(F.when(intent, F.col(c)), ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("before", last("amount")).withColumn("over", F.coalesce(last("status").isin(*TERMINAL), F.lit(False)))
    bad = lambda name, when: _failing(name, marked, when)
    return report(
        bad("pi_amount_positive", intent & ~F.coalesce(F.col("amount") > 0, F.lit(False))), bad("pi_amount_changed", intent & F.col("before").isNotNull() & ~F.col("amount").eqNullSafe(F.col("before"))), bad("pi_event_after_terminal", intent & F.col("over")),
        bad("pi_amount_received", (F.col("type") == "payment_intent.succeeded") & ~F.col("amount_received").eqNullSafe(F.col("amount"))), bad("charge_after_terminal", ~intent & F.col("over") & (F.col("type") != "charge.refunded")),
    )


def charge_refund_rules(flat: DataFrame) -> DataFrame:
    """Failed charges without a code, refunds whose running sum exceeds their charge, and refunded charges that state another sum than that or more than the charge."""
    kinds = flat.where("type in ('charge.succeeded', 'charge.failed', 'charge.refunded', 'refund.created')")
    rows = kinds.withColumn("key", F.when(F.col("type") == "refund.created", F.col("charge")).otherwise(F.col("object_id"))).where("key != ''")
    upto = W.partitionBy("run_id", "key").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    back = F.sum(F.when(F.col("type") == "refund.created", F.col("amount"))).over(upto)
    paid = F.last(F.when(F.col("type").isin("charge.succeeded", "charge.failed"), F.col("amount")), ignorenulls=True).over(upto)
    marked = rows.withColumn("back", back).withColumn("paid", paid)
    stated = F.col("amount_refunded")
    return report(
        _failing("failed_charge_without_code", flat.where("type = 'charge.failed'"), F.coalesce(F.col("failure_code"), F.lit("")) == ""), _failing("running_refunds_exceed", marked, (F.col("type") == "refund.created") & (F.col("back") > F.col("paid"))),
        _failing("amount_refunded", marked, (F.col("type") == "charge.refunded") & ((F.coalesce(stated, F.lit(0)) > F.coalesce("amount", F.lit(0))) | ~stated.eqNullSafe(F.col("back")))),
    )
