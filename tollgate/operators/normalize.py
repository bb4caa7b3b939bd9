"""Raw envelopes to normalized events. What depends on earlier events of an object is a window over that object.

``classified`` gives every raw event its attempt number, its payment intent's and invoice's state as of its place in the
stream, and the reason why it can't be mapped, if any; ``normalize_run`` maps the rest. Nothing is dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNKNOWN = "unknown"
DIMENSIONS = ("customer_country", "issuer_country", "currency", "psp", "payment_method_type", "card_brand", "platform", "app_version", "plan_id", "channel")
#: Fixed values of the mapping.
UNMAPPED = ("customer.created", "payment_method.attached", "customer.subscription.created", "invoice.finalized", "invoice.marked_uncollectible", "payment_intent.requires_action", "payment_intent.succeeded", "payment_intent.payment_failed", "payment_intent.canceled", "charge.refunded")
MAPPED = ("payment_intent.created", "charge.succeeded", "charge.failed", "invoice.created", "invoice.paid", "invoice.payment_failed", "customer.subscription.updated", "customer.subscription.deleted", "refund.created")
ISSUER_CODES = ("card_declined", "expired_card", "incorrect_cvc", "payment_method_provider_decline")
TECHNICAL_CODES = ("processing_error",)
FRAUD_REASON = "highest_risk_level"
MOST_ATTEMPTS = 255


def _is(*types: str) -> Column:
    return F.col("type").isin(*types)


CHARGE = ("charge.succeeded", "charge.failed")
INVOICE = ("invoice.created", "invoice.paid", "invoice.payment_failed")
SUBSCRIPTION = ("customer.subscription.updated", "customer.subscription.deleted")


def _keyed(kinds: tuple[str, ...], key: str) -> Column:
    """Whether a row is of the kinds and names its object."""
    return F.coalesce(_is(*kinds) & (F.col(key) != ""), F.lit(False))


def _last_before(when: Column, value: Column, own) -> Column:
    return F.last(F.when(when, value), ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, -1))


def object_state(raw: DataFrame) -> DataFrame:
    """What subscriptions and payment intents knew before a row: sub_plan, the plan of the subscription's latest created
    event; the payment intent's channel and idempotency flag as of a charge, the charge's attempt number, and where that
    payment intent was created and for which invoice. own and nr are the object.

    A row is of one object at most, so both kinds are one window; every other row, keyless ones included, stands alone and
    so spreads evenly. The window's keys are columns: as expressions each window function would shuffle the rows anew.
    """
    sub, pay = _keyed(("customer.subscription.created", *INVOICE), "subscription"), _keyed(("payment_intent.created", *CHARGE), "payment_intent")
    rows = raw.withColumns({"own": F.when(sub, F.col("subscription")).when(pay, F.col("payment_intent")), "nr": F.when(sub, 0).when(pay, 1).otherwise(F.col("seq"))})
    own, created = W.partitionBy("run_id", "own", "nr").orderBy("seq"), _is("payment_intent.created")
    known = rows.withColumns(
        {
            "sub_plan": _last_before(_is("customer.subscription.created"), F.coalesce(F.nullif("plan", F.lit("")), F.lit(UNKNOWN)), own),
            "pi_channel": _last_before(created, F.coalesce("channel", F.lit("")), own),
            "pi_key": _last_before(created, F.when(F.col("idempotency_key").isNotNull(), "1").otherwise("0"), own),
            "pi_invoice": _last_before(created, F.coalesce("invoice", F.lit("")), own),
            "pi_seq": _last_before(created, F.col("seq"), own),
        }
    )
    tried = F.coalesce(_is(*CHARGE) & F.col("pi_channel").isNotNull(), F.lit(False))
    nth = F.count_if(tried).over(own.rowsBetween(W.unboundedPreceding, 0))
    return known.withColumn("attempt", F.when(tried, nth).otherwise(F.lit(0).cast("bigint")))


def invoice_state(known: DataFrame) -> DataFrame:
    """Adds invoice_plan (as of the invoice's last event), invoice_psp (of the last renewal payment intent before) and pi_plan:
    a charge stands where its payment intent was created, and so knows the plan that the intent had.

    Rows without an invoice learn nothing here; they stay with those of their own object, so that alike rows pack together.
    """
    part, charge = _keyed(("payment_intent.created", *INVOICE, *SUBSCRIPTION), "invoice"), F.coalesce(_is(*CHARGE), F.lit(False))
    follows = charge & F.coalesce(F.col("pi_invoice") != "", F.lit(False))
    rows = known.withColumns({"own": F.when(part, F.col("invoice")).when(follows, F.col("pi_invoice")), "nr": F.when(part | follows, 0).otherwise(F.xxhash64("own", "nr")), "at": F.when(follows, F.col("pi_seq")).otherwise(F.col("seq"))})
    own = W.partitionBy("run_id", "own", "nr").orderBy("at", "seq")
    held = F.col("own").isNotNull()
    plan = _last_before(held & _is(*INVOICE), F.coalesce("sub_plan", F.lit(UNKNOWN)), own)
    psp = _last_before(held & _is("payment_intent.created"), F.coalesce(F.nullif("psp", F.lit("")), F.lit(UNKNOWN)), own)
    seen = rows.withColumns({"plan_then": plan, "invoice_psp": psp})
    pi_plan = F.when(charge & F.col("pi_channel").isNotNull(), F.coalesce("plan_then", F.lit(UNKNOWN)))
    return seen.withColumns({"invoice_plan": F.when(~charge, F.col("plan_then")), "pi_plan": pi_plan}).drop("own", "nr", "at", "plan_then", "pi_invoice", "pi_seq")


def failure_class(code: Column, reason: Column) -> Column:
    """fraud, declined or failed; null for a code that isn't known."""
    return F.when(reason == FRAUD_REASON, "fraud").when(code.isin(*ISSUER_CODES), "declined").when(code.isin(*TECHNICAL_CODES), "failed")


def classified(raw: DataFrame) -> DataFrame:
    """Raw events with their state, and reject: why an event can't be mapped (null if it can)."""
    known = invoice_state(object_state(raw))
    shape = ~((F.col("status") == "active") & F.col("prev_period").isNotNull()) & (F.col("status") != "past_due")
    charge, failed = _is(*CHARGE), _is("charge.failed")
    reject = (
        F.when(~_is(*MAPPED, *UNMAPPED) | F.col("type").isNull(), "unknown_type")
        .when(_is("payment_intent.created") & ~F.coalesce(F.col("channel").isin("checkout", "renewal"), F.lit(False)), "channel")
        .when(charge & F.col("pi_channel").isNull(), "before_payment_intent")
        .when(charge & (F.col("attempt") > MOST_ATTEMPTS), "too_many_attempts")
        .when(failed & failure_class(F.col("failure_code"), F.col("outcome_reason")).isNull(), "failure_code")
        .when(_is("refund.created") & ~F.coalesce(F.col("status").isin("succeeded", "pending"), F.lit(False)), "refund_status")
        .when(_is("customer.subscription.updated") & F.coalesce(shape, F.lit(True)), "subscription_shape")
    )
    return known.withColumn("reject", reject)


def norm_rejects(raw: DataFrame) -> DataFrame:
    """run_id, seq, id, type and reason of every event that can't be mapped."""
    return classified(raw).where("reject is not null").select("run_id", "seq", "id", "type", F.col("reject").alias("reason"))


def event_map() -> Column:
    """The normalized rows (event_type, status) that a raw event stands for, none to three."""
    row = lambda kind, status, when: F.when(when, F.struct(F.lit(kind).alias("event_type"), F.lit(status).alias("status")))
    intent, channel, refund = _is("payment_intent.created"), F.col("channel"), _is("refund.created")
    failure = F.when(_is("charge.failed"), failure_class(F.col("failure_code"), F.col("outcome_reason")))
    updated, active = _is("customer.subscription.updated"), F.col("status") == "active"
    made = F.array(
        row("checkout.started", "started", intent & (channel == "checkout")), row("subscription.renewal_attempted", "started", intent & (channel == "renewal")),
        row("payment.authorized", "authorized", _is("charge.succeeded")), row("payment.captured", "captured", _is("charge.succeeded")),
        row("fraud.flagged", "flagged", failure == "fraud"), row("payment.declined", "declined", failure.isin("fraud", "declined")), row("payment.failed", "failed", failure == "failed"),
        row("dunning.attempted", "attempted", _is(*CHARGE) & (F.col("pi_channel") == "renewal") & (F.col("attempt") > 1)),
        row("invoice.created", "created", _is("invoice.created")), row("invoice.paid", "paid", _is("invoice.paid")), row("invoice.payment_failed", "payment_failed", _is("invoice.payment_failed")),
        row("subscription.renewed", "renewed", updated & active), row("subscription.past_due", "past_due", updated & ~active),
        row("subscription.canceled", "canceled_voluntary", _is("customer.subscription.deleted") & (F.col("prev_status") == "active")), row("subscription.canceled", "canceled_involuntary", _is("customer.subscription.deleted") & ~F.coalesce(F.col("prev_status") == "active", F.lit(False))),
        row("refund.requested", "requested", refund), row("refund.succeeded", "succeeded", refund & (F.col("status") == "succeeded")),
    )
    return F.array_compact(made)


def normalize_run(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Normalized events of flat raw events; strict: an error if anything can't be mapped."""
    known = classified(raw)
    if strict and not known.where("reject is not null").isEmpty():
        raise ValueError("some raw events can't be mapped; norm_rejects lists them")
    rows = known.where("reject is null").withColumn("r", F.explode(event_map()))
    charge, billing = _is(*CHARGE), _is(*INVOICE, *SUBSCRIPTION)
    intent, refund = _is("payment_intent.created"), _is("refund.created")
    values = {
        "customer_country": F.col("customer_country"), "issuer_country": F.when(charge, F.col("issuer_country")), "currency": F.col("currency"), "psp": F.when(billing, F.col("invoice_psp")).otherwise(F.col("psp")),
        "payment_method_type": F.when(charge, F.col("payment_method_type")), "card_brand": F.when(charge, F.col("card_brand")), "platform": F.when(~billing, F.col("platform")), "app_version": F.when(charge | intent, F.col("app_version")),
        "plan_id": F.when(charge, F.col("pi_plan")).when(intent, F.col("invoice_plan")).when(_is(*INVOICE), F.col("sub_plan")).when(_is(*SUBSCRIPTION), F.col("plan")), "channel": F.when(charge, F.col("pi_channel")).when(billing, "renewal").otherwise(F.col("channel")),
    }
    known_or = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(UNKNOWN))
    failed = charge & F.col("r.event_type").isin("payment.declined", "payment.failed", "fraud.flagged")
    key = F.when(charge, F.col("pi_key").cast("int")).when(intent, F.col("idempotency_key").isNotNull().cast("int")).otherwise(0)
    return rows.select(
        "run_id", F.concat_ws("/", "id", "r.event_type").alias("event_id"), F.col("r.event_type").alias("event_type"), F.col("created").alias("occurred_at"), F.coalesce("delivered_at", "created").alias("ingested_at"), F.lit("merchant_1").alias("merchant_id"), F.col("object_id").alias("entity_id"),
        F.when(refund, UNKNOWN).otherwise(F.col("customer")).alias("customer_id"), F.when(charge | intent | refund, F.col("payment_intent")).otherwise(UNKNOWN).alias("payment_intent_id"), *(known_or(c).alias(n) for n, c in values.items()),
        F.when(charge, F.col("attempt")).otherwise(0).cast("int").alias("attempt_no"), key.alias("idempotency_key_present"), F.coalesce("amount", F.lit(0)).alias("amount_minor"), F.col("r.status").alias("status"),
        F.when(failed, F.col("outcome_reason")).alias("decline_code"), F.when(failed, F.col("failure_code")).alias("error_code"), F.col("id").alias("raw_event_id"), F.col("seq").alias("raw_seq"),
    )
