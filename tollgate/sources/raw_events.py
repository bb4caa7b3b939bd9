"""Raw payment-provider envelopes: reading JSON lines, flattening, sinks, and the given tables as envelopes.

Flat raw events have one row an envelope with the columns of ``FLAT``; ``seq`` is the total order of a run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .driver_tables import epoch

ENVELOPE = "id string, object string, api_version string, created bigint, livemode boolean, type string, data string, request struct<id:string,idempotency_key:string>, delivered_at bigint"
#: Where a flat column lies below data.object; the first path that holds something counts.
PATHS = {
    "object_id": ("id",), "customer": ("customer",), "payment_intent": ("payment_intent",), "invoice": ("invoice", "latest_invoice"), "subscription": ("subscription",), "charge": ("charge",),
    "channel": ("metadata.channel",), "psp": ("metadata.psp",), "customer_country": ("metadata.customer_country", "customer_address.country", "address.country"), "currency": ("currency", "items.data[0].price.currency"),
    "payment_method_type": ("payment_method_details.type",), "card_brand": ("payment_method_details.card.brand", "card.brand"), "platform": ("metadata.platform",), "app_version": ("metadata.app_version",),
    "plan": ("metadata.plan",), "amount": ("amount", "amount_due", "items.data[0].price.unit_amount"), "status": ("status",), "failure_code": ("failure_code",), "outcome_reason": ("outcome.reason",),
    "payment_method": ("payment_method", "default_payment_method"), "amount_received": ("amount_received",), "amount_refunded": ("amount_refunded",), "amount_paid": ("amount_paid",), "period_start": ("current_period_start",), "period_end": ("current_period_end",), "object_created": ("created",),
}
NUMBERS = ("amount", "amount_received", "amount_refunded", "amount_paid", "period_start", "period_end", "object_created")
FLAT = ("run_id", "seq", "id", "type", "object_type", "created", "delivered_at", "idempotency_key", *PATHS, "issuer_country", "prev_status", "prev_period")


def read_raw_events(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Envelopes of JSON lines (gzip or not) with run_id and seq, the total order of the run.

    ``seq`` comes from a ``seq`` field where the lines have one, as those of several files must; else it is the line's
    place in the order in which Spark reads the input, numbered by partition without gathering lines or Python.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    part = F.shiftright("at", 33).alias("part")
    before = lines.groupBy(part).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = lines.withColumn("part", part).join(F.broadcast(before), "part").withColumn("nth", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))  # a row a partition
    given = F.get_json_object("value", "$.seq").cast("bigint")
    parsed = numbered.select(F.coalesce(given, "nth").alias("seq"), F.from_json("value", ENVELOPE).alias("e"))
    return parsed.select(F.lit(run_id).alias("run_id"), "seq", "e.*")


def flatten_raw(raw: DataFrame) -> DataFrame:
    """Envelopes to flat raw events, by paths into the object; the payment method's country lies under a key named by its type."""
    at = lambda p: F.get_json_object("data", f"$.object.{p}")
    columns = {name: F.coalesce(*map(at, paths)) for name, paths in PATHS.items()}
    columns |= {n: columns[n].cast("bigint") for n in NUMBERS}
    # a payment method's own type is its object's
    columns["payment_method_type"] = F.coalesce(columns["payment_method_type"], F.when(at("object") == "payment_method", at("type")))
    kinds = ("card", "sepa_debit", "us_bank_account", "ideal", "link", "klarna")
    issuer = F.coalesce(*(F.when(at("payment_method_details.type") == k, at(f"payment_method_details.{k}.country")) for k in kinds))
    flat = raw.select(
        "run_id", "seq", "id", "type", F.get_json_object("data", "$.object.object").alias("object_type"), "created", "delivered_at", F.col("request.idempotency_key").alias("idempotency_key"),
        *(c.alias(n) for n, c in columns.items()), issuer.alias("issuer_country"), F.get_json_object("data", "$.previous_attributes.status").alias("prev_status"), F.get_json_object("data", "$.previous_attributes.current_period_start").alias("prev_period"),
    )
    # a subscription is its own subscription; a payment intent its own payment intent
    own = lambda kind: F.when(F.col("object_type") == kind, F.col("object_id"))
    return flat.withColumns({"subscription": F.coalesce(own("subscription"), "subscription"), "payment_intent": F.coalesce(own("payment_intent"), "payment_intent"), "invoice": F.coalesce(own("invoice"), "invoice")}).select(*FLAT)


def charge_attempts(flat: DataFrame) -> DataFrame:
    """Only charge events, with their hour and whether they succeeded."""
    hour = F.col("created") - F.col("created") % 3600
    return flat.where("type in ('charge.succeeded', 'charge.failed')").select("run_id", "seq", "object_id", "psp", "channel", "customer_country", "amount", hour.alias("hour"), (F.col("type") == "charge.succeeded").alias("ok"))


def read_context(spark: SparkSession, folder: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """Deployments and provider status entries: arrays under a key of one JSON document each."""
    read = lambda name, schema: spark.read.schema(f"{name} array<struct<{schema}>>").json(f"{folder}/{name}.json", multiLine=True).select(F.lit(run_id).alias("run_id"), F.inline(name))
    return read("deployments", "id:string,service:string,version:string,deployed_at:bigint"), read("psp_status", "id:string,psp:string,component:string,level:string,posted_at:bigint,resolved_at:bigint")


TRUTH = "record_key:string,scenario_kind:string,expected_route:string,start:bigint,end:bigint,expected_recovery:bigint,oracle_detectable_at:bigint,affected_cohorts:array<map<string,array<string>>>,affected_metrics:array<string>,unchanged_metrics:array<string>"


def read_truth(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Labelled records, one row each; the cohorts also as JSON text."""
    found = spark.read.schema(f"records array<struct<{TRUTH}>>").json(path, multiLine=True).select(F.lit(run_id).alias("run_id"), F.inline("records"))
    return found.withColumn("affected_cohorts_json", F.to_json("affected_cohorts"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Recorded answers by request hash; of several the last line of the last file, by name, wins."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("nth"))
    lines = lines.select(F.get_json_object("value", "$.request_hash").alias("request_hash"), "nth", F.get_json_object("value", "$.response").alias("response"), F.get_json_object("value", "$.error").alias("error"))
    return lines.groupBy("request_hash").agg(F.max_by(F.struct("response", "error"), "nth").alias("a")).select("request_hash", "a.response", "a.error")


def replace_run(df: DataFrame, path: str, run_id: str, replace: bool = False, expected: int | None = None) -> None:
    """Writes one run's partition; an existing one only with ``replace``; the count must be the manifest's."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run_id={run_id}")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) and not replace:
        raise ValueError(f"run {run_id} exists; say replace to write it anew")
    if expected is not None and (found := df.count()) != expected:
        raise ValueError(f"run {run_id} has {found} rows; the manifest says {expected}")
    if df.isEmpty():  # a dynamic overwrite touches only partitions that get rows
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        return
    df.withColumn("run_id", F.lit(run_id)).write.partitionBy("run_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to an insert-only log."""
    df.write.mode("append").partitionBy("run_id").parquet(path)


def incidents_current(events: DataFrame) -> DataFrame:
    """The latest status and snapshot of every incident."""
    return events.groupBy("run_id", "incident_id").agg(F.max_by("status", "seq").alias("status"), F.max_by("snapshot_json", "seq").alias("snapshot_json"), F.max("seq").alias("seq"))


def next_seq(records: DataFrame, first_seq: int = 1) -> DataFrame:
    """Numbers a run's decisions in order of time and id, from first_seq on: within days, each after those before it."""
    day = F.floor(F.col("as_of") / 86_400)
    days = records.groupBy("run_id", day.alias("day")).agg(F.count("*").alias("n"))
    before = days.select("run_id", "day", F.coalesce(F.sum("n").over(W.partitionBy("run_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a day
    nth = F.row_number().over(W.partitionBy("run_id", "day").orderBy("as_of", "candidate_id"))
    numbered = records.withColumn("day", day).withColumn("nth", nth).join(before, ["run_id", "day"])
    return numbered.select(*records.columns, (F.col("before") + F.col("nth") + (first_seq - 1)).alias("seq"))


def raw_from_orders(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    """Flat raw events: a payment intent an order, a charge a line item; dirty: charges are dated by shipment."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", epoch("o_orderdate").alias("ordered"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus", "l_returnflag", epoch("l_shipdate").alias("shipped"))
    nth = F.row_number().over(W.partitionBy("l_orderkey").orderBy("shipped", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    li = li.withColumn("n", nth).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    cents = lambda x: F.round(F.col(x) * 100).cast("bigint")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i.cast("int") + 1)
    key, null = F.col("o_orderkey"), F.lit(None).cast("string")
    created = F.col("shipped") if dirty else F.col("ordered") + F.col("n") * 600
    intents = o.select("o_orderkey", "o_custkey", F.lit(None).cast("int").alias("n"), F.concat(F.lit("evt_pi_"), key).alias("id"), F.col("ordered").alias("created"), cents("o_totalprice").alias("amount"), null.alias("l_linestatus"), null.alias("l_returnflag"))
    charges = li.select("o_orderkey", "o_custkey", "n", F.concat(F.lit("evt_ch_"), key, F.lit("_"), F.col("n")).alias("id"), created.alias("created"), cents("l_extendedprice").alias("amount"), "l_linestatus", "l_returnflag")
    both = intents.unionByName(charges)
    # one order over a run: times are split into days, numbered within, and each day starts after the days before it
    day = F.floor(F.col("created") / 86_400).alias("day")
    days = both.groupBy(day).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("day", "before")
    ordered = both.withColumn("day", day).withColumn("nth", F.row_number().over(W.partitionBy("day").orderBy("created", "id"))).join(days, "day")
    # what follows from an order or a line is said after they are in order, so that few columns are sorted
    charge, cust, ok, flag = F.col("n").isNotNull(), F.col("o_custkey"), F.col("l_linestatus") == "O", F.col("l_returnflag")
    intent = F.concat(F.lit("pi_"), key)
    columns = {
        "run_id": F.lit("run"), "seq": F.col("before") + F.col("nth"), "customer": F.concat(F.lit("cus_"), cust), "payment_intent": intent, "channel": F.when(key % 5 == 0, "renewal").otherwise("checkout"),
        "psp": pick(("psp_alpha", "psp_beta", "psp_gamma"), cust % 3), "customer_country": pick(("DE", "US", "BR", "GB"), cust % 4), "currency": pick(("eur", "usd", "brl", "gbp"), cust % 4), "platform": F.lit("web"), "app_version": F.lit(""),
        "type": F.when(~charge, "payment_intent.created").when(ok, "charge.succeeded").otherwise("charge.failed"), "object_type": F.when(charge, "charge").otherwise("payment_intent"), "object_id": F.when(charge, F.concat(F.lit("ch_"), key, F.lit("_"), F.col("n"))).otherwise(intent),
        "idempotency_key": F.when(~charge & (key % 7 != 0), "key"), "status": F.when(~charge, "requires_payment_method").when(ok, "succeeded").otherwise("failed"),
        "failure_code": F.when(charge & ~ok, F.when(flag == "R", "processing_error").otherwise("card_declined")), "outcome_reason": F.when(charge & ~ok & (flag == "N"), "highest_risk_level"),
        "payment_method_type": F.when(charge, "card"), "card_brand": F.when(charge, "visa"), "issuer_country": F.when(charge, pick(("DE", "US", "BR", "GB"), cust % 4)),
    }
    absent = {n: null for n in ("invoice", "subscription", "charge", "plan", "prev_status", "prev_period", "payment_method")} | {n: F.lit(None).cast("bigint") for n in ("delivered_at", *NUMBERS[1:])}
    return ordered.withColumns(columns | absent).select(*FLAT)


def raw_sql(dirty: bool = False) -> str:
    """The DuckDB twin of raw_from_orders: expressions that end in ``raw``."""
    common = """'run' as run_id, 'cus_' || o_custkey as customer, 'pi_' || o_orderkey as payment_intent, case when o_orderkey % 5 = 0 then 'renewal' else 'checkout' end as channel,
      ['psp_alpha', 'psp_beta', 'psp_gamma'][o_custkey % 3 + 1] as psp, ['DE', 'US', 'BR', 'GB'][o_custkey % 4 + 1] as customer_country, ['eur', 'usd', 'brl', 'gbp'][o_custkey % 4 + 1] as currency, 'web' as platform, '' as app_version"""
    created = "shipped" if dirty else "ordered + n * 600"
    return f"""
o as (select *, cast(floor(epoch(o_orderdate)) as bigint) as ordered from orders),
li as (select l.*, o.*, cast(floor(epoch(l_shipdate)) as bigint) as shipped, row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n from lineitem l join o on l_orderkey = o_orderkey),
both_ as (
  select {common}, 'evt_pi_' || o_orderkey as id, 'payment_intent.created' as type, 'payment_intent' as object_type, ordered as created, 'pi_' || o_orderkey as object_id, cast(round(o_totalprice * 100) as bigint) as amount,
    case when o_orderkey % 7 != 0 then 'key' end as idempotency_key, 'requires_payment_method' as status, null as failure_code, null as outcome_reason, null as payment_method_type, null as card_brand, null as issuer_country from o
  union all by name
  select {common}, 'evt_ch_' || o_orderkey || '_' || n as id, case when l_linestatus = 'O' then 'charge.succeeded' else 'charge.failed' end as type, 'charge' as object_type, {created} as created, 'ch_' || o_orderkey || '_' || n as object_id, cast(round(l_extendedprice * 100) as bigint) as amount,
    null as idempotency_key, case when l_linestatus = 'O' then 'succeeded' else 'failed' end as status, case when l_linestatus = 'O' then null when l_returnflag = 'R' then 'processing_error' else 'card_declined' end as failure_code,
    case when l_linestatus != 'O' and l_returnflag = 'N' then 'highest_risk_level' end as outcome_reason, 'card' as payment_method_type, 'visa' as card_brand, ['DE', 'US', 'BR', 'GB'][o_custkey % 4 + 1] as issuer_country from li),
raw as (select *, row_number() over (order by created, id) as seq from both_)
"""


#: A customer's billing as envelopes, one entry a kind of event: when it happens and its columns, as expressions over c
#: (the customer's key) that Spark and DuckDB read alike. Every rule of the checks is broken by some customers.
_SUB, _PAID = "c % 3 = 0", "c % 6 = 0"
_RENEWAL = {"customer": "concat('cus_', c)", "psp": "case c % 3 when 0 then 'psp_alpha' when 1 then 'psp_beta' else 'psp_gamma' end", "currency": "'eur'", "customer_country": "'DE'", "platform": "'server'"}
_INTENT = _RENEWAL | {"object_type": "'payment_intent'", "object_id": "concat('pi_in_', c)", "payment_intent": "concat('pi_in_', c)", "invoice": "concat('in_', c)", "payment_method": "concat('pm_', c)", "channel": "'renewal'", "amount": "1000 + c"}
_CHARGE = _RENEWAL | {"object_type": "'charge'", "payment_intent": "concat('pi_in_', c)", "invoice": "concat('in_', c)", "channel": "'renewal'", "amount": "1000 + c", "payment_method_type": "'card'", "card_brand": "'visa'", "issuer_country": "'DE'"}
_INVOICE = {"customer": "concat('cus_', c)", "object_type": "'invoice'", "object_id": "concat('in_', c)", "invoice": "concat('in_', c)", "subscription": "case when c % 33 = 0 then concat('sub_gone_', c) else concat('sub_', c) end", "currency": "'eur'", "customer_country": "'DE'", "amount": "1000 + c"}
_SUBSCRIPTION = {"customer": "concat('cus_', c)", "object_type": "'subscription'", "object_id": "concat('sub_', c)", "subscription": "concat('sub_', c)", "invoice": "concat('in_', c)", "plan": "case when c % 16 = 0 then '' else concat('plan_', c % 4) end", "period_start": "600200000 + c", "period_end": "600200000 + c + case when c % 60 = 0 then 0 else 2592000 end"}
_REFUND = {"object_type": "'refund'", "charge": "case when c % 48 = 0 then concat('ch_gone_', c) else concat('ch_in_', c) end", "payment_intent": "concat('pi_in_', c)", "psp": "'psp_alpha'", "currency": "'eur'", "channel": "'renewal'", "status": "case when c % 84 = 0 then 'failed' when c % 12 = 0 then 'succeeded' else 'pending' end"}
BILLING = (
    ("customer.created", "c % 97 != 0", "600000000 + c", {"object_type": "'customer'", "object_id": "concat('cus_', c)", "object_created": "600000000 + c + case when c % 95 = 0 then 5 else 0 end"}),
    ("payment_method.attached", "c % 89 != 0", "600100000 + c", {"object_type": "case when c % 88 = 0 then 'card' else 'payment_method' end", "object_id": "concat('pm_', c)", "customer": "concat('cus_', c)", "payment_method_type": "case when c % 101 = 0 then 'cheque' when c % 5 = 0 then 'sepa_debit' else 'card' end"}),
    ("customer.subscription.created", _SUB, "600200000 + c", _SUBSCRIPTION | {"invoice": "cast(null as varchar(9))", "status": "'active'"}),
    ("invoice.created", _SUB, "600300000 + c", _INVOICE | {"status": "case when c % 45 = 0 then 'open' else 'draft' end"}),
    ("payment_intent.created", _SUB, "600400000 + c", _INTENT | {"status": "'requires_payment_method'", "idempotency_key": "case when c % 2 = 0 then 'key' end"}),
    ("charge.succeeded", _PAID, "600400010 + c", _CHARGE | {"object_id": "concat('ch_in_', c)", "amount": "1000 + c + case when c % 66 = 0 then 1 else 0 end", "status": "'succeeded'"}),
    ("charge.failed", "c % 6 = 3", "600400010 + c", _CHARGE | {"object_id": "concat('ch_in_', c)", "status": "'failed'", "failure_code": "case when c % 27 = 0 then null when c % 9 = 3 then 'processing_error' else 'card_declined' end", "outcome_reason": "case when c % 21 = 0 then 'highest_risk_level' end"}),
    ("charge.succeeded", "c % 6 = 3", "600400610 + c", _CHARGE | {"object_id": "concat('ch_again_', c)", "status": "'succeeded'"}),
    ("payment_intent.succeeded", _SUB, "600400700 + c", _INTENT | {"status": "'succeeded'", "amount_received": "1000 + c - case when c % 72 = 0 then 1 else 0 end"}),
    ("charge.succeeded", "c % 78 = 0", "600400800 + c", _CHARGE | {"object_id": "concat('ch_late_', c)", "status": "'succeeded'"}),
    ("payment_intent.canceled", "c % 75 = 0", "600400900 + c", _INTENT | {"status": "'canceled'", "amount": "1000 + c + case when c % 2 = 0 then 1 else 0 end"}),
    ("invoice.payment_failed", "c % 6 = 3", "600450000 + c", _INVOICE | {"status": "'open'"}),
    ("invoice.paid", _SUB, "600500000 + c", _INVOICE | {"status": "'paid'", "amount_paid": "case when c % 54 = 0 then 0 else 1000 + c end"}),
    ("customer.subscription.updated", _SUB, "600600000 + c", _SUBSCRIPTION | {"status": "case when c % 51 = 0 then 'paused' when c % 6 = 0 then 'active' else 'past_due' end", "prev_period": "case when c % 6 = 0 then '1' end"}),
    ("customer.subscription.deleted", "c % 12 = 0", "600700000 + c", _SUBSCRIPTION | {"status": "'canceled'", "prev_status": "case when c % 24 = 0 then 'active' else 'past_due' end"}),
    ("refund.created", _PAID, "600800000 + c", _REFUND | {"object_id": "concat('re_', c)", "amount": "500"}),
    ("refund.created", "c % 18 = 0", "600850000 + c", _REFUND | {"object_id": "concat('re_more_', c)", "amount": "1000 + c"}),
    ("charge.refunded", "c % 12 = 0", "600900000 + c", _CHARGE | {"object_id": "concat('ch_in_', c)", "status": "'succeeded'", "amount_refunded": "case when c % 36 = 0 then 500 + 1000 + c when c % 30 = 0 then 1 else 500 end"}),
    ("order.shipped", "c % 93 = 0", "600950000 + c", {"object_type": "'order'", "object_id": "concat('or_', c)"}),
)
_KINDS = {n: "bigint" if n in ("created", "delivered_at", *NUMBERS) else "string" for n in FLAT if n not in ("run_id", "seq")}


def _event(i: int, kind: str, at: str, own: dict[str, str]) -> dict[str, str]:
    fixed = {"id": f"concat('evt_{i}_', c)", "type": f"'{kind}'", "created": at, "delivered_at": f"case when c % 2 = 0 then {at} + c % 7 * 100 end"}
    return {n: f"cast({(fixed | own).get(n, 'null')} as {k})" for n, k in _KINDS.items()}


def raw_from_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat raw events of every object kind: BILLING over the customers, numbered by (created, id)."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("c"))
    parts = [c.where(when).selectExpr("'run' as run_id", *(f"{x} as {n}" for n, x in _event(i, kind, at, own).items())) for i, (kind, when, at, own) in enumerate(BILLING)]
    every = reduce(DataFrame.unionByName, parts)
    # times fall into spans of a day, numbered within; each span starts after those before it
    day = F.floor(F.col("created") / 86_400).alias("day")
    days = every.groupBy(day).agg(F.count("*").alias("n")).select("day", F.coalesce(F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ordered = every.withColumn("day", day).withColumn("nth", F.row_number().over(W.partitionBy("day").orderBy("created", "id"))).join(days, "day")
    return ordered.withColumn("seq", F.col("before") + F.col("nth")).select(*FLAT)


def customers_sql() -> str:
    """The DuckDB twin of raw_from_customers: expressions that end in ``raw``."""
    parts = " union all ".join(f"select 'run' as run_id, {', '.join(f'{x} as {n}' for n, x in _event(i, kind, at, own).items())} from k where {when}" for i, (kind, when, at, own) in enumerate(BILLING))
    return f"k as (select c_custkey as c from customer), every as ({parts}), raw as (select *, row_number() over (order by created, id) as seq from every)"
