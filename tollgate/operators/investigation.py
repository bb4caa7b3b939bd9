"""Checks of an incident and what each cause predicts of them, and the bounded loop that runs the most telling ones.

All incidents go through the loop together: a round is one narrow step over rows that hold an incident's hypotheses and
checks as small arrays, so nine budgeted rounds cost no shuffle and no incident waits for another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detect import stable_id
from .investigate import dims_of

MOVED, UNCHANGED = "moved", "unchanged"
#: The dimension that a cause follows.
CAUSE_DIM = {
    "psp_degradation": "psp", "payment_method_degradation": "payment_method_type", "issuer_or_country_degradation": "customer_country", "checkout_regression": "app_version", "renewal_job_failure": "psp", "dunning_failure": "psp",
    "data_pipeline_issue": "psp", "duplicate_charging": "platform", "refund_process_change": "customer_country", "pricing_or_plan_change": "customer_country", "fraud_attack": "customer_country",
}
#: Metric, direction, related metric, its expected direction, causes under which it moves, causes under which it doesn't.
RELATED = (
    ("authorization_rate", "down", "checkout_conversion_rate", "down", ("psp_degradation", "payment_method_degradation", "issuer_or_country_degradation"), ("normal_variation",)),
    ("authorization_rate", "down", "fraud_flag_rate", "up", ("fraud_attack",), ("psp_degradation", "payment_method_degradation", "issuer_or_country_degradation", "normal_variation")),
    ("authorization_rate", "down", "attempt_volume", "up", ("fraud_attack",), ("psp_degradation", "issuer_or_country_degradation")),
    ("authorization_rate", "down", "late_arrival_share", "up", ("data_pipeline_issue",), ("psp_degradation", "payment_method_degradation", "issuer_or_country_degradation")),
    ("checkout_conversion_rate", "down", "authorization_rate", "down", ("psp_degradation",), ("checkout_regression",)),
    ("checkout_conversion_rate", "down", "late_arrival_share", "up", ("data_pipeline_issue",), ("checkout_regression",)),
    ("renewal_success_rate", "down", "dunning_recovery_rate", "down", ("dunning_failure",), ()),
    ("renewal_success_rate", "down", "authorization_rate", "down", ("psp_degradation",), ("renewal_job_failure", "dunning_failure")),
    ("dunning_recovery_rate", "down", "authorization_rate", "down", ("psp_degradation",), ("dunning_failure", "renewal_job_failure")),
    ("refund_count", "up", "authorization_rate", "down", (), ("refund_process_change",)),
    ("refund_count", "up", "duplicate_charge_rate", "up", ("duplicate_charging",), ("refund_process_change",)),
    ("duplicate_charge_rate", "up", "refund_count", "up", ("duplicate_charging",), ()),
    ("fraud_flag_rate", "up", "attempt_volume", "up", ("fraud_attack",), ()),
    ("fraud_flag_rate", "up", "authorization_rate", "down", ("fraud_attack",), ()),
    ("attempt_volume", "up", "fraud_flag_rate", "up", ("fraud_attack",), ("normal_variation",)),
    ("attempt_volume", "up", "authorization_rate", "down", ("fraud_attack",), ("normal_variation",)),
    ("attempt_volume", "down", "authorization_rate", "down", ("psp_degradation",), ("normal_variation",)),
    ("subscription_cancellation_rate", "up", "authorization_rate", "down", (), ("pricing_or_plan_change",)),
    ("late_arrival_share", "up", "authorization_rate", "down", ("data_pipeline_issue",), ()),
)
#: The service and the status component that speak for a cause, and what approval on checkout traffic says.
SERVICE_OF = {"renewal_job_failure": "renewal_job", "dunning_failure": "dunning_service", "refund_process_change": "refund_service", "pricing_or_plan_change": "pricing_service", "duplicate_charging": "api_gateway"}
STATUS_OF = {"psp_degradation": "authorization", "payment_method_degradation": "local_methods", "data_pipeline_issue": "webhooks"}
CHANNEL_MOVED = ("psp_degradation", "issuer_or_country_degradation", "payment_method_degradation", "fraud_attack", "data_pipeline_issue")
CHANNEL_UNCHANGED = ("renewal_job_failure", "dunning_failure", "normal_variation")
CLIENT_DIMS = ("platform", "app_version")
RANK = {"sibling": 0, "channel": 0, "related": 1, "status": 2, "deploy": 3}
CALLS, EVIDENCE, SHORTLIST, CONFIDENCE, MODEL_CALLS = 9, 60, 5, 0.5, 40
STOPS = ("sufficient_evidence", "strong_contradiction", "false_positive", "budget_exhausted", "tool_failure", "model_failure", "low_confidence", "no_checks_left", "no_disconfirming_check")


def _told(causes: Column, table: dict[str, str]) -> Column:
    """The predictions of the causes that an incident has, as a map."""
    every = F.array(*(F.struct(F.lit(c).alias("key"), F.lit(p).alias("value")) for c, p in sorted(table.items())))
    return F.map_from_entries(F.filter(every, lambda x: F.array_contains(causes, x["key"])))


def check_library(incidents: DataFrame, side_files: bool = True) -> DataFrame:
    """incident_id, check_id, kind, tool, args (array) and predictions (cause to moved, unchanged or present:x) of every check.

    incidents: incident_id, metric, direction, locus and scope (arrays of dimension=value), causes (array) and siblings
    (map of a dimension to the best supported other value of it). The tables of causes are a few dozen rows and broadcast.
    """
    spark = incidents.sparkSession
    base = incidents.withColumn("place", F.array_sort("locus"))
    dims = dims_of(F.col("locus"))
    of = lambda c: F.create_map(*(F.lit(x) for kv in CAUSE_DIM.items() for x in kv))[c]

    def follows(dim: Column) -> Column:
        said = lambda c: F.when((c == "normal_variation") | (of(c) == dim), UNCHANGED).when(F.array_contains(dims, of(c)), MOVED)
        return F.map_from_entries(F.filter(F.transform("causes", lambda c: F.struct(c.alias("key"), said(c).alias("value"))), lambda x: x["value"].isNotNull()))

    put = lambda dim, value: F.array_sort(F.concat(F.filter("locus", lambda x: F.split_part(x, F.lit("="), F.lit(1)) != dim), F.array(F.concat_ws("=", dim, value))))
    joined = lambda c: F.array_join(c, ",")
    row = lambda df, kind, tool, args, predictions: df.select("incident_id", F.lit(kind).alias("kind"), F.lit(tool).alias("tool"), args.alias("args"), predictions.alias("predictions"))

    sib = base.select("*", F.explode("siblings").alias("dim", "value"))
    sib = row(sib, "sibling", "compare_cohorts", F.array("metric", joined("place"), joined(put(F.col("dim"), F.col("value"))), "direction"), follows(F.col("dim")))
    split = {c: MOVED for c in CHANNEL_MOVED} | {c: UNCHANGED for c in CHANNEL_UNCHANGED}
    paid = F.array_sort(F.concat(F.filter("locus", lambda x: ~F.split_part(x, F.lit("="), F.lit(1)).isin(*CLIENT_DIMS)), F.array(F.lit("channel=checkout"))))
    both = F.arrays_overlap("causes", F.array(*map(F.lit, CHANNEL_MOVED))) & F.arrays_overlap("causes", F.array(*map(F.lit, CHANNEL_UNCHANGED)))
    channel = row(base.where((F.col("metric") == "authorization_rate") & ~F.array_contains(dims, "channel") & both), "channel", "get_metric_history", F.array("metric", joined(paid), "direction"), _told(F.col("causes"), split))
    table = [(m, w, rel, way, {c: MOVED for c in yes} | {c: UNCHANGED for c in no}) for m, w, rel, way, yes, no in RELATED]
    table = spark.createDataFrame(table, "metric string, direction string, related string, way string, told map<string,string>")
    near = base.join(F.broadcast(table), ["metric", "direction"])
    related = row(near, "related", "get_related_metrics", F.array("related", joined("place"), "way"), F.map_filter("told", lambda c, _: F.array_contains(F.col("causes"), c)))
    parts = [sib, channel, related]
    if side_files:
        services = F.transform(F.map_entries(_told(F.col("causes"), SERVICE_OF)), lambda e: F.struct(e["key"].alias("cause"), e["value"].alias("service")))
        client = F.filter("locus", lambda x: x.isin("platform=ios", "platform=android"))
        mobile = F.when(F.array_contains("causes", "checkout_regression"), F.transform(client, lambda x: F.struct(F.lit("checkout_regression").alias("cause"), F.concat(F.lit("mobile_"), F.split_part(x, F.lit("="), F.lit(2))).alias("service")))).otherwise(F.slice(services, 1, 0))
        deploy = base.select("incident_id", F.inline(F.concat(services, mobile)))
        parts.append(row(deploy, "deploy", "get_deployments", F.array("service", F.lit("onset_2h")), F.create_map("cause", F.concat(F.lit("present:"), "service"))))
        psps = F.array_distinct(F.transform(F.filter(F.concat("locus", "scope"), lambda x: x.startswith("psp=")), lambda x: F.split_part(x, F.lit("="), F.lit(2))))
        status = base.select("incident_id", "causes", F.explode(psps).alias("psp"))
        parts.append(row(status, "status", "check_psp_status", F.array("psp", F.lit("start_6h")), _told(F.col("causes"), {c: f"present:{x}" for c, x in STATUS_OF.items()})))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # a sibling that no cause speaks of is still a check; the others say something of a cause
    every = every.where((F.col("kind") == "sibling") | (F.size("predictions") > 0))
    return every.select("incident_id", stable_id("chk_", F.col("kind"), F.array_join("args", "|")).alias("check_id"), "kind", "tool", "args", "predictions")


_HYP = "struct<cause:string,prior:int,nth:int,s:int,c:int>"
_CHECK = "struct<check_id:string,kind:string,predictions:map<string,string>,observed:string,present:array<string>,failed:boolean>"
_PICK = "struct<check_id:string,confidence:double,failed:boolean>"
_STEP = "struct<nth:int,check_id:string,kind:string,observed:string,failed:boolean,confidence:double,leader_before:string>"


def _status(h: Column) -> Column:
    return F.when((h["c"] >= 1) & (h["c"] > h["s"]), "contradicted").when((h["s"] >= 2) & (h["c"] == 0), "supported").otherwise("open")


def _score(h: Column) -> Column:
    return h["prior"] + h["s"] - 2 * h["c"]


def _ranked(hyps: Column) -> Column:
    keyed = F.transform(hyps, lambda h: F.struct((-_score(h)).alias("a"), (-h["prior"]).alias("b"), h["nth"].alias("d"), h["cause"].alias("e"), h.alias("h")))
    return F.transform(F.array_sort(keyed), lambda x: x["h"])


def _opposes(check: Column, cause: Column) -> Column:
    """Whether a check could contradict a cause."""
    return F.coalesce(check["kind"].isin("sibling", "channel", "related") & check["predictions"][cause].isin(MOVED, UNCHANGED), F.lit(False))


def run_checks(cases: DataFrame, calls: int = CALLS, evidence: int = EVIDENCE, shortlist: int = SHORTLIST) -> DataFrame:
    """How the investigation of every incident went: stop_reason, detail, conclusion, steps, hypotheses and budgets used.

    cases: incident_id, hyps (cause, prior, nth), checks (check_id, kind, predictions, observed: an outcome; present: what
    side files showed; failed), narrowed (evidence items it starts with), picks (what another chooser says at each step,
    check_id null to stop; null: the first of the shortlist is taken) and trouble (tool_failure or model_failure if
    observing or narrowing failed, else null). Two calls look at the incident and its history, one at the end at its impact
    if the budget allows. Incidents without a hypothesis stop with no_checks_left.
    """
    zero = F.lit(0)
    fresh = F.transform("hyps", lambda h: F.struct(h["cause"].alias("cause"), h["prior"].alias("prior"), h["nth"].alias("nth"), zero.alias("s"), zero.alias("c")))
    kind = F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))
    df = cases.select(
        "incident_id", F.coalesce(fresh, F.array()).cast(f"array<{_HYP}>").alias("hyps"), F.coalesce("checks", F.array()).cast(f"array<{_CHECK}>").alias("checks"), F.col("picks").cast(f"array<{_PICK}>").alias("picks"),
        F.array().cast("array<string>").alias("done"), F.lit(2).alias("calls"), (F.coalesce("narrowed", zero) + 2).cast("int").alias("items"), zero.alias("asked"), zero.alias("failures"), zero.alias("opposing"),
        F.col("trouble").alias("reason"), F.when(F.col("trouble").isNotNull(), "before the loop").alias("detail"), F.array().cast(f"array<{_STEP}>").alias("steps"),
    )
    for _ in range(max(1, calls - 1)):
        df = df.withColumn("ranked", _ranked(F.col("hyps"))).withColumns({"lead": F.get("ranked", zero), "next": F.get("ranked", F.lit(1))})
        lead, second = F.col("lead"), F.col("next")
        holders = F.filter("hyps", lambda h: h["prior"] > 0)
        clear = (_status(lead) == "supported") & (second.isNull() | (_status(second) == "contradicted") | (_score(lead) - _score(second) >= 2))
        spent = F.when(F.col("calls") >= calls, "tool_calls").when(F.col("asked") >= MODEL_CALLS, "model_calls").when(F.col("items") >= evidence, "evidence_items")
        early = (
            F.when(spent.isNotNull(), "budget_exhausted").when(F.exists("hyps", lambda h: (h["cause"] == "normal_variation") & (_status(h) == "supported")), "false_positive")
            .when((F.size(holders) > 0) & F.forall(holders, lambda h: _status(h) == "contradicted"), "strong_contradiction").when(clear, "sufficient_evidence").when(lead.isNull(), "no_checks_left")
        )
        top = F.slice("ranked", 1, 3)
        told = lambda c: F.size(F.array_distinct(F.array_compact(F.transform(top, lambda h: c["predictions"][h["cause"]]))))  # noqa: B023,E731
        keyed = F.transform(
            F.filter("checks", lambda c: ~F.array_contains(F.col("done"), c["check_id"])),
            lambda c: F.struct((-told(c)).alias("a"), c["predictions"][F.col("lead.cause")].isNull().alias("b"), kind[c["kind"]].alias("d"), c["check_id"].alias("e"), c["kind"].alias("kind"), _opposes(c, F.col("lead.cause")).alias("opposes")),  # noqa: B023
        )
        df = df.withColumns({"early": F.when(F.col("reason").isNull(), early), "spent": spent, "pool": F.array_sort(keyed)}).withColumn("first", F.slice("pool", 1, shortlist))
        spare = F.filter(F.slice("pool", shortlist + 1, 1 << 20), lambda c: c["opposes"])
        swap = (F.size("first") > 0) & ~F.exists("first", lambda c: c["opposes"]) & (F.size(spare) > 0)
        df = df.withColumn("short", F.when(swap, F.concat(F.slice("first", 1, shortlist - 1), F.slice(spare, 1, 1))).otherwise(F.col("first")))
        pick = F.get("picks", F.size("steps"))
        by_model = F.col("picks").isNotNull()
        chosen = F.when(by_model, pick["check_id"]).otherwise(F.get("short", zero)["e"])
        sure = F.when(by_model, F.coalesce(pick["confidence"], F.lit(0.0))).otherwise(1.0)
        check = F.get(F.filter("checks", lambda c: c["check_id"] == F.col("chosen")), zero)
        df = df.withColumns({"chosen": chosen, "sure": sure, "lost": by_model & F.coalesce(pick["failed"], pick.isNull())}).withColumn("check", check)
        listed = F.exists("short", lambda c: c["e"] == F.col("chosen"))
        late = (
            F.when(F.size("short") == 0, "no_checks_left").when(~F.exists("short", lambda c: c["opposes"]), "no_disconfirming_check").when(F.col("lost"), "model_failure").when(F.col("chosen").isNull() | (F.col("sure") < CONFIDENCE), "low_confidence")
            .when(F.array_contains("done", F.col("chosen")), "tool_failure").when(~listed, "model_failure")
        )
        why = F.when(F.col("chosen").isNull(), "stop chosen").when(F.col("sure") < CONFIDENCE, "confidence").when(F.array_contains("done", F.col("chosen")), "repeated step")
        df = df.withColumn("late", F.when(F.col("reason").isNull() & F.col("early").isNull(), late))
        # the call counts, and of those that worked the outcome
        runs = F.col("reason").isNull() & F.col("early").isNull() & F.col("late").isNull()
        df = df.withColumns({"runs": runs, "works": runs & ~F.coalesce(F.col("check.failed"), F.lit(False))})
        said, seen, tokens = F.col("check.predictions"), F.col("check.observed"), F.coalesce("check.present", F.array().cast("array<string>"))

        def after(h: Column) -> Column:
            p = said[h["cause"]]  # noqa: B023
            side = p.startswith("present:")
            yes = F.when(side, F.array_contains(tokens, p)).otherwise(seen == p)  # noqa: B023
            counts = F.col("works") & p.isNotNull() & (side | seen.isin(MOVED, UNCHANGED, "opposite"))  # noqa: B023
            add = lambda when: F.when(F.coalesce(when, F.lit(False)), 1).otherwise(0)
            return F.struct(h["cause"].alias("cause"), h["prior"].alias("prior"), h["nth"].alias("nth"), (h["s"] + add(counts & yes)).alias("s"), (h["c"] + add(counts & ~yes & ~side)).alias("c"))

        shown = F.when(F.size(tokens) > 0, F.array_join(F.array_sort(tokens), ",")).otherwise(seen)
        step = F.struct(
            (F.size("steps") + 1).alias("nth"), F.col("chosen").alias("check_id"), F.col("check.kind").alias("kind"), F.when(F.col("works"), shown).alias("observed"), (~F.col("works")).alias("failed"), F.col("sure").alias("confidence"), F.col("lead.cause").alias("leader_before"),
        )
        failures = F.col("failures") + (F.col("runs") & ~F.col("works")).cast("int")
        twice = F.when(F.col("runs") & (failures >= 2), "tool_failure")
        asks = F.col("reason").isNull() & F.col("early").isNull() & by_model & F.exists("short", lambda c: c["opposes"])
        df = df.withColumns({
            "hyps": F.transform("hyps", after), "steps": F.when(F.col("runs"), F.concat("steps", F.array(step.cast(_STEP)))).otherwise(F.col("steps")), "done": F.when(F.col("runs"), F.array_append("done", F.col("chosen"))).otherwise(F.col("done")),
            "calls": F.col("calls") + F.col("runs").cast("int"), "items": F.col("items") + F.col("works").cast("int"), "asked": F.col("asked") + asks.cast("int"), "failures": failures, "opposing": F.col("opposing") + (F.col("works") & _opposes(F.col("check"), F.col("lead.cause"))).cast("int"),
            "detail": F.coalesce("detail", F.when(F.col("early") == "budget_exhausted", F.col("spent")).when(F.col("late").isin("low_confidence", "tool_failure"), why)), "reason": F.coalesce("reason", "early", "late", twice),
        })
        df = df.select("incident_id", "hyps", "checks", "picks", "done", "calls", "items", "asked", "failures", "opposing", "reason", "detail", "steps")
    lead = F.get(_ranked(F.col("hyps")), zero)
    silent = lambda h: (_status(h) == "open") & (h["s"] == 0) & (h["c"] == 0)
    final = lambda h: F.when(silent(h), "insufficient_evidence").otherwise(_status(h))
    conclusion = F.when((F.col("reason") == "strong_contradiction") | lead.isNull(), "unknown").when(F.col("reason") == "false_positive", "normal_variation").when(_status(lead) == "supported", lead["cause"]).otherwise("insufficient_evidence")
    impact = (F.col("calls") < calls) & (F.col("items") < evidence)
    hyps = F.transform(_ranked(F.col("hyps")), lambda h: F.struct(h["cause"].alias("cause"), h["prior"].alias("prior"), h["s"].alias("supporting"), h["c"].alias("contradicting"), _score(h).alias("score"), final(h).alias("status")))
    return df.select(
        "incident_id", F.col("reason").alias("stop_reason"), "detail", conclusion.alias("conclusion"), (F.col("calls") + impact.cast("int")).alias("tool_calls"), (F.col("items") + impact.cast("int")).alias("evidence"),
        F.col("asked").alias("model_calls"), F.col("opposing").alias("disconfirming_checks"), "steps", hyps.alias("hypotheses"),
    )
