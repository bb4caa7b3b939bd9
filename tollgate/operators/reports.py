"""Reports of investigations: claims whose every figure cites a field of recorded evidence, and the check of all citations.

Evidence is investigation_id, evidence_id, tool, payload (JSON text) and labels (map of a top-level field to observed,
inferred, estimated or recommended). A claim's slots name an evidence row, a path in its payload and the label under which
the value is told. Slots meet evidence in one join by (investigation, evidence), so no investigation is gathered anywhere.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What may be said of a field, the sentences, and what a stop of the loop means.
LABELS = ("observed", "inferred", "estimated", "recommended")
TEMPLATES = {
    "summary": "Incident {0} started at {1}; first detected at {2}.",
    "locus": "The change is located in {0} (Stage 4 analysis).",
    "consistent": "Evidence consistent with {cause}: {0} in {1} observed {2}, as that cause predicts.",
    "against": "Evidence against {cause}: {0} in {1} observed {2}.",
    "side_support": "Context consistent with {cause}: {0}.",
    "insufficient": "Insufficient evidence for {cause}.",
    "impact": "Estimated lost successful payments so far: {0}.",
    "next": "Recommended next check for a human: {0}.",
}
STATUS = {
    "sufficient_evidence": "completed", "strong_contradiction": "completed", "false_positive": "completed", "no_checks_left": "completed", "no_disconfirming_check": "completed",
    "low_confidence": "handed_off", "budget_exhausted": "budget_exhausted", "tool_failure": "failed", "model_failure": "failed",
}
SHOWN = 3
SLOT = "array<struct<evidence_id:string,field:string,label:string>>"
KEY = ("investigation_id", "evidence_id")


def _unique(evidence: DataFrame) -> DataFrame:
    """One row an evidence id: ids stand for what was asked, so a repeated one says the same."""
    row = F.struct("tool", "payload", "labels")
    # dealt first, so that whole payloads are sorted once and not on both sides of the shuffle
    one = evidence.where("evidence_id is not null").repartition(*KEY).groupBy(*KEY).agg(F.min_by(row, F.struct("tool", "payload")).alias("e"))
    return one.select(*KEY, "e.*")


def field_at(payload: Column, path: Column) -> tuple[Column, Column]:
    """The value at a path like a.0.b (as JSON text, strings bare) and whether it is there: a null that is stated counts.

    A path that differs by row is parsed for every row, so none is that can't matter: whether a field is there is asked of
    its parent's keys first, and a number names a key only where the text holds it in quotes (or anything escaped).
    """
    parts = F.split(path, r"\.")
    last = F.element_at(parts, -1)
    place = lambda p: F.concat(F.lit("$"), F.array_join(F.transform(p, lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("["), x, F.lit("]"))).otherwise(F.concat(F.lit("['"), x, F.lit("']")))), ""))
    named = lambda p: F.concat(F.lit("$"), F.array_join(F.transform(p, lambda x: F.concat(F.lit("['"), x, F.lit("']"))), ""))
    get = lambda p: F.call_function("get_json_object", payload, p)
    quoted = lambda x: F.contains(payload, F.concat(F.lit('"'), x, F.lit('"'))) | F.contains(payload, F.concat(F.lit("'"), x, F.lit("'")))
    keyed = F.exists(parts, lambda x: x.rlike(r"^\d+$") & (quoted(x) | F.contains(payload, F.lit("\\"))))
    value = F.coalesce(get(place(parts)), F.when(keyed, get(named(parts))))
    around = F.when(F.size(parts) == 1, payload).otherwise(get(place(F.slice(parts, F.lit(1), F.size(parts) - 1))))
    null_there = lambda x: F.array_contains(F.json_object_keys(x), last) | (last.rlike(r"^\d{1,9}$") & (last.try_cast("int") < F.json_array_length(x)))
    # without a parent only a number that names a key can be there
    there = F.get(F.transform(F.array(around), lambda x: F.coalesce(null_there(x), F.lit(False)) | F.when(x.isNotNull() | keyed, value.isNotNull()).otherwise(F.lit(False))), F.lit(0))
    return value, there


def _slots(*entries: tuple[Column, str, str]) -> Column:
    return F.array(*(F.struct(e.alias("evidence_id"), F.lit(f).alias("field"), F.lit(x).alias("label")) for e, f, x in entries)).cast(SLOT)


def _pieces(template: str) -> Column:
    """A sentence as pieces: text, the number of a slot, or the cause (slot -1)."""
    made = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            made.append((text, None))
        if name is not None:
            made.append((None, -1 if name == "cause" else int(name)))
    return F.array(*(F.struct(F.lit(t).cast("string").alias("text"), F.lit(n).cast("int").alias("slot")) for t, n in made))


def _claim(template: str, slots: Column, cause: Column | None = None, *order: Column) -> Column:
    return F.struct(F.array(*order).cast("array<int>").alias("place"), F.lit(template).alias("template"), (F.lit(None) if cause is None else cause).cast("string").alias("cause"), slots.alias("slots"))


def report_claims(investigations: DataFrame, hypotheses: DataFrame, evidence: DataFrame) -> DataFrame:
    """investigation_id, nth (from 0), template, cause, slots and text of every claim, in the order of the report.

    investigations: investigation_id and impact_evidence (an evidence id or null). hypotheses: investigation_id, nth, cause,
    status, supporting and contradicting (arrays of evidence ids). A report begins with what get_incident gave (of several,
    the smallest evidence id); each hypothesis shows its first three supporting and its first three contradicting items, the
    latter always, even where the evidence is unknown; the loss comes last, if it is known. A sentence of which a value is
    missing renders as empty text, which validate_claims tells. Without evidence of the incident its two claims are left out.
    """
    known = _unique(evidence)
    keys = F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>"))
    zero = F.lit(0)
    first = known.where("tool = 'get_incident'").groupBy("investigation_id").agg(F.min("evidence_id").alias("inc"))
    inc = F.col("inc")
    head = first.join(investigations.select("investigation_id").distinct(), "investigation_id", "left_semi").select(
        "investigation_id",
        F.inline(F.array(
            _claim("summary", _slots((inc, "incident_id", "observed"), (inc, "started_at", "observed"), (inc, "detected_at", "observed")), None, zero, zero, zero, zero),
            _claim("locus", _slots((inc, "locus", "inferred")), None, zero, F.lit(1), zero, zero),
        )),
    )
    hyps = hypotheses.withColumn("h", F.col("nth"))
    shown = lambda c: F.transform(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, SHOWN), lambda e, i: F.struct(i.alias("i"), e.alias("evidence_id")))
    cited = hyps.select("investigation_id", "h", "cause", F.lit(0).alias("role"), F.inline(shown(F.col("supporting"))))
    cited = cited.unionByName(hyps.select("investigation_id", "h", "cause", F.lit(1).alias("role"), F.inline(shown(F.col("contradicting")))))
    met = cited.join(known.select(*KEY, keys.alias("keys")), list(KEY), "left")
    e, cause = F.col("evidence_id"), F.col("cause")
    has = lambda k: F.array_contains("keys", k)
    order = (F.lit(1), F.col("h"), F.col("role"), F.col("i"))
    measured = _slots((e, "metric", "observed"), (e, "cohort", "observed"), (e, "outcome", "inferred"))
    item = (
        F.when(F.col("role") == 1, _claim("against", measured, cause, *order))
        .when(has("outcome"), _claim("consistent", measured, cause, *order))
        .when(has("present"), _claim("side_support", _slots((e, "present", "observed")), cause, *order))
        .when(has("components"), _claim("side_support", _slots((e, "components", "observed")), cause, *order))
    )
    items = met.withColumn("c", item).where("c is not null").select("investigation_id", "c.*")
    open_ = hyps.where("status = 'insufficient_evidence'").join(first, "investigation_id")
    unknown = open_.select("investigation_id", F.inline(F.array(_claim("insufficient", _slots((inc, "incident_id", "observed")), cause, F.lit(1), F.col("h"), F.lit(2), zero))))
    lost = investigations.select("investigation_id", F.col("impact_evidence").alias("evidence_id")).join(known, list(KEY)).where(F.get_json_object("payload", "$.lost_successful_payments").isNotNull())
    impact = lost.select("investigation_id", F.inline(F.array(_claim("impact", _slots((e, "lost_successful_payments", "estimated")), None, F.lit(2), zero, zero, zero))))
    every = head.unionByName(items).unionByName(unknown).unionByName(impact)
    nth = F.row_number().over(W.partitionBy("investigation_id").orderBy("place", "template", "cause")) - 1
    return rendered(every.withColumn("nth", nth).drop("place"), evidence)


def rendered(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims (investigation_id, nth, template, cause, slots) with their text; a slot of unknown evidence reads ?."""
    known = _unique(evidence).select(*KEY, "payload", F.lit(True).alias("known"))
    slots = claims.select("investigation_id", "nth", F.posexplode("slots").alias("k", "s")).select("investigation_id", "nth", "k", "s.*")
    met = slots.join(known, list(KEY), "left")
    value, there = field_at(F.col("payload"), F.col("field"))
    said = F.when(F.col("known").isNull(), "?").when(there, F.coalesce(value, F.lit("null")))
    per = met.groupBy("investigation_id", "nth").agg(F.map_from_entries(F.collect_list(F.struct("k", said.alias("said")))).alias("values"))
    pieces = None
    for name, template in TEMPLATES.items():
        pieces = F.when(F.col("template") == name, _pieces(template)) if pieces is None else pieces.when(F.col("template") == name, _pieces(template))
    none = F.create_map().cast("map<int,string>")
    full = claims.join(per, ["investigation_id", "nth"], "left").withColumn("values", F.coalesce("values", none))
    words = F.transform(pieces, lambda p: F.when(p["slot"].isNull(), p["text"]).when(p["slot"] == -1, F.col("cause")).otherwise(F.col("values")[p["slot"]]))
    text = F.when(F.forall(words, lambda w: w.isNotNull()), F.array_join(words, ""))
    return full.select("investigation_id", "nth", "template", "cause", "slots", F.coalesce(text, F.lit("")).alias("text"))


def validate_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """investigation_id, nth, slot (null: the claim itself) and error of every fault; none for a report that may be shown.

    A claim cites something and renders; a slot's evidence is of its investigation, its field is there, and its label is one
    of LABELS and the one that the evidence gives that field; an estimate comes from a field labelled so. A slot has one
    error at most, the first in that order.
    """
    known = _unique(evidence).select(*KEY, "payload", "labels", F.lit(True).alias("known"))
    slots = claims.select("investigation_id", "nth", F.posexplode("slots").alias("slot", "s")).select("investigation_id", "nth", "slot", "s.*")
    _, there = field_at(F.col("payload"), F.col("field"))
    own = F.col("labels")[F.split_part("field", F.lit("."), F.lit(1))]
    fault = (
        F.when(F.col("known").isNull(), "unknown_evidence")
        .when(~there | F.col("field").isNull(), "missing_field")
        .when(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), "label_outside")
        .when(own != F.col("label"), "label_differs")
        .when((F.col("label") == "estimated") & own.isNull(), "not_an_estimate")
    )
    # exploded, as a filter on the fault would work it out a second time
    of_slots = slots.join(known, list(KEY), "left").select("investigation_id", "nth", "slot", F.explode(F.array_compact(F.array(fault))).alias("error"))
    bare = F.when(F.coalesce(F.size("slots"), F.lit(0)) < 1, "no_evidence")
    silent = F.when(F.coalesce("text", F.lit("")) == "", "not_rendered")
    of_claims = claims.select("investigation_id", "nth", F.lit(None).cast("int").alias("slot"), F.explode(F.array_compact(F.array(bare, silent))).alias("error"))
    return of_slots.unionByName(of_claims)


def investigation_status(investigations: DataFrame, errors: DataFrame) -> DataFrame:
    """investigation_id, status and errors: what the stop reason means, and failed where the report has a fault or the reason isn't known."""
    told = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))
    faults = errors.groupBy("investigation_id").agg(F.count("*").alias("errors"))
    df = investigations.join(faults, "investigation_id", "left").withColumn("errors", F.coalesce("errors", F.lit(0).cast("bigint")))
    return df.withColumn("status", F.when(F.col("errors") > 0, "failed").otherwise(F.coalesce(told[F.col("stop_reason")], F.lit("failed"))))


def investigation_events(status: DataFrame) -> DataFrame:
    """The start and the finish of every investigation as the incident fold takes them: run_id, incident_id, time, kind, command, reason, target_id."""
    none = F.lit(None).cast("string")
    begin = F.struct(F.lit("start").alias("command"), none.alias("reason"), none.alias("target_id"))
    end = F.struct(F.lit("finish").alias("command"), F.col("status").alias("reason"), F.col("investigation_id").alias("target_id"))
    return status.select("run_id", "incident_id", F.col("as_of").alias("time"), F.lit("investigation").alias("kind"), F.inline(F.array(begin, end)))


def cited(steps: DataFrame, checks: DataFrame) -> DataFrame:
    """incident_id, cause, supporting and contradicting (arrays of check ids in the order of the steps) of a loop's steps.

    steps: incident_id and steps as run_checks gives them. What was measured speaks for the causes that predict it and
    against the others it was predicted by; what side files show only speaks for causes.
    """
    done = steps.select("incident_id", F.inline("steps")).where("not failed").select("incident_id", "nth", "check_id", "observed")
    told = checks.select("incident_id", "check_id", F.explode("predictions").alias("cause", "said"))
    met = done.join(told, ["incident_id", "check_id"])
    side = F.col("said").startswith("present:")
    yes = F.when(side, F.array_contains(F.split("observed", ","), F.col("said"))).otherwise(F.col("observed") == F.col("said"))
    no = ~side & F.col("observed").isin("moved", "unchanged", "opposite") & (F.col("observed") != F.col("said"))
    gather = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("nth", "check_id")))), lambda x: x["check_id"])
    return met.groupBy("incident_id", "cause").agg(gather(yes).alias("supporting"), gather(no).alias("contradicting"))
