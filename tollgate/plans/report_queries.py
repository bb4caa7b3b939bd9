"""Registered queries of reports: those of the day's investigations, and the citation check over evidence made of order lines, with its DuckDB twin."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import materialized
from ..operators import reports as r
from ..operators.detect import stable_id
from .investigate_queries import members
from .loop_queries import incidents, investigations, library
from .queries import add

LOST = "lost_successes"


def evidence(inc: DataFrame, checks: DataFrame, runs: DataFrame, own: DataFrame) -> DataFrame:
    """What the investigations recorded: the incident, each check that was run, and the payments lost over its alarms."""
    label = lambda **names: F.create_map(*(F.lit(x) for kv in names.items() for x in kv)).cast("map<string,string>")
    row = lambda df, eid, tool, payload, labels: df.select(F.col("incident_id").alias("investigation_id"), eid.alias("evidence_id"), tool.alias("tool"), payload.alias("payload"), labels.alias("labels"))
    seen = own.groupBy("incident_id").agg(F.min("seen_at").alias("detected_at"), F.sum(F.when(F.col("impact.measure") == LOST, F.col("impact.value"))).alias("lost"))
    known = inc.select("incident_id", F.col("onset").alias("started_at"), "locus").join(seen, "incident_id")
    base = row(known, stable_id("evd_", F.lit("get_incident"), F.col("incident_id")), F.lit("get_incident"), F.to_json(F.struct("incident_id", "started_at", "detected_at", "locus")), label(incident_id="observed", started_at="observed", detected_at="observed", locus="inferred"))
    lost = row(known, stable_id("evd_", F.lit("impact"), F.col("incident_id")), F.lit("impact"), F.to_json(F.struct(F.col("lost").alias("lost_successful_payments"))), label(lost_successful_payments="estimated"))
    done = runs.select("incident_id", F.inline("steps")).where("not failed").select("incident_id", "check_id", "kind", "observed").join(checks.select("incident_id", "check_id", "tool", "args"), ["incident_id", "check_id"])
    shown = F.filter(F.split("observed", ","), lambda x: x != "")
    payload = (
        F.when(F.col("kind") == "deploy", F.to_json(F.struct(shown.alias("present"))))
        .when(F.col("kind") == "status", F.to_json(F.struct(shown.alias("components"))))
        .otherwise(F.to_json(F.struct(F.col("args")[0].alias("metric"), F.split(F.col("args")[1], ",").alias("cohort"), F.col("observed").alias("outcome"))))
    )
    told = label(metric="observed", cohort="observed", outcome="inferred", present="observed", components="observed")
    return base.unionByName(lost).unionByName(row(done, F.col("check_id"), F.col("tool"), payload, told))


def reported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Investigations, their evidence and the claims of their reports."""
    inc, checks = materialized(incidents(spark, sf_dir), "incidents"), materialized(library(spark, sf_dir), "checks")
    runs, own = materialized(investigations(spark, sf_dir), "runs"), members(spark, sf_dir)
    recorded = materialized(evidence(inc, checks, runs, own), "evidence")
    hyps = runs.select("incident_id", F.posexplode("hypotheses").alias("nth", "h")).select("incident_id", "nth", "h.cause", "h.status")
    hyps = hyps.join(r.cited(runs, checks), ["incident_id", "cause"], "left").withColumnRenamed("incident_id", "investigation_id")
    known = runs.select(F.col("incident_id").alias("investigation_id"), "incident_id", "stop_reason", stable_id("evd_", F.lit("impact"), F.col("incident_id")).alias("impact_evidence"))
    known = known.join(inc.select("incident_id", F.col("onset").alias("as_of")), "incident_id").withColumn("run_id", F.lit("run_0"))
    return known, recorded, materialized(r.report_claims(known, hyps, recorded), "claims")


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, recorded, claims = reported(spark, sf_dir)
    return r.investigation_events(r.investigation_status(known, r.validate_claims(claims, recorded)))


def line_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as an investigation, each part in it as an evidence item; on filled lines the loss is stated as null and has no label."""
    x = spark.read.parquet(str(Path(sf_dir) / "lineitem.parquet"))
    text = lambda c: F.col(c).cast("bigint").cast("string")
    lost = F.when(F.col("l_linestatus") == "O", text("l_quantity")).otherwise("null")
    payload = F.concat(F.lit('{"metric":"m'), text("l_suppkey"), F.lit('","cohort":[{"psp":"'), F.col("l_returnflag"), F.lit('"}],"outcome":"moved","lost":'), lost, F.lit("}"))
    base = F.create_map(*map(F.lit, ("metric", "observed", "cohort", "observed", "outcome", "inferred")))
    labels = F.when(F.col("l_linestatus") == "O", F.map_concat(base, F.create_map(F.lit("lost"), F.lit("estimated")))).otherwise(base)
    return x.select(text("l_orderkey").alias("investigation_id"), F.concat(F.lit("evd_"), text("l_partkey")).alias("evidence_id"), F.lit("part").alias("tool"), payload.alias("payload"), labels.alias("labels"))


FIELDS = ("metric", "cohort.0.psp", "cohort.1.psp", "lost")
SAID = {"N": "observed", "A": "estimated", "R": "guessed"}


def line_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim a line: it cites its own part and the next one; lines without tax cite nothing, those without discount don't render."""
    x = spark.read.parquet(str(Path(sf_dir) / "lineitem.parquet"))
    nth = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    part = F.col("l_partkey").cast("bigint")
    field = F.element_at(F.array(*map(F.lit, FIELDS)), (F.col("l_quantity").cast("int") % 4) + 1)
    said = F.create_map(*(F.lit(v) for kv in SAID.items() for v in kv))[F.col("l_returnflag")]
    slot = lambda p, f, s: F.struct(F.concat(F.lit("evd_"), p.cast("string")).alias("evidence_id"), f.alias("field"), s.alias("label"))
    slots = F.when(F.col("l_tax") > 0, F.array(slot(part, field, said), slot(part + 1, F.lit("outcome"), F.lit("inferred")))).otherwise(F.array().cast(r.SLOT))
    return x.select(F.col("l_orderkey").cast("bigint").cast("string").alias("investigation_id"), nth.alias("nth"), F.lit("impact").alias("template"), slots.alias("slots"), F.when(F.col("l_discount") > 0, "said").otherwise("").alias("text"))


_CASES = f"""with line as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as nth from lineitem),
ev as (select l_orderkey, l_partkey, min({{'p': '{{"metric":"m' || l_suppkey || '","cohort":[{{"psp":"' || l_returnflag || '"}}],"outcome":"moved","lost":' || case when l_linestatus = 'O' then l_quantity::bigint::varchar else 'null' end || '}}', 's': l_linestatus}}) as e from lineitem group by 1, 2),
slot as (select l_orderkey, nth, 0 as slot, l_partkey as part, l_quantity::int % 4 as f, case l_returnflag when 'N' then 'observed' when 'A' then 'estimated' when 'R' then 'guessed' end as label from line where l_tax > 0
  union all select l_orderkey, nth, 1, l_partkey + 1, 9, 'inferred' from line where l_tax > 0),
met as (select slot.*, e, case f when 3 then case when e.s = 'O' then 'estimated' end when 9 then 'inferred' else 'observed' end as own from slot left join ev on ev.l_orderkey = slot.l_orderkey and ev.l_partkey = slot.part),
faults as (select l_orderkey::varchar as investigation_id, nth, slot, case when e is null then 'unknown_evidence' when f = 2 then 'missing_field' when label = 'guessed' then 'label_outside' when own != label then 'label_differs' when label = 'estimated' and own is null then 'not_an_estimate' end as error from met
  union all select l_orderkey::varchar, nth, null, 'no_evidence' from line where not l_tax > 0 union all select l_orderkey::varchar, nth, null, 'not_rendered' from line where not l_discount > 0)
"""


def _line_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.validate_claims(line_claims(spark, sf_dir), line_evidence(spark, sf_dir))


def _line_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(str(Path(sf_dir) / "orders.parquet"))
    reasons = F.array(*map(F.lit, (*r.STATUS, "stopped")))
    stop = F.element_at(reasons, (F.pmod(F.floor("o_totalprice"), F.lit(len(r.STATUS) + 1)) + 1).cast("int"))
    runs = orders.select(F.col("o_orderkey").cast("bigint").cast("string").alias("investigation_id"), stop.alias("stop_reason"))
    return r.investigation_status(runs, _line_errors(spark, sf_dir))


add("i13_report_claims", lambda s, sf: reported(s, sf)[2].select("investigation_id", "nth", "template", "cause", F.to_json("slots").alias("slots"), "text"))
add("i15_investigation_events", _status)
add("i14_validate_claims", _line_errors, f"{_CASES} select * from faults where error is not null")
add("i15_investigation_status", _line_status, f"""{_CASES}, n as (select investigation_id, count(*) as errors from faults where error is not null group by 1),
runs as (select o_orderkey::varchar as investigation_id, {[*r.STATUS, "stopped"]}[floor(o_totalprice)::bigint % {len(r.STATUS) + 1} + 1] as stop_reason from orders)
select investigation_id, stop_reason, coalesce(errors, 0) as errors, case when coalesce(errors, 0) > 0 then 'failed' else case stop_reason {" ".join(f"when '{k}' then '{v}'" for k, v in r.STATUS.items())} else 'failed' end end as status from runs left join n using (investigation_id)""")
