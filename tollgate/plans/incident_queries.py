"""Registered queries of incidents folded from alarms made of orders, with their DuckDB twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialized
from ..operators import correlate as c
from ..operators import detect as d
from ..operators import incidents as h
from ..operators.context import lifecycle_check
from ..sources.driver_tables import EPISODES_SQL, episodes_from_orders
from ..streaming.incidents import stream_incidents
from .queries import add

RUNS = 24
CAUSES = ("psp_degradation", "checkout_regression", "fraud_attack", "refund_process_change", "unknown")


def looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alarm of an hour or less as seen when it was detected, and again at its recovery, then on one platform of its scope for every third.

    A run is one of 24 merchants, by the alarm's start. Routes follow the scores: first that at detection, then the episode's.
    """
    cand = d.candidate_rows(episodes_from_orders(spark, sf_dir)).where("grain != '1d'")
    cand = materialized(cand, "alarms")
    scope = F.filter(F.array("scope"), lambda x: x != "")
    finer = (F.floor(F.col("window_start") / 900) % 3 == 0) & ~F.col("scope").contains("platform")
    route = lambda x: F.when(x >= 2.4, "INCIDENT").when(x >= 0.8, "DIGEST").otherwise("IGNORE")
    p = F.round(F.col("sample_size") / 61, 6)
    pick = lambda k: F.element_at(F.array(*map(F.lit, CAUSES)), (F.pmod(F.col("sample_size") + k, F.lit(len(CAUSES))) + 1).cast("int"))
    columns = (
        "run_id", "candidate_id", "metric", "direction", "start", "window_end", "scope", "change_type", "recovered_at", "evidence_ids", "incident_p", "severity_level", "categories", "route_source", "policy_version",
    )
    base = cand.select(
        F.concat(F.lit("run_"), F.floor(F.col("window_start") / 900) * 7 % RUNS).alias("run_id"), F.col("anomaly_id").alias("candidate_id"), "metric", "direction", F.col("window_start").alias("start"), "window_end", scope.alias("scope"),
        F.when(F.col("expected") == 0, "new_cohort").otherwise("rate_change").alias("change_type"), "recovered_at", F.slice("evidence_ids", 1, 1).alias("evidence_ids"), p.alias("incident_p"), F.when(p > 0.8, "critical").when(p > 0.5, "high").otherwise("low").alias("severity_level"),
        F.array(pick(0), pick(1), pick(2)).alias("categories"), F.lit("policy_v1").alias("route_source"), F.lit("policy_v1").alias("policy_version"), "detected_at", "score", "score_at_detection", finer.alias("finer"), F.col("sample_size").alias("n"),
    )
    first = base.select(*columns, F.col("detected_at").alias("time"), F.lit(0).alias("nth"), F.col("scope").alias("locus"), route(F.col("score_at_detection")).alias("route"), (F.col("n") % 4 != 0).alias("verified"))
    later = base.where("recovered_at is not null").select(*columns, F.col("recovered_at").alias("time"), F.lit(1).alias("nth"), F.when(F.col("finer"), F.concat("scope", F.array(F.lit("platform=web")))).otherwise(F.col("scope")).alias("locus"), route(F.col("score")).alias("route"), (F.col("n") % 7 != 0).alias("verified"))
    both = first.unionByName(later)
    return both.withColumn("decision_id", d.stable_id("dec_", F.col("candidate_id"), F.col("time").cast("string")))


def events(seen: DataFrame) -> DataFrame:
    """Fold events of looks: detected, checkpoint, recovered and recovery check."""
    none = lambda *names: {n: F.lit(None).cast("string") for n in names}
    empty = F.array().cast("array<string>")
    look = seen.withColumns(none("incident_id", "target_id", "actor", "command", "reason") | {"kind": F.when(F.col("nth") == 0, "detected").otherwise("checkpoint"), "parent": empty})
    ended = seen.where("nth = 1").select("run_id", "candidate_id", F.col("recovered_at").alias("time"), F.explode(F.array(F.lit("recovered"), F.lit("recovery_check"))).alias("kind"))
    ended = ended.withColumns(none("incident_id", "target_id", "actor", "command", "reason", "metric", "direction", "route", "decision_id") | {"start": F.lit(None).cast("bigint"), "locus": empty, "parent": empty, "verified": F.lit(False)})
    names = [x.split()[0] for x in h.EVENT.split(", ")]
    return look.select(names).unionByName(ended.select(names))


def folded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The fold of all alarms, and the looks it came from."""
    seen = materialized(looks(spark, sf_dir), "looks")
    return h.fold_candidates(h.candidates_of(events(seen))), seen


def commanded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The fold again with what people did to every fifth incident, and one impact and one investigation each for others.

    Both folds are of the same candidates.
    """
    seen = materialized(looks(spark, sf_dir), "looks")
    known = h.candidates_of(events(seen))
    first = h.fold_candidates(known)
    made = h.incident_events(first).where("seq = 1").withColumn("pick", F.conv(F.substring("incident_id", 5, 6), 16, 10).cast("long"))
    other = F.lead("incident_id").over(h.W.partitionBy("run_id").orderBy("event_time", "incident_id"))
    made = materialized(made.withColumn("other", other), "made")
    row = lambda kind, command, after, actor="human", reason=F.lit("checked"), target=F.lit(None): F.struct(F.lit(kind).alias("kind"), F.lit(command).alias("command"), (F.col("event_time") + after).alias("time"), F.lit(actor).alias("actor"), reason.cast("string").alias("reason"), target.cast("string").alias("target_id"))
    acts = (
        F.when(F.col("pick") % 5 == 0, F.array(row("human", "acknowledge", 600), row("human", "resolve", 7_200)))
        .when(F.col("pick") % 5 == 1, F.array(row("human", "merge", 5_400, target=F.col("other")), row("human", "escalate", 9_000)))
        .when(F.col("pick") % 5 == 2, F.array(row("investigation", "start", 60, "system"), row("investigation", "finish", 660, "system", F.lit("completed"), F.concat(F.lit("rep_"), "incident_id")), row("human", "escalate", 900, "policy")))
        .when(F.col("pick") % 5 == 3, F.array(row("impact", "estimate", 300, "system", F.col("pick").cast("string")), row("human", "dismiss", 900, reason=F.lit("")), row("human", "resolve", 1_000, "policy")))
    )
    said = made.where(acts.isNotNull()).select("run_id", "incident_id", F.inline(acts))
    names = {x.split()[0]: x.split(maxsplit=1)[1] for x in h.EVENT.split(", ")}
    said = materialized(said.select(*(F.col(n) if n in said.columns else F.lit(None).cast(t).alias(n) for n, t in names.items())), "commands")
    return h.fold_candidates(known, said), seen, said


def notes(said: DataFrame) -> DataFrame:
    """Impacts and investigations as snapshots read them."""
    impact, study = F.col("kind") == "impact", F.col("kind") == "investigation"
    status = F.when(F.col("command") == "start", "running").otherwise(F.col("reason"))
    nth = F.array_position(F.array(*map(F.lit, h.KINDS)), F.col("kind")) - 1
    return said.where(impact | study).select("run_id", "incident_id", "time", nth.alias("nth"), F.when(impact, F.col("reason")).alias("impact"), F.when(study, status).alias("status"), F.when(study, F.col("target_id")).alias("report"))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each chain of alarms reaches within a run and a metric group, and how many it holds; late data stands in every group."""
    seen = looks(spark, sf_dir).where("nth = 0").withColumn("own", c.metric_groups(F.col("metric"), F.col("direction")))
    every = F.array(*map(F.lit, sorted({g for *_, g in c.GROUPS})))
    rows = seen.select("run_id", F.col("candidate_id").alias("id"), F.col("start").alias("s"), F.coalesce("recovered_at", F.lit(h.FOREVER)).alias("e"), F.explode(F.when(F.array_contains("own", "ingestion"), every).otherwise(F.col("own"))).alias("grp"))
    return h.chains_of(rows).groupBy("run_id", "grp", "head").agg(F.count("*").alias("n"), F.max("e").alias("until"), F.min("id").alias("first"))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold, seen, said = commanded(spark, sf_dir)
    return h.incident_snapshots(h.incident_events(fold), h.incident_links(fold), seen.drop("window_start", "scope", "change_type", "recovered_at", "route"), notes(said))


def _lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of status that the lifecycle doesn't allow: none, if the fold is right."""
    rows = h.incident_events(commanded(spark, sf_dir)[0])
    return lifecycle_check(rows.withColumn("incident_id", F.concat_ws("|", "run_id", "incident_id")))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of all runs as a stream; files land in no order here, so one batch takes them."""
    source = materialized(events(looks(spark, sf_dir)), "event-stream")
    folder = source.inputFiles()[0].rsplit("/", 1)[0]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = stream_incidents(spark.readStream.schema(source.schema).parquet(folder))
    found.writeStream.format("parquet").option("checkpointLocation", f"{folder}-state").outputMode("append").trigger(availableNow=True).start(f"{folder}-fold").awaitTermination()
    return spark.read.schema(h._OUT).parquet(f"{folder}-fold").drop("island", "step", "cause_kind", "cause_id")


add("s4_stream_incidents", _streamed)
add("h3_fold_incidents", lambda s, sf: folded(s, sf)[0].drop("island", "step", "cause_kind", "cause_id"))
add("h4_apply_commands", lambda s, sf: commanded(s, sf)[0].where("part in ('event', 'rejected')").select("part", "run_id", "incident_id", "seq", "time", "status", "actor", "kind", "reason"))
add("h5_lifecycle_check", _lifecycle)
add("h6_incident_snapshots", _snapshots)
_GROUP = "case metric " + " ".join(f"when '{m}' then '{g}'" for m, w, g in c.GROUPS if not w) + " else case direction when 'up' then 'fraud' else 'payments' end end"
add("h3_chains", _chains, f"""with {EPISODES_SQL}, own as (
  select 'run_' || ((window_start // 900) * 7 % {RUNS}) as run_id, anomaly_id, window_start as s, coalesce(recovered_at, {h.FOREVER}) as e, {_GROUP} as own from candidates where grain != '1d'),
every as (select run_id, anomaly_id, s, e, unnest(case when own = 'ingestion' then {sorted({g for *_, g in c.GROUPS})} else [own] end) as grp from own),
far as (select *, max(e) over (partition by run_id, grp order by s, anomaly_id rows between unbounded preceding and 1 preceding) as far from every),
heads as (select *, max(case when far is null or s > far + {c.GAP} then s end) over (partition by run_id, grp order by s, anomaly_id) as head from far)
select run_id, grp, head, count(*) as n, max(e)::bigint as until, min(anomaly_id) as first from heads group by run_id, grp, head""")
