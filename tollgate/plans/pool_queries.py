"""Registered queries of pooled scores: detection with all alarms against hourly alarms alone, over 24 runs, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialized
from ..operators import evaluate as v
from ..operators import pool
from ..sources.driver_tables import truth_from_suppliers
from . import evaluate_queries as q
from .queries import add

RUNS = 24
SYSTEMS = {"main": "true", "hourly": "grain != '1d'"}
COUNTS = ("scored", "detected", "warm_up", "missed")


def score_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a run, system, split and kind: how its incidents fared, and how late they were detected."""
    cand, truth, matches = materialized(q._cand(spark, sf_dir), "candidates"), truth_from_suppliers(spark, sf_dir), q._matches(spark, sf_dir)
    parts = []
    for system, keep in SYSTEMS.items():
        own = cand.where(keep)
        found = v.record_outcomes(own, truth, matches.join(own.select("anomaly_id"), "anomaly_id", "left_semi"), q.START, q.WORLD_END)
        parts.append(found.withColumn("system", F.lit(system)))
    run = F.split_part("record_key", F.lit("_"), F.lit(2)).cast("int") % RUNS
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    every = parts[0].unionByName(parts[1]).withColumn("run", run)
    per = every.groupBy("run", "system", "scenario_kind").agg(
        F.count_if(F.col("outcome") != "oracle_null").alias("scored"), is_("detected").alias("detected"), is_("warm_up").alias("warm_up"), is_("missed").alias("missed"),
        F.collect_list(F.when(F.col("outcome") == "detected", F.col("latency_s"))).alias("latencies"), F.collect_list(F.when(F.col("outcome") != "oracle_null", (F.col("n_candidates") > 1).cast("double"))).alias("several"),
    )
    return per.withColumns({"run_id": F.concat(F.lit("run_"), "run"), "split": F.when(F.col("run") % 3 == 0, "held_out").otherwise("tuning")}).drop("run")


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.pool_scores(
        materialized(score_records(spark, sf_dir), "score-records"), ["system"], ["split", "scenario_kind"], ratios={"recall": ("detected", "scored")}, sums=COUNTS, shares={"several_candidates": "several"},
        medians={"latency_median_s": "latencies"}, places={"latency_p90_s": ("latencies", 0.9)},
    )


_GROUP = "case when grouping({0}) = 1 then 'all' else {0} end as {0}"
_UNDER = "".join(
    f", matches_{s} as (select m.* from matches m join c using (anomaly_id) where {keep}), hits_{s} as (select record_key, min(detected_at) as first, count(*) as n from matches_{s} join c using (anomaly_id) where relation = 'affected' group by 1)"
    f", rec_{s} as (select '{s}' as system, record_key, scenario_kind, case when oracle_detectable_at is null then 'oracle_null' when first is not null then 'detected' when until <= {q.START + v.WARM_UP} then 'warm_up' else 'missed' end as outcome, first - greatest(start, coalesce(oracle_detectable_at, start)) as latency_s, coalesce(n, 0) as n from t left join hits_{s} using (record_key) where expected_route = 'incident')"
    for s, keep in SYSTEMS.items()
)
POOLED = q.MATCHES.rstrip() + _UNDER + f""", a as (select *, cast(split_part(record_key, '_', 2) as int) % {RUNS} as run, case when run % 3 = 0 then 'held_out' else 'tuning' end as split from (select * from rec_main union all select * from rec_hourly)),
pooled as (select system, {_GROUP.format("split")}, {_GROUP.format("scenario_kind")}, count(distinct run) as runs, count(*) filter (where outcome != 'oracle_null') as scored, {", ".join(f"count(*) filter (where outcome = '{o}') as {o}" for o in COUNTS[1:])},
  detected::double / nullif(scored, 0) as recall, avg((n > 1)::int) filter (where outcome != 'oracle_null') as several_candidates, median(latency_s) filter (where outcome = 'detected') as latency_median_s,
  list_sort(list(latency_s) filter (where outcome = 'detected'))[cast(floor((detected - 1) * 0.9::double) as bigint) + 1]::double as latency_p90_s from a group by grouping sets ((system, split, scenario_kind), (system, split), (system, scenario_kind), (system)))
"""
_CONTRASTED = ("recall", "latency_median_s")
_GAINS = ", ".join(f"w.{m}::double as {m}_with, o.{m}::double as {m}_without, w.{m}::double - o.{m}::double as {m}_gain" for m in _CONTRASTED)
add("j17_pool_scores", pooled, POOLED + "select * from pooled")
add("j17_contrast", lambda s, sf: pool.contrast(pooled(s, sf), "system", "main", "hourly", _CONTRASTED), POOLED + f"select split, scenario_kind, {_GAINS} from (select * from pooled where system = 'main') w full join (select * from pooled where system = 'hourly') o using (split, scenario_kind)")
