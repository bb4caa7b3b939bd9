"""Registered queries of the detectors; those that reset as they scan have no SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialized
from ..operators import detect as d
from ..operators import metrics as m
from ..sources.driver_tables import EPISODES_SQL, NORM_SQL, episodes_from_orders
from ..streaming.detect import UPDATE, episodes_so_far, stream_detect
from .queries import END, START, add, norm


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fourteen series at their own grains."""
    return materialized(d.monitored_series(norm(spark, sf_dir), START, END), "series")


def _series_sql() -> str:
    parts = []
    for s in d.SERIES:
        r = m.request(s.metric, s.version, START, END, s.grain, s.group_by, visibility="window_close")
        scope = " || ',' || ".join(f"'{x}=' || {x}" for x in s.group_by) or "''"
        parts.append(f"select '{s.key}' as series, '{s.metric}' as metric, {s.version} as version, {r.seconds} as grain_s, '{s.direction}' as direction, '{s.kind}' as kind, {str(s.cusum).lower()} as cusum, {scope} as scope, window_start as ts, numerator as num, denominator as den from ({m.compute_sql(r)}) where is_complete")
    return " union all ".join(parts)


L = d.LIMITS
WITH = f"""with {NORM_SQL.replace("norm as (", "norm as materialized (", 1)}, series as materialized ({_series_sql()}),
refs as materialized (
  select s.series, s.scope, s.ts, r.kind, r.ts as ref_ts, r.num as ref_num, r.den as ref_den, l.lag, case when r.kind = 'count' then r.num::double else r.num / r.den end as ref_value
  from (select *, unnest({list(L.lags)}) as lag from series) l join series s on s.series = l.series and s.scope = l.scope and s.ts = l.ts + l.lag * 86400 join series r on r.series = l.series and r.scope = l.scope and r.ts = l.ts
  where r.kind = 'count' or r.den > 0),
ranked as (
  select *, count(*) over (partition by series, scope, ts) as n, row_number() over (partition by series, scope, ts order by abs(ref_value - mid) desc, lag desc) as nth
  from (select *, quantile_cont(ref_value, 0.5) over (partition by series, scope, ts) as mid from refs)),
base as (
  select series, scope, ts, count(*) as n_refs, case when any_value(kind) = 'count' then sum(ref_num)::double / count(*) else sum(ref_num)::double / sum(ref_den) end as expected,
         cast(case when any_value(kind) = 'count' then count(*) else sum(ref_den) end as bigint) as weight
  from ranked where n >= {L.min_refs} and not (n >= {L.trim_from} and nth = 1) group by series, scope, ts),
scored as (
  select s.*, n_refs, expected, weight,
         case when kind = 'count' then case when expected >= {L.min_expected} then 2 * (sqrt(num + 0.375) - sqrt(expected + 0.375)) / sqrt(1 + 1.0::double / weight) end
              when den >= {L.min_sample} then 2 * sqrt(den) * (asin(sqrt(least(1.0, num::double / den))) - asin(sqrt(least(1.0, expected)))) / sqrt(1 + den::double / weight) end as z,
         case when kind = 'count' then num - expected else num - den * expected end as excess
  from series s left join base using (series, scope, ts)),
phis as (
  select *, case when count(*) over w < {L.min_history} then {L.phi_default} else greatest(1.0, pow(quantile_cont(abs(z), 0.5) over w / 0.6745, 2)) end::double as phi
  from scored where z is not null window w as (partition by series, scope order by ts rows between {L.history} preceding and 1 preceding)),
orient as (
  select *, case direction when 'down' then -z / sqrt(phi) when 'up' then z / sqrt(phi) else abs(z / sqrt(phi)) end as a,
         case when direction != 'both' then direction when z > 0 then 'up' else 'down' end as side from phis),
flags as (
  select *, enough and (coalesce(a >= {L.z_single}, false) or (flagged and recent >= {L.persist_k})) as fire_p
  from (select *, cast(sum(flagged::int) over (partition by series, scope order by ts rows between {L.persist_n - 1} preceding and current row) as bigint) as recent
        from (select s.series, s.scope, s.ts, o.z, o.phi, o.a, o.side, coalesce(abs(o.excess) >= {L.min_excess}, false) as enough,
                     coalesce(abs(o.excess) >= {L.min_excess}, false) and coalesce(o.a >= {L.z_persist}, false) as flagged
              from series s left join orient o using (series, scope, ts))))
"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    return d.stabilized_z(s, d.trimmed_baseline(d.lagged_baseline(s)))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.flagged_series(series(spark, sf_dir))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.detect(norm(spark, sf_dir), START, END)


add("e1_monitored_series", series, WITH + "select * from series")
add("e2_lagged_baseline", lambda s, sf: d.lagged_baseline(series(s, sf)), WITH + "select series, scope, ts, kind, ref_ts, ref_num, ref_den, lag, ref_value from refs")
add("e3_trimmed_baseline", lambda s, sf: _rounded(d.trimmed_baseline(d.lagged_baseline(series(s, sf))), "expected"), WITH + "select series, scope, ts, n_refs, round(expected, 6) as expected, weight from base")
for _name, _kind in (("e4_stabilized_z_rate", "rate"), ("e5_stabilized_z_count", "count")):
    add(_name, lambda s, sf, k=_kind: _rounded(_scored(s, sf).where(F.col("kind") == k).select("series", "scope", "ts", "num", "den", "z", "excess"), "z", "excess"), WITH + f"select series, scope, ts, num, den, round(z, 6) as z, round(excess, 6) as excess from scored where kind = '{_kind}'")
add("e6_robust_phi", lambda s, sf: _rounded(d.robust_phi(_scored(s, sf)).select("series", "scope", "ts", "phi"), "phi"), WITH + "select series, scope, ts, round(phi, 6) as phi from phis")
add("e7_oriented_score", lambda s, sf: _rounded(d.oriented(d.robust_phi(_scored(s, sf))).select("series", "scope", "ts", "a", "side"), "a"), WITH + "select series, scope, ts, round(a, 6) as a, side from orient")
add("e8_point_flags", lambda s, sf: _flags(s, sf).select("series", "scope", "ts", "enough", "flagged", "recent", "fire_p"), WITH + "select series, scope, ts, enough, flagged, recent, fire_p from flags")
add("e9_cusum_e10_episodes", lambda s, sf: d.episodes(_flags(s, sf), START))
add("e12_static_detector", lambda s, sf: d.static_detector(series(s, sf), START))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the alarms made of orders; the detector's own are in e18_detect."""
    return d.link_parent(d.prefilter_low_volume(d.candidate_rows(episodes_from_orders(spark, sf_dir))))


_FLAT = "anomaly_id, system, series, metric, version, grain, scope, direction, window_start, window_end, detected_at, round(observed, 6) as observed, round(expected, 6) as expected, round(delta, 6) as delta, round(relative_delta, 6) as relative_delta, score, sample_size, array_to_string(methods, ',') as methods, array_to_string(evidence_ids, ',') as evidence_ids, status, recovered_at, score_at_detection, array_to_string(methods_at_detection, ',') as methods_at_detection"


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as text, so that both engines' results compare."""
    joined = {c: F.array_join(c, ",") for c in ("methods", "evidence_ids", "methods_at_detection")}
    return _rounded(df.withColumns(joined), "observed", "expected", "delta", "relative_delta")


add("e11_candidate_rows", lambda s, sf: _flat(d.candidate_rows(episodes_from_orders(s, sf))), f"with {EPISODES_SQL} select {_FLAT} from candidates")
add("e13_prefilter_low_volume", lambda s, sf: d.prefilter_low_volume(d.candidate_rows(episodes_from_orders(s, sf))).select("anomaly_id", "metric", "sample_size", "status", "reason"), f"with {EPISODES_SQL} select anomaly_id, metric, sample_size, status, reason from filtered")
add("e14_link_parent", lambda s, sf: _linked(s, sf).select("anomaly_id", "metric", "scope", "parent_id"), f"with {EPISODES_SQL} select anomaly_id, metric, scope, parent_id from linked")
add("e15_as_of_view", lambda s, sf: _flat(d.as_of_view(_linked(s, sf))), f"with {EPISODES_SQL}, seen as (select * replace (score_at_detection as score, methods_at_detection as methods, evidence_ids[1:1] as evidence_ids, detected_at as window_end, null::bigint as recovered_at, case status when 'recovered' then 'promoted' else status end as status) from linked) select {_FLAT}, reason from seen")
add("e16_concurrent_at", lambda s, sf: d.concurrent_at(d.prefilter_low_volume(d.candidate_rows(episodes_from_orders(s, sf)))).select("anomaly_id", F.size("others").alias("n"), F.md5(F.array_join("others", ",")).alias("others")), f"""with {EPISODES_SQL}, live as (select anomaly_id, window_start, detected_at, coalesce(recovered_at, 1099511627776) as until from linked where system = 'main' and status in ('promoted', 'recovered'))
select c.anomaly_id, cast(count(*) as int) as n, md5(string_agg(o.anomaly_id, ',' order by o.anomaly_id)) as others from live c join live o on o.detected_at <= c.detected_at and o.until > c.window_start and o.window_start < c.detected_at and o.anomaly_id != c.anomaly_id group by 1""")
add("e16_concurrent_counts", lambda s, sf: d.concurrent_counts(_linked(s, sf)), f"""with {EPISODES_SQL}, live as (select anomaly_id, window_start, detected_at, coalesce(recovered_at, 1099511627776) as until from linked where system = 'main' and status in ('promoted', 'recovered'))
select c.anomaly_id as id, (select count(*) from live o where o.detected_at <= c.detected_at and o.until > c.window_start) - 1 as concurrent from live c""")
add("e17_decidable", lambda s, sf: d.decidable(_linked(s, sf)).select("anomaly_id", "status", "detected_at"), f"with {EPISODES_SQL} select anomaly_id, status, detected_at from linked where status in ('promoted', 'recovered')")
add("e18_detect", lambda s, sf: d.detect(norm(s, sf), START, END))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All series as a stream of closed windows; the episodes that its updates amount to are those of e9_cusum_e10_episodes."""
    source = series(spark, sf_dir)
    folder = source.inputFiles()[0].rsplit("/", 1)[0]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = stream_detect(spark.readStream.schema(source.schema).parquet(folder), START)
    write = lambda df, _: df.write.mode("append").parquet(f"{folder}-episodes")
    found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start().awaitTermination()
    return episodes_so_far(spark.read.schema(UPDATE).parquet(f"{folder}-episodes"))


add("s3_stream_detect", streamed)
