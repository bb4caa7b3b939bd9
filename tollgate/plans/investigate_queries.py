"""Registered queries of investigations over alarms made of orders, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialized
from ..operators import detect as d
from ..operators import investigate as i
from ..sources.driver_tables import DAY, EPISODES_SQL, episodes_from_orders
from .queries import add

CHANGES = ("mix_shift", "volume_only", "new_cohort", "rate_change")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alarms of a day as one incident's members; every third is on one platform of its scope."""
    c = d.candidate_rows(episodes_from_orders(spark, sf_dir))
    scope = F.filter(F.array("scope"), lambda x: x != "")
    more = F.when((F.col("sample_size") % 3 == 0) & ~F.col("scope").contains("platform"), F.array(F.lit("platform=web"))).otherwise(F.array().cast("array<string>"))
    change = F.element_at(F.array(*map(F.lit, CHANGES)), (F.col("sample_size") % 4).cast("int") + 1)
    n = F.col("sample_size").cast("double")
    impact = F.when(F.col("sample_size") % 5 != 0, F.struct(F.when(F.col("sample_size") % 7 == 0, "excess").otherwise("lost_successes").alias("measure"), n.alias("value"), (n / 2).alias("low"), (n * 2).alias("high")))
    return c.select(
        F.concat(F.lit("inc_"), F.floor(F.col("window_start") / DAY)).alias("incident_id"), F.col("anomaly_id").alias("candidate_id"), "metric", "direction", scope.alias("scope"), F.concat(scope, more).alias("locus"), change.alias("change_type"),
        "window_start", "window_end", F.coalesce("recovered_at", "window_end").alias("episode_end"), F.col("detected_at").alias("seen_at"), "sample_size", "score", impact.alias("impact"),
    )


_PRIORS = ", ".join(str((m, w, pos, cause, [x for x, y in by_dim if y == cause], cause == direct)).replace("[]", "[]::varchar[]") for m, w, by_dim, family, direct in i.PRIORS for pos, cause in enumerate(family))
MEMBERS = f"""with {EPISODES_SQL}, mem as (select 'inc_' || (window_start // {DAY}) as incident_id, anomaly_id as candidate_id, metric, direction, list_filter([scope], lambda x: x != '') as scope, list_filter([scope, case when sample_size % 3 = 0 and not contains(scope, 'platform') then 'platform=web' else '' end], lambda x: x != '') as locus,
  {list(CHANGES)}[sample_size % 4 + 1] as change_type, window_start, window_end, coalesce(recovered_at, window_end) as episode_end, detected_at as seen_at, sample_size, score, sample_size % 5 != 0 as some, case when sample_size % 7 = 0 then 'excess' else 'lost_successes' end as measure from candidates),
p(metric, direction, pos, cause, dims, direct) as (values {_PRIORS}),
e as (select incident_id, seen_at, candidate_id, score, pos, cause, case when direct or len(list_intersect(dims, list_transform(locus, lambda x: split_part(x, '=', 1)))) > 0 then 3 else 1 end as weight from mem join p using (metric, direction)
  union all select incident_id, seen_at, candidate_id, score, 99, 'normal_variation', 3 from mem where change_type in {i.SHIFTS}),
g as (select incident_id, cause, max(weight) as prior, min({{'s': seen_at, 'c': candidate_id, 'p': pos}}) as first from e group by 1, 2),
r as (select incident_id, cause, prior, row_number() over (partition by incident_id order by prior desc, first) - 1 as nth from g where cause not in {i.ALWAYS}),
ids as (select incident_id, count(nth) as n from (select distinct incident_id from mem) left join (select * from r where nth < 7) using (incident_id) group by 1),
hyp as (select incident_id, nth, cause, prior from r where nth < 7 union all select ids.incident_id, n, 'normal_variation', coalesce(prior, 0) from ids left join g on g.incident_id = ids.incident_id and cause = 'normal_variation' union all select incident_id, n + 1, 'unknown', 0 from ids)
"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that clearly point to a cause support it where their score is high, and speak against it where it is very low."""
    own = members(spark, sf_dir)
    points = i.member_priors(own).where("weight = 3").groupBy("incident_id", "cause").agg(F.count_if(F.col("score") >= 4).alias("supporting"), F.count_if(F.col("score") < 1).alias("contradicting"))
    both = i.hypothesis_priors(own).join(points, ["incident_id", "cause"], "left").fillna(0, ["supporting", "contradicting"])
    return i.hypothesis_status(both).drop("hypothesis_id")


add("i6_hypothesis_priors", lambda s, sf: i.hypothesis_priors(members(s, sf)), MEMBERS + "select incident_id, 'hyp_' || sha256(incident_id || '|' || cause)[1:12] as hypothesis_id, nth, cause, prior from hyp")
add("i9_hypothesis_status", _status, MEMBERS + """, pts as (select incident_id, cause, count(*) filter (where score >= 4) as supporting, count(*) filter (where score < 1) as contradicting from e where weight = 3 group by 1, 2),
k as (select incident_id, nth, cause, prior, coalesce(supporting, 0) as supporting, coalesce(contradicting, 0) as contradicting from hyp left join pts using (incident_id, cause)), sc as (select *, prior + supporting - 2 * contradicting as score from k)
select *, case when contradicting >= 1 and contradicting > supporting then 'contradicted' when supporting >= 2 and contradicting = 0 then 'supported' else 'open' end as status, row_number() over (partition by incident_id order by score desc, prior desc, nth, cause) as rank from sc""")  # fmt: skip


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cohorts: a few hundred an incident, their priority as the combination; two orders are one cohort."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    half = F.floor(F.col("k") / 2)
    return o.select(F.floor(F.col("k") / 900).alias("incident_id"), F.col("o_orderpriority").alias("combo"), F.concat(F.lit("cohort="), half).alias("dims"), ((half * 7919 % 401 - 200) / 64.0).alias("contribution"))


def _narrow_sql() -> str:
    ctes = ["i0 as (select o_orderkey // 900 as incident_id, o_orderpriority as combo, 'cohort=' || (o_orderkey // 2) as dims, ((o_orderkey // 2) * 7919 % 401 - 200) / 64.0::double as contribution from orders)"]
    ctes.append("s0 as (select * exclude (place), place % 40 as place, [place // 40] as path from (select *, row_number() over (partition by incident_id, combo order by abs(contribution) desc, dims) - 1 as place from i0))")
    for nth in range(4):
        ctes.append(f"""c{nth} as (select incident_id, combo, path, count(*) as n, dense_rank() over (partition by incident_id order by sum(abs(contribution)) desc, arg_min(dims, place), combo, path) as nth from s{nth} group by 1, 2, 3)""")
        step = "case when n > 10 then cast(ceil(n / 4.0) as bigint) else n end"
        moved = f"place % ({step}) as place, list_append(path, place // ({step})) as path" if nth < 3 else "place, path, c3.nth as nth"
        ctes.append(f"s{nth + 1} as (select s.incident_id, s.combo, dims, contribution, {moved} from s{nth} s join c{nth} using (incident_id, combo, path) where c{nth}.nth <= 4)")
    return "with " + ", ".join(ctes) + """, one as (select *, row_number() over (partition by incident_id, dims order by nth desc) as again from s4 where place < 10)
select incident_id, row_number() over (partition by incident_id order by abs(contribution) desc, dims) as rank, combo, dims, contribution from one where again = 1"""


add("i5_narrow_select", lambda s, sf: i.narrow_select(items(s, sf)), _narrow_sql())

ANCHORS = MEMBERS + f""", anchors as (select incident_id, arg_max(m, {{'n': n, 'w': m.window_end, 'c': m.candidate_id}}) filter (where m.metric in {i.IMPACT_METRICS} and m.some) as a, coalesce(a, arg_max(m, {{'n': n, 'c': m.candidate_id}})) as b from (select incident_id, len(locus) as n, mem as m from mem) group by 1)
"""
add("h7_impact_anchor", lambda s, sf: i.impact_anchor(members(s, sf)).drop("impact").withColumn("cohort", F.array_join("cohort", ",")), ANCHORS + 'select incident_id, a.candidate_id as anchor, b.window_start as start, b.window_end as window_end, b.episode_end as "end", array_to_string(case when b.change_type = \'new_cohort\' then b.scope else b.locus end, \',\') as cohort from anchors')
_SCALED = ", ".join(f"case when a.measure = 'lost_successes' then round(a.sample_size * {f} * greatest(1.0, (a.episode_end - a.window_start) / (a.window_end - a.window_start)::double), 1) end as {c}" for c, f in (("value", "1.0::double"), ("low", "0.5::double"), ("high", "2.0::double")))
add("h8_lost_successes", lambda s, sf: i.lost_successes(i.impact_anchor(members(s, sf))), ANCHORS + f'select incident_id, a.candidate_id as anchor, b.window_start as start, b.episode_end as "end", {_SCALED} from anchors')


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alarm as an incident of its own, that recovers with it."""
    own = materialized(members(spark, sf_dir).select(F.concat(F.lit("inc_"), "candidate_id").alias("incident_id"), F.col("seen_at").alias("created_at"), F.col("window_start").alias("started_at"), "metric", F.col("metric").alias("first_metric"), i.dims_of(F.col("locus")).alias("locus_dims"), "episode_end"), "similar")
    turns = F.array(F.struct(F.lit(1).alias("seq"), F.col("created_at").alias("event_time"), F.lit("open").alias("status")), F.struct(F.lit(2).alias("seq"), F.col("episode_end").alias("event_time"), F.lit("recovered").alias("status")))
    return i.similar_incidents(own, own.select("incident_id", F.inline(turns)))


add("i11_similar_incidents", _similar, MEMBERS + """, inc as (select 'inc_' || candidate_id as incident_id, seen_at as created_at, window_start as started_at, metric, list_transform(locus, lambda x: split_part(x, '=', 1)) as dims, episode_end from mem),
y as (select incident_id, unnest(dims) as dim, created_at, started_at, metric, episode_end from inc),
met as (select distinct a.incident_id, b.incident_id as earlier_id, b.created_at as since, b.started_at, case when b.episode_end <= a.created_at then 'recovered' else 'open' end as status from y a join y b on a.metric = b.metric and a.dim = b.dim and b.created_at < a.created_at)
select incident_id, nth, earlier_id, started_at, status from (select *, row_number() over (partition by incident_id order by since, earlier_id) as nth from met) where nth <= 5""")  # fmt: skip
