"""Registered queries of cohort localization over the event tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialized
from ..operators import cohorts as c
from ..operators import metrics as m
from ..operators.detect import detect
from ..sources.driver_tables import NORM_SQL, PLANTED
from .queries import END, START, add, norm

#: The windows to explain: the days with a planted decline, two days of a new app version, a calm day.
ASKED = [("planted", "down", PLANTED[0], PLANTED[1]), ("new_app", "down", START + 15 * 86_400, START + 17 * 86_400), ("calm", "up", START + 9 * 86_400, START + 10 * 86_400)]


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "candidate_id string, direction string, window_start bigint, window_end bigint")


def tables(spark: SparkSession, sf_dir: str, metric: str = "authorization_rate") -> DataFrame:
    return c.cohort_tables(norm(spark, sf_dir), asked(spark), metric, 1, "1d", START, END)


def pooled(spark: SparkSession, sf_dir: str, metric: str = "authorization_rate") -> DataFrame:
    return c.pool_before_during(tables(spark, sf_dir, metric), asked(spark), START)


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pooled, tested and new cohorts, each written once."""
    rows = materialized(pooled(spark, sf_dir), "pooled")
    return rows, materialized(c.tested_cohorts(rows), "tested"), materialized(c.new_cohorts(rows), "new-cohorts")


def loci(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    rows, t, new = parts(spark, sf_dir)
    return rows, t, new, c.locus(t, rows, new, c.change_label(rows, new))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector's own candidates, explained."""
    events = norm(spark, sf_dir)
    return c.analyze_candidates(events, detect(events, START, END), START, END)


def tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.tested_cohorts(materialized(pooled(spark, sf_dir), "pooled"))


def _sql(metric: str = "authorization_rate", rows: str = "", combinations: tuple = c.COMBINATIONS, q: float = c.BH_Q) -> str:
    r = m.request(metric, 1, START, END, "1d", c.dimensions(), visibility="window_close", dense=False)
    kind = "count" if metric in c.COUNT_METRICS else "rate"
    rows = rows or "values " + ", ".join(str(x) for x in ASKED)
    named = lambda s: " || ',' || ".join(f"'{d}=' || {d}" for d in c.dimensions() if d in s)
    sets = " union all ".join(
        f"select candidate_id, direction, lag, '{','.join(d for d in c.dimensions() if d in s)}' as combination, {named(s)} as cohort, cast(sum(numerator) as bigint) as n, cast(sum(denominator) as bigint) as d from met group by all" for s in combinations
    )
    return f"""with {NORM_SQL}, asked(candidate_id, direction, window_start, window_end) as ({rows}), lags as (select unnest({[0, *c.LAGS]}) as lag),
cells as ({m.compute_sql(r)}),
wins as (select candidate_id, direction, lag, unnest(range(window_start - lag * 86400, window_end - lag * 86400, 86400)) as window_start from asked, lags where window_start - lag * 86400 >= {START}),
met as (select * from wins join cells using (window_start)),
tab as ({sets}),
now as (select candidate_id, combination, cohort, any_value(direction) as direction, coalesce(sum(n) filter (where lag = 0), 0) as k_now, coalesce(sum(d) filter (where lag = 0), 0) as n_now from tab group by 1, 2, 3),
days as (select now.candidate_id, combination, cohort, v.lag, coalesce(t.n, 0) as n, coalesce(t.d, 0) as d from now join (select candidate_id, lag from asked, lags where lag > 0 and window_start - lag * 86400 >= {START}) v using (candidate_id) left join tab t using (candidate_id, combination, cohort, lag)),
vals as (select *, {"n::double" if kind == "count" else "case when d > 0 then n::double / d else 0.0 end"} as v from days),
mids as (select *, count(*) over w as m, quantile_cont(v, 0.5) over w as mid from vals window w as (partition by candidate_id, combination, cohort)),
kept as (select * from (select *, row_number() over (partition by candidate_id, combination, cohort order by abs(v - mid) desc, lag desc) as nth from mids) where m < 4 or nth > 1),
bef as (select candidate_id, combination, cohort, count(*) as n_days, sum(n) as kb, sum(d) as nb from kept group by 1, 2, 3),
pooled as (select now.candidate_id, combination, cohort, '{kind}' as kind, direction, coalesce(n_days, 0) as n_days, {"coalesce(kb::double / n_days, 0.0)" if kind == "count" else "coalesce(kb, 0)::double"} as k_b, {"1.0::double" if kind == "count" else "coalesce(nb, 0)::double"} as n_b, k_now::double as k_d, {"1.0::double" if kind == "count" else "n_now::double"} as n_d from now left join bef using (candidate_id, combination, cohort)),
many as (select k.*, sum(n) over w as ks, sum(d) over w as ns, count(*) over w as cnt from kept k window w as (partition by candidate_id, combination, cohort)),
zs as (select candidate_id, combination, {"case when true then 2 * (sqrt(n + 0.375) - sqrt((ks - n)::double / (cnt - 1) + 0.375)) / sqrt(1 + 1.0::double / (cnt - 1)) end" if kind == "count" else f"case when d >= {c.SUPPORT} and ns - d > 0 then 2 * (asin(sqrt(least(1.0, n::double / d))) - asin(sqrt(least(1.0, (ks - n)::double / (ns - d))))) / sqrt(1.0::double / (ns - d) + 1.0::double / d) end"} as z from many where cnt >= 3),
phis as (select candidate_id, combination, case when count(z) < 6 then 1.0 else greatest(1.0, pow(quantile_cont(abs(z), 0.5) / 0.6745, 2)) end::double as phi from zs group by 1, 2),
sums as (select *, sum(n_b) over w as nb, sum(n_d) over w as nd, sum(k_b) over w as kb, sum(k_d) over w as kd from pooled window w as (partition by candidate_id, combination)),
rates as (select *, case when n_b > 0 then k_b / n_b when n_d > 0 then k_d / n_d else 0.0 end as rb from sums),
dec as (
  select * exclude (rb), case when kind = 'count' then k_d - k_b when nb > 0 and nd > 0 then (n_b / nb + n_d / nd) / 2 * ((case when n_d > 0 then k_d / n_d else rb end) - rb) else 0.0 end as rate_part,
    case when kind = 'count' then 0.0 when nb > 0 and nd > 0 then ((rb + (case when n_d > 0 then k_d / n_d else rb end)) / 2 - (kb / nb + kd / nd) / 2) * (n_d / nd - n_b / nb) else 0.0 end as composition_part from rates),
zt as (select d.*, coalesce(phi, 1.0) as phi, case when direction = 'down' then -1.0 else 1.0 end as toward, sum(rate_part + composition_part) over (partition by candidate_id, combination) as total,
    2 * (asin(sqrt(least(1.0, k_d / nullif(n_d, 0)))) - asin(sqrt(least(1.0, k_b / nullif(n_b, 0))))) / sqrt(coalesce(phi, 1.0) * (1 / n_b + 1 / n_d)) as z from dec d left join phis using (candidate_id, combination)),
zp as (select *, 1 / (1 + 0.2316419 * abs(z)) as t from zt where n_b >= {c.SUPPORT} and n_d >= {c.SUPPORT}),
ps as (select *, case when toward * z >= 0 then tail else 1 - tail end as p from (select *, 0.3989422804014327 * exp(-z * z / 2) * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))) as tail from zp)),
bh as (select *, row_number() over (partition by candidate_id order by p, combination, cohort) as rank, count(*) over (partition by candidate_id) as of_ from ps),
tested as (select *, coalesce(rank <= max(case when p <= {q} * rank / of_ then rank end) over (partition by candidate_id), false) as discovery,
    min(least(1.0, p * of_ / rank)) over (partition by candidate_id order by rank rows between current row and unbounded following) as q, case when total != 0 then rate_part / total else 0.0 end as coverage from bh)
"""


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


RATE, COUNT, KEYS = _sql(), _sql("attempt_volume"), "candidate_id, combination, cohort"
_keys = KEYS.split(", ")
add("f1_cohort_tables", tables, RATE + "select candidate_id, 'rate' as kind, direction, combination, cohort, lag, n, d from tab")
add("f2_pool_before_during", lambda s, sf: pooled(s, sf).drop("ref_days"), RATE + "select * from pooled")
add("f2_pool_counts", lambda s, sf: _round(pooled(s, sf, "attempt_volume").drop("ref_days"), "k_b"), COUNT + "select * replace (round(k_b, 6) as k_b) from pooled")
add("f3_z_rate", lambda s, sf: _round(tested(s, sf).select(*_keys, "z"), "z"), RATE + f"select {KEYS}, round(z, 6) as z from tested")
add("f5_phi_reference_days", lambda s, sf: _round(c.phi_reference_days(pooled(s, sf)), "phi"), RATE + "select candidate_id, combination, round(phi, 6) as phi from phis")
add("f5_phi_counts", lambda s, sf: _round(c.phi_reference_days(pooled(s, sf, "attempt_volume")), "phi"), COUNT + "select candidate_id, combination, round(phi, 6) as phi from phis")
add("f6_p_value", lambda s, sf: _round(tested(s, sf).select(*_keys, "p"), "p"), RATE + f"select {KEYS}, round(p, 6) as p from tested")
add("f7_benjamini_hochberg", lambda s, sf: _round(tested(s, sf).select(*_keys, "discovery", "q"), "q"), RATE + f"select {KEYS}, discovery, round(q, 6) as q from tested")
add("f8_decompose_rate", lambda s, sf: _round(c.decompose(pooled(s, sf)).select(*_keys, "rate_part", "composition_part"), "rate_part", "composition_part"), RATE + f"select {KEYS}, round(rate_part, 6) as rate_part, round(composition_part, 6) as composition_part from dec")
add("f9_decompose_count", lambda s, sf: _round(c.decompose(pooled(s, sf, "attempt_volume")).select(*_keys, "rate_part"), "rate_part"), COUNT + f"select {KEYS}, round(rate_part, 6) as rate_part from dec")

# the new cohorts as SQL, and what explains enough of the change
NEWS = RATE + f""", ntot as (select d.*, coalesce(phi, 1.0) as phi, case when direction = 'down' then -1.0 else 1.0 end as toward, sum(rate_part + composition_part) over (partition by candidate_id, combination) as total from dec d left join phis using (candidate_id, combination)),
nz as (select *, kd - k_d as rest_k, nd - n_d as rest_n from ntot where n_b < {c.SUPPORT} and n_d >= {c.SUPPORT} and nd - n_d >= {c.SUPPORT}),
np as (select *, 2 * (asin(sqrt(least(1.0, k_d / n_d))) - asin(sqrt(least(1.0, rest_k / rest_n)))) / sqrt(phi * (1 / rest_n + 1 / n_d)) as z from nz),
nq as (select *, case when toward * z >= 0 then tail else 1 - tail end as p from (select *, 0.3989422804014327 * exp(-z * z / 2) * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))) as tail from (select *, 1 / (1 + 0.2316419 * abs(z)) as t from np))),
nb as (select *, row_number() over (partition by candidate_id order by p, combination, cohort) as rank, count(*) over (partition by candidate_id) as of_ from nq),
news as (select *, coalesce(rank <= max(case when p <= {c.BH_Q} * rank / of_ then rank end) over (partition by candidate_id), false) as discovery, min(least(1.0, p * of_ / rank)) over (partition by candidate_id order by rank rows between current row and unbounded following) as q,
  (k_d / n_d - rest_k / rest_n) * n_d / nd as contribution, case when total != 0 then (k_d / n_d - rest_k / rest_n) * n_d / nd / total else 0.0 end as coverage from nb),
fresh as (select candidate_id, arg_max(cohort, {{'v': coverage, 'c': cohort}}) as cohort, arg_max(combination, {{'v': coverage, 'c': cohort}}) as combination from news where discovery and coverage >= {c.COVERAGE} group by 1),
shares as (select candidate_id, arg_min({{'share': share, 'combination': combination}}, {{'share': share, 'combination': combination}}) as b from (select candidate_id, combination, r / (r + c) as share from (select candidate_id, combination, abs(sum(rate_part)) as r, abs(sum(composition_part)) as c, count(*) filter (where n_b >= {c.SUPPORT} and n_d >= {c.SUPPORT}) as s from dec group by 1, 2) where s >= 2 and r + c > 0) group by 1),
labels as (select candidate_id, case when f.cohort is not null then 'new_cohort' when b is null then 'insufficient_data' when b.share >= {c.HIGH} then 'rate_change' when b.share <= {c.LOW} then 'mix_shift' else 'mixed' end as label, coalesce(f.combination, b.combination) as combination, b.share as rate_share from (select distinct candidate_id from pooled) left join shares using (candidate_id) left join fresh f using (candidate_id))
"""
add("f10_new_cohorts", lambda s, sf: _round(c.new_cohorts(materialized(pooled(s, sf), "pooled")).select(*_keys, "z", "p", "q", "discovery", "contribution", "coverage"), "z", "p", "q", "contribution", "coverage"), NEWS + f"select {KEYS}, round(z, 6) as z, round(p, 6) as p, round(q, 6) as q, discovery, round(contribution, 6) as contribution, round(coverage, 6) as coverage from news")
add("f11_change_label", lambda s, sf: _round(c.change_label(*parts(s, sf)[::2]), "rate_share"), NEWS + "select candidate_id, label, combination, round(rate_share, 6) as rate_share from labels")
add("f12_locus_f13_canonical", lambda s, sf: loci(s, sf)[3])
add("f14_rank_top_cohorts", lambda s, sf: c.rank_top_cohorts(*parts(s, sf)[1:]), NEWS + f"select candidate_id, cohort, nth from (select candidate_id, cohort, row_number() over (partition by candidate_id order by turn, towards desc, z desc, cohort) as nth from (select candidate_id, cohort, 0 as turn, 0.0 as towards, 0.0 as z from fresh union all select candidate_id, cohort, 1, toward * rate_part, abs(z) from tested where discovery)) where nth <= {c.TOP}")
add("f15_controls", lambda s, sf: (lambda x: c.controls(x[1], x[3]))(loci(s, sf)))
add("f17_f18_f23_analyze_candidates", analyses)
add("f16_impact_estimate", lambda s, sf: _round(c.impact_estimate(tested(s, sf)), "value", "low", "high"), RATE + f"""select {KEYS}, round(v, 6) as value, round(v - 1.96 * sd, 6) as low, round(v + 1.96 * sd, 6) as high
from (select *, toward * (rd - rb) * n_d as v, sqrt(phi * (rb * (1 - rb) / n_b + rd * (1 - rd) / n_d)) * n_d as sd from (select *, least(1.0, k_b / n_b) as rb, least(1.0, k_d / n_d) as rd from tested))""")
add("f20_naive_locus", lambda s, sf: _round(c.naive_locus(tested(s, sf)), "move"), RATE + "select candidate_id, arg_min(cohort, {'m': -move, 'c': cohort}) as naive_locus, round(max(move), 6) as move from (select *, case when k_b > 0 then toward * (k_d / n_d - k_b / n_b) / (k_b / n_b) end as move from tested) where move > 0 group by 1")
_DAYS = f"select 'day_' || t, 'down', t, t + 86400 from (select unnest(range({START} + 3 * 86400, {END}, 86400)) as t)"
add("f21_cohort_sweep", lambda s, sf: c.cohort_sweep(norm(s, sf), START, END).withColumns({"methods": F.array_join("methods", ","), "evidence_ids": F.array_join("evidence_ids", ",")}), _sql(rows=_DAYS, combinations=c.SWEEP, q=c.SWEEP_Q) + f""", hits as (
  select t.*, a.window_start as day, a.window_start - row_number() over (partition by cohort order by a.window_start) * 86400 as island from tested t join asked a using (candidate_id) where discovery),
runs as (select cohort, min(day) as first, max(day) as last, max(abs(z)) as score, arg_min({{'k': k_d / n_d, 'b': k_b / n_b, 'n': n_d}}, day) as f,
  array_to_string(list('evd_' || sha256('authorization_rate|1|' || cohort || '|1d|' || day)[1:16] order by day)[1:{c.MOST_EVIDENCE}], ',') as evidence_ids from hits group by cohort, island)
select 'anom_' || sha256('main|S12|authorization_rate|1|' || cohort || '|' || first)[1:16] as anomaly_id, 'main' as system, 'S12' as series, 'authorization_rate' as metric, 1 as version, '1d' as grain, cohort as scope, 'down' as direction, first as window_start, last + 86400 as window_end, first + 86400 as detected_at,
  round(f.k, 6) as observed, round(f.b, 6) as expected, round(f.k - f.b, 6) as delta, case when f.b != 0 then round((f.k - f.b) / f.b, 6) end as relative_delta, round(score, 3) as score, f.n::bigint as sample_size, 'cohort_sweep' as methods, evidence_ids from runs""")
