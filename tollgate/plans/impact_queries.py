"""Registered queries of revenue impact over failures of payments, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialized
from ..operators import impact as p
from ..operators import investigate as i
from ..sources.driver_tables import DAY, EPOCH_2024, NORM_SQL, norm_from_events
from .queries import add

BLOCK = 4 * 3600


def failures(norm: DataFrame) -> DataFrame:
    """The failed payments of four hours, a provider and a country, as the only member of an incident; odd blocks are told of the provider alone."""
    block = F.floor(F.col("occurred_at") / BLOCK)
    per = norm.where("event_type = 'payment.failed'").groupBy(block.alias("block"), "psp", "customer_country").agg(F.min("occurred_at").alias("window_start"), F.max("occurred_at").alias("last"), F.count("*").alias("n"))
    pair = lambda c: F.concat(F.lit(f"{c}="), F.col(c))
    locus = F.when(F.col("block") % 2 == 0, F.array(pair("psp"), pair("customer_country"))).otherwise(F.array(pair("psp")))
    n = F.col("n").cast("double")
    loss = F.struct(F.lit("lost_successes").alias("measure"), n.alias("value"), (n / 2).alias("low"), (n * 2).alias("high"))
    name = F.concat_ws("|", F.col("block").cast("string"), "psp", "customer_country")
    return per.select(
        name.alias("incident_id"), name.alias("candidate_id"), F.lit("authorization_rate").alias("metric"), F.lit("rate_change").alias("change_type"), locus.alias("scope"), locus.alias("locus"), "window_start", (F.col("window_start") + 3600).alias("window_end"),
        (F.col("last") + 1).alias("episode_end"), F.when(F.col("n") > 1, loss).alias("impact"),
    )


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    norm = norm_from_events(spark, sf_dir)
    anchors = materialized(i.impact_anchor(failures(norm)), "anchors")
    return anchors, p.revenue_baseline(anchors, norm, EPOCH_2024)


def _impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors, revenue = _parts(spark, sf_dir)
    found = p.incident_impact(anchors, i.lost_successes(anchors), revenue)
    flat = F.array_join(F.transform(F.map_entries("captured_revenue_minor"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return found.withColumns({"cohort": F.array_join("cohort", ","), "captured_revenue_minor": flat})


_LAGS = ", ".join(f"case when s - {k * DAY} >= q then coalesce(sum(minor) filter (where hour >= s - {k * DAY} and hour < e - {k * DAY}), 0)::bigint end" for k in p.LAGS)
BASE = f"""with {NORM_SQL.replace("norm as (", "norm as materialized (", 1)}, f as (select occurred_at // {BLOCK} as block, psp, customer_country, min(occurred_at) as start, max(occurred_at) + 1 as "end", count(*) as n from norm where event_type = 'payment.failed' group by 1, 2, 3),
t as (select *, block || '|' || psp || '|' || customer_country as incident_id, block % 2 = 0 as both_, start - start % 3600 as s, "end" - 1 - ("end" - 1) % 3600 + 3600 as e, greatest({EPOCH_2024}, s - {max(p.LAGS) * DAY}) as q from f),
h as (select psp, customer_country, currency, occurred_at - occurred_at % 3600 as hour, sum(amount_minor) as minor from norm where event_type = '{p.CAPTURED}' group by 1, 2, 3, 4),
m as (select incident_id, currency, coalesce(sum(minor) filter (where hour >= s and hour < e), 0)::bigint as observed_minor, list_filter([{_LAGS}], lambda x: x is not null) as refs from t join h on h.psp = t.psp and (h.customer_country = t.customer_country or not both_) and hour >= q and hour < e group by incident_id, currency, s, e, q),
k as (select *, list_sort(refs)[len(refs) // 2 + 1] as mid, list_transform(refs, lambda x: abs(x - mid)) as away, case when len(refs) >= {p.TRIM_FROM} then list_position(away, list_max(away)) end as cut from m where len(refs) >= {p.FEWEST}),
b as (select *, case when cut is null then refs else list_concat(refs[:cut - 1], refs[cut + 1:]) end as kept, list_sum(kept)::double / len(kept) as base, sqrt(list_sum(list_transform(kept, lambda x: (x - base) * (x - base))) / len(kept)) as sd from k),
rev as (select incident_id, currency, observed_minor, round_even(base, 0)::bigint as baseline_minor, round_even(base - observed_minor, 0)::bigint as lost_minor, round_even(base - 1.96::double * sd - observed_minor, 0)::bigint as low, round_even(base + 1.96::double * sd - observed_minor, 0)::bigint as high from b)
"""
# rounded half up as the decimal that a double reads as: round(double) multiplies first, and a product that falls just short of a half lands on it
_ROUND = "round({}::double::varchar::decimal(38, 18), {})::double".format
_SCALE = """greatest(1.0::double, ("end" - start) / 3600.0::double / 1.0::double)"""
add("h9_revenue_baseline", lambda s, sf: _parts(s, sf)[1], BASE + "select * from rev")
add("h10_incident_impact", _impact, BASE + f""", c as (select incident_id, string_agg(currency || '=' || observed_minor, ',' order by currency) as captured from rev group by 1)
select incident_id, case when n > 1 then incident_id end as anchor, start, "end", {_ROUND('(("end" - start) / 3600.0::double)', 2)} as hours, 'psp=' || psp || case when both_ then ',customer_country=' || customer_country else '' end as cohort,
{", ".join(f"case when n > 1 then {_ROUND(f"(n * {f}::double * {_SCALE})", 1)} end as {c}" for f, c in ((1.0, "lost_payments"), (0.5, "lost_low"), (2.0, "lost_high")))}, 'not_provided' as lost_revenue, coalesce(captured, '') as captured_revenue_minor from t left join c using (incident_id)""")
