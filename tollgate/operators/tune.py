"""Choosing limits: a grid is read off histograms of what passes where, so its size doesn't multiply with the candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ordered labels of a state, the change types that a route may ask for, and the most non-incidents a day.
STRENGTHS = ("weak", "moderate", "strong")
SHARES = ("not_provided", "minor", "partial", "most", "nearly_all")
LEAST_SHARES = ("not_provided", "partial")
IMPACTS = ("negligible", "small", "medium", "large")
TYPES = (("rate_like", ("rate_change", "new_cohort", "mixed")), ("not_composition", ("rate_change", "new_cohort", "mixed", "insufficient_data")))
BUDGET = 0.10


def impact_edges(rows: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> tuple[float, ...]:
    """The impact rates at places floor(q n), from 0, of the sorted ones, at two significant digits; three numbers reach the driver."""
    ranked = rows.where("impact_rate is not null").groupBy("impact_rate").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(W.orderBy("impact_rate")))
    total = F.max("upto").over(W.partitionBy())
    at = [F.min(F.when(F.col("upto") > F.least(F.col("of") - 1, F.floor(F.col("of") * q)), F.col("impact_rate"))).alias(f"e{i}") for i, q in enumerate(quantiles)]
    found = ranked.withColumn("of", total).agg(*at).first()
    return tuple(float(f"{x:.2g}") for x in found if x is not None)


def passing_grid(rows: DataFrame, incidents: DataFrame, days: float, edges: tuple[float, ...]) -> DataFrame:
    """recall, incident_per_day and non_incident_per_day of every (strength_min, change_types, impact_min, locus_share_min).

    rows: strength, change_type, impact_rate, locus_share, status and record_key of candidates with a state. What a
    candidate passes follows from its four ranks: candidates are counted by ranks first (a few hundred groups), and
    incidents by the distinct ranks of their candidates, and only then spread over the grid.
    """
    place = lambda c, names: F.array_position(F.array(*map(F.lit, names)), F.col(c)) - 1
    impact = F.when(F.col("impact_rate").isNull(), -1).otherwise(sum(((F.col("impact_rate") >= e).cast("int") for e in edges), F.lit(0)))
    kinds = F.array(*(F.when(F.col("change_type").isin(*types), name) for name, types in TYPES))
    ranks = rows.select(place("strength", STRENGTHS).cast("int").alias("s"), F.array_compact(kinds).alias("t"), impact.cast("int").alias("i"), place("locus_share", SHARES).cast("int").alias("l"), "status", "record_key")
    ranks = ranks.where("s >= 0 and i >= 0 and l >= 0 and size(t) > 0")
    wide = (
        F.explode(F.sequence(F.lit(0), "s")).alias("s_min"), F.explode("t").alias("change_types"), F.explode(F.sequence(F.lit(0), "i")).alias("i_min"),
        F.explode(F.filter(F.array(*map(F.lit, LEAST_SHARES)), lambda x: F.array_position(F.array(*map(F.lit, SHARES)), x) - 1 <= F.col("l"))).alias("locus_share_min"),
    )
    cell = ["s_min", "change_types", "i_min", "locus_share_min"]

    def spread(df: DataFrame) -> DataFrame:
        for c in wide:
            df = df.select("*", c)
        return df

    counts = ranks.groupBy("s", "t", "i", "l").agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("unmatched", "suppress")).alias("other"))
    counts = spread(counts).groupBy(*cell).agg(F.sum("n").alias("n"), F.sum("other").alias("other"))
    routed = ranks.where("status = 'incident'").join(incidents.select("record_key"), "record_key", "left_semi").select("record_key", "s", "t", "i", "l").distinct()
    routed = spread(routed).select("record_key", *cell).distinct().groupBy(*cell).agg(F.count("*").alias("routed"))
    scored = incidents.agg(F.count("*").alias("scored"))
    spark = rows.sparkSession
    grid = spark.createDataFrame([(s, t, i, l) for s in range(len(STRENGTHS)) for t, _ in TYPES for i in range(len(IMPACTS)) for l in LEAST_SHARES], "s_min int, change_types string, i_min int, locus_share_min string")
    all_ = F.broadcast(grid).join(counts, cell, "left").join(routed, cell, "left").crossJoin(F.broadcast(scored)).fillna(0, ["n", "other", "routed"])  # one row beside the grid
    name = lambda c, names: F.element_at(F.array(*map(F.lit, names)), F.col(c) + 1)
    return all_.select(
        name("s_min", STRENGTHS).alias("strength_min"), "change_types", name("i_min", IMPACTS).alias("impact_min"), "locus_share_min",
        F.when(F.col("scored") > 0, F.col("routed") / F.col("scored")).otherwise(0.0).alias("recall"), (F.col("other") / F.lit(days)).alias("non_incident_per_day"), (F.col("n") / F.lit(days)).alias("incident_per_day"),
    )


def tune_baseline_route(rows: DataFrame, incidents: DataFrame, days: float, budget: float = BUDGET) -> DataFrame:
    """The limits of most recall, then fewest routes, within the budget of non-incidents a day; the first in grid order of equals.

    An empty result if nothing keeps within it. edges are the impact rates that part the impact labels.
    """
    edges = impact_edges(rows)
    grid = passing_grid(rows, incidents, days, edges).where(F.col("non_incident_per_day") <= budget)
    place = lambda c, names: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    order = F.struct(
        (-F.col("recall")).alias("a"), F.col("incident_per_day").alias("b"), place("strength_min", STRENGTHS).alias("c"), place("change_types", [t for t, _ in TYPES]).alias("d"), place("impact_min", IMPACTS).alias("e"), place("locus_share_min", LEAST_SHARES).alias("f"),
    )
    best = grid.agg(F.min_by(F.struct(*grid.columns), order).alias("x")).where("x is not null").select("x.*")
    return best.withColumn("edges", F.array(*map(F.lit, edges)).cast("array<double>"))
