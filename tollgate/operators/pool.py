"""Scores of many runs as one: ratios of sums, rates a day, shares, medians and quantiles of pooled lists, and contrasts of systems.

A score record holds what can be added (counts) and what can be pooled (lists), never a finished rate, so runs fold in any
order and any grouping: a pooled ratio is the ratio of the sums, not the mean of the runs' ratios.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ALL = "all"


def pool_scores(
    rows: DataFrame, by: Sequence[str], rollup: Sequence[str] = (), ratios: Mapping[str, tuple[str, str]] | None = None, sums: Sequence[str] = (), shares: Mapping[str, str] | None = None,
    medians: Mapping[str, str] | None = None, places: Mapping[str, tuple[str, float]] | None = None,
) -> DataFrame:
    """One row a group: runs, the sums, ratios (numerator, denominator columns), shares, medians and places of lists.

    rows: a record a run and whatever it is split by. by: columns of every group. rollup: columns that a group may leave
    out (it then reads ``all``), every subset of them giving rows of its own; runs and values fold before they stand in several subsets. shares, medians: name to
    an array column whose values of all runs are pooled; places: the value at place floor(share * (n - 1)), from 0, of the
    pooled values in order. Null numbers count as 0, null values in lists are left out, a ratio over 0 and a statistic of
    no values are null, and a value of the grouping columns that is null stands as ``unknown``. An empty table gives no
    row. Lists are counted a value before they are pooled: a median costs the distinct values, not the values.
    """
    ratios, shares, medians, places = ratios or {}, shares or {}, medians or {}, places or {}
    keys = [*by, *rollup]
    named = rows.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("unknown")) for k in keys})
    # every record stands once in each subset; the subset's number keeps a value that is named all apart
    cubes = F.array(*(F.struct(F.lit(i).alias("cube"), *((F.col(r) if keep else F.lit(ALL)).alias(r) for r, keep in zip(rollup, kept, strict=True))) for i, kept in enumerate(product((True, False), repeat=len(rollup)))))
    group = [*by, *rollup, "cube"]

    def expanded(df: DataFrame) -> DataFrame:
        return df.withColumn("cubes", F.explode(cubes)).select(*(c for c in df.columns if c not in rollup), "cubes.*")

    summed = sorted({*sums, *(c for pair in ratios.values() for c in pair)})
    fine = named.groupBy(*keys, "run_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in summed), F.count("*").alias("records__"))
    total = expanded(fine).groupBy(*group).agg(F.count_distinct("run_id").alias("runs"), *(F.sum(c).alias(c) for c in summed))
    out = total.select(*group, "runs", *sums, *(F.when(F.col(b) != 0, F.col(a) / F.col(b)).alias(n) for n, (a, b) in ratios.items()))
    lists = sorted({*shares.values(), *medians.values(), *(c for c, _ in places.values())})
    if not lists:
        return out.drop("cube")
    numbers = lambda c: F.array_compact(F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>")))
    tagged = lambda c: F.transform(numbers(c), lambda x: F.struct(F.lit(c).alias("list"), x.alias("value")))
    values = [tagged(c) for c in lists]
    each = named.select(*keys, F.explode(F.concat(*values)).alias("x")).select(*keys, "x.*")
    counted = expanded(each.groupBy(*keys, "list", "value").agg(F.count("*").alias("n"))).groupBy(*group, "list", "value").agg(F.sum("n").alias("n"))
    own = W.partitionBy(*group, "list")
    placed = counted.withColumn("upto", F.sum("n").over(own.orderBy("value"))).withColumn("of", F.sum("n").over(own))

    def at(name: str, place) -> Column:
        """The pooled value at a place counted from 0."""
        return F.min(F.when((F.col("list") == name) & (F.col("upto") > place), F.col("value")))

    of = F.col("of")
    stats = [(F.sum(F.when(F.col("list") == c, F.col("value") * F.col("n"))) / F.sum(F.when(F.col("list") == c, F.col("n")))).alias(n) for n, c in shares.items()]
    stats += [((at(c, F.floor((of - 1) / 2)) + at(c, F.floor(of / 2))) / 2).alias(n) for n, c in medians.items()]
    stats += [at(c, F.floor((of - 1) * share)).alias(n) for n, (c, share) in places.items()]
    return out.join(placed.groupBy(*group).agg(*stats), group, "left").drop("cube")


def contrast(pooled: DataFrame, system: str, with_: str, without: str, measures: Sequence[str]) -> DataFrame:
    """The groups of both systems side by side: every measure with, without, and the difference (null where one is missing)."""
    keys = [c for c, kind in pooled.dtypes if kind == "string" and c != system]
    side = lambda name, end: pooled.where(F.col(system) == name).select(*keys, *(F.col(m).cast("double").alias(f"{m}_{end}") for m in measures))
    met = side(with_, "with").join(side(without, "without"), keys, "full")
    return met.select(*keys, *reduce(lambda a, m: [*a, f"{m}_with", f"{m}_without", (F.col(f"{m}_with") - F.col(f"{m}_without")).alias(f"{m}_gain")], measures, []))
