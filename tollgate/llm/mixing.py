"""Mixing sources to target weights by pivotal dependent rounding.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share ``share`` of all words; none takes
more than ``most`` times its own words, and what is over goes to the others by weight (a water level found with one
running sum over the per-source totals: a row of three numbers a source, so a million sources are some 30 MB in one sort).

Copies: within a source every document expects the same number of copies, target / size. The whole part is certain; the
fractional part is rounded dependently. Two documents with fractional parts trade words at random, the one's loss being
the other's gain in words, until one of them is whole; so the source's expected words never change and at the end one
document per group is still fractional. Groups are hashed buckets of about ``bucket_rows`` documents; the residuals of
a level meet in ``bucket_rows`` times fewer buckets of the next, so a hot source is a wide tree and not one task.

Defined cases: null text has size 0; documents of size 0 take nothing; a null source is a source of its own, last;
repeated rows are rounded one by one; reruns agree because every draw is a hash of the documents and ``seed``;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, let, words

WEIGHTS = (5, 2, 1)


def targets(per: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from one row a source (source, source_size)."""
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), nth % len(WEIGHTS) + 1))
    # a source is full once the water level reaches most * size / weight; levels are tried in that order
    turn = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everywhere = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    full = F.coalesce(F.sum("source_size").over(turn.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * F.lit(most)
    open_weight = F.sum("weight").over(turn.rowsBetween(0, W.unboundedFollowing))
    tried = weighed.withColumn("level", (F.sum("source_size").over(everywhere) * F.lit(share) - full) / open_weight)
    # the first level that its own source can take in holds for every source that is not full
    holds = F.when(F.col("source_size") * most >= F.col("level") * F.col("weight"), F.col("level"))
    tried = tried.withColumn("level", F.first(holds, ignorenulls=True).over(turn.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return tried.select("source", "source_size", F.least(F.col("source_size") * most, F.coalesce("level", F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _uniform(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(2**53)) / float(2**53)


def _trade(items: Column, seed: int) -> Column:
    """Folds one bucket's items in order: at most one stays fractional, the others are done. Large ones come first,
    so that what stays is small."""
    item = "struct<size:bigint,h:bigint,key:bigint,p:double>"
    start = F.struct(F.lit(None).cast(item).alias("rest"), F.array().cast(f"array<{item}>").alias("done"))

    def step(state: Column, x: Column) -> Column:
        y = state["rest"]
        up = F.least((1 - x["p"]) * x["size"], y["p"] * y["size"])  # words that x can win from y
        down = F.least(x["p"] * x["size"], (1 - y["p"]) * y["size"])
        wins = _uniform(x["h"], y["h"], F.lit(seed)) < down / (up + down)

        def settle(moved: Column) -> Column:
            px = F.when(moved["w"] == (1 - x["p"]) * x["size"], 1.0).when(-moved["w"] == x["p"] * x["size"], 0.0).otherwise(x["p"] + moved["w"] / x["size"])
            py = F.when(moved["w"] == y["p"] * y["size"], 0.0).when(-moved["w"] == (1 - y["p"]) * y["size"], 1.0).otherwise(y["p"] - moved["w"] / y["size"])
            new = lambda z, p: F.struct(z["size"].alias("size"), z["h"].alias("h"), z["key"].alias("key"), p.alias("p"))
            return let(F.struct(new(x, px).alias("x"), new(y, py).alias("y")), lambda b: F.filter(F.array(b["x"], b["y"]), lambda z: z.isNotNull()))

        both = F.when(y.isNull(), F.array(x)).otherwise(let(F.struct(F.when(wins, up).otherwise(-down).alias("w")), settle))
        whole = lambda z: (z["p"] <= 0) | (z["p"] >= 1)
        return let(both, lambda b: F.struct(F.get(F.filter(b, lambda z: ~whole(z)), 0).alias("rest"), F.concat(state["done"], F.filter(b, whole)).alias("done")))

    return F.aggregate(items, start, step)


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, bucket_rows: int = 256, seed: int = 7, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, more, source, size, source_size, target, copies, taken: one row for each row of docs (doc_id, text, source).

    more are bigint columns that tell rows of one doc_id, or without any, apart.
    """
    sized = docs.select("doc_id", *more, "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    # equal rows become one with a count, then rows again: numbered, so that they draw apart
    counted = durable(sized.groupBy("doc_id", *more, "source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    per = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = durable(targets(per, share, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    apart = counted.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    rows = apart.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    rows = rows.select("*", F.floor(rate).alias("base"), (rate - F.floor(rate)).alias("p"), F.xxhash64("doc_id", *more, "size", "nth", F.lit(seed)).alias("h"))

    key = F.xxhash64("source", F.lit(seed))  # the tree needs the source only to keep sources apart
    level = rows.where((F.col("size") > 0) & (F.col("p") > 0)).select(key.alias("src"), F.col("source").isNull().alias("no_src"), "h", F.coalesce("doc_id", F.lit(0)).alias("key"), "size", "p")
    biggest = counted.groupBy("source").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    buckets, done = -(-biggest // bucket_rows), None
    while True:
        groups = level.groupBy("src", "no_src", F.pmod(F.col("h"), F.lit(max(1, buckets))).alias("bucket"))
        folded = groups.agg(_trade(F.sort_array(F.collect_list(F.struct("size", "h", "key", "p")), asc=False), seed).alias("s"))
        folded = durable(folded, "mix-level")
        settled = folded.select("src", "no_src", F.explode("s.done").alias("d")).select("src", "no_src", "d.h", "d.size", (F.col("d.p") >= 1).alias("one"))
        done = settled if done is None else done.unionByName(settled)
        level = folded.where("s.rest is not null").select("src", "no_src", "s.rest.h", "s.rest.key", "s.rest.size", "s.rest.p")
        if buckets <= 1:
            break
        buckets = -(-buckets // bucket_rows)
    last = level.select("src", "no_src", "h", "size", (_uniform(F.col("h"), F.lit(seed + 1)) < F.col("p")).alias("one"))
    extra = done.unionByName(last).where("one").groupBy("src", "no_src", "h", "size").agg(F.count("*").alias("ones"))
    rows = rows.withColumns({"src": key, "no_src": F.col("source").isNull()})
    copies = F.col("base") + F.when(F.col("ones").isNotNull(), 1).otherwise(0)
    return rows.join(extra, ["src", "no_src", "h", "size"], "left").select("doc_id", *more, "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
