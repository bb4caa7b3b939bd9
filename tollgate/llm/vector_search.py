"""Nearest neighbours by inner product through an inverted multi-index.

Vectors are extended by one component, sqrt(M^2 - |x|^2) with M the largest norm, so that the nearest by Euclidean
distance are the largest by inner product. The two halves are quantised separately (k-means fitted on a bounded sample,
``sample`` vectors); a row's cell is its pair of centroids, and every row is indexed. A query takes cells in the order of
the summed distance to the two centroids, popped from a heap, until they hold ``share`` of all rows; those are reranked
by the exact inner product of the original vectors.

``share`` is calibrated when it is not given: on the sample, the share at which ``recall`` of the true neighbours lie in
the cells taken. Vectors with structure need few cells; directionless ones need many, whatever the index.

Equal vectors are one entry with their smallest ``k + 1`` ids (no more can be among k neighbours), so a vector held by a
third of the rows is one entry. Cells are cut into groups of about ``group_rows`` entries and queries, by their own cells,
into blocks, so that a block's queries open much the same groups; each (group, block) that a query opens scores one
matrix, and an entry goes to no other block. A crowded cell spreads over several groups.

Defined cases: null vectors, zero vectors and those holding null or non-finite components take no part; only vectors of
the query's length have an inner product with it, so each length is an index of its own; ties go to the smaller id; fewer
candidates than k are all returned; rows of one vec_id are one, with the smallest vector if they differ; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

Centroids = tuple[np.ndarray, np.ndarray, int]


def _kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(5)
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        counts = np.bincount(own, minlength=k)[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(rows[i : i + 4096], centres).argmin(1) for i in range(0, len(rows), 4096)])


def _extended(rows: np.ndarray, largest: float) -> np.ndarray:
    return np.column_stack((rows, np.sqrt(np.maximum(0, largest - (rows**2).sum(1)))))


def cells_in_order(first: np.ndarray, second: np.ndarray) -> Iterator[int]:
    """Cells (first * len(second) + second) by the sum of the two distances: a heap holds the frontier of pairs."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap = [(first[a[0]] + second[b[0]], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]) * len(second) + int(b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (first[a[i + 1]] + second[b[0]], i + 1, 0))


def _cells(rows: np.ndarray, largest: float, model: Centroids) -> np.ndarray:
    c1, c2, half = model
    wide = _extended(rows, largest)
    return _nearest(wide[:, :half], c1) * len(c2) + _nearest(wide[:, half:], c2)


def _taken(query: np.ndarray, model: Centroids, counts: np.ndarray, wanted: float) -> list[int]:
    c1, c2, half = model
    wide = np.append(query, 0.0)[None]
    found, held = [], 0
    for cell in cells_in_order(_distances(wide[:, :half], c1)[0], _distances(wide[:, half:], c2)[0]):
        if held >= wanted:
            break
        if counts[cell]:
            found.append(cell)
            held += counts[cell]
    return found


def _calibrated(rows: np.ndarray, largest: float, model: Centroids, k: int, recall: float) -> float:
    """The share of entries that the cells of the neighbours of up to 200 sample queries take, at the wanted recall."""
    counts, own = np.bincount(c := _cells(rows, largest, model), minlength=len(model[0]) * len(model[1])), c
    needs = []
    for i in range(0, len(rows), max(1, len(rows) // 200)):
        scores = rows @ rows[i]
        scores[i] = -np.inf
        order = _taken(rows[i], model, counts, np.inf)
        before = dict(zip(order, np.cumsum([counts[c] for c in order])))
        needs += [before[own[j]] / len(rows) for j in np.argsort(-scores)[: min(k, len(rows) - 1)]]
    return float(np.quantile(needs, recall)) if needs else 1.0


def _sound(df: DataFrame) -> DataFrame:
    """vec_id, v: one row a vec_id that takes part; of several different vectors of one id the smallest in array order."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    one = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    return one.where(F.forall("v", fine) & F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float | None = None, recall: float = 0.95, sample: int = 20_000, group_rows: int = 8_192, block_rows: int = 2_048) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors for each row of queries (both: vec_id, embedding)."""
    have, asked = durable(_sound(vectors), "vectors"), durable(_sound(queries), "queries")
    lengths = [r["d"] for r in asked.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]  # as many as there are vector lengths
    of = lambda df, d: df.where(F.size("v") == d)
    parts = [_search(of(have, d), of(asked, d), d, k, share, recall, sample, group_rows, block_rows) for d in lengths]
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")


def _search(vectors: DataFrame, asked: DataFrame, length: int, k: int, share: float | None, recall: float, sample: int, group_rows: int, block_rows: int) -> DataFrame | None:
    """search among vectors (vec_id, v) of one length."""
    spark = vectors.sparkSession
    limited = vectors.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    entries = durable(limited.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    stats = entries.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("largest")).first()
    n, largest = stats["n"], stats["largest"]
    if not n:
        return None

    fitted = np.array(entries.orderBy(F.xxhash64("v"), "v").limit(sample).toPandas()["v"].tolist())
    per_half = int(min(256, len(fitted), max(1, np.ceil(np.sqrt(n / 16)))))
    half = length // 2 or 1
    wide = _extended(fitted, largest)
    model = (_kmeans(wide[:, :half], per_half), _kmeans(wide[:, half:], per_half), half)
    share = _calibrated(fitted, largest, model, k, recall) if share is None else share

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield rows.assign(cell=_cells(np.array(rows["v"].tolist()), largest, model))

    def dealt(rows: DataFrame, schema: str, label: str, size: int, name: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """The rows with their cell, and with the part of about ``size`` rows that neighbouring cells share; a crowded cell has several."""
        held = durable(rows.mapInPandas(assign, schema), label)
        counts = np.zeros(per_half * per_half, np.int64)
        for r in held.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most 65,536 cells
            counts[r["cell"]] = r["n"]
        before = np.cumsum(counts) - counts
        cells = spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(counts)), "before": before, "held": counts}))
        within = F.pmod(F.xxhash64("v"), F.lit(1 << 40)) / float(1 << 40)
        part = F.floor((F.col("before") + within * F.col("held")) / size).alias(name)
        return held.join(F.broadcast(cells), "cell").select(*held.columns, part), counts, before

    grouped, counts, before = dealt(entries, "v array<double>, ids array<bigint>, cell bigint", "vector-cells", group_rows, "grp")
    blocks, _, _ = dealt(asked, "vec_id bigint, v array<double>, cell bigint", "query-cells", block_rows, "block")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row a query and group that it opens, with its cells there."""
        for rows in batches:
            for query_id, v, block in zip(rows["vec_id"], rows["v"], rows["block"]):
                taken = np.sort(np.array(_taken(np.array(v), model, counts, share * n), np.int64))
                low, high = before[taken] // group_rows, (before[taken] + counts[taken] - 1) // group_rows
                grp = np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high)])
                cell = np.repeat(taken, high - low + 1)
                order = np.argsort(grp, kind="stable")
                starts = np.flatnonzero(np.concatenate(([True], np.diff(grp[order]) > 0)))
                cells = [x.tolist() for x in np.split(cell[order], starts[1:])]
                yield pd.DataFrame({"query_id": query_id, "v": [v] * len(starts), "block": block, "grp": grp[order][starts], "cells": cells})

    # each query walks many cells: a few hundred a task
    tasks = max(spark.sparkContext.defaultParallelism, -(-blocks.count() // 256))
    routed = blocks.drop("cell").repartition(tasks, "vec_id").mapInPandas(route, "query_id bigint, v array<double>, block bigint, grp bigint, cells array<bigint>")
    routed = durable(routed, "vector-routes")
    # an entry goes to the blocks whose queries open its group, and to no other
    opened_by = routed.select(F.col("grp").alias("g"), F.col("block").alias("to")).distinct()
    spread = grouped.join(opened_by, F.col("grp") == F.col("g")).select("v", "ids", "cell", "grp", F.col("to").alias("block"))

    def score(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "ids": [], "score": []}
        if len(ask) and len(have):
            x = np.array(have["v"].tolist())
            local, cell = np.unique(have["cell"].to_numpy(), return_inverse=True)
            for at in range(0, len(ask), 512):
                part = ask.iloc[at : at + 512]
                q = np.array(part["v"].tolist())
                opened = np.array([np.isin(local, c) for c in part["cells"]])[:, cell]
                scores = np.where(opened, q @ x.T, -np.inf)
                top = np.argpartition(-scores, min(k, len(x) - 1), axis=1)[:, : k + 1]
                # whatever equals the last one taken may hold a smaller id
                least = np.take_along_axis(scores, top, 1).min(1)
                for i, j in zip(*np.nonzero((scores >= least[:, None]) & opened)):
                    out["query_id"].append(part["query_id"].iloc[i])
                    out["ids"].append(have["ids"].iloc[j])
                    out["score"].append(float((q[i] * x[j]).sum()))
        return pd.DataFrame(out)

    found = routed.groupBy("grp", "block").cogroup(spread.groupBy("grp", "block")).applyInPandas(score, "query_id bigint, ids array<bigint>, score double")
    found = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
