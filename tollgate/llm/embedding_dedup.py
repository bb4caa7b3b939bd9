"""Near-duplicate vectors of one label: int8 products of tiles, with error bounds that leave only doubtful pairs to doubles.

1. Equal vectors of one label are one class with a count of its copies; copies are never compared.
2. The classes of a label (and of one vector length) are dealt into blocks by a hash. A block is packed into one row: the
   unit vectors as 8-bit integers with a scale each, the exact length of what rounding took from each, and the vectors
   themselves.
3. Two blocks meet once. Tile by tile the integer products are worked out (sums of such products are exact in single
   precision up to 1,040 components, so the matrix product of floats is the integer one). If x and y are unit vectors, x', y' their
   rounded forms and a, b the lengths of x - x' and y - y', then |xy - x'y'| <= a + b + ab. Pairs beyond doubt are links
   or none; only the others are worked out from the vectors in double precision.
4. A meeting returns one row per class linked in it: the vectors it is linked with, and the smallest member it is tied
   to inside the meeting. Links are counted and never listed, so a crowd of near copies costs no row a pair.
5. Connected components over those ties give each vector its component.

All pairs of blocks of a label meet, so the arithmetic grows with the square of a label's distinct vectors, and what is
shuffled with that square over ``block_rows``: no bound on unstructured vectors excludes pairs at this threshold safely.

Defined cases: rows of one vec_id are one vector, the smallest sound one in (label, vector) order; vectors that are null, zero or hold
null or non-finite components and rows without a label link with nothing and stand alone; vectors of different length
don't link; rows without a vec_id are one row that links with nothing, is its own (null) component and is kept; pairs at
exactly the threshold are links; a label may hold any share of the rows; other columns aren't read; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import durable
from .near_dedup import components

#: Most by which sums in single or double precision may miss a cosine.
SLACK = 1e-5
_PACKED = "label string, d int, blk int, ids binary, copies binary, ints binary, scales binary, errors binary, vectors binary"


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit integers, scales and error lengths of the unit vectors of v's rows."""
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    scales = np.abs(unit).max(1) / 127
    ints = np.rint(unit / scales[:, None]).astype(np.int8)
    return ints, scales, np.sqrt(((unit - ints * scales[:, None]) ** 2).sum(1))


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows by a power of two, so that no square overflows or vanishes; cosines stay what they are."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    label, d, blk = (x.as_py() for x in key)
    v = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    ints, scales, errors = quantised(_scaled(v.astype(float)))
    whole = lambda c: rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    held = {"label": [label], "d": pa.array([d], pa.int32()), "blk": pa.array([blk], pa.int32()), "ids": [whole("rep").tobytes()], "copies": [whole("copies").tobytes()]}
    return pa.table(held | {"ints": [ints.tobytes()], "scales": [scales.tobytes()], "errors": [errors.tobytes()], "vectors": [v.tobytes()]})


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of two 8-bit matrices."""
    part = 1024
    if a.shape[1] <= part:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum((a[:, i : i + part].astype(np.float32) @ b[:, i : i + part].astype(np.float32).T).astype(np.float64) for i in range(0, a.shape[1], part))


class Block:
    """Unpacked rows of one block, or of two that meet."""

    def __init__(self, rows: list[dict]):
        d, read = rows[0]["d"], lambda c, t: np.concatenate([np.frombuffer(r[c], t) for r in rows])
        self.ids, self.copies, self.scales, self.errors = read("ids", np.int64), read("copies", np.int64), read("scales", float), read("errors", float)
        kind = np.float32 if len(rows[0]["vectors"]) == len(rows[0]["ints"]) * 4 else float
        self.ints, self.v = read("ints", np.int8).reshape(-1, d), _scaled(read("vectors", kind).reshape(-1, d).astype(float))
        self.norms = np.sqrt((self.v * self.v).sum(1))


def tile_links(x: Block, p: slice, q: slice, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of rows of p and q whose cosine is least or more, and how many were worked out in double precision."""
    near = products(x.ints[p], x.ints[q]) * x.scales[p].astype(np.float32)[:, None] * x.scales[q].astype(np.float32)
    widest = (1 + x.errors[p].max()) * (1 + x.errors[q].max()) - 1
    i, j = np.nonzero(near >= least - widest - SLACK)
    own = near[i, j].astype(float)
    i, j = i + p.start, j + q.start
    once = i < j
    i, j, own = i[once], j[once], own[once]
    bound = (1 + x.errors[i]) * (1 + x.errors[j]) - 1 + SLACK
    link = own - bound >= least
    doubt = np.flatnonzero(~link & (own + bound >= least))
    for at in range(0, len(doubt), 65_536):
        of = doubt[at : at + 65_536]
        link[of] = np.einsum("ij,ij->i", x.v[i[of]], x.v[j[of]]) / (x.norms[i[of]] * x.norms[j[of]]) >= least
    return i[link], j[link], len(doubt)


def _tie(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """roots[x] becomes the smallest member of x's component once the pairs (i, j) are joined; roots of roots are themselves."""
    while True:
        a, b = roots[i], roots[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while (roots[roots] != roots).any():
            roots[:] = roots[roots]


def _meet(least: float, tile: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        packed = sorted(rows.select(["d", "blk", "ids", "copies", "ints", "scales", "errors", "vectors"]).to_pylist(), key=lambda r: r["blk"])
        x, first = Block(packed), len(packed[0]["ids"]) // 8
        alone = len(packed) == 1
        order = np.argsort(x.ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        links, roots = np.zeros(len(x.ids), np.int64), np.arange(len(x.ids))  # roots by rank of id
        for p in range(0, first, tile):
            for q in range(p if alone else first, len(x.ids), tile):
                i, j, _ = tile_links(x, slice(p, min(p + tile, first)), slice(q, min(q + tile, len(x.ids))), least)
                np.add.at(links, i, x.copies[j])
                np.add.at(links, j, x.copies[i])
                _tie(roots, place[i], place[j])
        linked = np.flatnonzero(links)
        return pa.table({"rep": x.ids[linked], "root": x.ids[order[roots[place[linked]]]], "links": links[linked]})

    return run


def _vectors(vectors: DataFrame, columns: tuple[str, str, str]) -> DataFrame:
    """vec_id, label, v: a row a vec_id; label and v are null where nothing of it can link."""
    vec_id, embedding, label = columns
    v = F.col(embedding) if vectors.schema[embedding].dataType == ArrayType(FloatType()) else F.col(embedding).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0)
    one = F.when(sound, F.struct(F.col(label).cast("string").alias("label"), v.alias("v")))
    return vectors.groupBy(F.col(vec_id).cast("long").alias("vec_id")).agg(F.min(one).alias("s")).select("vec_id", "s.label", "s.v")


def near_components(vectors: DataFrame, least: float = 0.93, columns: tuple[str, str, str] = ("vec_id", "embedding", "label"), block_rows: int = 8_192, tile: int = 1_024) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable) and kept of every vector."""
    rows = durable(_vectors(vectors, columns), "vectors")
    classes = durable(rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vector-classes")

    # a block holds block_rows rows, or about 8 MB of components if that is less, but 256 rows of any length
    size = F.least(F.lit(block_rows), F.greatest(F.lit(256), F.floor(F.lit(1 << 20) / F.col("d"))))
    sized = classes.withColumn("d", F.size("v"))
    several = sized.groupBy("label", "d").agg(F.count("*").alias("n")).where(F.col("n") > size).select("label", "d", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    # as many rows as there are blocks of 256 rows at most: a few MB for a billion vectors
    dealt = sized.join(F.broadcast(several), ["label", "d"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    packed = dealt.groupBy("label", "d", "blk").applyInArrow(_pack, _PACKED)
    packed = durable(packed.join(F.broadcast(several), ["label", "d"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), "vector-blocks")

    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("low", F.least("blk", "other")).withColumn("high", F.greatest("blk", "other"))
    ties = met.groupBy("label", "d", "low", "high").applyInArrow(_meet(least, tile), "rep bigint, root bigint, links bigint")
    ties = durable(ties, "vector-ties")

    found = components(ties.select(F.col("rep").alias("node")).distinct(), ties.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = ties.groupBy("rep").agg(F.sum("links").alias("links")).join(found, F.col("rep") == F.col("node")).select("rep", "links", "comp")
    told = classes.select("rep", "copies").join(linked, "rep", "left").where("copies > 1 or links > 0")
    told = durable(told.select("rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("comp", "rep").alias("comp")), "vector-links")
    # only vectors with copies are looked for again by what they hold; the others are their class
    copied = rows.join(classes.where("copies > 1").select("label", "v", "rep"), ["label", "v"]).where("vec_id != rep").select(F.col("vec_id").alias("copy"), "rep")
    members = told.select(F.col("rep").alias("member"), "links", "comp").unionByName(copied.join(told, "rep").select(F.col("copy").alias("member"), "links", "comp"))
    whole = rows.select("vec_id").join(members, F.col("vec_id") == F.col("member"), "left")
    component = F.coalesce("comp", "vec_id")
    return whole.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
