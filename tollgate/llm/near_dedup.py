"""Near-duplicate components by HyperMinHash banding, verified on full shingle sets.

1. Every text becomes its set of hashed k-word shingles, in numpy over Arrow batches. Equal sets are one class: copies
   are never compared. A class goes by a number drawn from its set, so neither a null doc_id nor one id of two texts
   loses or joins classes; one row of it, that of the smallest doc_id, is read again.
2. A set's HyperMinHash has ``REGISTERS`` buckets; each keeps the leading-zero count and ``MANTISSA`` bits of its smallest
   hash in 16 bits. Empty buckets borrow from others in a fixed order. Bands of four registers are join keys; the chance
   that a pair of similarity s shares none of the 32 bands is (1 - s^4)^32: below 1e-10 at 0.85, 1e-7 at 0.8.
3. Classes that share a band key are tied to the key's smallest member (a star, never all pairs), and components of
   those stars are candidates: no link leaves one.
4. Inside a candidate component, a collision-corrected estimate of the Jaccard similarity from the registers rules pairs
   out, and the full sets confirm the rest by integer arithmetic. Small components are one group each. Large ones grow
   from pivots in rounds (``_large_links``): each block of open classes meets a few members of the component's largest
   cluster, what links joins it, and blocks of what is left meet the others only where rounds stop helping. A group
   returns a spanning forest of its links.
5. Connected components of the confirmed links give each class, and so each document, its component.

Defined cases: null texts and texts without a word have an empty set and are linked with nothing; fewer than k words
are one shingle; repeated rows are copies; a component's label is its smallest doc_id that isn't null, and its kept rows
have that id and one text (of components without any id the one of the smallest text key); extra columns are not read; an empty table gives an empty result. Component
labels spread by a join and an aggregate a round through tables in the shared folder, so lost executors cost one round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

REGISTERS, PER_BAND, MANTISSA = 128, 4, 10
BANDS = REGISTERS // PER_BAND
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text."""
    raw = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    if not len(raw):
        return np.empty(0, np.uint64)
    word = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        # a word's hash: the sum of its mixed bytes times falling powers, from running sums over 8-byte windows
        value = _mix(raw.astype(np.uint64) + np.uint64(1))
        power = np.multiply.accumulate(np.full(int((ends - starts).max()) + 1, _BASE, np.uint64))
        within = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else None
        if within is None:
            lead = int(starts[0])
            within = np.concatenate((np.zeros(lead, np.int64), np.arange(lead, len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))))
        inside = word[1:-1]
        terms = np.where(inside, value * power[np.minimum(within, len(power) - 1)], np.uint64(0))
        sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(terms)))
        words = _mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))
        k = min(k, len(words))
        n = len(words) - k + 1
        acc = np.full(n, np.uint64(k))
        for i in range(k):
            acc = _mix(acc * _BASE + words[i : i + n])
    return np.unique(acc)


def _orders() -> np.ndarray:
    """For each register, the registers it borrows from when empty, in order."""
    return np.array([np.random.default_rng(j).permutation(REGISTERS) for j in range(REGISTERS)])


def registers(s: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The set's registers: 16 bits of leading zeros and mantissa of each bucket's smallest hash."""
    bucket = (s >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))  # s is sorted
    rest = (s[first] << np.uint64(7)) | np.uint64(64)
    zeros = 63 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)
    zeros = np.clip(zeros, 0, 57)
    mantissa = ((rest << zeros.astype(np.uint64)) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out = np.full(REGISTERS, -1, np.int64)
    out[bucket[first]] = (zeros << MANTISSA) | mantissa.astype(np.int64)
    empty = np.flatnonzero(out < 0)
    if len(empty):
        tried = out[orders[empty]]
        out[empty] = tried[np.arange(len(empty)), (tried >= 0).argmax(1)]
    return out.astype(np.uint16)


def band_keys(r: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        acc = np.arange(BANDS, dtype=np.uint64)
        for i in range(PER_BAND):
            acc = _mix(acc * _BASE + r.reshape(BANDS, PER_BAND)[:, i].astype(np.uint64) + np.uint64(1))
    return acc.astype(np.int64)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of every row of a against every row of b: equal registers, less those equal by accident.

    Two unrelated registers agree if their leading-zero counts and mantissas do: sum over z of 4^-(z+1) * 2^-MANTISSA.
    """
    accident = (1 / 3) * 2.0**-MANTISSA
    same = np.empty((len(a), len(b)), np.float32)
    for i, row in enumerate(a):
        same[i] = (b == row).mean(1)
    return (same - accident) / (1 - accident)


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        orders = _orders()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(1):
                s = shingles(text.as_py(), k)
                out[0].append(len(s))
                out[1].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                r = registers(s, orders) if len(s) else None
                out[2].append(None if r is None else r.tobytes())
                out[3].append(None if r is None else band_keys(r))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64()))], ["doc_id", "key", "n_shingles", "digest", "registers", "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py(), k).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("comp"), batch.column("registers"), pa.array(found, pa.binary())], ["cls", "comp", "registers", "hashes"])

    return run


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable over edges (a, b); nodes without edges stand alone.

    A round takes each node's smallest label among its neighbours' and then the label of that label.
    """
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = durable(both.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("low"))
        took = labels.join(near, labels["node"] == near["a"]).select("node", "comp", F.least("comp", "low").alias("low"))
        hop = took.select(F.col("node").alias("of"), F.col("low").alias("root"))
        new = durable(took.join(hop, took["low"] == hop["of"]).select("node", (F.col("root") != F.col("comp")).alias("changed"), F.col("root").alias("comp")), "labels")
        labels = new.select("node", "comp")
        if new.where("changed").isEmpty():
            return nodes.join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def links_between(a: pd.DataFrame, b: pd.DataFrame, percent: int, margin: float = 0.3) -> list[tuple[int, int]]:
    """A spanning forest of the confirmed links among the rows of a and b (cls, registers, hashes); a may be b."""
    rows = a if a is b else pd.concat([a, b], ignore_index=True)
    signed = np.stack([np.frombuffer(x, np.uint16) for x in rows["registers"]])
    m, n = len(a), len(rows)
    left, right = (signed, signed) if a is b else (signed[:m], signed[m:])
    maybe = estimated(left, right) >= percent / 100 - margin
    if a is b:
        np.fill_diagonal(maybe, False)
    shift = 0 if a is b else m
    used = np.unique(np.concatenate((np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0)) + shift)))
    if not len(used):
        return []
    sets = {int(i): np.frombuffer(rows["hashes"].iloc[i], np.uint64) for i in used}
    flat = np.concatenate([sets[int(i)] for i in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[int(i)]) for i in used])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # hashes of one set only add to no intersection
    column, owner = column[shared], owner[shared]
    both = np.zeros((len(used), len(used)), np.float64)
    step = max(1, 16_000_000 // len(used))
    if len(column):
        _, column = np.unique(column, return_inverse=True)
        cuts = np.searchsorted(column, np.arange(0, column[-1] + step + 1, step))
        for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
            if y > x:
                table = np.zeros((len(used), int(column[y - 1]) - k * step + 1), np.float32)
                table[owner[x:y], column[x:y] - k * step] = 1
                both += table @ table.T
    size = np.array([len(sets[int(i)]) for i in used])
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    names, forest = rows["cls"].tolist(), []
    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        i, j = int(used[i]), int(used[j])
        p, q = root(i), root(j)
        if p != q:
            parent[p] = q
            forest.append((names[i], names[j]))
    return forest


_EDGE = "a bigint, b bigint"


def _confirm(percent: int):
    def small(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(links_between(rows, rows, percent), columns=["a", "b"]).astype("int64")

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["side"].to_numpy()
        a = rows[side == 0].reset_index(drop=True)
        b = a if not (side == 1).any() else rows[side == 1].reset_index(drop=True)
        return pd.DataFrame(links_between(a, b, percent), columns=["a", "b"]).astype("int64")

    return small, pair


def text_key(text: Column) -> Column:
    """Tells texts of one doc_id, or without any, apart."""
    return F.xxhash64(text.cast("string"))


def _numbered(classes: DataFrame) -> DataFrame:
    """Adds cls, a 64-bit number of the digest; should two digests meet, all are drawn anew."""
    salt = 0
    while True:
        found = durable(classes.withColumn("cls", F.xxhash64("digest", F.lit(salt))), "near-classes")
        if found.groupBy("cls").count().where("count > 1").isEmpty():
            return found
        salt += 1


def _stars(classes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all classes of a band key: each class to the smallest of its keys' heads, and its other
    heads to that one. A key's head is its smallest class. Copies share most heads, so a hot key adds an edge a class.
    """
    banded = classes.select("cls", F.explode("bands").alias("key"))
    heads = banded.groupBy("key").agg(F.min("cls").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    mine = banded.join(heads, "key").groupBy("cls").agg(F.collect_set("head").alias("heads"))  # at most a head a band
    low = F.array_min("heads")
    return mine.select(F.explode(F.array_union("heads", F.array("cls"))).alias("a"), low.alias("b")).where("a != b").distinct()


def _blocked(rows: DataFrame, block: int) -> DataFrame:
    """Adds parts and blk: the rows of a comp in blocks of about ``block``."""
    sizes = rows.groupBy("comp").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    return rows.join(sizes, "comp").withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))


def _large_links(large: DataFrame, pair, block: int, pivots: int) -> DataFrame:
    """A set of confirmed links that connects whatever is linked in each large candidate component.

    A round deals the open classes to blocks; every block meets the same few pivots, and the links found join classes
    to clusters. Two classes of one cluster need no further test, so only classes outside their component's largest
    cluster stay open, and the next round's pivots come from that cluster. Where rounds stop helping, blocks of what is
    still open meet each other and the blocks of the largest cluster, so that no link between clusters is missed.
    """
    nodes = large.select(F.col("cls").alias("node"))
    rest, main, links, turn, before = large, large, None, 0, None
    while True:
        nth = F.row_number().over(W.partitionBy("comp").orderBy(F.xxhash64("cls", F.lit(turn)), "cls"))
        chosen = main.withColumn("nth", nth).where(F.col("nth") <= pivots).drop("nth")
        dealt = durable(_blocked(rest, block), "near-open")
        blocks = dealt.select("comp", "blk").distinct()
        sides = dealt.select("comp", "blk", "cls", "registers", "hashes", F.lit(1).alias("side")).unionByName(chosen.join(blocks, "comp").select("comp", "blk", "cls", "registers", "hashes", F.lit(0).alias("side")))
        new = sides.groupBy("comp", "blk").applyInPandas(pair, _EDGE)
        links = durable(new if links is None else new.unionByName(links), "near-round")
        clustered = large.join(components(nodes, links).withColumnRenamed("comp", "cluster"), F.col("cls") == F.col("node")).drop("node")
        counted = clustered.groupBy("comp", "cluster").agg(F.count("*").alias("n")).groupBy("comp").agg(F.max(F.struct("n", "cluster"))["cluster"].alias("largest"))
        placed = durable(clustered.join(counted, "comp").withColumn("open", F.col("cluster") != F.col("largest")).drop("cluster", "largest"), "near-clusters")
        rest, main = placed.where("open").drop("open"), placed.where("not open").drop("open")
        left = rest.count()
        if not left:
            return links
        if before is not None and 2 * left > before:
            break
        turn, before = turn + 1, left
    half = block // 2
    o, d = _blocked(rest, half), _blocked(main, half)
    others, firsts = o.select("comp", F.col("parts").alias("of")).distinct(), d.select("comp", F.col("parts").alias("of")).distinct()
    to = lambda rows, pairs: rows.withColumn("to", F.explode(F.expr(pairs)))
    paired = (
        to(o, "transform(sequence(blk, parts - 1), x -> struct(blk as l, x as r, 'o' as kind, 0 as side))"),
        to(o.where("blk > 0"), "transform(sequence(0, blk - 1), x -> struct(x as l, blk as r, 'o' as kind, 1 as side))"),
        to(o.join(firsts, "comp"), "transform(sequence(0, of - 1), x -> struct(blk as l, x as r, 'd' as kind, 0 as side))"),
        to(d.join(others, "comp"), "transform(sequence(0, of - 1), x -> struct(x as l, blk as r, 'd' as kind, 1 as side))"),
    )
    every = reduce(DataFrame.unionByName, (p.select("cls", "registers", "hashes", "comp", "to.l", "to.r", "to.kind", "to.side") for p in paired))
    return links.unionByName(every.groupBy("comp", "l", "r", "kind").applyInPandas(pair, _EDGE))


def near_components(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 384, pivots: int = 32) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept for every row of docs (doc_id, text)."""
    return keyed_components(docs, k, percent, block, pivots).drop("key")


def keyed_components(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 384, pivots: int = 32) -> DataFrame:
    """The columns of near_components and the text's key, which names a row together with doc_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("key"))
    signed = durable(texts.mapInArrow(_signed(k), "doc_id bigint, key bigint, n_shingles bigint, digest binary, registers binary, bands array<bigint>"), "near-signed")
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key", "registers", "bands")).alias("c"))
    classes = _numbered(classes.select("digest", F.struct("c.unnamed", "c.doc_id", "c.key").alias("row"), "c.registers", "c.bands"))

    stars = _stars(classes)
    candidates = components(classes.select(F.col("cls").alias("node")), stars)
    sizes = candidates.groupBy("comp").agg(F.count("*").alias("members")).where("members > 1")
    members = durable(candidates.join(sizes, "comp").select(F.col("node").alias("cls"), "comp", "members").join(classes.select("cls", "registers", "row"), "cls"), "near-members")
    rows = members.select("cls", "comp", "registers", F.col("row.doc_id").alias("id__"), F.col("row.key").alias("key__"))
    read = texts.join(rows, texts["doc_id"].eqNullSafe(rows["id__"]) & (texts["key"] == rows["key__"]))
    read = read.select("cls", "comp", "registers", "text").dropDuplicates(["cls"]).mapInArrow(_sets(k), "cls bigint, comp bigint, registers binary, hashes binary")
    full = durable(read.join(members.select("cls", "members"), "cls"), "near-sets")

    small, pair = _confirm(percent)
    links = full.where(F.col("members") <= block).groupBy("comp").applyInPandas(small, _EDGE)
    large = full.where(F.col("members") > block).drop("members")
    if not large.isEmpty():
        links = links.unionByName(_large_links(large, pair, block, pivots))
    found = components(classes.select(F.col("cls").alias("node")), durable(links, "near-links"))
    named = classes.select("digest", "cls", "row").join(found, F.col("cls") == F.col("node")).select("digest", "row", "comp")
    roots = named.groupBy("comp").agg(F.min("row").alias("root"))
    out = signed.select("doc_id", "key", "n_shingles", "digest").join(named.join(roots, "comp").select("digest", "root"), "digest", "left")
    first = F.col("root.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("root.key") == F.col("key"))
    return out.select("doc_id", "key", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("root.doc_id")).alias("component_id"), (F.col("root").isNull() | first).alias("kept"))
