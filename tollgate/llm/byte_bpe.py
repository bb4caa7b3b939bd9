"""Byte-level BPE: the merges are folds of Spark's higher-order functions over the distinct words of blocks of documents.

Three steps in one narrow stage, without a shuffle:

1. ``_split`` (Arrow) cuts texts by the tokenizer's pattern and numbers a partition's distinct pieces; each block of
   documents carries the pieces that are new, so that a piece is merged once and not once an occurrence.
2. ``merged`` (Spark) folds the ranked merges over each piece's byte tokens. The rank map is a literal: a map literal is
   searched from end to end, so it is laid out as a perfect hash of token pairs in two literal arrays, and a lookup
   costs the same for any pair.
3. ``_join`` (Arrow) writes every document's ids from its pieces' ids, and decodes the ids again by concatenating the
   binary pieces they stand for.

A block ends at the first document that brings it to ``block_bytes`` of text. Once a partition's distinct pieces take
``MOST_BYTES``, the numbering starts anew, which repeats merges but changes no result; so memory is bounded by these two
and by the longest text. Texts are read whole.

A fold looks at a whole piece at every merge, so it is for words. Pieces above ``LONG`` bytes (runs of letters, blanks or
signs without a break) merge in rounds instead: all places of the lowest rank at once, in a pass of numpy (``merged_long``).

Defined cases: null and empty texts have no ids and decode to nothing; repeated rows give equal rows; columns other than
``doc_id`` and ``text`` are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Primes whose product exceeds every pair key (left << 16 | right), so two keys never agree in both remainders.
BUCKETS, SLOTS = 65_537, 131_071
NO_RANK = 1 << 16
MOST_BYTES = 128 << 20
LONG = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte string to rank, from a file of base64 pieces and ranks; every rank is below 65,536."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """left << 16 | right to the rank of both joined, for every pair of tokens that joins to a token."""
    found = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                found[left << 16 | right] = rank
    return found


def perfect_hash(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """shift and slots: key's slot is (key % SLOTS + shift[key % BUCKETS]) % SLOTS and holds key << 16 | rank."""
    buckets: dict[int, list[int]] = {}
    for key in pairs:
        buckets.setdefault(key % BUCKETS, []).append(key)
    shift, slots = [0] * BUCKETS, [0] * SLOTS
    for bucket, keys in sorted(buckets.items(), key=lambda x: -len(x[1])):
        tries = ((bucket * 7919 + d) % SLOTS for d in range(SLOTS))  # spread, so that few are taken
        by = next(d for d in tries if not any(slots[(k + d) % SLOTS] for k in keys))
        shift[bucket] = by
        for k in keys:
            slots[(k + by) % SLOTS] = k << 16 | pairs[k]
    return shift, slots


def rank_tables(tables: tuple[np.ndarray, np.ndarray]) -> Column:
    """The literal rank map: struct of the two arrays of the perfect hash."""
    shift, slots = tables
    literal = lambda xs: F.split(F.lit(",".join(map(str, xs.tolist()))), ",").cast("array<bigint>")
    return F.struct(literal(shift).alias("shift"), literal(slots).alias("slots"))


def merged(tokens: Column, tables: Column) -> Column:
    """The ids of one piece from its byte tokens (array<bigint>): always the leftmost of the lowest-ranked pairs is joined."""
    none = F.array().cast("array<bigint>")

    def rank(left: Column, right: Column) -> Column:
        """The pair's rank; whatever has none gets NO_RANK or more, as the slot then holds another key's upper bits."""
        key = F.shiftleft(left, 16).bitwiseOR(right)
        return F.get(tables["slots"], ((key % SLOTS + F.get(tables["shift"], (key % BUCKETS).cast("int"))) % SLOTS).cast("int")).bitwiseXOR(F.shiftleft(key, 16))

    def step(s: Column, _: Column) -> Column:
        ids, pairs = s["ids"], s["pairs"]

        def join(at: Column) -> Column:
            m = F.get(pairs, at - 1)
            before = F.when(at > 1, F.concat(F.slice(pairs, F.lit(1), at - 2), F.array(rank(F.get(ids, at - 2), m)))).otherwise(none)
            after = F.when(at < F.size(pairs), F.concat(F.array(rank(m, F.get(ids, at + 1))), F.slice(pairs, at + 2, F.size(pairs)))).otherwise(none)
            new = F.concat(F.slice(ids, F.lit(1), at - 1), F.array(m), F.slice(ids, at + 2, F.size(ids)))
            return F.when(m < NO_RANK, F.struct(new.alias("ids"), F.concat(before, after).alias("pairs"))).otherwise(F.struct(ids.alias("ids"), none.alias("pairs")))

        # no pairs are left once nothing can be joined
        return F.when(F.size(pairs) == 0, s).otherwise(let(F.array_position(pairs, F.array_min(pairs)).cast("int"), join))

    def fold(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: rank(F.get(t, i), F.get(t, i + 1)))
        start = F.struct(t.alias("ids"), pairs.alias("pairs"))
        return F.aggregate(F.sequence(F.lit(2), F.size(t)), start, step, lambda s: s["ids"])

    return F.when(F.size(tokens) < 2, tokens).otherwise(fold(tokens))


def merged_long(tokens: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of one piece of any length: like merged, but every place of the lowest rank is joined in one pass.

    That is the same as one by one from the left, unless a join makes a pair of a lower rank still; then only the first
    place is joined.
    """
    shift, slots = tables

    def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 16 | right
        return slots[(key % SLOTS + shift[key % BUCKETS]) % SLOTS] ^ key << 16

    ids = tokens.astype(np.int64)
    pairs = ranks(ids[:-1], ids[1:])
    while len(pairs) and (m := int(pairs.min())) < NO_RANK:
        at = np.flatnonzero(pairs == m)
        # of places side by side every other one counts, from the left
        run = np.concatenate(([True], np.diff(at) > 1))
        nth = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
        at = at[nth % 2 == 0]

        def joined(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
            new = ids.copy()
            new[at] = m
            new = np.delete(new, at + 1)
            where = at - np.arange(len(at))
            changed = np.unique(np.concatenate((where - 1, where)))
            changed = changed[(changed >= 0) & (changed < len(new) - 1)]
            kept = np.delete(pairs, at)  # the pair that went; those beside it are worked out again
            kept[changed] = ranks(new[changed], new[changed + 1])
            # also what stood there before the neighbour was joined too
            one = at[at > 0], at[at + 2 < len(ids)]
            beside = np.concatenate((kept[changed], ranks(ids[one[0] - 1], np.full(len(one[0]), m)), ranks(np.full(len(one[1]), m), ids[one[1] + 2])))
            return new, kept, int(beside.min()) if len(beside) else NO_RANK

        new, kept, low = joined(at)
        if low < m and len(at) > 1:
            new, kept, _ = joined(at[:1])
        ids, pairs = new, kept
    return ids


_BLOCK = "ids array<bigint>, counts array<int>, codes binary, known bigint, pieces array<array<bigint>>"


def _split(pattern: str, byte_tokens: list[int], tables: tuple[np.ndarray, np.ndarray], block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, tokens = regex.compile(pattern).findall, np.array(byte_tokens, np.int64)

        class Numbers(dict):
            held = 0

            def __missing__(self, piece):
                self[piece] = n = len(self)
                raw = piece.encode()
                if len(raw) > LONG:
                    long[len(new)] = merged_long(tokens[np.frombuffer(raw, np.uint8)], tables)
                new.append(raw)
                self.held += len(raw) + 150  # about what the entry takes
                return n

        def block() -> pa.RecordBatch:
            flat, sizes = tokens[np.frombuffer(b"".join(new), np.uint8)], list(map(len, new))
            if long:  # these are merged already, and merging them again changes nothing
                cuts = np.cumsum(sizes)[:-1]
                parts = [long.get(i, x) for i, x in enumerate(np.split(flat, cuts))]
                flat, sizes = np.concatenate(parts), list(map(len, parts))
            ends = np.cumsum([0, *sizes], dtype=np.int32)
            inner = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            outer = pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner)
            columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([np.concatenate(codes).tobytes()], pa.binary()), pa.array([len(pieces) - len(new)]), outer]
            return pa.RecordBatch.from_arrays(columns, ["ids", "counts", "codes", "known", "pieces"])

        ids, counts, codes, new, long, pieces, size = [], [], [], [], {}, Numbers(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                found = np.array([pieces[p] for p in find(text)], np.int32)
                ids.append(doc_id.as_py())
                counts.append(len(found))
                codes.append(found)
                size += len(text)
                if size >= block_bytes:
                    yield block()
                    ids, counts, codes, size = [], [], [], 0
                    new.clear()
                    long.clear()
                    if pieces.held > MOST_BYTES:
                        pieces = Numbers()
        if ids:
            yield block()

    return run


def _join(tokens: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, flat = np.zeros(1, np.int64), np.empty(0, np.int32)
        for batch in batches:
            for row in range(batch.num_rows):
                counts, codes = batch.column("counts")[row].values.to_numpy(), np.frombuffer(batch.column("codes")[row].as_py(), np.int32)
                inner = batch.column("pieces")[row].values
                new, own = inner.offsets.to_numpy().astype(np.int64), inner.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                new = new - new[0] if len(new) else np.zeros(1, np.int64)
                if batch.column("known")[row].as_py() == 0:
                    starts, flat = new, own
                else:
                    starts, flat = np.concatenate((starts, starts[-1] + new[1:])), np.concatenate((flat, own))
                doc_ids, at, out, held = batch.column("ids")[row].values, 0, ([], [], []), 0
                for k, n in enumerate(counts):
                    code = codes[at : at + n]
                    at += n
                    first, lengths = starts[code], starts[code + 1] - starts[code]
                    ends = np.cumsum(lengths)
                    total = int(ends[-1]) if n else 0
                    mine = flat[np.repeat(first - (ends - lengths), lengths) + np.arange(total)] if n else flat[:0]
                    for to, x in zip(out, (total, mine.astype("<u4").tobytes(), b"".join([tokens[i] for i in mine.tolist()])), strict=True):
                        to.append(x)
                    held += 5 * total
                    if held > 8_000_000 or k + 1 == len(counts):
                        own = doc_ids[k + 1 - len(out[0]) : k + 1]
                        yield pa.RecordBatch.from_arrays([own, pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])
                        out, held = ([], [], []), 0

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (the ids' bytes) of every document."""
    byte_tokens = [ranks[bytes([b])] for b in range(256)]
    tokens = [piece for piece, _ in sorted(ranks.items(), key=lambda x: x[1])]
    tables = tuple(np.array(x, np.int64) for x in perfect_hash(pair_ranks(ranks)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = texts.mapInArrow(_split(pattern, byte_tokens, tables, block_bytes), _BLOCK)
    # bound once, as every further place in the plan would hold a copy of the tables
    merges = blocks.withColumn("pieces", let(rank_tables(tables), lambda t: F.transform("pieces", lambda p: merged(p, t))))
    return merges.mapInArrow(_join(tokens), "doc_id bigint, n_tokens bigint, ids binary, decoded binary")
