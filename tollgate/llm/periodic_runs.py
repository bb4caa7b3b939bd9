"""Periodic runs: stretches of words that repeat with a short period, found by an online sparse diagonal DP.

Words at distance ``lag`` that are equal lie on the diagonal of that lag. A run of smallest period q and length l is a
diagonal of l - q matches in a row, so ``max(6 - q, 3 * q)`` of them make a run. ``diagonals`` reads the words once, from
left to right: each earlier occurrence of the word at an active lag adds one to that lag's match length, and an active lag
without a match ends; a diagonal that was long enough is emitted at once.

Only lags that can still become a run are made active. A run of a lag from 2^k up matches at 3 * 2^k words in a row at
least, so it matches over a whole block of 2^(k+1) words that begins at a multiple of 2^k. ``openings`` therefore looks
for earlier occurrences of the blocks that begin there, by sums of hashed words, at the 2^k lags of the class: as many
comparisons a class as there are words, in numpy, so n log n for any text, also for one word a million times. What the
hashes propose the words themselves confirm. Multiples of a period that cover the same stretch are left out.

Texts are read whole, in chunks of ``CHUNK`` bytes and up; words of a chunk are numbered, and every text ends with a number
of its own that no diagonal crosses.

Defined cases: null and empty texts and texts of white space have no words and no runs and collapse to nothing; equal rows
give equal rows; of two periods over one stretch the smallest counts; overlapping runs each drop what lies behind their
first period; columns other than doc_id and text aren't read; a very long text is a chunk of its own, and memory grows with
the longest; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, LEAST_PERIODS = 6, 4
CHUNK = 4 << 20
Run = tuple[int, int, int]


def needed(lag: int) -> int:
    """Matches in a row that make a run of this period."""
    return max(LEAST_WORDS - lag, (LEAST_PERIODS - 1) * lag)


def diagonals(words: list[int], at: list[int], lags: list[int]) -> Iterator[Run]:
    """(start, end, lag) of every diagonal long enough, as it ends; lags[j] is looked at from word at[j] on, at ascending.

    The last word must be equal to no other.
    """
    lengths: dict[int, int] = {}
    i = j = 0
    while j < len(at) or lengths:
        if not lengths:
            i = at[j]
        while j < len(at) and at[j] == i:
            lag, back = lags[j], i
            j += 1
            if lag not in lengths:
                while back > lag and words[back - 1] == words[back - 1 - lag]:
                    back -= 1
                lengths[lag] = i - back
        word = words[i]
        for lag in [x for x in lengths if words[i - x] != word]:
            length = lengths.pop(lag)
            if length >= needed(lag):
                yield i - length - lag, i, lag
        for lag in lengths:
            lengths[lag] += 1
        i += 1


def openings(blocks: np.ndarray, k: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, lags): a block that begins at a multiple of step and is met again lag words before, for lags 2^k to 2^(k+1) - 1."""
    width, widest = 1 << k, (2 << k) - 1
    own = blocks[::step]
    before = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(widest, blocks.dtype), blocks)), width)[::step][: len(own)]
    row, column = np.nonzero(before == own[:, None])
    at, lag = row * step, widest - column
    inside = at >= lag
    return at[inside], lag[inside]


def _uncovered(at: np.ndarray, lags: np.ndarray, runs: list[Run]) -> np.ndarray:
    """Which openings lie in no known run of a period that divides the lag: there the diagonal is that run again."""
    if not runs or not len(at):
        return np.ones(len(at), bool)
    start, end, period = np.array(sorted(runs), np.int64).T
    far = np.maximum.accumulate(end)
    reaching = np.maximum.accumulate(np.where(end == far, np.arange(len(end)), 0))
    of = np.searchsorted(start, at - lags, "right") - 1
    run = reaching[np.maximum(of, 0)]
    return (of < 0) | (end[run] <= at) | (lags % period[run] != 0)


def find(ids: np.ndarray, longest: int) -> list[Run]:
    """(start, end, period) of every run, by start and period; no text has more than ``longest`` words, each ends with a number of its own."""
    words, runs, size = ids.tolist(), [], 4
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    fold = lambda x, by: x[:-by] * np.uint64(0xBF58476D1CE4E5B9 + 2 * by) + x[by:]
    blocks = fold(fold(mixed, 1), 2) if len(ids) >= 4 else mixed[:0]
    for k in range(max(0, longest // LEAST_PERIODS).bit_length()):
        # blocks of 4 words do for lags 1 to 3
        if k > 1:
            if len(blocks) <= size:
                break
            blocks, size = fold(blocks, size), 2 * size
        at, lags = openings(blocks, k, max(2, 1 << k))
        fresh = _uncovered(at, lags, runs)
        runs += diagonals(words, at[fresh].tolist(), lags[fresh].tolist())
    least: dict[tuple[int, int], int] = {}
    for start, end, period in runs:
        least[start, end] = min(period, least.get((start, end), period))
    return sorted((start, end, period) for (start, end), period in least.items())


def _batch(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    flat: list = []
    for words in texts:
        flat += words
        flat.append(None)
    sizes = np.array([len(words) for words in texts], np.int64)
    base = np.concatenate(([0], np.cumsum(sizes + 1)))
    number = {word: i for i, word in enumerate(dict.fromkeys(flat))}
    numbers = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    numbers[base[1:] - 1] = len(number) + np.arange(len(texts))

    found: list[list[Run]] = [[] for _ in texts]
    runs = find(numbers, int(sizes.max(initial=0)))
    owner = np.searchsorted(base, [r[0] for r in runs], "right") - 1
    for own, (start, end, period) in zip(owner.tolist(), runs, strict=True):
        found[own].append((start - int(base[own]), end - int(base[own]), period))

    collapsed = []
    for words, own in zip(texts, found, strict=True):
        if own:
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, [start + period for start, _, period in own], 1)
            np.add.at(depth, [end for _, end, _ in own], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
        collapsed.append(b" ".join(words))
    structs = [[{"start": s, "length": e - s, "period": p} for s, e, p in own] for own in found]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(structs, kind), pa.array(collapsed, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw"), strict=True):
            raw = raw.as_py()
            ids.append(doc_id)
            texts.append(raw.split())  # parts at just the six ASCII white-space bytes
            held += len(raw)
            if held >= CHUNK:
                yield _batch(ids, texts)
                ids, texts, held = [], [], 0
    if ids:
        yield _batch(ids, texts)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period) and collapsed (words kept, one space between)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))
    found = texts.mapInArrow(_found, "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
