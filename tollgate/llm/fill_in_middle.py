"""Fill-in-middle: texts cut at two line ends into prefix, middle and suffix, and put in another order.

The line ends of a text are byte offsets in a set laid out like a Roaring bitmap (``BoundarySet``): offsets share a
container by their upper 16 bits, a container is an array, a bitmap or a list of runs, whichever is smallest, and the
cumulative cardinalities of the containers find the one that holds the k-th end by binary search; a select inside it
gives the offset. Python workers find the cuts of Arrow batches; Spark builds the outputs and takes them apart again.

Defined cases: null and empty texts are plain and empty, with n = 0; a text that holds one of the three marks is plain,
whatever it was drawn; a null doc_id draws like an empty one; both cuts may fall on the same end (an empty middle), on
0 or behind the last line; equal rows give equal rows; columns other than doc_id and text aren't read; texts of any
length are read whole, and a worker holds a batch of them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_BITS = 16


class ArrayContainer:
    """Sorted 16-bit values as they are."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """65,536 bits in words of 64, with the bits set before each word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << _BITS, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        word, left = int(self.words[at]), k - int(self.before[at])
        for _ in range(left):
            word &= word - 1
        return at * 64 + (word & -word).bit_length() - 1


class RunContainer:
    """Runs of consecutive values: first value of each, with the values before each."""

    def __init__(self, first: np.ndarray, before: np.ndarray):
        self.first, self.before = first.astype(np.uint16), before

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[at]) + k - int(self.before[at])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest layout of sorted distinct values below 65,536."""
    begins = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    sizes = {"array": 2 * len(low), "bitmap": 1 << _BITS - 3, "runs": 4 * len(begins)}
    kind = min(sizes, key=sizes.get)
    return ArrayContainer(low) if kind == "array" else BitmapContainer(low) if kind == "bitmap" else RunContainer(low[begins], begins)


class BoundarySet:
    """Sorted distinct offsets in containers by their upper bits, with cumulative cardinalities."""

    def __init__(self, offsets: np.ndarray):
        upper = offsets >> _BITS
        self.before = np.flatnonzero(np.diff(upper, prepend=-1))
        self.upper = upper[self.before]
        self.containers = [container(x & (1 << _BITS) - 1) for x in np.split(offsets, self.before[1:])] if len(offsets) else []

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.upper[at]) << _BITS) + self.containers[at].select(k - int(self.before[at]))


def line_ends(raw: np.ndarray) -> np.ndarray:
    """Offsets behind every line of a text's bytes; the last line may do without its line feed."""
    ends = np.flatnonzero(raw == 10) + 1
    return np.append(ends, len(raw)) if len(raw) and raw[-1] != 10 else ends


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = len(batch)
        n, first, second = (np.zeros(rows, np.int64) for _ in range(3))
        h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        for i, raw in enumerate(batch.column("raw")):
            ends = line_ends(np.frombuffer(raw.as_buffer(), np.uint8)) if raw.as_buffer().size else np.zeros(0, np.int64)
            n[i] = len(ends)
            low, high = sorted((h1[i] % (n[i] + 1), h2[i] % (n[i] + 1)))
            if high:
                ends = BoundarySet(ends)
                first[i], second[i] = ends.select(low - 1) if low else 0, ends.select(high - 1)
        kept = [batch.column(c) for c in ("doc_id", "raw", "h3", "h4")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(n), pa.array(first), pa.array(second)], ["doc_id", "raw", "h3", "h4", "n", "first", "second"])


def transform(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """doc_id, n (lines), form, prefix, middle, suffix (null if plain) and output of every document.

    ``percent`` of the documents are cut, and ``spm_percent`` of those have their suffix first; draws are digests of seed
    and doc_id, so reruns agree.
    """
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(drawn, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"), *groups)
    cut = texts.mapInArrow(_cuts, "doc_id bigint, raw binary, h3 bigint, h4 bigint, n bigint, first bigint, second bigint")

    text, first, second = F.col("raw").cast("string"), F.col("first").cast("int"), F.col("second").cast("int")
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (F.col("n") == 0) | marked | (F.col("h3") % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    part = lambda at, size: F.when(F.col("form") != "plain", F.substr("raw", at, size).cast("string"))
    cut = cut.withColumn("form", form).select(
        "doc_id", "n", "form", text.alias("text"),
        part(F.lit(1), first).alias("prefix"), part(first + 1, second - first).alias("middle"), part(second + 1, F.octet_length("raw") - second).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return cut.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(form: Column, output: Column) -> Column:
    """The text, from output and form alone: a cut text holds no mark of its own, so the marks part it in four."""
    parts = F.split(output, "<[PSM]>", -1)
    at = lambda i: F.get(parts, i)
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))
