"""Cross-site boilerplate: lines that stand on many sites go, but for their first place.

Every line's sites are counted by a HyperLogLog sketch (``approx_count_distinct``: a fixed few words a line hash that
merge by aggregation). With few sites the sketch counts its non-empty registers, and never more of them than there are
sites: an estimate above ``sure`` proves that the line spreads. Lines at or below it that could still spread (as many
rows as the threshold, more than one site) are near the threshold and get exact distinct counts. So the sketch decides
most lines and the result is exact.

Hot lines: both the sketch and the distinct count are partial aggregates; the join that marks places is a plain
equi-join, whose skewed partitions Spark splits. The first place of a line (smallest doc_id, then position) stays, so a
text that was copied everywhere survives once; a document all of whose lines go is left with an empty text.

Defined cases: a null text stays null, an empty one empty; lines with fewer than ``min_words`` words are never
removed, where every letter of a script without spaces between words counts as a word (the SQL twin, which the given
tables can't tell apart, counts white-space words alone); a null site is a site; repeated rows share their fate; other columns go through unread, whatever their names (but
``n_lines`` and ``n_removed``, which are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, let


#: Letters of scripts without spaces, one by one, or runs of anything else but white space.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_UNIT = rf"(?:[{_UNSPACED}]|[^\x20\x09-\x0D{_UNSPACED}]++)"


def _key(line: Column) -> Column:
    """96 bits of a line's words in lower case, white space alike."""
    norm = F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))
    return F.struct(F.xxhash64(norm).alias("a"), F.hash(norm, F.length(norm)).alias("b"))


def _register_bits(rsd: float) -> int:
    return math.ceil(2 * math.log2(1.106 / rsd))


def spread(lines: DataFrame, min_sites: int, rsd: float) -> DataFrame:
    """k, first: the keys of lines on at least min_sites sites, with their first place; lines has k, site, doc_id, pos."""
    registers = 2 ** _register_bits(rsd)
    if min_sites > registers // 2:
        raise ValueError("the sketch needs more registers for this threshold: lower rsd")
    sure = math.floor(registers * math.log(registers / (registers - (min_sites - 1))) + 0.5)
    sketch = lines.groupBy("k").agg(
        F.approx_count_distinct("site", rsd).alias("about"),
        F.count("*").alias("n"),
        (F.min("site") < F.max("site")).alias("many"),
        F.min(F.struct("doc_id", "pos")).alias("first"),
    )
    sketch = durable(sketch.where((F.col("n") >= min_sites) & (F.col("many") | F.lit(min_sites <= 1))), "line-sketches")
    near = sketch.where(F.col("about") <= sure).select("k", "first")
    exact = lines.join(near.select("k"), "k", "left_semi").groupBy("k").agg(F.countDistinct("site").alias("sites"))
    found = near.join(exact.where(F.col("sites") >= min_sites), "k").select("k", "first")
    return sketch.where(F.col("about") > sure).select("k", "first").unionByName(found)


def dedup(docs: DataFrame, site: str = "source", min_sites: int = 6, min_words: int = 2, rsd: float = 0.14) -> DataFrame:
    """All columns of docs with the text cleaned, and n_lines and n_removed, which take the place of such columns of docs."""
    # the columns of docs stay inside one, so that no name of theirs meets one made here
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.col(site).alias("site"), F.xxhash64("text").alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_removed"))).alias("row"))
    each = rows.select(F.col("id").alias("doc_id"), "key", F.concat(F.lit("s"), F.col("site")).alias("site"), F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    # anchored and without backtracking: no more of a line is read than its first min_words words
    each = each.where(F.col("line").rlike(rf"^[\x20\x09-\x0D]*+(?:{_UNIT}[\x20\x09-\x0D]*+){{{min_words}}}"))
    lines = durable(each.select(_key(F.col("line")).alias("k"), F.coalesce("site", F.lit("")).alias("site"), "doc_id", "key", "pos"), "lines")
    widely = durable(spread(lines, min_sites, rsd), "lines-spread")
    marks = lines.join(widely, "k").where(~F.struct("doc_id", "pos").eqNullSafe(F.col("first")))
    marks = marks.groupBy(F.col("doc_id").alias("of"), F.col("key").alias("of_key")).agg(F.collect_set("pos").alias("gone"))
    joined = rows.join(marks, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    parts = F.split("body", "\n")
    stay = let(parts, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)))
    text = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(stay, "\n"))
    kept = [text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*kept, F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
