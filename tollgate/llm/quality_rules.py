"""Line-first cleaning: rules judge each line, failing lines go, documents that lose too much text go.

Everything is computed inside the row with built-in functions, so the job is one narrow stage: no shuffle, no group,
and a cost that follows the text alone.

Defined cases: a null text has no words, no lines and fails the base rules; an empty text likewise; repeated rows are
judged one by one; a share exactly at a limit passes; of equal lines the first counts; texts of any length are judged
whole, in memory that follows the longest; columns other than ``doc_id`` and ``text`` are not read, so clashing names do no harm; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, words

#: Phrases that mark a line as page furniture (compared in lower case).
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "sign in",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
)
SYMBOLS = "[#*$%&|<>]"
#: A line ends well if its last visible character closes a sentence, a quotation or an enumeration, in any script: Unicode's
#: punctuation but for opening brackets, dashes and signs that stand in for words or start list items.
LINE_END = r"[\p{Po}\p{Pe}\p{Pf}\p{Pi}][\x20\x09-\x0D]*$"
NO_END = r"[#%&*@/\\§¶†‡•·‧・][\x20\x09-\x0D]*$"
#: Scripts written without spaces; two of their letters count as a word.
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
LETTERS_A_WORD = 2


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules and of the line rules."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_separators: int = 2
    max_symbols_percent: int = 10
    long_line_words: int = 12
    max_lost_percent: int = 50


def repeated_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice in the array w.

    Windows are compared by a 64-bit hash inside one document. Sorting brings equal ones together; the covered words
    follow from the start positions, as a window adds at most three words beyond the window before it.
    """
    starts = F.sequence(F.lit(0), F.size(w) - 3)
    hashed = F.transform(starts, lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))

    def twice(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))

    at = F.sort_array(F.transform(let(F.sort_array(hashed), twice), lambda x: x["i"]))
    none = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(at, none, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(covered)


def line_fails(line: Column, rules: Rules) -> Column:
    """Whether the navigation, symbol, punctuation or boilerplate rule takes a line."""
    low = F.lower(line)
    navigation = F.regexp_count(line, F.lit(r"\||»|›| > ")) > rules.max_separators
    symbols = 100 * F.regexp_count(line, F.lit(SYMBOLS)) > rules.max_symbols_percent * F.length(line)
    # a short line without closing punctuation is a menu entry or a heading; a long one is prose that was cut off
    ends = line.rlike(LINE_END) & ~line.rlike(NO_END)
    unspaced = F.regexp_count(line, F.lit("[" + "".join(rf"\p{{Is{x}}}" for x in UNSPACED) + "]"))
    parts = F.size(F.split(F.trim(line), " +"))
    unfinished = ~ends & (parts < rules.long_line_words) & (parts + F.floor(unspaced / LETTERS_A_WORD) < rules.long_line_words)
    furniture = F.lit(False)
    for phrase in BOILERPLATE:
        furniture = furniture | low.contains(phrase)
    return navigation | symbols | unfinished | furniture


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the base counts, the cleaned text, and the verdict for every document.

    ``cleaned`` is the text without failing lines and without repeats of an earlier line; ``kept`` is false if a base
    rule fails or the lines removed hold more than ``max_lost_percent`` of the words' characters.
    """
    zero = F.lit(0).cast("long")
    visible = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    chars = lambda xs: F.aggregate(xs, zero, lambda a, x: a + F.length(x))
    base = docs.select("doc_id", "text", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), visible).alias("lines"))
    counted = base.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        chars(F.col("w")).alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        let(F.col("w"), repeated_words).alias("n_repeat_words"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.filter(F.array_distinct("lines"), lambda x: ~line_fails(x, rules)).alias("good"),
    )
    left = chars(F.transform(F.col("good"), lambda x: F.regexp_replace(x, r"[\x20\x09-\x0D]+", "")))
    judged = counted.select(
        "*",
        F.coalesce(F.size("good"), F.lit(0)).cast("long").alias("n_good_lines"),
        F.coalesce(left, zero).alias("chars_left"),
        ((F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))).alias("base_failed"),
        F.array_join("good", "\n").alias("cleaned"),
    ).drop("good")
    enough = 100 * (F.col("word_chars") - F.col("chars_left")) <= rules.max_lost_percent * F.col("word_chars")
    return judged.withColumn("kept", ~F.col("base_failed") & enough)
