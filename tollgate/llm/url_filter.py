"""URL verdicts: host and path rules first, then a character language-model ratio learned from what the rules decide.

Two smoothed variable-order Markov models, one of allowed and one of blocked URLs, count characters after contexts of 0
to ``max_order`` characters. A character's probability after a context is its count there, pulled towards its
probability after the context one shorter: (n(context, c) + k P(c | shorter)) / (n(context) + k). Counts are
exact and stay in Spark tables, one an order, keyed by the context: the model grows with the corpus and the driver reads
none of it. A character's log ratio depends on itself and the ``max_order`` characters before it, its gram; so the
distinct grams of the texts are scored, order by order, each from its suffix's probability (a key has at most as many
grams as there are characters), and texts meet their grams' ratios by an equi-join. The score is the mean log ratio a character;
the threshold is the one that errs least on a fifth of the ruled URLs, kept out of the counts (``calibrated``).

Defined cases: a null url, or one without ``://``, has empty host and path; an empty text has no score and is allowed,
as is everything if the rules decide nothing for one of the two classes; repeated rows are judged alike, page_id may be null; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable

#: The rules of the registered query.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, empty where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^[^?#]*", 0)
    return ascii_lower(host), path


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule and the rule's verdict; of the rules that fit, the longest wins."""
    host, path = split_url(F.col("url"))
    cut = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, _, start = text.partition("/")
        fits = ((F.col("host") == at) | F.endswith("host", F.lit(f".{at}"))) & F.startswith("path", F.lit(f"/{start}"))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return cut.select("*", rule.alias("rule"), verdict.alias("ruled"))


def symbols(url: Column) -> Column:
    """What the models read: the whole url in lower case, digits alike."""
    return F.regexp_replace(F.lower(url), "[0-9]", "0")


def _context(text: Column, at: Column, order: Column) -> Column:
    """The ``order`` characters before position ``at`` of a text that starts with max_order blanks."""
    return F.substring(text, at - order, order)


def _placed(texts: DataFrame, max_order: int) -> DataFrame:
    """Every character's place i in the padded text s, which replaces s."""
    padded = texts.where("s != ''").withColumn("s", F.concat(F.lit(" " * max_order), F.col("s")))
    return padded.withColumn("i", F.explode(F.sequence(F.lit(max_order + 1), F.length("s"))))


def fit(texts: DataFrame, max_order: int) -> DataFrame:
    """Exact counts of (s, good): k, context, good, bad and the counts after each character, one row a context."""
    grams = _placed(texts, max_order).withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(max_order + 1)))))
    at = (F.col("s"), F.col("i"), F.col("k"))
    counted = grams.select("k", _context(*at).alias("context"), F.substring(at[0], at[1], F.lit(1)).alias("c"), "good").groupBy("k", "context", "c").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    after = F.map_from_entries(F.collect_list(F.struct("c", F.struct("good", "bad")))).alias("after")
    return durable(counted.groupBy("k", "context").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), after), "url-counts")


def ratios(grams: DataFrame, model: DataFrame, max_order: int, smoothing: float) -> DataFrame:
    """gram, ratio: the log ratio of each distinct gram's last character after the characters before it."""
    below = None
    for k in range(max_order + 1):
        own = grams.select(F.substring("gram", max_order - k + 1, k + 1).alias("gram")).distinct()
        own = own.withColumn("context", F.substring("gram", 1, k)).withColumn("suffix", F.substring("gram", 2, k))
        seen = own.join(model.where(F.col("k") == k).select("context", "good", "bad", "after"), "context", "left")
        if below is None:
            seen = seen.withColumns({"p_good": F.lit(1 / 64), "p_bad": F.lit(1 / 64)})
        else:
            seen = seen.join(below.select(F.col("gram").alias("suffix"), "p_good", "p_bad"), "suffix")
        here = F.element_at("after", F.substring("gram", k + 1, 1))
        step = lambda x: (F.coalesce(here[x], F.lit(0)) + smoothing * F.col(f"p_{x}")) / (F.coalesce(x, F.lit(0)) + smoothing)  # noqa: E731, B023
        below = seen.select("gram", step("good").alias("p_good"), step("bad").alias("p_bad"))
    return durable(below.select("gram", F.ln(F.col("p_good") / F.col("p_bad")).alias("ratio")), "url-ratios")


def scores(texts: DataFrame, model: DataFrame, max_order: int, smoothing: float) -> DataFrame:
    """s, score: the mean log ratio a character of each distinct s that isn't empty."""
    placed = _placed(texts.select("s").distinct().withColumn("whole", F.col("s")), max_order)
    grams = placed.select("whole", _context(F.col("s"), F.col("i") + 1, F.lit(max_order + 1)).alias("gram"))
    found = ratios(grams.select("gram").distinct(), model, max_order, smoothing)
    return grams.join(found, "gram").groupBy(F.col("whole").alias("s")).agg(F.avg("ratio").alias("score"))


def calibrated(held: DataFrame, step: float = 0.001) -> float:
    """The score (in steps) at which the shares of held-out allowed URLs below and blocked URLs not below sum to the least;
    the middle of equal ones, 0 without both classes. Scores are counted by step, so the driver reads a bounded histogram.
    """
    bins = {r["bin"]: (r["good"], r["bad"]) for r in held.groupBy(F.round(F.col("score") / step).cast("int").alias("bin")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).collect()}
    goods, bads = (sum(b[i] for b in bins.values()) for i in (0, 1))
    if not goods or not bads:
        return 0.0
    below, kept, tried = 0, bads, []
    for at in sorted(bins):  # the error if everything below this bin is blocked
        tried.append((below / goods + kept / bads, at))
        below, kept = below + bins[at][0], kept - bins[at][1]
    tried.append((below / goods + kept / bads, max(bins) + 1))
    least = min(e for e, _ in tried)
    i = next(i for i, (e, _) in enumerate(tried) if e == least)
    # anything between the bin before and this one gives the same error
    low = tried[i - 1][1] if i else tried[i][1]
    return (low + tried[i][1]) / 2 * step


def judge(pages: DataFrame, rules=RULES, cells: int | None = None, max_order: int = 4, smoothing: float = 2.0) -> DataFrame:
    """page_id, url, host, path, rule, score (null where a rule decides) and verdict of every page.

    cells is read no more: counts are exact.
    """
    cut = ruled(pages, rules).withColumn("s", symbols(F.coalesce("url", F.lit(""))))
    fold = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)) == 0
    labelled = cut.where("rule is not null and url is not null").select("s", (F.col("ruled") == "allow").alias("good"), fold.alias("held"))
    model = fit(labelled.where("not held"), max_order)
    if model.where("k = 0 and good > 0 and bad > 0").isEmpty():
        return cut.select("page_id", "url", "host", "path", "rule", F.lit(None).cast("double").alias("score"), F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    held = labelled.where("held")
    scored = durable(scores(cut.where("rule is null").select("s").unionByName(held.select("s")), model, max_order, smoothing), "url-scores")
    threshold = calibrated(held.join(scored, "s"))
    judged = cut.join(scored, "s", "left").withColumn("score", F.when(F.col("rule").isNull(), F.col("score")))
    said = F.when(F.col("score") < threshold, "block").otherwise("allow")
    return judged.select("page_id", "url", "host", "path", "rule", "score", F.coalesce("ruled", said).alias("verdict"))
