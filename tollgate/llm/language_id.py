"""Language identification as inference of a multilingual mixture.

Training counts hashed byte trigrams of every labelled text by language: numpy in Arrow batches, summed by Spark. The
counts are ``CELLS`` numbers a language (languages, not documents, bound the model); they are smoothed to one
distribution a language.

A text is a mixture: each trigram comes from language l with proportion pi_l. Expectation-maximisation estimates the
proportions of a set of languages; the set grows from the best single language by whichever addition raises the
log-likelihood most, while the gain exceeds ``penalty`` times half the logarithm of the number of trigrams. The
prediction is the language with the largest proportion in the set chosen, the score that proportion.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a text shorter than a trigram is padded
by blanks; ties go to the first language by code point; rows without a label teach nothing; if nothing is labelled
every text is ``und``; repeated rows are judged alike and each counted; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 15
CELLS = 1 << BITS
UNDETERMINED = "und"


def grams(text: str) -> np.ndarray:
    """Cell of every byte trigram of a whole text in lower case, white space and digits alike."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    plain = np.where((raw <= 32) | ((raw >= 48) & (raw <= 57)), 32, raw).astype(np.uint32)
    joined = plain[:-2] << 16 | plain[1:-1] << 8 | plain[2:]
    return (joined[plain[1:-1] + plain[2:] != 64] * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            own = totals.setdefault(lang.as_py(), np.zeros(CELLS, np.int64))
            own += np.bincount(grams(text.as_py()), minlength=CELLS)
    for lang, own in totals.items():
        cells = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(own[cells])], ["lang", "cell", "n"])


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and their log-probabilities, one row a language, from rows of (lang, text)."""
    texts = labelled.where("lang is not null and text is not null").select("lang", "text")
    counted = texts.mapInArrow(_counted, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    per = counted.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("c")).select("lang", "c.cell", "c.n").toPandas()  # a row a language, of at most CELLS cells
    langs = sorted(per["lang"])
    table = np.full((len(langs), CELLS), 0.5)
    for lang, cells, n in zip(per["lang"], per["cell"], per["n"]):
        table[langs.index(lang)][np.asarray(cells, np.int64)] += np.asarray(n, np.float64)
    return langs, np.log(table / table.sum(1, keepdims=True)) if langs else table


def mixture(logp: np.ndarray, counts: np.ndarray, chosen: list[int], rounds: int = 25) -> tuple[np.ndarray, float]:
    """Proportions of the chosen languages by expectation-maximisation, and the log-likelihood; logp has a column a cell."""
    own = logp[chosen]
    top = own.max(0)
    p = np.exp(own - top)
    share, n = np.full(len(chosen), 1 / len(chosen)), counts.sum()
    for _ in range(rounds if len(chosen) > 1 else 0):
        weighed = share[:, None] * p
        new = (weighed / weighed.sum(0)) @ counts / n
        moved, share = np.abs(new - share).max(), new
        if moved < 1e-4:
            break
    return share, float((np.log(share @ p) + top) @ counts)


def infer(logp: np.ndarray, text: str, penalty: float) -> tuple[list[int], np.ndarray]:
    """The language set by penalised likelihood and its proportions."""
    cells, counts = np.unique(grams(text), return_counts=True)
    if not len(cells):
        return [0], np.ones(1)
    own = logp[:, cells]
    single = own @ counts
    chosen = [int(single.argmax())]
    share, likely = np.ones(1), float(single.max())
    cost = penalty * 0.5 * np.log(max(2, counts.sum()))
    while len(chosen) < len(logp):
        tried = [(mixture(own, counts, [*chosen, k]), k) for k in range(len(logp)) if k not in chosen]
        (new, better), k = max(tried, key=lambda x: (x[0][1], -x[1]))
        if better - likely <= cost:
            break
        chosen, share, likely = [*chosen, k], new, better
    return chosen, share


def _predicted(langs: list[str], logp: np.ndarray, penalty: float):
    single = logp.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, score, sets = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                if text is None or not langs:
                    said.append(UNDETERMINED), score.append(0.0), sets.append([])
                    continue
                chosen, share = infer(single, text, penalty)
                best = min(range(len(chosen)), key=lambda i: (-share[i], chosen[i]))
                said.append(langs[chosen[best]])
                score.append(float(min(1.0, share[best])))
                sets.append([{"lang": langs[c], "share": float(s)} for c, s in sorted(zip(chosen, share), key=lambda x: (-x[1], x[0]))])
            mix = pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(said, pa.string()), pa.array(score, pa.float64()), mix], ["row", "lang_pred", "score", "mixture"])

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], penalty: float = 8.0) -> DataFrame:
    """The columns named in keep, lang_pred, score and mixture (languages and shares, largest first) of every row.

    Columns of docs with one of the last three names are replaced.
    """
    letters = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    keep = [c for c in keep if c not in ("lang_pred", "score", "mixture")]
    asked = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in keep)).alias("row"), letters.alias("text"))
    out = T.StructType([asked.schema["row"], *T._parse_datatype_string("lang_pred string, score double, mixture array<struct<lang:string,share:double>>").fields])
    return asked.mapInArrow(_predicted(*model, penalty), out).select(*(F.col(f"row.`{c}`").alias(c) for c in keep), "lang_pred", "score", "mixture")


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: crc32 of the doc_id's digits leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
