"""A training corpus from ``documents``: language, boilerplate lines, near copies, source weights, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet into the shared
folder and rereads it for the next stage. All stages but the last return the columns of ``documents``.

Defined cases, alike in every stage: a row is named by doc_id, null or not, and its text, so one id may have two texts
and rows without an id are kept apart; null and empty texts have no language and go in the first stage; repeated rows are
copies, of which near-dedup keeps one; columns beside those of ``documents`` are dropped, whatever their names; an empty
table passes through all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm import byte_bpe, language_id, line_dedup, mixing, near_dedup
from tollgate.llm.common import durable, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if no language explains this share of it.
MIN_SHARE = 0.4


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language of their own; texts without a letter and even mixtures go.

    The language inferred takes the place of the label. A text that is null or has no letter is ``und`` and goes.
    """
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    said = language_id.identify(docs.select(*COLUMNS), model, COLUMNS)
    kept = said.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_SHARE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that stand on many sources, but for their first place; documents left without a word go."""
    done = line_dedup.dedup(docs)
    left = done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, near_dedup.text_key(F.col("text")).alias("row_key"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of every group of near copies (five words, 0.8).

    A row is named by doc_id, null or not, and its text: one id may have two texts.
    """
    found = near_dedup.keyed_components(docs).where("kept").select(F.col("doc_id").alias("id__"), F.col("key").alias("key__")).distinct()
    rows = _keyed(docs)
    kept = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id__")) & (F.col("row_key") == F.col("key__")), "left_semi")
    return kept.dropDuplicates(["doc_id", "row_key"]).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the source weights say: 0, 1 or 2 rows."""
    rows = _keyed(docs)
    plan = mixing.mix(rows, more=("row_key",)).where("copies > 0").select(F.col("doc_id").alias("id__"), F.col("row_key").alias("key__"), "copies")
    met = rows.join(plan, F.col("doc_id").eqNullSafe(F.col("id__")) & (F.col("row_key") == F.col("key__")))
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the check that they decode to the text."""
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    done = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", languages),
    ("line_dedup", boilerplate),
    ("near_dedup", near_copies),
    ("mixing", mixture),
    ("byte_bpe", tokens),
]

#: Inference by iteration, registers and hashed draws have no SQL twin; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
