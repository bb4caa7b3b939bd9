"""Registered queries of the training-data operators, and their DuckDB twins where SQL can express one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embedding_dedup, fill_in_middle, language_id, license_scan, line_dedup, mixing, near_dedup, oracles, periodic_runs as runs, quality_rules, sharding, url_filter, vector_search
from .common import let, shared_folder, table, words


LOADS = 16


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen loads of equal ranges of doc_id, appended in two commits and compacted; every document with its place."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    arrival = F.floor(F.col("doc_id") * LOADS / F.lit(last + 1))
    early = F.coalesce(F.col("doc_id") < (last + 1) // 2, F.lit(True))
    for part in (early, ~early):
        store.append(docs.where(part), arrival, F.octet_length("text"))
    store.compact(F.conv(F.substring(F.md5(F.col("row.doc_id").cast("string")), 1, 8), 16, 10).cast("long"))
    runs = store.manifest().groupBy("run").agg(F.first("tier").alias("tier"), F.first("files").alias("n_files"))
    found = store.located().select("row.doc_id", F.col("place.arrival").alias("arrival"), F.octet_length("row.text").cast("long").alias("n_bytes"), F.md5("row.text").alias("text_md5"), F.col("place.run").alias("run"), F.col("place.file").alias("file_no"))
    return found.join(runs, "run").withColumnRenamed("run", "run_id")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.train(docs.where("not held_out"))
    return language_id.identify(docs.drop("lang"), model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    done = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices and short licences anywhere in a text."""
    return license_scan.passages(table(spark, sf_dir, "documents"))


def license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plainer form that SQL can say: single lines that are a notice."""
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("line")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.clean(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_good_lines", F.md5("cleaned").alias("cleaned_md5"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("form"), F.col("output"))
    return cut.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_components(table(spark, sf_dir, "embeddings"))


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text: a tenth of the documents, by a digest of doc_id, repeat a stretch of words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def looped(w):
        n, a = F.size(w), F.pmod(g, F.greatest(F.size(w), F.lit(1)))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        of = lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), of), " "))

    return docs.select("doc_id", F.when(h % 10 == 0, let(words(F.col("text")), looped)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over the documents, a tenth of them with loops."""
    found = runs.periodic_runs(with_loops(table(spark, sf_dir, "documents")))
    # the greatest length, then the smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    found = found.select("*", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"))
    return found.select("doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()} | {"license_lines": license_lines}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
