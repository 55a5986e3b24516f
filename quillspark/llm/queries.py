"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chat, langid, licences, lines, manifest, mixing, pieces, quality, simhash, sketch, tokencount, vectors, whitening
from quillspark.llm.graph import spark_tables


def piece_model() -> str:
    """Path of the piece vocabulary that the queries use."""
    return importlib.import_module("public_tokenizers").path("piece_bpe_32k.model")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link_vectors(spark_tables(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.95)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark_tables(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_documents(docs, piece_model()).select("doc_id", "token_counts.*")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark_tables(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark_tables(spark, sf_dir, "documents").select("doc_id", "text")
    made = sketch.fingerprint_documents(docs)
    own, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch.fingerprint(own).alias("fingerprint"),
        sketch.fingerprint(edited).alias("edited_fingerprint"),
        sketch.resemblance(own, edited).alias("near_edited"),
        sketch.resemblance(own, after).alias("near_next"),
        sketch.distinct_shingles(own).alias("n_shingles"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark_tables(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.simhash_documents(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(spark_tables(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark_tables(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.dedup_lines(docs)
    gone = F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit(""))
    return out.select("doc_id", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias("n_dropped"), gone.alias("dropped_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark_tables(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", pieces.piece_digest(F.col("text"), piece_model()).alias("d")).select("doc_id", "d.*")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark_tables(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    says = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id bigint, turn bigint, role string, text string")
    found = chat.digest_formatted(chat.format_branches(chat.conversation_messages(turns.unionByName(extra))))
    return found.select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


#: Production parameters of the mixing query.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "language": {"de": 2, "en": 5, "es": 1, "fr": 2}}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark_tables(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, WEIGHTS, 0.6, max_epochs=2, seed=42)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark_tables(spark, sf_dir, "documents").select("doc_id", "text")
    rated = quality.rate_documents(docs, spark_tables(spark, sf_dir, "labels").select("doc_id", "quality"))
    score = F.col("quality_score")
    return rated.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= quality.CUTOFF).cast("int").alias("predicted"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitening.whiten(spark_tables(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = made.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = manifest.manifest(spark_tables(spark, sf_dir, "documents"))
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_token_counts, op3_language_id, op4_fingerprints, op5_simhash, op6_licences, op7_line_dedup, op8_sentencepiece, op9_chat_format, op10_mixing, op11_quality, op12_whitening, op13_manifest)}
ORACLE = {"op6_licences": licences.scan_sql(), "op10_mixing": mixing.mix_sql(WEIGHTS, "0.6", 2, 42), "op13_manifest": manifest.manifest_sql()}
