"""Queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, language_model, licences, line_chunks, media, mixing, quality, simhash, token_shards, toxicity, turns, whitening
from .shared import table


def tokenizer_path(name: str = token_shards.TOKENIZER) -> str:
    """Where the installed vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = quality.held_out(3, 1)
    weights = quality.train(docs, table(spark, sf_dir, "labels"), "quality", ~held)
    scored = quality.score(docs, weights)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, bytes before and after, bytes in repeated passages and removed."""
    got = line_chunks.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = lambda c: F.octet_length(F.coalesce(c, F.lit(""))).cast("long")
    return got.select("doc_id", size("text").alias("n_bytes"), size("line_text").alias("kept_bytes"), "repeated_bytes", F.size("removed").alias("removed_chunks"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = quality.held_out(5, 0)
    index = toxicity.build_index(docs, table(spark, sf_dir, "labels"), "toxic", ~held)
    scored = toxicity.score(docs, index)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sentences, licences, n_licences of every document."""
    got = licences.scan(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.array_join("sentence_ids", " ").alias("sentences"), F.array_join("licences", " ").alias("licences"), F.size("licences").alias("n_licences"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back."""
    return token_shards.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words of every leak."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, checksums and feature of every document's stored payload."""
    return media.media_columns(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, least repair cost, audit and hash of every conversation."""
    got = turns.repair(turns.damage(table(spark, sf_dir, "conversations")))
    hashes = turns.digests(got.turns).withColumnRenamed("conv_id", "of")
    return got.report.join(hashes, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 32 whitened components of every usable vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log10 probability of every document."""
    return language_model.score(table(spark, sf_dir, "documents").select("doc_id", "text"), quality.held_out(7, 2), quality.held_out(7, 3))


QUERIES = (
    op1_quality_classifier,
    op2_line_chunks,
    op3_toxicity,
    op4_source_mixing,
    op5_simhash_near_dedup,
    op6_html_text,
    op7_licence_scan,
    op8_token_shards,
    op9_decontamination,
    op10_media_columns,
    op11_conversation_repair,
    op12_embedding_whitening,
    op13_language_model,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator on whole tables; the others are
    tested against brute force, round trips or held-out labels."""
    return {"op7_licence_scan": licences.oracle()}
