"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import chats, decontamination, hard_negatives, html, jaccard_join, media, merkle, packing, pitman_yor, quality, simple8b, token_counts, toxicity

END_ID = 2


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file: in CORVANE_TOKENIZERS if set, else where the public_tokenizers package has it."""
    folder = os.environ.get("CORVANE_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of at most 1024 tokens of byte_bpe_50k."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 1024, END_ID)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of each document under the Pitman-Yor model, and under add-one smoothing."""
    return pitman_yor.lm_scores(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of each document, learnt from labels outside the held-out fifth."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Simple-8b files of word_bpe_49k ids, read back."""
    return simple8b.token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), END_ID)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their component under 4-word shingle similarity of 0.85."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), 4, 85)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, their posterior and the trained score of each document."""
    return quality.quality(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of piece_bpe_32k of each document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), 4096)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored media, sniffed and read back."""
    return media.media_features(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document is in the benchmark."""
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations through the template of marked turns, read back."""
    return chats.digest(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten negatives for each of five positives of every hundredth embedding."""
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of the documents, verified against a copy that was tampered with."""
    return merkle.tampered_manifest(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_html_extraction, op3_lm_scoring, op4_toxicity, op5_token_binary, op6_ngram_jaccard_join, op7_quality_classifier, op8_token_counts, op9_media_columns, op10_benchmark_decontamination, op11_chat_formatting, op12_hard_negatives, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op10_benchmark_decontamination": decontamination.SQL, "op11_chat_formatting": chats.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_merkle_manifest": merkle.SQL}
