"""One query per operator over the given tables, with production parameters."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.llm import (
    attention_lm, decontaminate, embedding_join, language, licenses, mixing, piece_counts, quality, repeats, shingle_join, spelling, token_files, turn_trie,
)
from packloom.llm.oracle_sql import ORACLE_SQL  # noqa: F401
from packloom.session import scratch_path

WORD_BPE = "word_bpe_49k.json"
END_ID = 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op1_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.classes(_table(spark, sf_dir, "documents"))


def op2_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_copies(_table(spark, sf_dir, "embeddings"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chain = language.train(docs, F.coalesce(_fold(4) != 2, F.lit(False)))
    return language.identify(docs, chain).select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    network = quality.train(docs, labels, F.coalesce(_fold(3) != 1, F.lit(False)))
    return quality.score(docs, network).select(
        "doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = attention_lm.score(_table(spark, sf_dir, "documents"), _fold(7) != 2, public_tokenizers.path(WORD_BPE))
    return scored.select("doc_id", F.coalesce(_fold(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.piece_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-file")
    token_files.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE), END_ID)
    return token_files.read(spark, path)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(_table(spark, sf_dir, "documents")))


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.trie(*turn_trie.rebuilt(_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shingle_join": op1_shingle_join,
    "op2_embedding_join": op2_embedding_join,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_quality": op6_quality,
    "op7_lm_scores": op7_lm_scores,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_token_files": op10_token_files,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_turn_trie": op13_turn_trie,
}
