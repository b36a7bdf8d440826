"""A corpus from raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table, written as Parquet and read again as the documents of
the next. All but the last keep the columns of the documents.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.llm import decontaminate, mixing, quality, shingle_join, token_files
from packloom.llm.queries import END_ID, WORD_BPE
from packloom.session import materialize, scratch_path, small_batches

#: SQL cannot express the network, the draw of the mix or the token files.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; it learns from the labels of these documents. A null text counts as
    empty, repeated rows are judged alike, an empty table stays empty."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    network = quality.train(docs, labels, F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(False)))
    return quality.filtered(docs, network)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies. One row of it, if it is repeated: that of the
    smallest hash, so that a second run keeps the same; documents without words or id stay; an empty table stays empty."""
    small_batches(spark)
    groups = materialize(shingle_join.classes(docs).where("component_id is not null and component_id <> doc_id").select("doc_id").distinct(), "copies")
    rest = docs.join(groups, "doc_id", "left_anti").select(*docs.columns)
    row = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")
    once = rest.where("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(row).select("row.*")
    return once.unionByName(rest.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Null and empty texts and rows without id stay, repeated rows go or stay
    together; an empty table stays empty."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Empty texts and rows without id stay once."""
    small_batches(spark)
    return mixing.repeated(docs, mixing.mix(docs))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token file and returns its documents: doc_id, start, n_tokens, ids_crc32. A null text holds the end id
    alone, a null id comes first, repeated rows are written each; an empty table gives no row."""
    small_batches(spark)
    path = scratch_path(spark, "corpus-tokens")
    token_files.write(docs, path, public_tokenizers.path(WORD_BPE), END_ID)
    return token_files.read(spark, path)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_files", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
