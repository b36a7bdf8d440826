"""Reading file trees and writing bundles and history."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.functions import paths as P
from packloom.functions import text as T


def scan_files(spark: SparkSession, root: str, repo_depth: int = 1) -> DataFrame:
    """Walk a folder of repositories: (repo, path, size_bytes, mtime, content).

    The first ``repo_depth`` segments below ``root`` name the repository. Unreadable and hidden entries
    are left to the reader; directories come back from ``expand_nodes``.
    """
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)
    )
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    below = F.substring_index(F.col("path"), base + "/", -1)
    parts = F.split(below, "/")
    df = raw.select(
        F.array_join(F.slice(parts, 1, repo_depth), "/").alias("repo"),
        F.array_join(F.slice(parts, F.lit(repo_depth + 1), F.size(parts)), "/").alias("path"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), F.col("content").alias("bytes"),
    )
    return df.select(
        "repo", "path", "size_bytes", "mtime", T.is_binary_content(F.col("bytes")).alias("binary_bytes"),
        T.read_text(F.col("bytes"), F.col("path")).alias("content"),
    )


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """A table of files with at least repo, path and content."""
    df = spark.read.parquet(path)
    if "size_bytes" not in df.columns:
        df = df.withColumn("size_bytes", F.octet_length("content").cast("bigint"))
    return P.with_path_columns(df)


def load_commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("repo", "commit_id", "committed_at", "path", "change_type")


def write_bundles(bundles: DataFrame, path: str, mode: str = "overwrite") -> None:
    bundles.write.mode(mode).parquet(path)


def write_bundle_text(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Plain text files, one folder per export, entries in order inside it."""
    (
        rows.repartition("export_id")
        .sortWithinPartitions("export_id", "path")
        .select("export_id", F.col("text").alias("value"))
        .write.mode(mode)
        .partitionBy("export_id")
        .text(path)
    )


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
