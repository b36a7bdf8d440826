"""Session settings and the shared checkpoint folder."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "packloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and benches; on a cluster the submitter's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_MADE_UP = "spark.packloom.madeUpDir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    A temporary folder is only made up for a local master; on a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_MADE_UP, None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made_up = tempfile.mkdtemp(prefix="packloom-")
    spark.conf.set(_MADE_UP, made_up)  # the core setting cannot be set once a session runs
    return made_up


ROW_GROUP_BYTES = 8 * 1024 * 1024


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/packloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table", *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives the
    loss of executors, unlike a block kept on them."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    # Small row groups, so that a table of texts can be read back by many tasks.
    df.write.partitionBy(*partition_by).option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_BYTES = 4 * 1024 * 1024


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by bytes, too: the 10,000 rows that go to a Python worker at once may be long texts,
    and are held by the executor and, in several forms, by the worker. A limit that is set already stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def data_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet") if "://" not in sf_dir else f"{sf_dir}/{table}.parquet"
