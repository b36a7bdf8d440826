"""Streams over the same operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packloom.config import FoldConfig
from packloom.operators import summary, traces
from packloom.session import materialize


def stream_recent_changes(changes: DataFrame, hours: int = 24, slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(window_start, window_end, repo, n_changes): change events per sliding window."""
    return (
        changes.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{hours} hours", slide).alias("w"), "repo")
        .agg(F.count(F.lit(1)).alias("n_changes"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "repo", "n_changes")
    )


def stream_fold_traces(
    lines: DataFrame, project_classes: DataFrame, out_path: str, checkpoint: str,
    gap: str = "10 minutes", delay: str = "1 hour", config: FoldConfig = FoldConfig(),
) -> StreamingQuery:
    """Fold each session of a trace once no line of it has arrived for ``gap``; (trace_id, line_no, line, ts)
    in, (trace_id, session_start, text) out.

    The state holds the lines of the open sessions by trace and session, and the watermark closes them: the
    stream needs no second copy of its lines. A session is what the lines themselves make it, so batches may
    be cut anywhere; lines more than ``delay`` behind the newest are dropped. An open session is one
    row of state, so ``gap`` bounds what a row may hold. Folding is the batch job, with the session in the key. A batch is
    written under its id, so a repeated batch replaces itself.
    """
    closed = (
        lines.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("session"), "trace_id")
        .agg(F.collect_list(F.struct("line_no", "line")).alias("lines"))
        .select("trace_id", F.col("session.start").alias("session_start"), "lines")
    )

    def fold(batch: DataFrame, batch_id: int) -> None:
        done = materialize(batch, "closed")
        keyed = done.select(F.struct("trace_id", "session_start").alias("trace_id"), F.explode("lines").alias("at"))
        folded = traces.fold_traces(keyed.select("trace_id", "at.line_no", "at.line"), project_classes, config)
        folded.select("trace_id.*", "text").write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return (
        closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(fold).trigger(availableNow=True).start()
    )


def stream_history(exports: DataFrame, table_path: str, checkpoint: str, n: int = 10) -> StreamingQuery:
    """Keep the ``n`` newest exports per repository in ``table_path/v=<batch>``.

    Every batch reads the version before, merges, and writes its own version: a repeated batch gives
    the same version again.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = latest_history(spark, table_path, batch.schema, batch_id)
        both = batch if before is None else batch.unionByName(before.select(*batch.columns))
        summary.recent_exports(_newest(both), n).write.mode("overwrite").parquet(
            f"{table_path}/v={batch_id}"
        )

    return (
        exports.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(merge).trigger(availableNow=True).start()
    )


def _newest(exports: DataFrame) -> DataFrame:
    """One row per export: the newest, of equally new ones the last in the order of all columns."""
    rest = [c for c in exports.columns if c not in ("repo", "export_id", "ts")]
    newest = exports.groupBy("repo", "export_id").agg(F.max(F.struct("ts", *rest)).alias("row"))
    return newest.select("repo", "export_id", "row.*").select(*exports.columns)


def latest_history(spark: SparkSession, table_path: str, schema, before: int | None = None) -> DataFrame | None:
    """Newest complete version, below ``before`` when given; versions are the batch numbers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    versions = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        done = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/{name}/_SUCCESS"))
        if name.startswith("v=") and done:
            versions.append(int(name[2:]))
    versions = [v for v in versions if before is None or v < before]
    return spark.read.schema(schema).parquet(f"{table_path}/v={max(versions)}") if versions else None
