"""Files, directories, and which of them a selection reaches."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.functions import paths as P

NODE_COLUMNS = ["repo", "path", "name", "ext", "dir", "is_dir", "size_bytes"]


def directories(files: DataFrame) -> DataFrame:
    """Every directory above a file: (repo, path). The distinct parents are exploded, not the files."""
    return (
        files.select("repo", P.dir_name(F.col("path")).alias("dir"))
        .distinct()
        .select("repo", F.explode(P.self_and_ancestors(F.col("dir"))).alias("path"))
        .distinct()
    )


def expand_nodes(files: DataFrame, *carry: str) -> DataFrame:
    """Files plus their directories as rows of their own; ``carry`` names further file columns."""
    dirs = P.with_path_columns(directories(files)).select(
        "repo", "path", "name", "ext", "dir", F.lit(True).alias("is_dir"),
        F.lit(0).cast("bigint").alias("size_bytes"),
    )
    leaves = P.with_path_columns(files.select("repo", "path", "size_bytes", *carry)).select(
        "repo", "path", "name", "ext", "dir", F.lit(False).alias("is_dir"), "size_bytes", *carry
    )
    return leaves.unionByName(dirs, allowMissingColumns=True)


def dedup_selection(selections: DataFrame) -> DataFrame:
    """One row per selected path of an export, at its first position."""
    return selections.groupBy("export_id", "repo", "path").agg(
        F.min("root_ordinal").alias("root_ordinal"), F.max("is_dir").alias("is_dir")
    )


def reach(nodes: DataFrame, selections: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Nodes each selection walks, once per export at the first root that reaches them.

    ``blocked(repo, dir, blocked_depth)`` gives, per directory, the depth of the deepest excluded
    directory on its chain. A node is reached from a root only when nothing from the root down to its
    parent is excluded, so a node is hidden when that depth is not above the root.

    Which roots reach a directory is worked out on the distinct directories and reduced to one row per export
    and directory; nodes only meet these by their parent, and roots that name them by their path.
    """
    roots = selections.select(
        "export_id", "repo", F.col("path").alias("root"), "root_ordinal",
        F.col("is_dir").alias("root_is_dir"),
    )
    dirs = nodes.select("repo", "dir").distinct()
    if blocked is None:
        dirs = dirs.withColumn("blocked_depth", F.lit(-1))
    else:
        dirs = dirs.join(blocked, ["repo", "dir"], "left").withColumn("blocked_depth", F.coalesce("blocked_depth", F.lit(-1)))
    open_root = P.depth(F.col("root")) > F.col("blocked_depth")
    below = (
        dirs.withColumn("root", F.explode(P.dir_chain(F.col("dir"))))
        .join(roots.where("root_is_dir"), ["repo", "root"])
        .where(open_root)
        .groupBy("export_id", "repo", "dir")
        .agg(F.min("root_ordinal").alias("root_ordinal"))
    )
    # A root is at least one deeper than the directory it lies in, so nothing above hides it.
    named = nodes.join(roots.withColumnRenamed("root", "path"), ["repo", "path"]).withColumn("explicit", ~F.col("root_is_dir"))
    reached = nodes.join(below, ["repo", "dir"]).withColumn("explicit", F.lit(False)).unionByName(named.drop("root_is_dir"))
    # The node columns depend on (repo, path); as grouping keys they keep the aggregation hash-based.
    payload = [c for c in nodes.columns if c not in ("repo", "path")]
    return reached.groupBy("export_id", "repo", "path", *payload).agg(
        F.min("root_ordinal").alias("root_ordinal"), F.max("explicit").alias("explicit"),
    )


def dfs_order(nodes: DataFrame) -> DataFrame:
    """Add the depth-first sort key."""
    return nodes.withColumn("dfs_key", P.dfs_key(F.col("path")))
