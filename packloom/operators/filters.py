"""Exclusion filters, pruning, the file limit and the counters."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom import constants as K
from packloom.config import ExportConfig
from packloom.functions import paths as P
from packloom.functions import text as T
from packloom.operators import ignore, nodes as N
from packloom.session import materialize

REASONS = ["IGNORED_NAME", "GITIGNORE", "BINARY_CONTENT", "SIZE_LIMIT", "FILENAME_FILTER"]


def is_ignored_name(name: Column, names=K.IGNORED_NAMES) -> Column:
    return name.isin(list(names))


def is_known_binary(ext: Column) -> Column:
    return F.coalesce(F.lower(ext).isin(K.BINARY_EXTENSIONS), F.lit(False))


def is_too_big(size_bytes: Column, max_kb: int) -> Column:
    return size_bytes > F.lit(max_kb * 1024)


def fails_filename_filter(name: Column, filters) -> Column:
    """No listed ending matches; an empty list keeps everything."""
    if not filters:
        return F.lit(False)
    kept = F.lit(False)
    for f in filters:
        ending = f if f.startswith(".") else f".{f}"
        kept = kept | F.endswith(F.lower(name), F.lit(ending.lower()))
    return ~kept


def measured(files: DataFrame, config: ExportConfig) -> DataFrame:
    """Reduce the text of each file to the flags the walk needs, in the scan stage; ignore files keep theirs.

    Content is dropped here, before any shuffle. The binary test runs only when the cheaper metadata
    filters have not already excluded the file.
    """
    df = P.with_path_columns(files)
    cheap = is_known_binary(F.col("ext")) | is_too_big(F.col("size_bytes"), config.max_file_size_kb)
    # A scan of raw files has already tested the bytes before decoding them.
    by_content = F.col("binary_bytes") if "binary_bytes" in files.columns else T.is_binary_content(F.col("content"))
    df = df.withColumn(
        "binary_content", F.when(cheap, F.lit(False)).otherwise(by_content)
    ).withColumn("dropped", T.is_dropped(F.col("content"), config.line_numbers))
    extra = []
    for i, (_, test, *_) in enumerate(config.extra_filters):
        df = df.withColumn(f"extra_{i}", test(df))
        extra.append(f"extra_{i}")
    rules = F.when(F.col("name") == K.IGNORE_FILE, F.col("content")).alias("ignore_text")
    return df.select("repo", "path", "size_bytes", "binary_content", "dropped", rules, *extra)


def exclusion_reason(config: ExportConfig) -> Column:
    """First failing filter; needs ``gitignored`` and ``explicit`` next to the node columns.

    Own filters stand at the position they ask for, at the end without one.
    """
    is_file = ~F.col("is_dir")
    chain = [
        ("IGNORED_NAME", is_ignored_name(F.col("name"), config.ignored_names)),
        ("GITIGNORE", F.col("gitignored") & ~F.col("explicit")),
        ("BINARY_CONTENT", is_file & is_known_binary(F.col("ext"))),
        ("SIZE_LIMIT", is_file & is_too_big(F.col("size_bytes"), config.max_file_size_kb)),
        ("BINARY_CONTENT", is_file & F.col("binary_content")),
    ]
    if config.filters_enabled:
        failed = fails_filename_filter(F.col("name"), config.filename_filters)
        chain.append(("FILENAME_FILTER", is_file & failed))
    for i, (reason, _, *position) in enumerate(config.extra_filters):
        chain.insert(position[0] if position else len(chain), (reason, is_file & F.col(f"extra_{i}")))
    first = F
    for reason, failed in chain:
        first = first.when(failed, F.lit(reason))
    return first


def blocked_depths(bad_dirs: DataFrame, all_dirs: DataFrame) -> DataFrame:
    """Per directory, the depth of the deepest excluded directory on its chain (itself included)."""
    chain = all_dirs.select("repo", "dir", F.explode(P.self_and_ancestors(F.col("dir"))).alias("path"))
    return (
        chain.join(bad_dirs, ["repo", "path"])
        .groupBy("repo", "dir")
        .agg(F.max(P.depth(F.col("path"))).alias("blocked_depth"))
    )


def walk(files: DataFrame, selections: DataFrame, config: ExportConfig = ExportConfig()) -> DataFrame:
    """The nodes every export reaches, each with its exclusion reason (null = passes).

    Texts are read once, for the flags; the tree of nodes with its flags is written to the shared
    folder and all later steps work on that metadata. Directory exclusion depends on the corpus alone,
    so it is decided once on the directories and shared by all exports.
    """
    flags = measured(files, config)
    extra = [c for c in flags.columns if c.startswith("extra_")]
    tree = materialize(N.expand_nodes(flags, "binary_content", "dropped", "ignore_text", *extra), "tree")
    rules = tree.where("ignore_text is not null").select("repo", F.col("dir").alias("gi_dir"), F.col("ignore_text").alias("text"))
    tree = tree.drop("ignore_text")
    ignored = materialize(ignore.ignored_nodes(tree, rules), "ignored")
    dirs = tree.where("is_dir").select("repo", "path", "name")
    named = dirs.where(is_ignored_name(F.col("name"), config.ignored_names)).select("repo", "path")
    ignored_dirs = dirs.select("repo", "path").join(ignored, ["repo", "path"], "left_semi")
    bad = named.unionByName(ignored_dirs).distinct()
    blocked = blocked_depths(bad, dirs.select("repo", F.col("path").alias("dir")))
    tree = tree.join(ignored.withColumn("gitignored", F.lit(True)), ["repo", "path"], "left").withColumn(
        "gitignored", F.coalesce("gitignored", F.lit(False))
    )
    reached = N.reach(tree, selections, blocked)
    return reached.withColumn("exclusion_reason", exclusion_reason(config)).withColumn(
        "kept",
        ~F.col("is_dir") & F.col("exclusion_reason").isNull() & ~F.coalesce("dropped", F.lit(False)),
    )


def cap_per_group(df: DataFrame, group: list[str], order: list, n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each group.

    A first cut within hashed slices keeps a hot group out of one task: every slice sends at most
    ``n`` rows on. The plan is the same for every ``n``.
    """
    slice_of = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(64))
    within = Window.partitionBy(*group, "_slice").orderBy(*order)
    df = df.withColumn("_slice", slice_of).withColumn("_rn", F.row_number().over(within))
    df = df.where(F.col("_rn") <= n).drop("_slice", "_rn")
    name = rank or "_rank"
    over = Window.partitionBy(*group).orderBy(*order)
    top = df.withColumn(name, F.row_number().over(over)).where(F.col(name) <= n)
    return top if rank else top.drop(name)


def file_limit(walked: DataFrame, limit: int | None = 200) -> DataFrame:
    """Stop each export after its ``limit``-th kept file in walk order; equal paths follow by repository. Without a
    limit nothing is left out.

    Only the position of that file is needed. The kept nodes are cut to the first ``limit`` per export
    (map-side, see ``cap_per_group``), the last of them is the cut-off, and one row per export joins
    back: no export is ever ordered as a whole in one task.
    """
    if limit is None:
        return walked
    order = F.struct(F.col("root_ordinal"), P.dfs_key(F.col("path")).alias("key"), F.col("repo"))
    kept = walked.where("kept").select("export_id", order.alias("position"))
    first = cap_per_group(kept, ["export_id"], [F.col("position")], limit)
    cut = (
        first.groupBy("export_id")
        .agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("cut"))
        .where(F.col("n") >= limit)
        .select("export_id", "cut")
    )
    return walked.join(cut, "export_id", "left").where(
        F.col("cut").isNull() | (order <= F.col("cut"))
    ).drop("cut")


def limit_reached(limited: DataFrame, limit: int) -> DataFrame:
    return limited.groupBy("export_id").agg(
        (F.count_if("kept") >= F.lit(limit)).alias("limit_reached")
    )


def exclusion_counts(walked: DataFrame) -> DataFrame:
    by_reason = [
        F.count_if(F.col("exclusion_reason") == r).alias(r.lower()) for r in REASONS
    ]
    return walked.groupBy("export_id").agg(*by_reason, F.count_if("kept").alias("kept_files"))


def excluded_extensions(walked: DataFrame, shown: int = 5) -> DataFrame:
    """Distinct extensions dropped by the filename filter, sorted, and the first few for display."""
    return (
        walked.where(F.col("exclusion_reason") == "FILENAME_FILTER")
        .select("export_id", F.coalesce("ext", F.lit("no_extension")).alias("ext"))
        .distinct()
        .groupBy("export_id")
        .agg(F.array_sort(F.collect_list("ext")).alias("exts"))
        .withColumn("shown", F.slice("exts", 1, shown))
    )


def estimate_files(files: DataFrame, selections: DataFrame, cap: int = 1000) -> DataFrame:
    """Number of files below each selection, stopping at ``cap``."""
    counted = N.reach(
        P.with_path_columns(files.select("repo", "path")).withColumn("is_dir", F.lit(False)), selections
    )
    return counted.groupBy("export_id").agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("n_files"))
