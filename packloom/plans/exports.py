"""One call per user-level export: select, relate, unite, filter, render."""
from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.config import ExportConfig
from packloom.functions import paths as P
from packloom.functions import text as T
from packloom.operators import filters, graph, inherit, relate, render, summary
from packloom.operators.imports import import_edges
from packloom.session import materialize


@dataclass(frozen=True)
class Export:
    """What an export produces. Building one writes its metadata tables; texts are rendered when read.

    ``truncated`` (export_id, truncated) tells, for exports over a capped relation, where the cap was reached.
    """

    walked: DataFrame
    entries: DataFrame
    config: ExportConfig
    truncated: DataFrame | None = None

    def kept(self) -> DataFrame:
        return self.entries.select("export_id", "repo", "path", "approx_tokens")

    def counts(self) -> DataFrame:
        return filters.exclusion_counts(self.walked)

    def bundles(self, summaries: DataFrame | None = None, urls: DataFrame | None = None) -> DataFrame:
        return render.pack_bundles(self.entries, self.config, summaries, urls)


def export_selected(files: DataFrame, selections: DataFrame, config: ExportConfig = ExportConfig()) -> Export:
    """Export exactly the selection; directories are walked."""
    return _rendered(filters.walk(files, selections, config), files, config)


def _rendered(walked: DataFrame, files: DataFrame, config: ExportConfig) -> Export:
    """Cut at the file limit and render what is kept. The walked metadata is written once: the limit,
    the counters and the rendering all read it."""
    walked = materialize(walked, "walked")
    walked = filters.file_limit(walked, config.file_limit)
    kept = walked.where("kept").select("export_id", "repo", "path")
    return Export(walked, render.render_entries(kept, files, config), config)


def union_selection(selections: DataFrame, related: DataFrame) -> DataFrame:
    """Selection first, then the related files, each path once."""
    mine = selections.select("export_id", "repo", "path", F.lit(0).alias("root_ordinal"), "is_dir")
    is_dir = F.col("is_dir") if "is_dir" in related.columns else F.lit(False)
    more = related.select("export_id", "repo", "path", F.lit(1).alias("root_ordinal"), is_dir.alias("is_dir"))
    return mine.unionByName(more).groupBy("export_id", "repo", "path").agg(
        F.min("root_ordinal").alias("root_ordinal"), F.max("is_dir").alias("is_dir")
    )


def _export_explicit(files: DataFrame, chosen: DataFrame, config: ExportConfig) -> Export:
    """Export of explicitly named files. Nothing above them is looked at and ignore rules do not apply,
    so the tree of directories is not needed, and no other text is measured or rendered. Texts are reduced to
    flags in the scan; none is shuffled or written for the choice of files."""
    chosen = materialize(chosen, "chosen")
    files = graph.likely(files, chosen)
    flags = filters.measured(files, config).drop("ignore_text")
    nodes = P.with_path_columns(flags).withColumn("is_dir", F.lit(False))
    walked = nodes.join(chosen.where(~F.col("is_dir")).drop("is_dir"), ["repo", "path"])
    walked = walked.withColumn("gitignored", F.lit(False)).withColumn("explicit", F.lit(True))
    walked = walked.withColumn("exclusion_reason", filters.exclusion_reason(config))
    walked = walked.withColumn("kept", F.col("exclusion_reason").isNull() & ~F.col("dropped"))
    return _rendered(walked, files, config)


def _with_related(
    files: DataFrame, selections: DataFrame, related: DataFrame, config: ExportConfig, only_if_found: bool = False
) -> Export:
    related = materialize(related, "related")
    if only_if_found:
        new = related.join(selections.select("export_id", "repo", "path"), ["export_id", "repo", "path"], "left_anti")
        found = new.select("export_id").distinct()
        selections = selections.join(found, "export_id", "left_semi")
    chosen = union_selection(selections, related)
    if "is_dir" in related.columns:
        chosen = materialize(chosen, "chosen")
        if not chosen.where("is_dir").isEmpty():  # imports of a folder are walked
            return export_selected(files, chosen, config)
    return _export_explicit(files, chosen, config)


def export_direct_imports(files, selections, config=ExportConfig(), edges=None) -> Export:
    edges = edges if edges is not None else materialize(import_edges(files), "edges")
    return _with_related(files, selections, graph.direct_imports(selections, edges), config)


def export_transitive_imports(files, selections, config=ExportConfig(), edges=None, max_depth=None, cap=None) -> Export:
    edges = edges if edges is not None else materialize(import_edges(files), "edges")
    related = materialize(graph.transitive_imports(selections, edges, max_depth, cap), "imports")
    export = _with_related(files, selections, related, config)
    return export if cap is None else replace(export, truncated=truncated(related, cap))


def truncated(related: DataFrame, cap: int) -> DataFrame:
    """(export_id, truncated): whether a capped relation reached its cap."""
    return related.groupBy("export_id").agg((F.count(F.lit(1)) >= F.lit(cap)).alias("truncated"))


def export_dependents(files, selections, config=ExportConfig(), edges=None) -> Export:
    """Selected files, without directories, and what depends on them."""
    edges = edges if edges is not None else materialize(import_edges(files), "edges")
    picked = selections.where(~F.col("is_dir"))
    found = graph.dependents(picked, files, edges, config.dependent_cap, config.dependent_max_bytes)
    found = materialize(found, "dependents")
    return replace(_with_related(files, picked, found, config), truncated=truncated(found, config.dependent_cap))


def export_bidirectional(files, selections, config=ExportConfig(), edges=None, transitive=True) -> Export:
    edges = edges if edges is not None else materialize(import_edges(files), "edges")
    found = graph.dependents(selections, files, edges, config.dependent_cap, config.dependent_max_bytes)
    found = materialize(found, "dependents")
    related = graph.bidirectional(selections, files, edges, transitive, config.dependent_expand_limit, found)
    export = _with_related(files, selections, related, config, only_if_found=True)
    return replace(export, truncated=truncated(found, config.dependent_cap))


def export_implementations(files, selections, config=ExportConfig(), include_tests=True) -> Export:
    related = inherit.implementations(selections, files, include_tests).unionByName(
        inherit.jvm_implementations(selections, files, include_tests)
    ).distinct()
    return _with_related(files, selections, related, config)


def export_implementations_of(files, type_names, config=ExportConfig(), include_tests=True) -> Export:
    """The files that declare the named types and their subtypes; one export per declaring file."""
    script = inherit.inheritable_elements(files).where(F.col("name").isin(list(type_names))).select("repo", "path")
    jvm = inherit.jvm_declarations(files).where(F.col("name").isin(list(type_names))).select("repo", "path")
    chosen = script.unionByName(jvm).distinct().select(
        F.xxhash64("repo", "path").alias("export_id"), "repo", F.lit(0).alias("root_ordinal"), "path", F.lit(False).alias("is_dir")
    )
    related = inherit.implementations(chosen, files, include_tests, list(type_names)).unionByName(
        inherit.jvm_implementations(chosen, files, include_tests, list(type_names))
    ).distinct()
    return _with_related(files, chosen, related, config)


def cap_related(related: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` related files of each export by path."""
    return filters.cap_per_group(related, ["export_id"], [F.col("path"), F.col("repo")], cap)


def export_tests(files, selections, config=ExportConfig(), cap: int | None = None) -> Export:
    related = relate.related_tests(selections, files)
    related = related if cap is None else cap_related(related, cap)
    return _with_related(files, selections, related, config)


def export_all_tests(files, selections, config=ExportConfig(), cap: int | None = None) -> tuple[Export, DataFrame]:
    related = materialize(relate.all_related_tests(selections, files), "related")
    related = related if cap is None else cap_related(related, cap)
    picked = selections.join(related.select("export_id").distinct(), "export_id", "left_semi")
    return _with_related(files, picked, related, config), relate.test_categories(related)


def export_resources(files, selections, config=ExportConfig(), strategies=None) -> Export:
    related = materialize(relate.related_resources(selections, files, strategies), "related")
    picked = selections.join(related.select("export_id").distinct(), "export_id", "left_semi")
    return _with_related(files, picked, related, config)


def export_configs(files, selections, config=ExportConfig()) -> Export:
    return _with_related(files, selections, relate.config_files(selections, files), config)


def export_package(files, selections, config=ExportConfig()) -> Export:
    return _with_related(files, selections, relate.package_peers(selections, files), config)


def _per_repo(paths: DataFrame) -> DataFrame:
    """One export per repository; its id is the hash of the name."""
    return paths.select(
        F.xxhash64("repo").alias("export_id"), "repo", F.lit(0).alias("root_ordinal"), "path", F.lit(False).alias("is_dir")
    ).distinct()


def export_recent_changes(files, file_times, now: str, hours: int = 24, config=ExportConfig()) -> Export:
    return _export_explicit(files, _per_repo(summary.recent_changes(file_times, now, hours)), config)


def export_last_commit(files, commits, config=ExportConfig()) -> Export:
    return _export_explicit(files, _per_repo(summary.last_commit_files(commits, files)), config)


def export_changes_only(files, current, last, config=ExportConfig()) -> Export:
    chosen = summary.changes_only(current, last, files).select(
        "export_id", "repo", F.lit(0).alias("root_ordinal"), "path", F.lit(False).alias("is_dir")
    )
    return _export_explicit(files, chosen, config)


def notice(export: Export, bundles: DataFrame) -> DataFrame:
    """(export_id, size, tokens): the two figures shown after an export."""
    sized = render.export_size(bundles)
    return sized.select("export_id", T.notice_size(F.col("size_bytes")).alias("size"), T.grouped_number(F.col("tokens")).alias("tokens"))

