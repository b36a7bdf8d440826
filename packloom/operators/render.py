"""From kept files to entries, from entries to one text per export."""
from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.config import ExportConfig
from packloom.functions import paths as P
from packloom.functions import text as T
from packloom.operators import graph, summary


def render_entries(kept: DataFrame, files: DataFrame, config: ExportConfig = ExportConfig()) -> DataFrame:
    """(export_id, repo, path, body, approx_tokens) of every kept (export_id, repo, path).

    Texts are prepared once per file, in the scan, before they meet the exports that use them: what the caller does
    not ask for is not shuffled. Files that no export keeps are cut there too, but for a few.
    """
    texts = P.with_path_columns(graph.likely(files.select("repo", "path", "content"), kept)).where(
        ~T.is_dropped(F.col("content"), config.line_numbers)
    )
    body = T.prepared_text(F.col("content"), config.line_numbers)
    texts = texts.withColumn("body", body)
    if config.path_header:
        texts = texts.withColumn("body", T.with_header(F.col("body"), F.col("path"), F.col("ext"), F.col("name")))
    texts = texts.select("repo", "path", "body", T.approx_tokens(F.col("body")).alias("approx_tokens"))
    return kept.select("export_id", "repo", "path").join(texts, ["repo", "path"]).select(
        "export_id", "repo", "path", "body", "approx_tokens"
    )


def drop_unreadable(entries: DataFrame) -> DataFrame:
    return entries.where((F.col("body") != "") & ~T.is_error_text(F.col("body")))


def sort_entries(entries: DataFrame) -> DataFrame:
    """Entries in output order. Range-partitioned, so one large export is spread over tasks."""
    return entries.orderBy("export_id", "path")


def entry_text(output_format: str, path: Column, body: Column, path_header: bool = True) -> Column:
    """One entry as it stands in a bundle."""
    if output_format == "plain":
        return body
    inner = F.when(T.has_header(body), T.without_first_line(body)).otherwise(body) if path_header else body
    if output_format == "markdown":
        return F.concat(
            F.lit("### "), path, F.lit("\n\n```"), T.fence_hint(path), F.lit("\n"), inner, F.lit("\n```\n\n")
        )
    return F.concat(
        F.lit('  <file path="'), T.escape_xml(path), F.lit('">\n    <content><![CDATA[\n'), inner,
        F.lit("\n    ]]></content>\n  </file>\n"),
    )


def _joined(entries: DataFrame, output_format: str, path_header: bool) -> DataFrame:
    """One text per export. The file limit bounds what one export holds; see ``bundle_rows`` otherwise."""
    text = entry_text(output_format, F.col("path"), F.col("body"), path_header)
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("path", text.alias("text")))), lambda e: e["text"]
    )
    rows = entries.groupBy("export_id")
    if output_format == "plain":
        return rows.agg(F.array_join(ordered, "\n").alias("text"))
    if output_format == "markdown":
        return rows.agg(F.array_join(ordered, "").alias("text"))
    return rows.agg(F.concat(F.lit("<files>\n"), F.array_join(ordered, ""), F.lit("</files>")).alias("text"))


def render_plain(entries: DataFrame) -> DataFrame:
    return _joined(entries, "plain", True)


def render_markdown(entries: DataFrame, path_header: bool = True) -> DataFrame:
    return _joined(entries, "markdown", path_header)


def render_xml(entries: DataFrame, path_header: bool = True) -> DataFrame:
    return _joined(entries, "xml", path_header)


def bundle_rows(entries: DataFrame, config: ExportConfig = ExportConfig()) -> DataFrame:
    """The same texts as one row per entry, in output order, for exports without a file limit."""
    text = entry_text(config.output_format, F.col("path"), F.col("body"), config.path_header)
    return sort_entries(entries).select("export_id", "path", text.alias("text"))


def tree_nodes(entries: DataFrame, include_files: bool = False) -> DataFrame:
    """(export_id, path, name, depth, is_file, parent) of the tree above the included paths."""
    chained = entries.select("export_id", "path").distinct().select(
        "export_id", F.posexplode(P.self_and_ancestors(F.col("path"))).alias("i", "node"),
        F.size(F.split("path", "/")).alias("n"),
    )
    nodes = chained.select(
        "export_id", F.col("node").alias("path"), (F.col("i") + 1).alias("depth"), (F.col("i") + 1 == F.col("n")).alias("is_file")
    )
    if not include_files:
        nodes = nodes.where(~F.col("is_file"))
    nodes = nodes.groupBy("export_id", "path", "depth").agg(F.min("is_file").alias("is_file"))
    return nodes.withColumn("name", P.base_name(F.col("path"))).withColumn("parent", P.dir_name(F.col("path")))


def directory_tree(entries: DataFrame, include_files: bool = False) -> DataFrame:
    """(export_id, text): the box-drawing tree, directories before files, each by name.

    A node's line depends on which of its ancestors are the last child of their parent. The last child
    is an aggregate per parent, so no directory is ever sorted as a whole for it.
    """
    nodes = tree_nodes(entries, include_files)
    last = nodes.groupBy("export_id", "parent").agg(F.max(F.struct("is_file", "name")).alias("last"))
    marked = nodes.join(last, ["export_id", "parent"]).select(
        "export_id", "path", "depth", "name", "is_file",
        ((F.col("last.is_file") == F.col("is_file")) & (F.col("last.name") == F.col("name"))).alias("is_last"),
    )
    up = nodes.select("export_id", F.col("path").alias("leaf"), F.explode(P.self_and_ancestors(F.col("path"))).alias("path"))
    lines = up.join(marked, ["export_id", "path"]).groupBy("export_id", "leaf").agg(
        F.array_sort(F.collect_list(F.struct("depth", "is_file", "name", "is_last"))).alias("chain")
    )
    above = F.transform(
        F.slice("chain", F.lit(1), F.size("chain") - 1),
        lambda a: F.when(a["is_last"], F.lit("    ")).otherwise(F.lit("│   ")),
    )
    own = F.try_element_at("chain", F.lit(-1))
    line = F.concat(
        F.lit("// "), F.array_join(above, ""), F.when(own["is_last"], F.lit("└── ")).otherwise(F.lit("├── ")), own["name"], F.lit("\n")
    )
    key = F.transform("chain", lambda a: F.struct(a["is_file"].alias("f"), a["name"].alias("n")))
    return (
        lines.select("export_id", F.struct(key.alias("key"), line.alias("line")).alias("row"))
        .groupBy("export_id")
        .agg(F.array_sort(F.collect_list("row")).alias("rows"))
        .select(
            "export_id",
            F.concat(
                F.lit("// Directory structure\n"), F.array_join(F.transform("rows", lambda r: r["line"]), ""),
                F.lit("// End of directory structure"),
            ).alias("text"),
        )
    )


def pack_bundles(
    entries: DataFrame, config: ExportConfig = ExportConfig(), summaries: DataFrame | None = None, urls: DataFrame | None = None
) -> DataFrame:
    """(export_id, text): tree, then summary, then entries. The summary is made where the settings ask for it,
    with ``urls`` (export_id, url), unless ``summaries`` (export_id, text) are given."""
    if summaries is None and config.repo_summary:
        now = config.generated_at or datetime.datetime.now().isoformat(" ", "seconds")
        summaries = summary.repo_summary(entries, urls, now, config.output_format)
    bundles = _joined(entries, config.output_format, config.path_header)
    text = F.col("text")
    if summaries is not None:
        bundles = bundles.join(summaries.select("export_id", F.col("text").alias("_summary")), "export_id", "left")
        text = F.concat(F.coalesce("_summary", F.lit("")), text)
    if config.directory_tree:
        trees = directory_tree(entries, config.files_in_tree)
        # Without files a selection of root files has a tree of only its two frame lines.
        frame = F.lit("// Directory structure\n// End of directory structure")
        bundles = bundles.join(trees.select("export_id", F.col("text").alias("_tree")), "export_id", "left")
        text = F.concat(F.coalesce("_tree", frame), F.lit("\n\n"), text)
    return bundles.select("export_id", text.alias("text"))


def export_size(bundles: DataFrame) -> DataFrame:
    return bundles.select(
        "export_id", F.octet_length("text").cast("bigint").alias("size_bytes"), T.approx_tokens(F.col("text")).alias("tokens")
    )
