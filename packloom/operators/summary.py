"""Figures per export, the summary block, history and diff."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packloom import constants as K
from packloom.functions import text as T
from packloom.operators.filters import cap_per_group


def entry_stats(entries: DataFrame) -> DataFrame:
    """Chars and tokens below the header, for entries whose header is the ``// filename: `` form."""
    own = F.startswith("body", F.lit(K.DEFAULT_HEADER))
    inner = T.without_first_line(F.col("body"))
    first = F.substring_index("body", "\n", 1)
    return entries.where(own).select(
        "export_id",
        F.trim(F.substring(first, F.lit(len(K.DEFAULT_HEADER) + 1), F.length(first))).alias("path"),
        F.length(inner).cast("bigint").alias("chars"), T.approx_tokens(inner).alias("tokens"),
    )


def bundle_totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("export_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens")
    )


def pct_of_total(stats: DataFrame) -> DataFrame:
    """Add ``pct``. The total is a partial aggregate joined back, not a window over the whole export."""
    total = stats.groupBy("export_id").agg(F.sum("chars").alias("_total"))
    pct = F.when(F.col("_total") > 0, F.col("chars") / F.col("_total") * 100.0).otherwise(F.lit(0.0))
    return stats.join(total, "export_id").withColumn("pct", pct).drop("_total")


def top_files(stats: DataFrame, n: int = 10) -> DataFrame:
    return cap_per_group(stats, ["export_id"], [F.col("chars").desc(), F.col("path")], n, rank="rank")


def _one_decimal(pct):
    return F.format_string("%.1f", pct)


def repo_summary(
    entries: DataFrame, urls: DataFrame | None, now: str, output_format: str = "plain"
) -> DataFrame:
    """(export_id, text): the summary block. ``urls(export_id, url)`` names the repository, ``now`` is
    a timestamp literal so that runs repeat."""
    stats = entry_stats(entries)
    totals = stats.groupBy("export_id").agg(F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))
    counted = entries.groupBy("export_id").agg(F.count(F.lit(1)).alias("n_files"))
    head = counted.join(totals, "export_id", "left").fillna(0, ["chars", "tokens"])
    if urls is not None:
        head = head.join(urls.select("export_id", "url"), "export_id", "left")
    else:
        head = head.withColumn("url", F.lit(None).cast("string"))
    url = F.coalesce("url", F.lit("Not a Git repository"))
    stamp = F.date_format(F.lit(now).cast("timestamp"), "dd.MM.yyyy, HH:mm:ss")
    nums = [F.col(c).cast("string") for c in ("chars", "tokens")]
    pct = _one_decimal("pct")
    if output_format == "plain":
        item = F.concat(F.lit("    "), F.col("path"), F.lit("\n    "), nums[0], F.lit(" chars | "), nums[1], F.lit(" tokens | "), pct, F.lit("%\n"))
    elif output_format == "markdown":
        item = F.concat(F.lit("### "), F.col("path"), F.lit("\n"), nums[0], F.lit(" chars | "), nums[1], F.lit(" tokens | "), pct, F.lit("%\n\n"))
    else:
        item = F.concat(
            F.lit("      <file>\n        <path>"), T.escape_xml(F.col("path")), F.lit("</path>\n        <chars>"), nums[0],
            F.lit("</chars>\n        <tokens>"), nums[1], F.lit("</tokens>\n        <percentage>"), pct,
            F.lit("</percentage>\n      </file>\n"),
        )
    ranked = top_files(pct_of_total(stats), 10).select("export_id", F.struct("rank", item.alias("item")).alias("row"))
    items = ranked.groupBy("export_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["item"]), "").alias("items")
    )
    n, chars, tokens = F.col("n_files").cast("string"), F.col("chars").cast("string"), F.col("tokens").cast("string")
    items_text = F.coalesce("items", F.lit(""))
    if output_format == "plain":
        text = F.concat(
            F.lit("**Repository Info**\n\nRepository\n    "), url, F.lit("\nGenerated At\n    "), stamp,
            F.lit("\nFormat\n    plain text\n\nPack Summary\n\nTotal Files\n    "), n,
            F.lit(" files\nTotal Size\n    "), chars, F.lit(" chars\nTotal Tokens\n    "), tokens,
            F.lit(" tokens\n\nTop 10 Files\n\n"), items_text, F.lit("\n"),
        )
    elif output_format == "markdown":
        text = F.concat(
            F.lit("# Repository Info\n\n## Repository\n"), url, F.lit("\n## Generated At\n"), stamp,
            F.lit("\n## Format\nmarkdown\n\n# Pack Summary\n\n## Total Files\n"), n,
            F.lit(" files\n## Total Size\n"), chars, F.lit(" chars\n## Total Tokens\n"), tokens,
            F.lit(" tokens\n\n## Top 10 Files\n\n"), items_text,
        )
    else:
        text = F.concat(
            F.lit("<repository-summary>\n  <repository-info>\n    <repository-url>"), T.escape_xml(url),
            F.lit("</repository-url>\n    <generated-at>"), T.escape_xml(stamp),
            F.lit("</generated-at>\n    <format>xml</format>\n  </repository-info>\n  <pack-summary>\n    <total-files>"), n,
            F.lit("</total-files>\n    <total-chars>"), chars, F.lit("</total-chars>\n    <total-tokens>"), tokens,
            F.lit("</total-tokens>\n    <top-files>\n"), items_text,
            F.lit("    </top-files>\n  </pack-summary>\n</repository-summary>\n"),
        )
    return head.join(items, "export_id", "left").select("export_id", text.alias("text"))


def history_rows(entries: DataFrame, bundles: DataFrame, now: str) -> DataFrame:
    """One history row per export: counts, bytes, tokens, paths and the summary line."""
    from packloom.operators.render import export_size

    counted = entries.groupBy("export_id", "repo").agg(
        F.count(F.lit(1)).cast("int").alias("file_count"), F.array_sort(F.collect_set("path")).alias("file_paths")
    )
    rows = counted.join(export_size(bundles), "export_id")
    line = T.export_line(F.col("file_count"), F.col("size_bytes"), F.col("tokens"))
    return rows.select(
        "repo", "export_id", F.lit(now).cast("timestamp").alias("ts"), "file_count", "size_bytes", "tokens",
        "file_paths", line.alias("summary"),
    )


def recent_exports(history: DataFrame, n: int = 10) -> DataFrame:
    return cap_per_group(history, ["repo"], [F.col("ts").desc(), F.col("export_id").desc()], n)


_FILE_KEY = ["export_id", "repo", "path"]


def _paths(df: DataFrame) -> DataFrame:
    return df.select(*_FILE_KEY).distinct()


def diff_added(current: DataFrame, last: DataFrame) -> DataFrame:
    return _paths(current).join(_paths(last), _FILE_KEY, "left_anti")


def diff_removed(current: DataFrame, last: DataFrame) -> DataFrame:
    return _paths(last).join(_paths(current), _FILE_KEY, "left_anti")


def diff_unchanged(current: DataFrame, last: DataFrame) -> DataFrame:
    return _paths(current).join(_paths(last), _FILE_KEY, "left_semi")


def export_diff(current: DataFrame, last: DataFrame) -> DataFrame:
    """(export_id, repo, path, status) from one full outer join."""
    now = _paths(current).withColumn("in_current", F.lit(True))
    then = _paths(last).withColumn("in_last", F.lit(True))
    status = (
        F.when(F.col("in_last").isNull(), F.lit("added"))
        .when(F.col("in_current").isNull(), F.lit("removed"))
        .otherwise(F.lit("unchanged"))
    )
    return now.join(then, _FILE_KEY, "full_outer").select(*_FILE_KEY, status.alias("status"))


def diff_text(diff: DataFrame, previous: DataFrame, current: DataFrame) -> DataFrame:
    """(export_id, text): the diff as it is copied. ``diff`` as ``export_diff`` gives it, ``previous``
    (export_id, summary) from the history, empty where there is none, and ``current`` (export_id, file_count,
    size_bytes, tokens). Paths are ordered, then repositories; a text is as long as the two exports it compares.
    """
    def listed(status: str, sign: str):
        chosen = F.array_sort(F.collect_list(F.when(F.col("status") == status, F.struct("path", "repo"))))
        return F.transform(chosen, lambda r: F.concat(F.lit(f"{sign} "), r["path"], F.lit("\n")))

    lists = diff.groupBy("export_id").agg(listed("added", "+").alias("added"), listed("removed", "-").alias("removed"))

    def block(title: str, column: str, end: str):
        head = F.concat(F.lit(f"{title} Files ("), F.size(column).cast("string"), F.lit("):\n"))
        return F.when(F.size(column) > 0, F.concat(head, F.array_join(column, ""), F.lit(end))).otherwise(F.lit(""))

    line = T.export_line(F.col("file_count"), F.col("size_bytes"), F.col("tokens"))
    return (
        current.join(lists, "export_id")
        .join(previous.select("export_id", F.col("summary").alias("_before")), "export_id", "left")
        .select("export_id", F.concat(
            F.lit("Export Diff Summary\n===================\n\nPrevious: "), F.coalesce("_before", F.lit("")), F.lit("\nCurrent: "), line,
            F.lit("\n\n"), block("Added", "added", "\n"), block("Removed", "removed", ""),
        ).alias("text"))
    )


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("export_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "unchanged")]
    )


def changes_only(current: DataFrame, last: DataFrame, files: DataFrame) -> DataFrame:
    """Added paths that exist in their repository."""
    return diff_added(current, last).join(files.select("repo", "path").distinct(), ["repo", "path"], "left_semi").select(*_FILE_KEY)


def last_commit_files(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Files of the latest commit of each repository that still exist.

    The latest commit is an aggregate joined back, so a repository's history is never sorted.
    """
    latest = commits.groupBy("repo").agg(F.max(F.struct("committed_at", "commit_id")).alias("m")).select(
        "repo", "m.committed_at", "m.commit_id"
    )
    changed = commits.where(F.col("change_type") != "deleted").join(latest, ["repo", "committed_at", "commit_id"])
    return changed.select("repo", "path").distinct().join(
        files.select("repo", "path").distinct(), ["repo", "path"], "left_semi"
    )


def recent_changes(file_times: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Files changed strictly after ``now`` minus ``hours``."""
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"interval {hours} hours")
    return file_times.where(F.col("mtime").cast("timestamp") > cutoff).select("repo", "path")
