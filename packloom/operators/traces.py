"""Stack-trace folding over a table of lines.

Runs of foldable lines are found in two levels: inside slices of a few thousand lines, then over one
row per slice, which tells how many lines it has, where its first and last break is, and how the run that is
open at its end begins. A trace, or a run, of any length is therefore spread over tasks. ``fold_lines`` gives the
folded lines as rows; only where the text of a trace is asked for is a trace one row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom import constants as K
from packloom.config import FoldConfig
from packloom.functions import text as T
from packloom.operators.filters import cap_per_group
from packloom.session import materialize

SLICE_LINES = 4096


def raw_lines(traces: DataFrame) -> DataFrame:
    """(trace_id, text) to (trace_id, line_no, line)."""
    return traces.select("trace_id", F.posexplode(F.split("text", K.LINE_BREAK, -1)).alias("line_no", "line")).select(
        "trace_id", F.col("line_no").cast("bigint").alias("line_no"), "line"
    )


def classify_lines(lines: DataFrame) -> DataFrame:
    """Add ``solid`` (not blank), ``kind`` (caused_by, suppressed, frame, ellipsis, other), ``class_name``
    and ``indent``."""
    trimmed = F.regexp_replace("line", r"^\s+|\s+$", "")
    kind = (
        F.when(trimmed.rlike(K.CAUSED_BY_PATTERN), F.lit("caused_by"))
        .when(trimmed.rlike(K.SUPPRESSED_PATTERN), F.lit("suppressed"))
        .when(F.col("line").rlike(K.FRAME_PATTERN), F.lit("frame"))
        .when(trimmed.rlike(K.ELLIPSIS_PATTERN), F.lit("ellipsis"))
        .otherwise(F.lit("other"))
    )
    return lines.withColumn("solid", F.col("line").rlike(r"\S")).withColumn("kind", kind).withColumn(
        "class_name", F.when(F.col("kind") == "frame", F.regexp_extract("line", K.FRAME_PATTERN, 1))
    ).withColumn("indent", F.regexp_extract("line", r"^[ \t]*", 0))


def _plain_class(class_name: Column) -> Column:
    """Without the module prefix."""
    return F.substring_index(class_name, "/", -1)


def _starts_with_any(text: Column, prefixes) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | F.startswith(text, F.lit(p))
    return found


def project_class_lookup(classified: DataFrame, project_classes: DataFrame, config: FoldConfig = FoldConfig()) -> DataFrame:
    """Add ``foldable``. Prefixes decide most frames on the row itself; only the classes they leave
    open meet the project's classes."""
    name = _plain_class(F.col("class_name"))
    is_frame = F.col("kind") == "frame"
    never, always = _starts_with_any(name, config.never_fold), _starts_with_any(name, config.always_fold)
    marked = classified.withColumn("_open", is_frame & ~never & ~always).withColumn("_never", is_frame & never)
    # Decided rows get a spread-out key that matches nothing, so they do not pile up on one null key.
    spread = F.concat(F.lit("#"), F.pmod(F.xxhash64("trace_id", "line_no"), F.lit(4096)).cast("string"))
    marked = marked.withColumn("_class", F.when(F.col("_open"), F.col("class_name")).otherwise(spread))
    own = project_classes.select(F.col("class_name").alias("_class"), F.lit(True).alias("_own")).distinct()
    foldable = (
        F.when(is_frame, ~F.col("_never") & ~F.coalesce("_own", F.lit(False)))
        .when(F.col("kind") == "ellipsis", F.lit(config.fold_ellipsis))
        .otherwise(F.lit(False))
    )
    return marked.join(own, "_class", "left").withColumn("foldable", foldable).drop("_open", "_never", "_class", "_own")


def fold_blocks(lines: DataFrame) -> DataFrame:
    """Add ``pos`` (position among the non-blank lines), ``block`` (position before the run, null for
    lines that do not fold), ``block_len`` and ``block_indent`` (of the first line of the run).

    A run lies between two breaks, so its length is the difference of their positions; no run is ever
    gathered under a key of its own. A trace that lies in its first slice is done with that slice alone; only
    for longer ones are the slices set beside each other.
    """
    marked = lines.where(F.col("trace_id").isNotNull() & F.col("line_no").isNotNull())
    beyond = (F.col("line_no") >= SLICE_LINES) | (F.col("line_no") < 0)
    long = materialize(marked.where(beyond).select("trace_id").distinct(), "long-traces")
    slices = materialize(_slices(_in_slices(marked.join(long, "trace_id", "left_semi"))), "slices")
    local = _in_slices(marked)

    placed = local.join(slices, ["trace_id", "_slice"], "left").withColumns({
        "_offset": F.coalesce("_offset", F.lit(0)), "_ahead": F.coalesce("_ahead", F.col("_n") + 1)})
    here = F.col("foldable") & F.col("solid")
    block = F.coalesce(F.col("_offset") + F.col("_break"), F.col("_carry"), F.lit(0)).cast("bigint")
    length = F.coalesce(F.col("_offset") + F.col("_next"), F.col("_ahead")) - F.col("block") - 1
    began_here = F.col("block") >= F.col("_offset")
    return placed.withColumn("pos", (F.col("_offset") + F.col("_rn")).cast("bigint")).withColumn(
        "block", F.when(here, block)
    ).withColumn("block_len", F.when(here, length.cast("bigint"))).withColumn(
        "block_indent", F.when(here, F.when(began_here, F.col("_begin.indent")).otherwise(F.col("_indent")))
    ).select(*lines.columns, "pos", "block", "block_len", "block_indent")


def _in_slices(lines: DataFrame) -> DataFrame:
    """Add ``_slice``, ``_n`` (its non-blank lines), ``_rn`` (position among them), ``_break`` and ``_next`` (positions of the breaks
    around), and ``_begin`` (how the last run of the slice so far begins)."""
    marked = lines.withColumn("_slice", F.floor(F.col("line_no") / SLICE_LINES))
    inside = Window.partitionBy("trace_id", "_slice").orderBy("line_no")
    onward = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    solid = F.col("solid").cast("bigint")
    local = marked.withColumns({"_rn": F.sum(solid).over(inside), "_n": F.sum(solid).over(whole)})
    at_break = F.when(F.col("solid") & ~F.col("foldable"), F.col("_rn"))
    local = local.withColumn("_break", F.max(at_break).over(inside)).withColumn("_next", F.min(at_break).over(onward))
    opens = F.col("solid") & F.col("foldable") & (F.col("_rn") == F.coalesce("_break", F.lit(0)) + 1)
    return local.withColumn("_begin", F.last(F.when(opens, F.struct("_rn", "indent")), ignorenulls=True).over(inside))


def _slices(local: DataFrame) -> DataFrame:
    """(trace_id, _slice, _offset, _carry, _ahead, _indent): what the other slices of a trace tell each one."""
    slices = local.groupBy("trace_id", "_slice").agg(
        F.max("_rn").alias("_n"), F.max("_break").alias("_last"), F.min("_next").alias("_first"),
        F.max(F.when(F.col("_begin._rn") > F.coalesce("_break", F.lit(0)), F.struct("_rn", "_begin"))).alias("_end"),
    )
    # The run that is open at the end of the slice, if its last non-blank line folds.
    ongoing = (F.col("_end._rn") == F.col("_n")) & (F.col("_end._begin._rn") == F.coalesce("_last", F.lit(0)) + 1)
    slices = slices.withColumn("_open", F.when(ongoing, F.col("_end._begin.indent")))
    by_trace = Window.partitionBy("trace_id").orderBy("_slice")
    before = by_trace.rowsBetween(Window.unboundedPreceding, -1)
    after = by_trace.rowsBetween(1, Window.unboundedFollowing)
    slices = slices.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(
        "_total", F.sum("_n").over(Window.partitionBy("trace_id")))
    slices = slices.withColumns({
        "_carry": F.max(F.col("_offset") + F.col("_last")).over(before),
        "_ahead": F.coalesce(F.min(F.col("_offset") + F.col("_first")).over(after), F.col("_total") + 1),
        "_stretch": F.count("_last").over(by_trace),  # slices up to the next one with a break share a run
    })
    stretch = Window.partitionBy("trace_id", "_stretch").orderBy("_slice")
    slices = slices.withColumn("_start", F.first("_open", ignorenulls=True).over(stretch))
    slices = slices.withColumn("_indent", F.lag("_start").over(by_trace))
    return slices.select("trace_id", "_slice", "_offset", "_carry", "_ahead", "_indent")


def _head(config: FoldConfig) -> Column:
    return F.least(F.lit(max(config.keep_head, 0)).cast("bigint"), F.col("block_len"))


def _tail(config: FoldConfig) -> Column:
    return F.least(F.lit(max(config.keep_tail, 0)).cast("bigint"), F.col("block_len") - _head(config))


def _is_folded(config: FoldConfig) -> Column:
    at = F.col("pos") - F.col("block")
    return F.coalesce(
        (F.col("block_len") >= config.min_frames) & (at > _head(config)) & (at <= F.col("block_len") - _tail(config)),
        F.lit(False),
    )


def top_package(class_name: Column) -> Column:
    """``org.x`` or ``com.x``, otherwise the first segment; null without a package."""
    plain = _plain_class(class_name)
    cut = F.length(plain) - F.length(F.substring_index(plain, ".", -1)) - 1
    pkg = F.when(cut > 0, F.substring(plain, F.lit(1), cut))
    return F.when(pkg.rlike(r"^(?:org|com)\."), F.substring_index(pkg, ".", 2)).otherwise(F.substring_index(pkg, ".", 1))


def package_hints(blocks: DataFrame, config: FoldConfig = FoldConfig(), max_groups: int = 3) -> DataFrame:
    """(trace_id, block, hints): the packages folded most often, ties by name."""
    counted = (
        blocks.where(_is_folded(config))
        .select("trace_id", "block", top_package(F.col("class_name")).alias("pkg"))
        .where(F.col("pkg").isNotNull())
        .groupBy("trace_id", "block", "pkg")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = cap_per_group(counted, ["trace_id", "block"], [F.col("n").desc(), F.col("pkg")], max_groups, rank="rank")
    named = F.struct("rank", F.concat(F.col("pkg"), F.lit(".*("), F.col("n").cast("string"), F.lit(")")).alias("hint"))
    return top.groupBy("trace_id", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(named)), lambda h: h["hint"]), ", ").alias("hints")
    )


def fold_rows(lines: DataFrame, project_classes: DataFrame, config: FoldConfig = FoldConfig()) -> DataFrame:
    """Every line with what is shown in its place: (trace_id, line_no, line, solid, shown).

    The first line of a folded stretch shows the placeholder, the others show nothing (null). Lines are
    read and classified once; blocks are worked out without the texts, and only folded lines come back.
    """
    looked = materialize(project_class_lookup(classify_lines(lines), project_classes, config), "lines")
    narrow = looked.select("trace_id", "line_no", "solid", "foldable", "class_name", "indent")
    blocks = materialize(
        fold_blocks(narrow).where(F.col("block_len") >= config.min_frames).where(_is_folded(config)), "folded"
    )
    first = F.col("pos") == F.col("block") + _head(config) + 1
    marks = blocks.where(first)
    if config.package_hints:
        marks = marks.join(package_hints(blocks, config), ["trace_id", "block"], "left")
        note = F.coalesce(F.concat(F.lit(" ("), F.col("hints"), F.lit(")")), F.lit(""))
    else:
        note = F.lit("")
    indent = F.col("block_indent") if config.preserve_indent else F.lit("    ")
    n = (F.col("block_len") - _head(config) - _tail(config)).cast("string")
    mark = F.concat(indent, F.lit("... "), n, F.lit(" folded frames"), note, F.lit(" ..."))
    changed = marks.select("trace_id", "line_no", mark.alias("mark")).unionByName(
        blocks.where(~first).select("trace_id", "line_no", F.lit(None).cast("string").alias("mark"))
    ).withColumn("gone", F.lit(True))
    return looked.select("trace_id", "line_no", "line", "solid").join(changed, ["trace_id", "line_no"], "left").select(
        "trace_id", "line_no", "line", "solid",
        F.when(F.col("gone").isNull(), F.col("line")).otherwise(F.col("mark")).alias("shown"),
    )


def fold_lines(lines: DataFrame, project_classes: DataFrame, config: FoldConfig = FoldConfig()) -> DataFrame:
    """(trace_id, line_no, line): the folded traces line by line, for traces of any length."""
    rows = fold_rows(lines, project_classes, config)
    return rows.where(F.col("solid") & F.col("shown").isNotNull()).select("trace_id", "line_no", F.col("shown").alias("line"))


def _texts(rows: DataFrame, config: FoldConfig) -> DataFrame:
    """(trace_id, text, raw) from one aggregation. A trace shorter than the minimum, or without a solid
    line, keeps its blank lines."""
    gathered = rows.groupBy("trace_id").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "line", "solid", "shown"))).alias("rows"),
        F.bool_or("solid").alias("any_solid"),
    )
    raw = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    shown = F.array_join(
        F.transform(
            F.filter("rows", lambda r: r["solid"] & r["shown"].isNotNull()), lambda r: r["shown"]
        ),
        "\n",
    )
    untouched = (F.size("rows") < config.min_frames) | ~F.col("any_solid")
    return gathered.select("trace_id", F.when(untouched, raw).otherwise(shown).alias("text"), raw.alias("raw"))


def fold_traces(lines: DataFrame, project_classes: DataFrame, config: FoldConfig = FoldConfig()) -> DataFrame:
    """(trace_id, text)."""
    return _texts(fold_rows(lines, project_classes, config), config).select("trace_id", "text")


def raw_text(lines: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("trace_id").agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("raw"))


def append_raw(folded: DataFrame, raw: DataFrame) -> DataFrame:
    return folded.join(raw, "trace_id").select(
        "trace_id", F.concat_ws("\n", "text", F.lit(K.RAW_TRACE_MARKER), "raw").alias("text")
    )


def fold_and_emit(lines: DataFrame, project_classes: DataFrame, config: FoldConfig = FoldConfig()) -> DataFrame:
    """(trace_id, text, chars, tokens)."""
    out = _texts(fold_rows(lines, project_classes, config), config)
    if config.append_raw:
        out = out.withColumn("text", F.concat_ws("\n", "text", F.lit(K.RAW_TRACE_MARKER), "raw"))
    return out.select(
        "trace_id", "text", F.length("text").cast("bigint").alias("chars"), T.approx_tokens(F.col("text")).alias("tokens")
    )
