"""Relations along the import graph: direct, transitive, reversed."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom import constants as K
from packloom.functions import paths as P
from packloom.operators.filters import cap_per_group
from packloom.session import materialize


def selected_files(selections: DataFrame) -> DataFrame:
    return selections.where(~F.col("is_dir")).select("export_id", "repo", "path").distinct()


def direct_imports(selections: DataFrame, edges: DataFrame) -> DataFrame:
    """Files the selection imports, without the selected files themselves."""
    start = selected_files(selections)
    hops = start.join(edges, (start.repo == edges.repo) & (start.path == edges.src)).select(
        start.export_id, start.repo, F.col("dst").alias("path"), F.col("dst_is_dir").alias("is_dir")
    ).distinct()
    return hops.join(start, ["export_id", "repo", "path"], "left_anti")


#: Most hops that one round of ``closure`` takes before what it found meets the nodes known already.
HOPS = 4


def _merged(runs: list[tuple[int, DataFrame]]) -> list[tuple[int, DataFrame]]:
    """Runs of equal rank are written as one run of the next rank, so that n rounds leave log n tables."""
    while len(runs) > 1 and runs[-1][0] == runs[-2][0]:
        (rank, newer), (_, older) = runs.pop(), runs.pop()
        runs.append((rank + 1, materialize(older.unionByName(newer), "levels")))
    return runs


def _union(runs: list[tuple[int, DataFrame]]) -> DataFrame:
    out = runs[0][1]
    for _, run in runs[1:]:
        out = out.unionByName(run)
    return out


def _shuffled(df: DataFrame) -> DataFrame:
    """Joined by shuffle and sort whatever its size: tables that are broadcast pass through the driver, and those of all rounds add up there."""
    return df.hint("merge")


def closure(start: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Breadth-first closure of (export_id, repo, path) over (repo, src, dst) with the depth of each
    node; the start has depth 0. All exports advance together.

    A round takes one hop, then two, then ``HOPS``, and drops what is known only at its end: the nodes known already are read
    once per round. Its depths are least hop counts, as the frontier holds every node of one depth. Each round is
    written to the shared folder, and rounds are merged in pairs, so the plan does not grow with the depth,
    a node is written again at most log(rounds) times, and a lost executor costs one round.
    """
    key = ["export_id", "repo", "path"]
    hop_edges = edges.select("repo", F.col("src").alias("path"), "dst").distinct() if max_depth != 0 else None
    frontier = materialize(start.select(*key).distinct().withColumn("depth", F.lit(0)), "level")
    runs, depth, hops = [(0, frontier)], 0, 1
    while max_depth is None or depth < max_depth:
        take = hops if max_depth is None else min(hops, max_depth - depth)
        at, found = frontier.select(*key), None
        for hop in range(1, take + 1):
            at = at.join(_shuffled(hop_edges), ["repo", "path"]).select("export_id", "repo", F.col("dst").alias("path")).distinct()
            step = at.withColumn("depth", F.lit(depth + hop))
            found = step if found is None else found.unionByName(step)
        if take > 1:
            found = found.groupBy(*key).agg(F.min("depth").alias("depth"))
        found = materialize(found.join(_shuffled(_union(runs)), key, "left_anti").select(*key, "depth"), "level")
        depth, hops = depth + take, min(2 * hops, HOPS)
        if found.isEmpty():
            break
        runs = _merged([*runs, (0, found)])
        frontier = found.where(F.col("depth") == depth)
    return _union(runs)


def transitive_imports(
    selections: DataFrame, edges: DataFrame, max_depth: int | None = None, cap: int | None = None
) -> DataFrame:
    """Closure of the imports of the selected files; a cap keeps the nearest, then the first by path.
    ``edges`` is read once per level: pass a written table."""
    reached = closure(selected_files(selections), edges, max_depth).where(F.col("depth") > 0)
    dirs = edges.where("dst_is_dir").select("repo", F.col("dst").alias("path")).distinct()
    reached = reached.join(_shuffled(dirs.withColumn("is_dir", F.lit(True))), ["repo", "path"], "left").select(
        "export_id", "repo", "path", F.coalesce("is_dir", F.lit(False)).alias("is_dir"), "depth"
    )
    if cap is not None:
        reached = cap_per_group(reached, ["export_id"], [F.col("depth"), F.col("path")], cap)
    return reached


# Word characters are those of Unicode, in texts, stems and the final test alike.
_WORD = r"(?U)\w+"
# Two neighbouring words with the short separator between them, overlapping.
_PAIR = r"(?U)\b(?=(\w+[^\w\s]{1,3}\w+))"
# All that stands between two words, for stems made of such characters only.
_BETWEEN = r"(?U)(?<=\w)\W+(?=\w)"


def searchable(files: DataFrame, max_bytes: int = K.DEPENDENT_MAX_BYTES) -> DataFrame:
    """Files the dependents search looks at."""
    df = P.with_path_columns(files.where(F.col("size_bytes") <= max_bytes))
    parents = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    skipped = F.arrays_overlap(parents, F.array(*[F.lit(d) for d in K.DEPENDENT_SKIP_DIRS]))
    return df.where(F.col("ext").isin(K.DEPENDENT_EXTENSIONS) & ~skipped)


def _whole_word(stem: Column) -> Column:
    quoted = F.regexp_replace(stem, r"([\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F])", r"\\$1")
    return F.concat(F.lit(r"(?U)\b"), quoted, F.lit(r"\b"))


def stem_terms(starts: DataFrame) -> DataFrame:
    """Search key of every selected stem: a word, a pair of words, or, for a stem without word characters,
    the stem itself, which then is all that stands between two words.

    ``verify`` marks stems the key does not decide alone. The empty stem (``.env``) is no name and is not
    searched for.
    """
    stem = F.col("stem")
    words = F.regexp_extract_all(stem, F.lit(_WORD), 0)
    pairs = F.regexp_extract_all(stem, F.lit(_PAIR), 1)
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return starts.where(stem != "").select(
        "*",
        F.when(F.size(words) == 0, stem).when(stem.rlike(r"(?U)^\w+$"), stem).when(F.size(pairs) > 0, F.try_element_at(pairs, F.lit(1))).otherwise(longest).alias("term"),
        ((F.size(words) > 0) & ~stem.rlike(r"(?U)^\w+$") & ~stem.rlike(r"(?U)^\w+[^\w\s]{1,3}\w+$")).alias("verify"),
    )


#: 64-bit words of the term filter: 2 MB, whatever the number of terms.
FILTER_WORDS = 1 << 18


def _place(repo: Column, term: Column) -> tuple[Column, Column]:
    """The word of the filter a term falls in, and its two bits there."""
    h = F.xxhash64(repo, term)
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(h, F.lit(FILTER_WORDS)).cast("int"), bit(40).bitwiseOR(bit(50))


def term_filter(wanted: DataFrame) -> DataFrame:
    """One row, ``words``: a Bloom filter of the (repo, term) rows. A full filter lets everything through, so the
    join behind it decides alone."""
    at, bits = _place(F.col("repo"), F.col("term"))
    filled = wanted.select(at.alias("at"), bits.alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    empty = wanted.sparkSession.range(FILTER_WORDS, numPartitions=1).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("bigint").alias("bits"))
    words = filled.unionByName(empty).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    listed = words.agg(F.array_sort(F.collect_list(F.struct("at", "bits"))).alias("all"))
    return listed.select(F.col("all.bits").alias("words"))


def likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose (repo, path) may be among the wanted ones, cut in the scan: all that are, and a few that are not."""
    at, bits = _place(F.col("repo"), F.col("path"))
    held = F.element_at(term_filter(wanted.select("repo", F.col("path").alias("term"))).scalar(), at + 1)
    return rows.where(held.bitwiseAND(bits) == bits)


def stem_hits(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(repo, path, stem): which of the stems each text holds as a whole word.

    Texts are split into distinct words, word pairs and separators. Those that a filter of the wanted terms lets
    through leave the scan and meet the distinct stems of their repository in an equi-join, so what is shuffled
    follows the hits; no text is tested against a list of stems.
    """
    wanted = materialize(terms.select("repo", "stem", "term", "verify").distinct(), "terms")
    at, bits = _place(F.col("repo"), F.col("term"))
    held = F.element_at(term_filter(wanted.select("repo", "term").distinct()).scalar(), at + 1)
    tokens = F.array_distinct(
        F.concat(
            F.regexp_extract_all("content", F.lit(_WORD), 0), F.regexp_extract_all("content", F.lit(_PAIR), 1),
            F.regexp_extract_all("content", F.lit(_BETWEEN), 0),
        )
    )
    found = materialize(
        texts.select("repo", "path", F.explode(tokens).alias("term"))
        .where(held.bitwiseAND(bits) == bits)
        .join(wanted, ["repo", "term"])
        .select("repo", "path", "stem", "verify"),
        "found",
    )
    checked = (
        found.where("verify").select("repo", "path", "stem")
        .join(texts.select("repo", "path", "content"), ["repo", "path"])
        .where(F.rlike("content", _whole_word(F.col("stem"))))
        .select("repo", "path", "stem")
    )
    return found.where(~F.col("verify")).select("repo", "path", "stem").unionByName(checked)


def _selected_terms(selections: DataFrame) -> DataFrame:
    start = P.with_path_columns(selected_files(selections))
    return stem_terms(start.select("export_id", "repo", "stem").distinct())


def dependents_candidates(
    selections: DataFrame, files: DataFrame, max_bytes: int = K.DEPENDENT_MAX_BYTES
) -> DataFrame:
    """Files whose text holds the stem of a selected file as a whole word."""
    terms = _selected_terms(selections)
    return (
        stem_hits(terms, searchable(files, max_bytes))
        .join(terms.select("export_id", "repo", "stem"), ["repo", "stem"])
        .select("export_id", "repo", "path")
        .distinct()
        .join(selected_files(selections), ["export_id", "repo", "path"], "left_anti")
    )


def dependents(
    selections: DataFrame, files: DataFrame, edges: DataFrame, cap: int = K.DEPENDENT_CAP,
    max_bytes: int = K.DEPENDENT_MAX_BYTES,
) -> DataFrame:
    """Files that import a selected file and whose text names one, the first ``cap`` by path.

    The reversed edges come first: only files that import something selected have their text searched,
    and a hit only counts for the exports that file already belongs to. A stem that occurs everywhere
    thus never multiplies exports with files.
    """
    start = selected_files(selections)
    importers = edges.join(_shuffled(start), (edges.repo == start.repo) & (edges.dst == start.path)).select(
        start.export_id, edges.repo, F.col("src").alias("path")
    ).distinct()
    importers = materialize(importers.join(_shuffled(start), ["export_id", "repo", "path"], "left_anti"), "importers")
    scope = searchable(files, max_bytes).join(importers.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    terms = _selected_terms(selections)
    confirmed = (
        importers.join(_shuffled(stem_hits(terms, scope)), ["repo", "path"])
        .join(_shuffled(terms.select("export_id", "repo", "stem")), ["export_id", "repo", "stem"], "left_semi")
        .select("export_id", "repo", "path")
        .distinct()
    )
    return cap_per_group(confirmed, ["export_id"], [F.col("path"), F.col("repo")], cap)


def bidirectional(
    selections: DataFrame, files: DataFrame, edges: DataFrame, transitive: bool = True,
    limit: int = K.DEPENDENT_EXPAND_LIMIT, used_by: DataFrame | None = None,
) -> DataFrame:
    """Dependents, imports of the selection, and direct imports of the first dependents. ``edges`` and
    ``used_by``, the dependents where they are known, are read several times: pass written tables."""
    if used_by is None:
        used_by = materialize(dependents(selections, files, edges), "dependents")
    if transitive:
        uses = transitive_imports(selections, edges).select("export_id", "repo", "path", "is_dir")
        first = cap_per_group(used_by, ["export_id"], [F.col("path"), F.col("repo")], limit)
        more = first.join(_shuffled(edges), (first.repo == edges.repo) & (first.path == edges.src)).select(
            first.export_id, first.repo, F.col("dst").alias("path"), F.col("dst_is_dir").alias("is_dir")
        )
        uses = uses.unionByName(more)
    else:
        uses = direct_imports(selections, edges)
    everything = used_by.withColumn("is_dir", F.lit(False)).unionByName(uses).distinct()
    return everything.join(_shuffled(selected_files(selections)), ["export_id", "repo", "path"], "left_anti")
