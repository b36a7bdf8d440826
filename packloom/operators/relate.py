"""Relations by name and place: tests, resources, configuration, package peers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom import constants as K
from packloom.functions import paths as P
from packloom.functions import text as T
from packloom.operators.graph import selected_files
from packloom.session import materialize


def sources_of(selections: DataFrame) -> DataFrame:
    """Selected files with their path columns, language and family."""
    df = P.with_path_columns(selected_files(selections))
    df = df.withColumn("language", T.detect_language(F.col("ext")))
    return df.withColumn("family", T.language_family(F.col("language")))


def _by_name(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(export_id, repo, name) to the files of that name in the repository."""
    named = P.with_path_columns(files.select("repo", "path")).select("repo", "path", "name")
    return wanted.distinct().join(named, ["repo", "name"]).select("export_id", "repo", "path").distinct()


def _fill(template: str, stem: Column, ext: Column) -> Column:
    """A fixed name template with the stem and the lower-case extension filled in."""
    parts: list[Column] = []
    for i, piece in enumerate(template.split("{}")):
        if i:
            parts.append(stem)
        for j, bit in enumerate(piece.split("{ext}")):
            if j:
                parts.append(ext)
            if bit:
                parts.append(F.lit(bit))
    return F.concat(*parts)


def tests_by_name(selections: DataFrame, files: DataFrame) -> DataFrame:
    src = sources_of(selections)
    ext = F.coalesce(F.lower("ext"), F.lit(""))
    names = F.lit(None).cast("array<string>")
    for family, templates in K.TEST_NAMES.items():
        names = F.when(
            F.col("family") == family, F.array(*[_fill(t, F.col("stem"), ext) for t in templates])
        ).otherwise(names)
    wanted = src.select("export_id", "repo", F.explode(F.array_distinct(names)).alias("name"))
    return _by_name(wanted, files)


def _prefixes(text: Column) -> Column:
    return P.let(
        text, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda n: F.substring(t, F.lit(1), n))
    )


#: Length of the pieces by which names are found.
GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """The distinct pieces of ``size`` characters."""
    return P.let(text, lambda t: F.when(F.length(t) < size, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - (size - 1)), lambda i: F.substring(t, i, F.lit(size))))))


def _containing(asked: DataFrame, named: DataFrame, on: list[str]) -> DataFrame:
    """(export_id, repo, path): ``asked`` (export_id, part and ``on``) with the ``named`` (path, name and
    ``on``, repo among them) whose name contains the part; no part is empty.

    A name publishes its pieces of up to ``GRAM`` characters, a number linear in its length. A distinct part asks
    with one of its own, the one that the fewest names hold; a part with a piece no name holds asks for nothing.
    What meets is tested in full.
    """
    pieces = F.concat(*[_grams(F.col("name"), n) for n in range(1, GRAM + 1)])
    index = materialize(named.select(*on, "path", "name", F.explode(pieces).alias("gram")), "grams")
    # Null key columns never join, as in the names themselves.
    parts = asked.select(*on, "part").distinct()
    short = F.when(F.length("part") <= GRAM, F.array("part")).otherwise(_grams(F.col("part"), GRAM))
    held = index.groupBy(*on, "gram").agg(F.count("*").alias("n"))
    choice = (
        parts.select(*on, "part", F.size(short).alias("of"), F.explode(short).alias("gram")).join(held, [*on, "gram"])
        .groupBy(*on, "part", "of").agg(F.count("*").alias("hits"), F.min(F.struct("n", "gram")).alias("best"))
        .where("hits = of").select(*on, "part", F.col("best.gram").alias("gram"))
    )
    # Written, so that no task holds the sorts of the choice together with those of the pairs.
    choice = materialize(choice, "choice")
    met = choice.join(index, [*on, "gram"]).where(F.contains("name", F.col("part"))).select(*on, "part", "path")
    return asked.join(met, [*on, "part"]).select("export_id", "repo", "path")


def tests_in_folders(selections: DataFrame, files: DataFrame) -> DataFrame:
    """Script tests in ``__tests__`` or ``tests`` beside the source, and sibling .test./.spec. files.

    "Name contains the stem" is looked up by pieces of the name; "name starts with the stem" is an equi-join on
    the name's prefixes.
    """
    src = sources_of(selections).where(F.col("family") == "SCRIPT").where(F.col("stem") != "")
    named = P.with_path_columns(files.select("repo", "path"))
    folder = P.base_name(F.col("dir"))
    in_folder = named.where(folder.isin("__tests__", "tests") & (F.col("stem") != "")).select(
        "repo", "path", P.dir_name(F.col("dir")).alias("src_dir"),
        F.lower("stem").alias("name"),
    )
    beside = src.select("export_id", "repo", F.col("dir").alias("src_dir"), F.lower("stem").alias("part")).distinct()
    nested = _containing(beside, in_folder, ["repo", "src_dir"])
    siblings = named.where((F.instr("name", ".test.") > 0) | (F.instr("name", ".spec.") > 0)).where(
        F.col("stem") != ""
    ).select("repo", "path", F.col("dir").alias("src_dir"), F.explode(_prefixes(F.col("stem"))).alias("part"))
    cased = src.select("export_id", "repo", F.col("dir").alias("src_dir"), F.col("stem").alias("part")).distinct()
    adjacent = cased.join(siblings, ["repo", "src_dir", "part"]).select("export_id", "repo", "path")
    return nested.unionByName(adjacent).distinct()


def related_tests(selections: DataFrame, files: DataFrame) -> DataFrame:
    return tests_by_name(selections, files).unionByName(tests_in_folders(selections, files)).distinct()


def tests_extended(selections: DataFrame, files: DataFrame) -> DataFrame:
    src = sources_of(selections).where(F.col("ext").isNotNull())
    names = F.array(
        *[_fill(p.replace("*", "{}") + ".{ext}", F.col("stem"), F.col("ext")) for p in K.EXTENDED_TEST_PATTERNS]
    )
    return _by_name(src.select("export_id", "repo", F.explode(names).alias("name")), files)


def in_test_dir(path: Column) -> Column:
    """Markers are looked for in the path seen from the repository root."""
    rooted = F.concat(F.lit("/"), path)
    found = F.lit(False)
    for marker in K.TEST_DIR_MARKERS:
        found = found | F.contains(rooted, F.lit(marker))
    return found


def tests_in_test_dirs(selections: DataFrame, files: DataFrame) -> DataFrame:
    """Files of the same extension in a test directory whose name contains the source stem."""
    src = sources_of(selections).where(F.col("ext").isNotNull() & (F.col("stem") != "")).select(
        "export_id", "repo", "ext", F.lower("stem").alias("part")
    ).distinct()
    placed = P.with_path_columns(files.select("repo", "path")).where(in_test_dir(F.col("path"))).where(
        F.col("stem") != ""
    ).select("repo", "path", "ext", F.lower("stem").alias("name"))
    return _containing(src, placed, ["repo", "ext"]).distinct()


def is_test_resource(path: Column) -> Column:
    rooted = F.lower(F.concat(F.lit("/"), path))
    found = F.lit(False)
    for d in K.TEST_RESOURCE_DIRS:
        found = found | F.contains(rooted, F.lit(f"/{d}/"))
    return in_test_dir(path) & found


def test_resources(files: DataFrame) -> DataFrame:
    return files.select("repo", "path").where(is_test_resource(F.col("path")))


def test_utilities(files: DataFrame) -> DataFrame:
    """Patterns are looked up literally, star included."""
    names = [f"{p}.{e}" for p in K.TEST_UTILITY_PATTERNS for e in K.TEST_UTILITY_EXTENSIONS]
    return files.select("repo", "path").where(P.base_name(F.col("path")).isin(names))


def matches_test_name(stem: Column) -> Column:
    found = F.lit(False)
    low = F.lower(stem)
    for p in K.EXTENDED_TEST_PATTERNS:
        word = F.lit(p.strip("*").lower())
        found = found | (F.endswith(low, word) if p.startswith("*") else F.startswith(low, word))
    return found


def all_test_files(files: DataFrame) -> DataFrame:
    named = P.with_path_columns(files.select("repo", "path"))
    return named.where(in_test_dir(F.col("path")) | matches_test_name(F.col("stem"))).select("repo", "path")


def all_related_tests(selections: DataFrame, files: DataFrame) -> DataFrame:
    """Tests of every kind; resources and utilities are those of the whole repository."""
    shared = test_resources(files).unionByName(test_utilities(files)).distinct()
    exports = selections.select("export_id", "repo").distinct()
    return (
        tests_extended(selections, files)
        .unionByName(tests_in_test_dirs(selections, files))
        .unionByName(exports.join(shared, "repo").select("export_id", "repo", "path"))
        .distinct()
    )


def _mentions(text: Column, markers) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(text, F.lit(m))
    return found


# A resource strategy states, per source row, what it looks for: a file name, a path, or a path that
# falls back to the name. All strategies read the text in one projection.
def _wants(by: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(by).alias("by"), v.alias("value")))


def _nothing_unless(condition: Column, wants: Column) -> Column:
    return F.when(condition, wants).otherwise(F.slice(wants, 1, 0))


def _with_suffixes(suffixes: list[str]) -> Column:
    return F.array(*[F.concat(F.col("stem"), F.lit(s)) for s in suffixes])


def _spring() -> Column:
    views = F.array_distinct(F.regexp_extract_all("content", F.lit(K.SPRING_VIEW_PATTERN), 1))
    exts = F.array(*[F.lit(e) for e in K.TEMPLATE_EXTENSIONS])
    names = F.flatten(F.transform(views, lambda v: F.transform(exts, lambda e: F.concat_ws(".", v, e))))
    applies = F.col("language").isin(K.JVM_LANGUAGES) & _mentions(F.col("content"), K.SPRING_MARKERS)
    return _nothing_unless(applies, _wants("name", names))


def _react() -> Column:
    suffixes = [f".{e}" for e in K.STYLE_EXTENSIONS] + [f".module.{e}" for e in K.STYLE_EXTENSIONS]
    applies = F.lower("ext").isin("jsx", "tsx", "js", "ts") & _mentions(F.col("content"), K.REACT_MARKERS)
    return _nothing_unless(applies, _wants("name", _with_suffixes(suffixes)))


def _vue() -> Column:
    is_vue = F.coalesce(F.lower("ext") == "vue", F.lit(False)) | _mentions(F.col("content"), K.VUE_MARKERS)
    return _nothing_unless(is_vue, _wants("name", _with_suffixes([f".{e}" for e in K.STYLE_EXTENSIONS])))


def _angular() -> Column:
    template = F.regexp_extract("content", K.ANGULAR_TEMPLATE_PATTERN, 1)
    block = F.regexp_extract("content", K.ANGULAR_STYLES_PATTERN, 1)
    refs = F.concat(F.array(template), F.regexp_extract_all(block, F.lit(K.QUOTED_PATTERN), 1))
    applies = (F.col("language") == "TYPESCRIPT") & F.contains("content", F.lit(K.ANGULAR_MARKER))
    return _nothing_unless(applies, _wants("path", F.filter(refs, lambda r: r != "")))


def _literal() -> Column:
    return _wants("near", F.array_distinct(F.regexp_extract_all("content", F.lit(K.RESOURCE_LITERAL_PATTERN), 1)))


def _naming() -> Column:
    exts = F.array(*[F.lit(e) for e in K.RESOURCE_EXTENSIONS])
    other = F.filter(exts, lambda e: ~F.coalesce(e == F.col("ext"), F.lit(False)))
    return _wants("name", F.transform(other, lambda e: F.concat_ws(".", F.col("stem"), e)))


RESOURCE_STRATEGIES = {
    "spring": _spring, "react": _react, "vue": _vue, "angular": _angular, "literal": _literal, "naming": _naming,
}


def resource_links(sources: DataFrame, files: DataFrame, strategies=None) -> DataFrame:
    """(repo, src, dst) by the named strategies, all by default.

    A callable ``(sources, files) -> DataFrame(repo, src, dst)`` in the list is a further strategy.
    """
    chosen = list(RESOURCE_STRATEGIES) if strategies is None else list(strategies)
    named = [RESOURCE_STRATEGIES[s]() for s in chosen if isinstance(s, str)]
    links = None
    if named:
        df = P.with_path_columns(sources.select("repo", "path", "content"))
        df = df.withColumn("language", T.detect_language(F.col("ext")))
        wanted = materialize(
            df.select("repo", "dir", F.col("path").alias("src"), F.explode(F.array_distinct(F.concat(*named))).alias("w"))
            .select("repo", "src", "w.by", "w.value", P.resolve_relative(F.col("dir"), F.col("w.value")).alias("path")),
            "wanted",
        )
        existing = files.select("repo", "path").distinct()
        placed = wanted.where(F.col("by") != "name")
        direct = placed.join(existing, ["repo", "path"], "left_semi").select("repo", "src", F.col("path").alias("dst"))
        missing = wanted.where(F.col("by") == "near").join(existing, ["repo", "path"], "left_anti")
        by_name = wanted.where(F.col("by") == "name").unionByName(missing).select(
            "repo", "src", P.base_name(F.col("value")).alias("name"),
            ((F.col("by") == "near") | (F.instr("value", "/") == 0)).alias("usable"),
        ).where("usable").drop("usable").distinct()
        names = P.with_path_columns(files.select("repo", "path")).select("repo", "name", F.col("path").alias("dst"))
        links = direct.unionByName(by_name.join(names, ["repo", "name"]).select("repo", "src", "dst"))
    for strategy in chosen:
        if not isinstance(strategy, str):
            one = strategy(sources, files).select("repo", "src", "dst")
            links = one if links is None else links.unionByName(one)
    return links.distinct()


def related_resources(selections: DataFrame, files: DataFrame, strategies=None) -> DataFrame:
    """Resources of the selected files. Each distinct file is searched once, however often selected."""
    start = selected_files(selections)
    sources = files.join(start.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    links = resource_links(sources, files, strategies)
    return (
        start.join(links, (start.repo == links.repo) & (start.path == links.src))
        .select(start.export_id, start.repo, F.col("dst").alias("path"))
        .distinct()
    )


def config_files(selections: DataFrame, files: DataFrame) -> DataFrame:
    """Configuration files in the repository root and in the directory of each selected file."""
    src = sources_of(selections)
    names = F.array(*[F.lit(n) for n in K.CONFIG_NAMES["BASE"]])
    special = F.array().cast("array<string>")
    for family, listed in K.CONFIG_NAMES.items():
        if family != "BASE":
            special = F.when(F.col("family") == family, F.array(*[F.lit(n) for n in listed])).otherwise(special)
    places = src.select("export_id", "repo", "dir", "family").distinct()
    wanted = places.select(
        "export_id", "repo", F.explode(F.array_distinct(F.array(F.lit(""), F.col("dir")))).alias("dir"),
        F.concat(names, special).alias("names"),
    ).select("export_id", "repo", "dir", F.explode("names").alias("name")).distinct()
    known = sorted({n for listed in K.CONFIG_NAMES.values() for n in listed})
    configs = P.with_path_columns(files.select("repo", "path")).where(F.col("name").isin(known))
    return wanted.join(configs, ["repo", "dir", "name"]).select("export_id", "repo", "path").distinct()


def package_peers(selections: DataFrame, files: DataFrame) -> DataFrame:
    """Other files in the directories of the selected files.

    Each (export, directory) is looked up once: with two or more selected files every file there is a
    peer of another one, with a single selected file all but that file are.
    """
    dirs = (
        sources_of(selections)
        .groupBy("export_id", "repo", "dir")
        .agg(F.min("path").alias("only"), F.count(F.lit(1)).alias("n"))
    )
    placed = files.select("repo", "path", P.dir_name(F.col("path")).alias("dir"))
    return (
        dirs.join(placed, ["repo", "dir"])
        .where((F.col("n") > 1) | (F.col("path") != F.col("only")))
        .select("export_id", "repo", "path")
    )


def test_category(path: Column) -> Column:
    """First category that fits: resource, utility, e2e, performance, integration, unit."""
    name = P.base_name(path)
    stem, low = F.lower(P.stem(name)), F.lower(F.concat(F.lit("/"), path))
    code = F.coalesce(P.extension(name).isin(K.TEST_CODE_EXTENSIONS), F.lit(False))
    return (
        F.when(~code & (F.contains(low, F.lit("/test/")) | F.contains(low, F.lit("/tests/"))), F.lit("resource"))
        .when(_mentions(stem, ["testutil", "testhelper", "mockutil", "basetest"]), F.lit("utility"))
        .when(_mentions(stem, ["e2e", "endtoend"]), F.lit("e2e"))
        .when(_mentions(stem, ["perf", "performance", "load", "stress"]), F.lit("performance"))
        .when(F.endswith(stem, F.lit("it")) | _mentions(stem, ["integration", "inttest"]), F.lit("integration"))
        .otherwise(F.lit("unit"))
    )


_CATEGORY_LABELS = [
    ("unit", "unit"), ("integration", "integration"), ("e2e", "E2E"), ("performance", "performance"),
    ("resource", "resources"), ("utility", "utilities"),
]


def test_categories(tests: DataFrame) -> DataFrame:
    """Counts per category and the line that describes them."""
    counted = tests.groupBy("export_id").agg(
        *[F.count_if(test_category(F.col("path")) == c).alias(f"n_{c}") for c, _ in _CATEGORY_LABELS]
    )
    parts = [
        F.when(F.col(f"n_{c}") > 0, F.concat(F.col(f"n_{c}").cast("string"), F.lit(f" {label}")))
        for c, label in _CATEGORY_LABELS
    ]
    return counted.withColumn(
        "text", F.concat(F.lit("All Tests Export ("), F.concat_ws(", ", *parts), F.lit(")"))
    )


def repo_membership(selected: DataFrame, repos: DataFrame) -> DataFrame:
    """Each selected path with every repository root that contains it."""
    chained = selected.select("export_id", "repo", "path", F.explode(
        F.concat(F.array(F.lit("")), P.self_and_ancestors(F.col("path")))
    ).alias("repo_root"))
    return chained.join(repos, ["repo", "repo_root"]).select("export_id", "repo", "path", "repo_root", "url")


def best_repo(selected: DataFrame, repos: DataFrame) -> DataFrame:
    """Root holding most selected files of an export, the first root by name on a tie."""
    counted = repo_membership(selected, repos).groupBy("export_id", "repo", "repo_root", "url").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.groupBy("export_id").agg(
        F.min_by(F.struct("repo", "repo_root", "url"), F.struct(-F.col("n"), "repo_root", "url")).alias("b")
    ).select("export_id", "b.repo", "b.repo_root", "b.url")
