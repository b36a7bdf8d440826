"""Import extraction and resolution.

Each import is one lookup key. Instead of spelling out up to 65 candidate paths per import, every file
publishes the few keys under which it can be found, with its priority; imports are reduced to distinct
keys first, so a module imported by every file of a repository is resolved once.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom import constants as K
from packloom.functions import paths as P
from packloom.functions import text as T
from packloom.operators import nodes as N
from packloom.session import materialize


def extract_imports(files: DataFrame) -> DataFrame:
    """(repo, src, dir, language, family, import_str): the distinct imports of each file."""
    df = P.with_path_columns(files.select("repo", "path", "content"))
    df = df.withColumn("language", T.detect_language(F.col("ext")))
    df = df.withColumn("family", T.language_family(F.col("language"))).where(F.col("family") != "OTHER")
    found = F.lit(None).cast("array<string>")
    for family, patterns in K.IMPORT_PATTERNS.items():
        hits = F.concat(*[F.regexp_extract_all("content", F.lit(p), 1) for p in patterns])
        found = F.when(F.col("family") == family, hits).otherwise(found)
    return df.select(
        "repo", F.col("path").alias("src"), "dir", "language", "family",
        F.explode(F.array_distinct(found)).alias("import_str"),
    )


def _entry(family: str, key: Column, prio: Column | int, when: Column, exact: bool = False) -> Column:
    rank = prio if isinstance(prio, Column) else F.lit(prio)
    return F.when(
        when,
        F.struct(F.lit(family).alias("family"), key.alias("key"), rank.cast("int").alias("prio"), F.lit(exact).alias("exact")),
    )


def _rank(value: Column, listed: list[str]) -> Column:
    """1-based position in a fixed list, 0 when it is not there."""
    return F.coalesce(F.array_position(F.expr("array(" + ", ".join(f"'{v}'" for v in listed) + ")"), value), F.lit(0))


def lookup_keys(files: DataFrame) -> DataFrame:
    """(repo, family, key, prio, exact, dst, dst_is_dir): the names files and directories answer to."""
    nodes = N.expand_nodes(files.select("repo", "path", "size_bytes")).select("repo", "path", "name", "is_dir")
    path = F.col("path")
    suffix = F.when(~F.col("is_dir"), F.concat(F.lit("."), P.extension(F.col("name"))))
    nodes = nodes.select(
        "repo", "path", "is_dir", suffix.alias("suffix"), F.substring_index("path", "/", 1).alias("top"),
        F.when(F.instr("path", "/") > 0, F.expr("substring(path, instr(path, '/') + 1)")).alias("below"),
        F.when(~F.col("is_dir"), _rank(F.col("name"), K.SCRIPT_INDEX_FILES)).otherwise(F.lit(0)).alias("index_rank"),
        (F.col("name") == "__init__.py").alias("is_init"),
    )
    below, suffix, index_rank = F.col("below"), F.col("suffix"), F.col("index_rank")

    def bare(p: Column) -> Column:
        return F.substring(p, F.lit(1), F.length(p) - F.length(suffix))

    def under(root: str) -> tuple[Column, Column]:
        if root == "":
            return F.lit(True), path
        return F.startswith(path, F.lit(root + "/")), F.substring(path, F.lit(len(root) + 2), F.length(path))

    script, rooted = _rank(suffix, K.SCRIPT_RELATIVE_EXTENSIONS), _rank(suffix, K.SCRIPT_ROOT_EXTENSIONS)
    alias, style, jvm = _rank(suffix, K.SCRIPT_ALIAS_EXTENSIONS), _rank(suffix, K.CSS_EXTENSIONS), _rank(suffix, K.JVM_EXTENSIONS)
    root = _rank(F.col("top"), K.SCRIPT_ROOTS)
    in_root = (root > 0) & below.isNotNull()
    in_src = (F.col("top") == "src") & below.isNotNull()
    entries = [
        _entry("path", path, 0, F.lit(True), exact=True),
        _entry("script", bare(path), script, script > 0),
        _entry("script", P.dir_name(path), index_rank + 9, index_rank > 0),
        _entry("root", below, 20 * root, in_root, exact=True),
        _entry("root", bare(below), 20 * root + rooted, in_root & (rooted > 0)),
        _entry("root", P.dir_name(below), 20 * root + 9 + index_rank, in_root & (index_rank > 0)),
        _entry("alias_src", below, 200, in_src, exact=True),
        _entry("alias_src", bare(below), 200 + alias, in_src & (alias > 0)),
        _entry("alias_top", path, 200, F.lit(True), exact=True),
        _entry("alias_top", bare(path), 200 + alias, alias > 0),
        _entry("python", bare(path), 0, suffix == ".py"),
        _entry("package", P.dir_name(path), 0, F.col("is_init") & ~F.col("is_dir")),
        _entry("style", bare(path), style, style > 0),
    ]
    for r, jvm_root in enumerate(K.JVM_ROOTS):
        inside, rest = under(jvm_root)
        entries.append(_entry("jvm", rest, 3 * r, inside, exact=True))
        entries.append(_entry("jvm", bare(rest), 3 * r + jvm, inside & (jvm > 0)))
    return nodes.select(
        "repo", path.alias("dst"), F.col("is_dir").alias("dst_is_dir"),
        F.explode(F.array_compact(F.array(*entries))).alias("e"),
    ).select("repo", "e.family", "e.key", "e.prio", "e.exact", "dst", "dst_is_dir")


def lookup_requests(imports: DataFrame) -> DataFrame:
    """Add ``requests``: the lookups one import stands for, each with the rank it starts at."""
    s, lang = F.col("import_str"), F.col("family")
    imports = imports.withColumn("_rel", P.resolve_relative(F.col("dir"), s)).withColumn(
        "_plain", P.resolve_relative(F.lit(""), s)
    )
    rel, plain = F.col("_rel"), F.col("_plain")
    # After a trailing slash or dot segment only the exact path can still be meant.
    open_end = s.rlike(r"(^|/)\.{0,2}$")

    def ask(family: str, key: Column, base: int, when: Column, exact_only: Column = F.lit(False)) -> Column:
        return F.when(
            when & key.isNotNull(),
            F.struct(F.lit(family).alias("lookup"), key.alias("key"), F.lit(base).alias("base"), exact_only.alias("exact_only")),
        )

    relative = s.rlike(r"^\.\.?/")
    script, slashed = lang == "SCRIPT", F.replace(s, F.lit("."), F.lit("/"))
    jvm_end = F.endswith(s, F.lit("."))
    jvm = F.regexp_replace(F.regexp_replace(slashed, "/+", "/"), "^/|/$", "")
    alias = F.substring(s, F.lit(3), F.length(s))
    is_alias = script & ~relative & F.startswith(s, F.lit("@/"))
    requests = F.array_compact(
        F.array(
            ask("path", rel, 0, script & relative, F.lit(True)),
            ask("script", rel, 0, script & relative & ~open_end),
            ask("script_index", rel, 0, script & relative & open_end),
            ask("root", plain, 0, script & ~relative, open_end),
            ask("alias_src", alias, 0, is_alias),
            ask("alias_top", alias, 0, is_alias),
            ask("jvm", jvm, 0, lang == "JVM", jvm_end),
            ask("jvm", F.replace(jvm, F.lit("_"), F.lit("")), 100, lang == "JVM", jvm_end),
            ask("jvm", s, 200, lang == "JVM"),
            ask("python", slashed, 0, lang == "PYTHON"),
            ask("python", s, 1, lang == "PYTHON"),
            ask("package", slashed, 2, lang == "PYTHON"),
            ask("path", rel, 0, (lang == "HTML") & ~F.startswith(s, F.lit("/"))),
            ask("path", rel, 0, lang == "CSS"),
            ask("style", rel, 0, (lang == "CSS") & ~open_end),
        )
    )
    return imports.withColumn("requests", requests).drop("_rel", "_plain")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, src, family, import_str, dst, dst_is_dir): the best file for every import that has one."""
    # What an import resolves to depends on its text and, only when relative, on the directory.
    from_dir = F.col("family").isin("HTML", "CSS") | F.col("import_str").rlike(r"^\.\.?/")
    imports = imports.withColumn("dir", F.when(from_dir, F.col("dir")).otherwise(F.lit("")))
    asked = imports.select("repo", "dir", "family", "import_str").distinct()
    lookups = lookup_requests(asked).select(
        "repo", "dir", F.col("family").alias("lang"), "import_str", F.explode("requests").alias("q")
    ).select("repo", "dir", "lang", "import_str", "q.lookup", "q.key", "q.base", "q.exact_only")
    keys = lookup_keys(files)
    # Below a ``src`` folder the alias means that folder, so there the files at the top publish no alias.
    with_src = N.directories(files).where(F.col("path") == "src").select("repo")
    top = F.col("family") == "alias_top"
    keys = keys.where(~top).unionByName(keys.where(top).join(with_src, "repo", "left_anti"))
    index_only = F.col("lookup") == "script_index"
    lookups = lookups.withColumn("index_only", index_only).withColumn(
        "lookup", F.when(index_only, F.lit("script")).otherwise(F.col("lookup"))
    )
    keys = keys.withColumnRenamed("family", "lookup")
    hits = lookups.join(keys, ["repo", "lookup", "key"]).where(
        (~F.col("exact_only") | F.col("exact")) & (~F.col("index_only") | (F.col("prio") >= 10))
    )
    best = hits.groupBy("repo", "dir", "lang", "import_str").agg(
        F.min_by(F.struct("dst", "dst_is_dir"), F.struct(F.col("base") + F.col("prio"), "dst")).alias("best")
    ).select("repo", "dir", F.col("lang").alias("family"), "import_str", "best.dst", "best.dst_is_dir")
    return imports.join(best, ["repo", "dir", "family", "import_str"]).select(
        "repo", "src", "family", "import_str", "dst", "dst_is_dir"
    )


def import_edges(files: DataFrame) -> DataFrame:
    """Distinct (repo, src, dst, dst_is_dir) of the whole corpus."""
    found = materialize(extract_imports(files), "imports")  # texts are read once
    return resolve_imports(found, files).select("repo", "src", "dst", "dst_is_dir").distinct()


def resolved_by(files: DataFrame, family: str) -> DataFrame:
    """Edges of one language family."""
    mine = materialize(extract_imports(files).where(F.col("family") == family), "imports")
    return resolve_imports(mine, files).select("repo", "src", "import_str", "dst")
