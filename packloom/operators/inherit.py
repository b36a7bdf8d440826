"""Subtypes found in text.

Every file states its super-type names once; they meet the declared names of their repository in an
equi-join, so no declared name is ever tested against a text.
"""
from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom import constants as K
from packloom.functions import paths as P
from packloom.functions import text as T
from packloom.operators.graph import closure, selected_files
from packloom.session import materialize


def _scripts(files: DataFrame) -> DataFrame:
    df = P.with_path_columns(files.select("repo", "path", "content"))
    return df.where(T.detect_language(F.col("ext")).isin(K.SCRIPT_LANGUAGES))


def inheritable_elements(files: DataFrame) -> DataFrame:
    """(repo, path, name, kind), one row per declaration."""
    def declared(kind: str, pattern: str) -> Column:
        names = F.regexp_extract_all("content", F.lit(pattern), 1)
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))

    found = F.concat(*[declared(kind, pattern) for kind, pattern in K.INHERITABLE_PATTERNS.items()])
    return _scripts(files).select("repo", "path", F.explode(found).alias("e")).select("repo", "path", "e.name", "e.kind")


# Forms in which a text names a super-type; the name must be followed by white space, <, comma or brace.
_EXTENDS = r"class\s+[A-Z][a-zA-Z0-9_]*\s+extends\s+([A-Z][a-zA-Z0-9_]*)(?:\s|<|,|\{)"
_LISTED = r"(?:implements|extends)\s+((?:[^,\s{]*,\s*)*[^,\s{<]*[\s<{,])"
_WRAPPED = r"(?:withRouter|connect|memo|forwardRef)\s*\(\s*([A-Z][a-zA-Z0-9_]*)\s*\)"
_RETURNED = r"const\s+[A-Z][a-zA-Z0-9_]*\s*=\s*\([^)]*\)\s*=>\s*<([A-Z][a-zA-Z0-9_]*)"


def _entries(names: Column, form: str) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(form).alias("form"), n.alias("super_name")))


def super_names(files: DataFrame) -> DataFrame:
    """(repo, path, form, super_name): what each script extends, implements or wraps."""
    text = F.col("content")
    pieces = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_LISTED), 1), lambda g: F.split(g, ",", -1)))
    listed = F.filter(
        F.transform(pieces, lambda p: F.regexp_extract(p, r"^\s*([A-Z][a-zA-Z0-9_]*)(?:[\s<{]|$)", 1)),
        lambda n: n != "",
    )
    # A returned tag counts for every name it starts with.
    tags = F.flatten(
        F.transform(
            F.regexp_extract_all(text, F.lit(_RETURNED), 1),
            lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda n: F.substring(t, F.lit(1), n)),
        )
    )
    found = F.concat(
        _entries(F.regexp_extract_all(text, F.lit(_EXTENDS), 1), "class"),
        _entries(listed, "interface"),
        _entries(F.concat(F.regexp_extract_all(text, F.lit(_WRAPPED), 1), tags), "component"),
    )
    return _scripts(files).select("repo", "path", F.explode(F.array_distinct(found)).alias("e")).select(
        "repo", "path", "e.form", "e.super_name"
    )


def _form_of(kind: Column) -> Column:
    return (
        F.when(kind == "INTERFACE", F.lit("interface"))
        .when(kind == "REACT_COMPONENT", F.lit("component"))
        .otherwise(F.lit("class"))
    )


def is_test_by_name(path: Column) -> Column:
    rooted, name = F.concat(F.lit("/"), path), P.stem(P.base_name(path))
    placed = F.lit(False)
    for d in ("/test/", "/tests/", "/__tests__/"):
        placed = placed | F.contains(rooted, F.lit(d))
    late = name.rlike("(?i)test") & name.rlike("(?:IT|IntegrationTest|E2ETest)$")
    return placed | name.rlike(r"(?:Test|Tests|Spec)$|^Test|\.test\.|\.spec\.") | late


def _without_tests(related: DataFrame, include_tests: bool) -> DataFrame:
    return related if include_tests else related.where(~is_test_by_name(F.col("path")))


def implementations(
    selections: DataFrame, files: DataFrame, include_tests: bool = True, names: list[str] | None = None
) -> DataFrame:
    """Other scripts that extend, implement or wrap what a selected file declares.

    ``names`` narrows the declarations to the given types.
    """
    start = selected_files(selections)
    declared = inheritable_elements(
        files.join(start.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    )
    if names is not None:
        declared = declared.where(F.col("name").isin(names))
    declared = declared.select(
        "repo", F.col("path").alias("declared_in"), F.col("name").alias("super_name"), _form_of(F.col("kind")).alias("form")
    ).distinct()
    wanted = start.join(
        declared, (start.repo == declared.repo) & (start.path == declared.declared_in)
    ).select(start.export_id, start.repo, "declared_in", "super_name", "form")
    found = wanted.join(super_names(files), ["repo", "form", "super_name"]).where(
        F.col("path") != F.col("declared_in")
    )
    return _without_tests(found.select("export_id", "repo", "path").distinct(), include_tests)


_JVM_DECLARED = r"\b(?:class|interface|object)\s+([A-Z]\w*)"
# Call and type arguments without further ones inside; taken out level by level.
_ARGUMENTS = r"\([^()]*\)|<[^()<>{};=]*>"
LEVELS_A_SCAN = 8
_TYPE = r"\s*(?:@[\w.]+\s+)*[\w.]+(?:\s+by\s+[\w.]+)?"
_LIST = rf"(?::|\bextends\b|\bimplements\b){_TYPE}(?:\s*,{_TYPE})*"
# A declaration and its super-types; it ends where the list of types ends.
_JVM_HEADER = rf"\b(?:class|interface|object)\s+([A-Z]\w*)(?:\s+[@\w. ]*\bconstructor\b)?\s*({_LIST}(?:\s+{_LIST})*)"
_JVM_SUPER = r"(?:[:,]|\bextends\b|\bimplements\b)\s*(?:@[\w.]+\s+)*(?:\w+\.)*([A-Z]\w*)"


def _jvm(files: DataFrame) -> DataFrame:
    df = P.with_path_columns(files.select("repo", "path", "content"))
    return df.where(T.detect_language(F.col("ext")).isin(K.JVM_LANGUAGES))


def jvm_declarations(files: DataFrame) -> DataFrame:
    """(repo, path, name) by short name."""
    return _jvm(files).select(
        "repo", "path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(_JVM_DECLARED), 1))).alias("name")
    )


def _without_arguments(text: Column) -> Column:
    for _ in range(LEVELS_A_SCAN):
        text = F.regexp_replace(text, _ARGUMENTS, "")
    return text


def jvm_headers(files: DataFrame) -> DataFrame:
    """(repo, path, header) of every declaration with super-types, without call and type arguments.

    One scan takes out ``LEVELS_A_SCAN`` levels of arguments. The few texts that hold more are written and go
    round again until none is left, however deep.
    """
    rest = _jvm(files).select("repo", "path", F.replace("content", F.lit("->"), F.lit(" ")).alias("text"))
    found = []
    while True:
        bare = rest.withColumn("text", _without_arguments(F.col("text"))).withColumn("deeper", F.col("text").rlike(_ARGUMENTS))
        scanned = materialize(bare.select(
            "repo", "path", F.when(F.col("deeper"), F.col("text")).alias("text"),
            F.when(~F.col("deeper"), F.regexp_extract_all("text", F.lit(_JVM_HEADER), 0)).alias("headers"),
        ), "headers")
        found.append(scanned.select("repo", "path", F.explode("headers").alias("header")))
        rest = scanned.where("text is not null").select("repo", "path", "text")
        if rest.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)


def jvm_supers(files: DataFrame) -> DataFrame:
    """(repo, path, name, super_name): which type states which super-types, textual and by short name.

    Call and type arguments count for nothing.
    """
    supers = F.regexp_extract_all(F.regexp_extract("header", _JVM_HEADER, 2), F.lit(_JVM_SUPER), 1)
    return jvm_headers(files).select(
        "repo", "path", F.regexp_extract("header", _JVM_HEADER, 1).alias("name"), F.explode(supers).alias("super_name")
    ).distinct()


def jvm_implementations(
    selections: DataFrame, files: DataFrame, include_tests: bool = True, names: list[str] | None = None
) -> DataFrame:
    """Files with direct and indirect subtypes of the JVM types in the selected files, without those files.

    The closure runs over the names of types, so what else a file declares does not count, and a name that
    many files declare is followed once. ``names`` narrows the start to the given types.
    """
    supers = materialize(jvm_supers(files), "supers")
    start = selected_files(selections)
    declared = jvm_declarations(files.join(start.select("repo", "path").distinct(), ["repo", "path"], "left_semi"))
    if names is not None:
        declared = declared.where(F.col("name").isin(names))
    types = start.join(declared, ["repo", "path"]).select("export_id", "repo", F.col("name").alias("path")).distinct()
    edges = supers.select("repo", F.col("super_name").alias("src"), F.col("name").alias("dst")).distinct()
    reached = closure(types, edges).select("export_id", "repo", F.col("path").alias("super_name"))
    found = reached.join(supers, ["repo", "super_name"]).select("export_id", "repo", "path").distinct()
    found = found.join(start, ["export_id", "repo", "path"], "left_anti")
    return _without_tests(found, include_tests)


def implementation_stats(selections: DataFrame, files: DataFrame) -> DataFrame:
    """Declared types of the selected files by kind. An abstract script class counts twice."""
    start = selected_files(selections)
    mine = files.join(start.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    header = r"(?m)^[ \t]*((?:[a-z]+[ \t]+)*)(class|interface|object)\s+[A-Z]\w*"
    jvm = _jvm(mine).select(
        "repo", "path",
        F.explode(
            F.arrays_zip(
                F.regexp_extract_all("content", F.lit(header), 1).alias("modifiers"),
                F.regexp_extract_all("content", F.lit(header), 2).alias("keyword"),
            )
        ).alias("h"),
    ).select(
        "repo", "path",
        F.when(F.col("h.keyword") == "interface", F.lit("INTERFACE"))
        .when(F.col("h.modifiers").rlike(r"\b(?:abstract|open|sealed)\b"), F.lit("ABSTRACT_CLASS"))
        .otherwise(F.lit("CLASS"))
        .alias("kind"),
    )
    kinds = inheritable_elements(mine).select("repo", "path", "kind").unionByName(jvm)
    per_file = kinds.groupBy("repo", "path").agg(
        F.count_if(F.col("kind") == "INTERFACE").alias("i"),
        F.count_if(F.col("kind") == "ABSTRACT_CLASS").alias("a"),
        F.count_if(F.col("kind") == "CLASS").alias("c"),
        F.count_if(F.col("kind") == "REACT_COMPONENT").alias("r"),
    )
    return start.join(per_file, ["repo", "path"]).groupBy("export_id").agg(
        F.sum("i").alias("interfaces"), F.sum("a").alias("abstract_or_open"),
        F.sum("c").alias("concrete"), F.sum("r").alias("components"),
    )


def stats_text(interfaces: Column, abstract_or_open: Column, components: Column) -> Column:
    """``2 interfaces, 1 abstract/open class and 1 React component``."""
    def part(n: Column, one: str, many: str) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(" "), F.when(n > 1, F.lit(many)).otherwise(F.lit(one))))

    parts = F.array_compact(
        F.array(
            part(interfaces, "interface", "interfaces"),
            part(abstract_or_open, "abstract/open class", "abstract/open classes"),
            part(components, "React component", "React components"),
        )
    )
    n = F.size(parts)
    front = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return (
        F.when(n == 0, F.lit("No inheritable types"))
        .when(n == 1, F.try_element_at(parts, F.lit(1)))
        .otherwise(F.concat(front, F.lit(" and "), F.try_element_at(parts, F.lit(-1))))
    )
