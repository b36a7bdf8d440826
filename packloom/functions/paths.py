"""Path arithmetic as columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Parent directory; the repository root is the empty string."""
    cut = F.length(path) - F.length(base_name(path)) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut)).otherwise(F.lit(""))


def extension(name: Column) -> Column:
    """Text after the last dot, null when there is no dot."""
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1))


def stem(name: Column) -> Column:
    """Text before the last dot, the whole name when there is no dot."""
    ext = extension(name)
    return F.when(ext.isNull(), name).otherwise(
        F.substring(name, F.lit(1), F.length(name) - F.length(ext) - 1)
    )


def with_path_columns(df: DataFrame) -> DataFrame:
    """Add ``name``, ``stem``, ``ext`` and ``dir`` derived from ``path``."""
    df = df.withColumn("name", base_name(F.col("path"))).withColumn("dir", dir_name(F.col("path")))
    return df.withColumn("ext", extension(F.col("name"))).withColumn("stem", stem(F.col("name")))


def depth(path: Column) -> Column:
    """Number of segments; 0 for the root."""
    return F.when(path == "", F.lit(0)).otherwise(F.size(F.split(path, "/")))


def self_and_ancestors(path: Column) -> Column:
    """``a``, ``a/b`` ... up to the path itself; no root entry."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(
        let(
            F.split(path, "/"),
            lambda parts: F.transform(
                F.sequence(F.lit(1), F.size(parts)),
                lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
            ),
        )
    )


def dir_chain(directory: Column) -> Column:
    """The root (``""``) followed by every directory down to ``directory``."""
    return F.concat(F.array(F.lit("")), self_and_ancestors(directory))


def dfs_key(path: Column) -> Column:
    """Sort key of a depth-first walk: siblings by name, a directory before what is below it."""
    return F.split(path, "/")


def resolve_relative(directory: Column, reference: Column) -> Column:
    """Join ``reference`` onto ``directory`` and fold ``.`` and ``..``; null when it leaves the root."""
    segments = F.concat(
        F.when(directory == "", F.array().cast("array<string>")).otherwise(F.split(directory, "/")),
        F.split(reference, "/"),
    )

    def step(acc: Column, seg: Column) -> Column:
        return (
            F.when(acc.isNull() | (seg == "") | (seg == "."), acc)
            .when((seg == "..") & (F.size(acc) == 0), F.lit(None).cast("array<string>"))
            .when(seg == "..", F.slice(acc, F.lit(1), F.size(acc) - 1))
            .otherwise(F.concat(acc, F.array(seg)))
        )

    folded = F.aggregate(segments, F.array().cast("array<string>"), step)
    return F.array_join(folded, "/")


def relative_path(absolute: Column, root: Column, name: Column) -> Column:
    """Path below ``root``, the bare name when the file is elsewhere or there is no root."""
    below = F.when(
        F.startswith(absolute, F.concat(root, F.lit("/"))),
        F.substring(absolute, F.length(root) + 2, F.length(absolute)),
    )
    return F.coalesce(below, name)


def normalize_path(path: Column, root: Column) -> Column:
    """Slashes forward, the root prefix of old absolute paths removed, the root itself empty."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    r = F.regexp_replace(F.replace(root, F.lit("\\"), F.lit("/")), "/+$", "")
    return (
        F.when(F.startswith(p, F.concat(r, F.lit("/"))), F.substring(p, F.length(r) + 2, F.length(p)))
        .when(p == r, F.lit(""))
        .otherwise(p)
    )
