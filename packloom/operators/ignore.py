"""Ignore files: parse rules, compile them to match columns, decide per node.

Matching is an equi-join of directories to the ignore files above them. Most rules are then found by a
literal: the path or name they equal, or the extension they end in, looked up with the node's own. Only the
rest are tested as patterns, by the nodes below their ignore file, inside a single row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom import constants as K
from packloom.functions import paths as P
from packloom.session import materialize


def load_ignore_files(files: DataFrame) -> DataFrame:
    """(repo, gi_dir, text) of every ignore file. A table partitioned by ``ignore_file`` is not read beyond these."""
    if "ignore_file" in files.columns:
        files = files.where("ignore_file")
    return files.where(P.base_name(F.col("path")) == K.IGNORE_FILE).select(
        "repo", P.dir_name(F.col("path")).alias("gi_dir"), F.col("content").alias("text")
    )


def parse_ignore_rules(ignore_files: DataFrame) -> DataFrame:
    lines = ignore_files.select(
        "repo", "gi_dir", F.posexplode(F.split("text", K.LINE_BREAK, -1)).alias("rule_no", "line")
    )
    lines = lines.withColumn("original", F.regexp_replace("line", r"^\s+|\s+$", "")).where(
        (F.col("original") != "") & ~F.startswith("original", F.lit("#"))
    )
    negated = F.startswith("original", F.lit("!"))
    body = F.when(negated, F.substring("original", F.lit(2), F.length("original"))).otherwise(F.col("original"))
    body = F.regexp_replace(F.regexp_replace(body, r"^\\([#!])", "$1"), r"\\ ", " ")
    dir_only = F.endswith(body, F.lit("/"))
    bare = F.regexp_replace(body, "/$", "")
    return lines.select(
        "repo", "gi_dir", "rule_no", "original", negated.alias("negated"), dir_only.alias("dir_only"),
        F.startswith(bare, F.lit("/")).alias("rooted"), F.regexp_replace(bare, "^/", "").alias("pattern"),
    )


def _literal(token: Column) -> Column:
    """A one-character token as a regex literal."""
    return F.when(token.rlike(r"[.\\(){}\[\]+*?^$|]"), F.concat(F.lit("\\"), token)).otherwise(token)


_PATH_TOKEN = r"(?s)\\.|\*\*|\*|\?|\[[^\]]*\]|."
_NAME_TOKEN = r"(?s)\\.|\*\*|\*|\?|."


def _path_regex(glob: Column) -> Column:
    """Path glob to regex: ``*`` stays in a segment, ``**`` crosses, sets and ``{a,b}`` are honoured.

    Null for a glob that does not compile (an open set or group, a nested group, a last backslash).
    """
    tokens = F.regexp_extract_all(glob, F.lit(_PATH_TOKEN), 0)

    def bracket(t: Column) -> Column:
        inside = F.substring(t, F.lit(2), F.length(t) - 2)
        quoted = F.regexp_replace(inside, r"([\\\[&^])", r"\\$1")
        return F.when(
            F.startswith(inside, F.lit("!")),
            F.concat(F.lit("[^/"), F.substring(quoted, F.lit(2), F.length(quoted)), F.lit("]")),
        ).otherwise(F.concat(F.lit("["), quoted, F.lit("]")))

    def step(acc: Column, t: Column) -> Column:
        group, bad = acc["open"], acc["bad"]
        piece = (
            F.when(t == "**", F.lit(".*"))
            .when(t == "*", F.lit("[^/]*"))
            .when(t == "?", F.lit("[^/]"))
            .when((t == "{") & ~group, F.lit("(?:(?:"))
            .when((t == "}") & group, F.lit("))"))
            .when((t == ",") & group, F.lit(")|(?:"))
            .when((F.length(t) > 1) & F.startswith(t, F.lit("[")), bracket(t))
            .when((F.length(t) == 2) & F.startswith(t, F.lit("\\")), _literal(F.substring(t, 2, 1)))
            .otherwise(_literal(t))
        )
        broken = (
            (t == "[") | (t == "\\") | ((t == "{") & group) | (t == "[]")
            | (F.startswith(t, F.lit("[")) & F.contains(t, F.lit("/")))
        )
        return F.struct(
            F.concat(acc["out"], piece).alias("out"),
            F.when(t == "{", F.lit(True)).when(t == "}", F.lit(False)).otherwise(group).alias("open"),
            (bad | broken).alias("bad"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("open"), F.lit(False).alias("bad"))
    done = F.aggregate(tokens, start, step)
    return F.when(~done["bad"] & ~done["open"], F.concat(F.lit("^"), done["out"], F.lit("$")))


def _name_regex(glob: Column) -> Column:
    """Name glob to regex: sets and groups are literal here."""
    tokens = F.regexp_extract_all(glob, F.lit(_NAME_TOKEN), 0)
    pieces = F.transform(
        tokens,
        lambda t: F.when(t == "**", F.lit(".*"))
        .when(t == "*", F.lit("[^/]*"))
        .when(t == "?", F.lit("[^/]"))
        .when((F.length(t) == 2) & F.startswith(t, F.lit("\\")), _literal(F.substring(t, 2, 1)))
        .otherwise(_literal(t)),
    )
    return F.concat(F.lit("^"), F.array_join(pieces, ""), F.lit("$"))


def compile_ignore_rules(rules: DataFrame) -> DataFrame:
    """Add the match columns. Distinct patterns repeat across repositories, so the work is per rule row
    and stays on the small side."""
    pattern = F.col("pattern")
    has_slash = F.contains(pattern, F.lit("/"))
    simple = ~pattern.rlike(r"[*?\[{]") & ~F.col("dir_only")
    glob = F.concat(
        F.when(~F.col("rooted") & ~F.startswith(pattern, F.lit("**")) & ~has_slash, F.lit("**/")).otherwise(F.lit("")),
        pattern,
        F.when(F.col("dir_only") & ~F.endswith(pattern, F.lit("/**")), F.lit("/**")).otherwise(F.lit("")),
    )
    last = F.substring_index(pattern, "/", -1)
    name_source = F.when(F.col("dir_only"), last).otherwise(pattern)
    deep = F.instr(pattern, "/**/*.")
    return rules.select(
        "*",
        simple.alias("simple"),
        F.when(simple & (F.col("rooted") | has_slash), pattern).alias("eq_path"),
        F.when(simple & ~(F.col("rooted") | has_slash), pattern).alias("eq_name"),
        F.when(F.col("dir_only"), F.concat(pattern, F.lit("/"))).alias("dir_prefix"),
        F.when(~simple & (deep > 0), F.substring(pattern, F.lit(1), deep - 1)).alias("deep_prefix"),
        F.when(~simple & (deep > 0), F.concat(F.lit("."), F.substring_index(pattern, ".", -1))).alias("deep_suffix"),
        F.when(~simple, _path_regex(glob)).alias("path_regex"),
        F.when(
            ~simple & (name_source != "") & (~has_slash | F.col("dir_only")), _name_regex(name_source)
        ).alias("name_regex"),
        last.alias("last_segment"),
    )


def rule_hits(rule: Column, path: Column, name: Column, is_dir: Column) -> Column:
    """Whether one compiled rule matches one path given relative to its ignore file."""
    no = F.lit(False)
    by_equality = F.coalesce(path == rule["eq_path"], no) | F.coalesce(name == rule["eq_name"], no)
    by_glob = (
        F.when(rule["path_regex"].isNull(), no)
        .when(F.coalesce(F.startswith(path, rule["dir_prefix"]), no), F.lit(True))
        .when(
            F.coalesce(F.startswith(path, rule["deep_prefix"]), no),
            F.endswith(path, rule["deep_suffix"]),
        )
        .otherwise(F.rlike(path, rule["path_regex"]))
    )
    by_name = F.coalesce(F.rlike(name, rule["name_regex"]), no)
    dir_only = rule["dir_only"]
    return (
        F.when(rule["simple"], by_equality)
        .when(by_glob, ~(dir_only & (name == rule["last_segment"]) & ~is_dir))
        .otherwise(by_name & (~dir_only | is_dir))
    )


_RULE_FIELDS = [
    "rule_no", "original", "negated", "dir_only", "simple", "eq_path", "eq_name", "dir_prefix", "deep_prefix",
    "deep_suffix", "path_regex", "name_regex", "last_segment",
]


def _verdict(negated: Column) -> Column:
    return F.when(negated, F.lit(-1)).otherwise(F.lit(1))


def _literal_key(path: Column, name: Column, suffix: Column) -> Column:
    """What a rule without a pattern is found by. The letter keeps paths, names and endings apart."""
    return (
        F.when(path.isNotNull(), F.concat(F.lit("p"), path))
        .when(name.isNotNull(), F.concat(F.lit("n"), name))
        .otherwise(F.concat(F.lit("e"), F.substring_index(suffix, ".", -1)))
    )


def literal_rules(rules: DataFrame) -> DataFrame:
    """(repo, gi_dir, key, rule_no, verdict, suffix) of the rules that equal a path or name, or are ``*.`` and an
    ending, which the names below must end in."""
    suffix = F.when(F.col("pattern").rlike(_ENDING) & ~F.col("rooted") & ~F.col("dir_only"), F.substring("pattern", F.lit(2), F.length("pattern")))
    return rules.withColumn("suffix", suffix).where(F.col("simple") | F.col("suffix").isNotNull()).select(
        "repo", "gi_dir", _literal_key(F.col("eq_path"), F.col("eq_name"), F.col("suffix")).alias("key"), "rule_no",
        _verdict(F.col("negated")).alias("verdict"), "suffix",
    )


def pattern_rules(rules: DataFrame) -> DataFrame:
    """The other rules."""
    ending = F.col("pattern").rlike(_ENDING) & ~F.col("rooted") & ~F.col("dir_only")
    return rules.where(~F.col("simple") & ~ending)


#: ``*.`` and an ending without any further pattern character.
_ENDING = r"^\*\.[^*?\[\]{}\\/,]+$"


def rule_sets(rules: DataFrame) -> DataFrame:
    """Compiled rules of an ignore file in one row, last rule first. The array is as long as the file."""
    grouped = rules.groupBy("repo", "gi_dir").agg(
        F.collect_list(F.struct(*_RULE_FIELDS)).alias("rules")
    )
    newest_first = lambda a, b: b["rule_no"] - a["rule_no"]
    return grouped.withColumn("rules", F.array_sort("rules", newest_first))


def _below(path: Column, gi_dir: Column) -> Column:
    return F.when(gi_dir == "", path).otherwise(F.substring(path, F.length(gi_dir) + 2, F.length(path)))


def applicable(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """Nodes with each ignore file of ``placed`` (repo, gi_dir) on their directory chain.

    Which ignore files apply is resolved on distinct directories, so a node is only multiplied by the
    files that really lie above it.
    """
    dirs = nodes.select("repo", "dir").distinct()
    chain = (
        dirs.select("repo", "dir", F.explode(P.dir_chain(F.col("dir"))).alias("gi_dir"))
        .join(placed.select("repo", "gi_dir").distinct(), ["repo", "gi_dir"])
        .groupBy("repo", "dir")
        .agg(F.collect_list("gi_dir").alias("gi_dirs"))
    )
    levels = nodes.select("repo", "path", "name", "dir", "is_dir").join(chain, ["repo", "dir"]).select(
        "repo", "path", "name", "is_dir", F.explode("gi_dirs").alias("gi_dir")
    )
    return levels.withColumn("rel", _below(F.col("path"), F.col("gi_dir")))


def match_ignore_rules(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Every (node, rule) match: (repo, path, gi_dir, gi_depth, rule_no, verdict). ``rules`` is read several
    times: pass a written table."""
    literal = literal_rules(rules)
    keys = F.array(
        F.concat(F.lit("p"), F.col("rel")), F.concat(F.lit("n"), F.col("name")),
        F.concat(F.lit("e"), F.substring_index("name", ".", -1)),
    )
    found = (
        applicable(nodes, literal).select("repo", "path", "name", "gi_dir", F.explode(keys).alias("key"))
        .join(literal, ["repo", "gi_dir", "key"])
        .where(F.col("suffix").isNull() | F.endswith("name", F.col("suffix")))
        .select("repo", "path", "gi_dir", "rule_no", "verdict")
    )
    patterns = pattern_rules(rules)
    hits = F.filter(
        "rules", lambda r: rule_hits(r, F.col("rel"), F.col("name"), F.col("is_dir"))
    )
    tested = (
        applicable(nodes, patterns).join(rule_sets(patterns), ["repo", "gi_dir"])
        .select("repo", "path", "gi_dir", F.explode(hits).alias("rule"))
        .select("repo", "path", "gi_dir", "rule.rule_no", _verdict(F.col("rule.negated")).alias("verdict"))
    )
    return found.unionByName(tested).withColumn("gi_depth", P.depth(F.col("gi_dir")))


def file_verdicts(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Verdict of each ignore file that matched, from its last matching rule."""
    return last_match_wins(match_ignore_rules(nodes, rules))


def last_match_wins(matches: DataFrame) -> DataFrame:
    """Verdict per ignore file from its single matches."""
    return matches.groupBy("repo", "path", "gi_dir", "gi_depth").agg(
        F.max_by("verdict", "rule_no").alias("verdict")
    )


def ignore_hierarchy(verdicts: DataFrame) -> DataFrame:
    """Deeper ignore files override: (repo, path, ignored) for every node some rule matched."""
    return verdicts.groupBy("repo", "path").agg(
        (F.max_by("verdict", "gi_depth") == 1).alias("ignored")
    )


def ignored_nodes(nodes: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """(repo, path) of the nodes that ignore rules exclude. The last rule of the deepest ignore file decides, so
    one aggregation does for both."""
    rules = materialize(compile_ignore_rules(parse_ignore_rules(ignore_files)), "rules")
    return match_ignore_rules(nodes, rules).groupBy("repo", "path").agg(
        F.max_by("verdict", F.struct("gi_depth", "rule_no")).alias("verdict")
    ).where("verdict = 1").select("repo", "path")
