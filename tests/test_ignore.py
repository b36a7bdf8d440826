import pytest
from pyspark.sql import functions as F

from packloom.operators import ignore, nodes
from tests.conftest import paths

# (rule, path, is directory, ignored)
CASES = [
    ("*.txt", "file.txt", False, True),
    ("*.txt", "file.jpg", False, False),
    ("*.txt", "path/to/file.txt", False, True),
    ("dir/", "dir", True, True),
    ("dir/", "dir", False, False),
    ("dir/", "dir/file.txt", False, True),
    ("*.log", "debug.log", False, True),
    ("!debug.log", "debug.log", False, False),
    ("/root.txt", "root.txt", False, True),
    ("/root.txt", "subdir/root.txt", False, False),
    ("**/build/", "project/build", True, True),
    ("**/build/", "project/build/output.txt", False, True),
    ("doc/**/*.pdf", "doc/manual.pdf", False, True),
    ("doc/**/*.pdf", "doc/guides/user/manual.pdf", False, True),
    ("\\#file.txt", "#file.txt", False, True),
    ("\\!file.txt", "!file.txt", False, True),
    ("\\!file.txt", "file.txt", False, False),
    ("file\\*.txt", "file*.txt", False, True),
    ("file\\?.txt", "file?.txt", False, True),
    # a rooted glob or directory also matches deeper, through the name
    ("/*.txt", "deep/down/a.txt", False, True),
    ("/build/", "deep/build", True, True),
    ("foo/bar/", "else/bar", True, True),
    # only the prefix and the ending are tested
    ("doc/**/*.pdf", "docs2/x.pdf", False, True),
    # a set works below a directory but not at the root
    ("[ab].txt", "sub/a.txt", False, True),
    ("[ab].txt", "a.txt", False, False),
    ("[!ab].txt", "sub/c.txt", False, True),
    ("[!ab].txt", "sub/a.txt", False, False),
    ("*.{js,ts}", "sub/a.ts", False, True),
    ("*.{js,ts}", "sub/a.css", False, False),
    ("**/x/*.c", "a/b/x/y.c", False, True),
    ("src/?.c", "src/a.c", False, True),
    ("src/?.c", "src/ab.c", False, False),
    # an open set does not compile, only the name pattern is left
    ("[ab*.txt", "[abc.txt", False, True),
    ("a+b(c).t*", "x/a+b(c).tt", False, True),
]


def verdicts(spark, rules, items):
    """rules: {(repo, dir): text}; items: [(repo, path, is_dir)]."""
    gi = spark.createDataFrame([(r, d, t) for (r, d), t in rules.items()], "repo string, gi_dir string, text string")
    compiled = ignore.compile_ignore_rules(ignore.parse_ignore_rules(gi))
    rows = [(r, p, p.split("/")[-1], "/".join(p.split("/")[:-1]), d) for r, p, d in items]
    df = spark.createDataFrame(rows, "repo string, path string, name string, dir string, is_dir boolean")
    whole = {(r.repo, r.path): r.ignored for r in ignore.ignore_hierarchy(ignore.file_verdicts(df, compiled)).collect()}
    single = ignore.last_match_wins(ignore.match_ignore_rules(df, compiled))
    split = {(r.repo, r.path): r.ignored for r in ignore.ignore_hierarchy(single).collect()}
    assert whole == split
    return whole


def test_patterns(spark):
    got = verdicts(
        spark,
        {(f"r{i}", ""): c[0] for i, c in enumerate(CASES)},
        [(f"r{i}", c[1], c[2]) for i, c in enumerate(CASES)],
    )
    for i, case in enumerate(CASES):
        assert got.get((f"r{i}", case[1]), False) == case[3], case


def test_last_rule_of_a_file_decides(spark):
    text = "*.log\n!keep.log\n# note\n\n  keep.*  \r\n!keep.md"
    got = verdicts(spark, {("r", ""): text}, [("r", "keep.log", False), ("r", "a.log", False), ("r", "keep.md", False)])
    assert got == {("r", "keep.log"): True, ("r", "a.log"): True, ("r", "keep.md"): False}


def test_deeper_files_override(spark):
    rules = {("r", ""): "*.log", ("r", "src"): "other.log", ("r", "src/sub"): "!other.log"}
    items = [("r", "src/sub/other.log", False), ("r", "src/other.log", False), ("r", "src/sub/x.log", False), ("r", "src/a.c", False)]
    got = verdicts(spark, rules, items)
    assert got == {("r", "src/sub/other.log"): False, ("r", "src/other.log"): True, ("r", "src/sub/x.log"): True}


def test_rules_stay_in_their_repository(spark, corpus):
    files = corpus({("a", ".gitignore"): "*.log", ("a", "x.log"): "1", ("b", "x.log"): "1"})
    hidden = ignore.ignored_nodes(nodes.expand_nodes(files), ignore.load_ignore_files(files))
    assert [(r.repo, r.path) for r in hidden.collect()] == [("a", "x.log")]


def test_lookup_of_literals_equals_testing_every_rule(spark):
    """Every rule against every node below its ignore file, with and without the index."""
    rules = ["*.log", "*.tar.gz", "*.", "*..", "log", "/log", "a/log", "*.l?g", "*.log/", "/*.log", "!*.log", "*.{a,b}", "*.a,b", "x.log", "**/log",
             "*log", "*.\\a", "log/", "sub/*.log", "*.[l]og", ".log", "*.LOG"]
    names = ["log", "a.log", ".log", "x.tar.gz", "tar.gz", "x.", "x..", "x.a,b", "x.a", "x.b", "x.LOG", "x.log", "l", "x.\\a"]
    items = [(d + n, folder) for d in ("", "a/", "sub/", "sub/log/", "sub/x.log/") for n in names for folder in (False, True)]
    df = spark.createDataFrame(
        [("r", p, p.split("/")[-1], "/".join(p.split("/")[:-1]), d) for p, d in items], "repo string, path string, name string, dir string, is_dir boolean")
    gi = spark.createDataFrame([("r", "", "\n".join(rules)), ("r", "sub", "\n".join(rules[::-1]))], "repo string, gi_dir string, text string")
    compiled = ignore.compile_ignore_rules(ignore.parse_ignore_rules(gi))
    got = [(r.path, r.gi_dir, r.rule_no) for r in ignore.match_ignore_rules(df, compiled).collect()]
    rule = F.struct(*(F.col(f"rules.{c}").alias(c) for c in ignore._RULE_FIELDS))
    pairs = df.join(compiled.alias("rules"), "repo").where((F.col("gi_dir") == "") | F.startswith("path", F.lit("sub/")))
    rel = F.when(F.col("gi_dir") == "", F.col("path")).otherwise(F.substring("path", 5, 100))
    want = [(r.path, r.gi_dir, r.rule_no) for r in pairs.where(ignore.rule_hits(rule, rel, F.col("name"), F.col("is_dir"))).collect()]
    assert sorted(got) == sorted(want) and len(want) > 300


@pytest.mark.parametrize("glob,regex", [("**/*.txt", r"^.*/[^/]*\.txt$"), ("a[!b]{c,d}", "^a[^/b](?:(?:c)|(?:d))$"), ("a{b", None), ("a\\", None)])
def test_path_regex(spark, glob, regex):
    df = spark.createDataFrame([(glob,)], "g string")
    assert df.select(ignore._path_regex(F.col("g"))).first()[0] == regex
