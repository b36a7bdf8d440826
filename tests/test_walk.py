from packloom.config import ExportConfig
from packloom.operators import filters, nodes
from packloom.plans import exports
from pyspark.sql import functions as F
from tests.conftest import paths


def reasons(walked):
    return {r.path: r.exclusion_reason for r in walked.collect()}


def test_excluded_directory_is_counted_once(corpus, select):
    files = corpus({"build/a/x.txt": "1", "build/y.txt": "2", "src/z.txt": "3"})
    walked = filters.walk(files, select("build/", "src/"))
    assert reasons(walked) == {"build": "IGNORED_NAME", "src": None, "src/z.txt": None}
    assert filters.exclusion_counts(walked).first().ignored_name == 1


def test_ancestors_above_a_root_do_not_matter(corpus, select):
    files = corpus({"build/gen/x.txt": "1", "build/gen/y.png": "2"})
    walked = filters.walk(files, select("build/gen/", "build/gen/x.txt"))
    assert reasons(walked) == {"build/gen": None, "build/gen/x.txt": None, "build/gen/y.png": "BINARY_CONTENT"}


def test_first_failing_filter_names_the_reason(corpus, select):
    big = "x" * 3000
    files = corpus({
        ".gitignore": "secret*\nhidden/", "a/target": "t", "a/secret.png": "1", "a/pic.PNG": big, "a/big.txt": big,
        "a/nul.txt": "a\0b", "a/ok.txt": "t", "a/hidden/in.txt": "t", "a/other.md": "t", "a/Makefile": "t",
    })
    config = ExportConfig(max_file_size_kb=2, filters_enabled=True, filename_filters=("txt",))
    walked = filters.walk(files, select("a/"), config)
    assert reasons(walked) == {
        "a": None, "a/target": "IGNORED_NAME", "a/secret.png": "GITIGNORE", "a/pic.PNG": "BINARY_CONTENT",
        "a/big.txt": "SIZE_LIMIT", "a/nul.txt": "BINARY_CONTENT", "a/ok.txt": None, "a/hidden": "GITIGNORE",
        "a/other.md": "FILENAME_FILTER", "a/Makefile": "FILENAME_FILTER",
    }
    assert filters.excluded_extensions(walked).first().exts == ["md", "no_extension"]


def test_explicit_file_bypasses_ignore_rules_but_not_names(corpus, select):
    files = corpus({".gitignore": "*.log\nd/", "x.log": "1", "d/y.c": "1", "target": "1"})
    walked = filters.walk(files, select("x.log", "target", "d/"))
    assert reasons(walked) == {"x.log": None, "target": "IGNORED_NAME", "d": "GITIGNORE"}


def test_limit_follows_the_walk_not_the_path_order(corpus, select):
    files = corpus({"s/a.txt": "1", "s/a/z.txt": "2", "s/b.txt": "3", "s/b.png": "4", "t/c.png": "5"})
    walked = filters.walk(files, select("s/", "t/"))
    limited = filters.file_limit(walked, 2)
    assert paths(limited.where("kept")) == ["s/a.txt", "s/a/z.txt"]
    assert paths(limited) == ["s", "s/a", "s/a.txt", "s/a/z.txt"]
    assert filters.exclusion_counts(limited).first().binary_content == 0
    exact = filters.file_limit(walked, 3)
    assert filters.limit_reached(exact, 3).first().limit_reached
    # with exactly as many files as the limit the walk still ends at the last one
    assert "t/c.png" not in paths(exact)


def test_uncounted_files_do_not_use_up_the_limit(corpus, select):
    files = corpus({"s/a.txt": "// Error reading", "s/b.txt": "", "s/c.txt": "x"})
    numbered = filters.file_limit(filters.walk(files, select("s/"), ExportConfig()), 2)
    assert paths(numbered.where("kept")) == ["s/b.txt", "s/c.txt"]
    plain = filters.walk(files, select("s/"), ExportConfig(line_numbers=False))
    assert paths(plain.where("kept")) == ["s/c.txt"]


def test_node_reached_twice_is_one_row(corpus, select):
    files = corpus({"s/a.txt": "1"})
    walked = filters.walk(files, select("s/a.txt", "s/"))
    row = walked.where(F.col("path") == "s/a.txt").collect()
    assert len(row) == 1 and row[0].root_ordinal == 0 and row[0].explicit
    assert nodes.dedup_selection(select("s/", "s/")).count() == 1


def test_custom_filter(corpus, select):
    files = corpus({"s/a.txt": "TODO", "s/b.txt": "fine"})
    config = ExportConfig(extra_filters=(("HAS_TODO", lambda df: F.contains(df.content, F.lit("TODO"))),))
    assert reasons(filters.walk(files, select("s/"), config)) == {"s": None, "s/a.txt": "HAS_TODO", "s/b.txt": None}


def test_custom_filter_position(corpus, select):
    files = corpus({"s/a.png": "TODO"})
    todo = lambda df: F.contains(df.content, F.lit("TODO"))
    last = ExportConfig(extra_filters=(("HAS_TODO", todo),))
    first = ExportConfig(extra_filters=(("HAS_TODO", todo, 0),))
    assert reasons(filters.walk(files, select("s/"), last))["s/a.png"] == "BINARY_CONTENT"
    assert reasons(filters.walk(files, select("s/"), first))["s/a.png"] == "HAS_TODO"


def test_cap_per_group_equals_a_plain_window_on_a_hot_group(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("g"), (F.col("id") * 7919 % 20011).alias("v"))
    for n in (3, 1500):
        got = filters.cap_per_group(df, ["g"], [F.col("v")], n)
        rows = sorted(map(tuple, got.collect()))
        by = {}
        for g, v in sorted(map(tuple, df.collect())):
            by.setdefault(g, []).append(v)
        assert rows == sorted((g, v) for g, vs in by.items() for v in vs[:n])


def test_estimate(corpus, select):
    files = corpus({f"s/{i}.txt": "x" for i in range(7)})
    assert filters.estimate_files(files, select("s/")).first().n_files == 7
    assert filters.estimate_files(files, select("s/"), cap=5).first().n_files == 5


def test_export_keeps_every_file_it_should(corpus, select):
    files = corpus({"s/a.ts": "one\ntwo", "s/b.png": "x", "s/c.md": "t"})
    export = exports.export_selected(files, select("s/"))
    assert {r.path: r.body for r in export.entries.collect()} == {
        "s/a.ts": "// filename: s/a.ts\n1: one\n2: two", "s/c.md": "// filename: s/c.md\n1: t",
    }
    assert export.bundles().first().text == "// filename: s/a.ts\n1: one\n2: two\n// filename: s/c.md\n1: t"


def test_limit_counts_equal_paths_of_two_repositories(corpus, select):
    files = corpus({("p", "a.ts"): "x", ("q", "a.ts"): "y"})
    both = select("a.ts", repo="p").unionByName(select("a.ts", repo="q"))
    kept = exports.export_selected(files, both, ExportConfig(file_limit=1)).kept().collect()
    assert [(r.repo, r.path) for r in kept] == [("p", "a.ts")]
