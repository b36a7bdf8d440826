import datetime as dt

from pyspark.sql import functions as F

from packloom.config import ExportConfig
from packloom.operators import render, summary
from packloom.plans import exports
from packloom.sources import corpus_io
from packloom.streaming import jobs
from tests.conftest import paths

NOW = "2024-03-01 12:00:00"


def entries_of(spark, *rows):
    return spark.createDataFrame([(1, "r", p, b, len(b) // 2) for p, b in rows], "export_id bigint, repo string, path string, body string, approx_tokens bigint")


def test_formats(spark):
    e = entries_of(spark, ("b/y.kt", "// filename: b/y.kt\n1: val y"), ("a/x.py", "# filename: a/x.py\n1: x"))
    assert render.render_plain(e).first().text == "# filename: a/x.py\n1: x\n// filename: b/y.kt\n1: val y"
    assert render.render_markdown(e).first().text == "### a/x.py\n\n```python\n1: x\n```\n\n### b/y.kt\n\n```kotlin\n1: val y\n```\n\n"
    # without headers the first line stays
    assert "```python\n# filename" in render.render_markdown(e, path_header=False).first().text
    xml = render.render_xml(entries_of(spark, ("a&<b>.ts", "x ]]> y"))).first().text
    assert xml == '<files>\n  <file path="a&amp;&lt;b&gt;.ts">\n    <content><![CDATA[\nx ]]> y\n    ]]></content>\n  </file>\n</files>'


def test_directory_tree(spark):
    e = entries_of(spark, *[(p, "x") for p in ["src/main/A.kt", "src/main/B.kt", "src/test/T.kt", "docs/r.md", "z.txt", "a.txt"]])
    assert render.directory_tree(e, True).first().text == "\n".join([
        "// Directory structure", "// ├── docs", "// │   └── r.md", "// ├── src", "// │   ├── main", "// │   │   ├── A.kt",
        "// │   │   └── B.kt", "// │   └── test", "// │       └── T.kt", "// ├── a.txt", "// └── z.txt", "// End of directory structure",
    ])
    assert render.directory_tree(e).first().text == "\n".join([
        "// Directory structure", "// ├── docs", "// └── src", "//     ├── main", "//     └── test", "// End of directory structure",
    ])


def test_bundle_puts_tree_and_summary_first(spark):
    e = entries_of(spark, ("a.kt", "// filename: a.kt\nx"))
    config = ExportConfig(directory_tree=True, repo_summary=True)
    text = render.pack_bundles(e, config, summary.repo_summary(e, None, NOW)).first().text
    assert text.startswith("// Directory structure\n// End of directory structure\n\n**Repository Info**\n")
    assert text.endswith("\n\n// filename: a.kt\nx")


def test_summary_numbers(spark):
    e = entries_of(spark, ("a.kt", "// filename: a.kt\n" + "x" * 30), ("b.kt", "// filename: b.kt\n" + "y" * 10), ("c.py", "# filename: c.py\nz"))
    text = summary.repo_summary(e, None, NOW).first().text
    # the Python entry is a file but not in the figures
    assert "Total Files\n    3 files\nTotal Size\n    40 chars\nTotal Tokens\n    2 tokens\n" in text
    assert "    a.kt\n    30 chars | 1 tokens | 75.0%\n    b.kt\n    10 chars | 1 tokens | 25.0%\n" in text
    assert "    01.03.2024, 12:00:00\n" in text and "Not a Git repository" in text
    urls = spark.createDataFrame([(1, "ssh://h/a&b")], "export_id bigint, url string")
    assert "<repository-url>ssh://h/a&amp;b</repository-url>" in summary.repo_summary(e, urls, NOW, "xml").first().text
    assert "### a.kt\n30 chars | 1 tokens | 75.0%\n\n" in summary.repo_summary(e, urls, NOW, "markdown").first().text


def test_percentages_sum_up_and_top_is_stable(spark):
    rows = [(1, f"p{i:02}", 7 if i < 12 else 3, 1) for i in range(30)]
    stats = spark.createDataFrame(rows, "export_id bigint, path string, chars bigint, tokens bigint")
    assert abs(summary.pct_of_total(stats).agg(F.sum("pct")).first()[0] - 100) < 1e-9
    assert [r.path for r in summary.top_files(stats).orderBy("rank").collect()] == [f"p{i:02}" for i in range(10)]


def test_history_keeps_the_newest(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("r", i, t0 + dt.timedelta(minutes=i)) for i in range(15)] + [("q", 99, t0)]
    history = spark.createDataFrame(rows, "repo string, export_id bigint, ts timestamp")
    kept = summary.recent_exports(history)
    assert sorted(r.export_id for r in kept.where("repo = 'r'").collect()) == list(range(5, 15))
    assert kept.count() == 11


def test_diff(spark, corpus):
    cur = spark.createDataFrame([(1, "r", p) for p in ("src/New.kt", "same", "gone/New")], "export_id bigint, repo string, path string")
    last = spark.createDataFrame([(1, "r", p) for p in ("src/Old.kt", "same", "same")], "export_id bigint, repo string, path string")
    got = {r.path: r.status for r in summary.export_diff(cur, last).collect()}
    assert got == {"src/New.kt": "added", "gone/New": "added", "src/Old.kt": "removed", "same": "unchanged"}
    assert tuple(summary.diff_counts(summary.export_diff(cur, last)).first())[1:] == (2, 1, 1)
    files = corpus({"src/New.kt": "x", "same": "y"})
    assert paths(summary.changes_only(cur, last, files)) == ["src/New.kt"]
    assert paths(exports.export_changes_only(files, cur, last).entries) == ["src/New.kt"]


def test_diff_of_two_repositories(spark):
    schema = "export_id bigint, repo string, path string"
    cur = spark.createDataFrame([(1, "p", "a.ts"), (1, "q", "a.ts")], schema)
    last = spark.createDataFrame([(1, "p", "a.ts")], schema)
    assert [r.repo for r in summary.diff_added(cur, last).collect()] == ["q"]
    assert {r.repo: r.status for r in summary.export_diff(cur, last).collect()} == {"p": "unchanged", "q": "added"}


def test_recent_and_last_commit(spark, corpus):
    t = dt.datetime(2024, 3, 1, 12)
    times = spark.createDataFrame([("r", "a", t), ("r", "b", t - dt.timedelta(hours=24)), ("r", "c", t - dt.timedelta(days=7))], "repo string, path string, mtime timestamp")
    assert paths(summary.recent_changes(times, NOW)) == ["a"]
    commits = spark.createDataFrame(
        [("r", 1, t, "a", "modified"), ("r", 2, t + dt.timedelta(hours=1), "b", "added"), ("r", 2, t + dt.timedelta(hours=1), "gone", "modified"), ("r", 2, t + dt.timedelta(hours=1), "c", "deleted")],
        "repo string, commit_id bigint, committed_at timestamp, path string, change_type string",
    )
    files = corpus({"a": "1", "b": "2", "c": "3"})
    assert paths(summary.last_commit_files(commits, files)) == ["b"]
    assert paths(exports.export_last_commit(files, commits).entries) == ["b"]


def test_scan_a_tree_and_write_bundles(spark, select, tmp_path):
    tree = tmp_path / "trees"
    for path, data in {"one/src/a.py": b"x = 1\n", "one/b.bin": b"\0\1", "two/src/c.kt": "grün".encode(), "one/bad.txt": b"\xff\xfe\xfd"}.items():
        target = tree / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    files = corpus_io.scan_files(spark, str(tree))
    rows = {(r.repo, r.path): (r.size_bytes, r.content) for r in files.collect()}
    assert rows["one", "src/a.py"] == (6, "x = 1\n") and rows["two", "src/c.kt"] == (5, "grün")
    export = exports.export_selected(files, select("src/", "b.bin", "bad.txt", repo="one"))
    assert paths(export.entries) == ["src/a.py"]
    assert {r.path: r.exclusion_reason for r in export.walked.where("not is_dir").collect()} == {
        "src/a.py": None, "b.bin": "BINARY_CONTENT", "bad.txt": "BINARY_CONTENT",
    }
    out = str(tmp_path / "out")
    corpus_io.write_bundles(export.bundles(), out)
    assert spark.read.parquet(out).first().text == "# filename: src/a.py\n1: x = 1\n2: \n"
    corpus_io.write_bundle_text(render.bundle_rows(export.entries), str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).count() > 0
    history = str(tmp_path / "hist")
    for _ in range(2):
        corpus_io.append_history(summary.history_rows(export.entries, export.bundles(), NOW), history)
    assert [r.file_count for r in spark.read.parquet(history).collect()] == [1, 1]
    loaded = str(tmp_path / "files")
    files.select("repo", "path", "content").write.parquet(loaded)
    assert corpus_io.load_files(spark, loaded).where("path = 'src/a.py'").first().size_bytes == 6


def test_history_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    schema = "repo string, export_id bigint, ts timestamp"
    source, table, mark = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "mark")
    rows = [("r" if i % 3 else "q", i, t0 + dt.timedelta(minutes=(i * 37) % 101)) for i in range(60)]
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.stream_history(stream, table, mark, 10).awaitTermination()
    got = sorted(map(tuple, jobs.latest_history(spark, table, stream.schema).collect()))
    assert got == sorted(map(tuple, summary.recent_exports(spark.createDataFrame(rows, schema), 10).collect()))


def _sessions(rows, gap):
    """Lines of each (trace, session start), by brute force."""
    found = {}
    for trace in {r[1] for r in rows}:
        last = None
        for ts, _, n, line in sorted(r for r in rows if r[1] == trace):
            if last is None or ts - last > gap:
                start = ts
            last = ts
            found.setdefault((trace, start), []).append((n, line))
    return {k: sorted(v) for k, v in found.items()}


def test_trace_stream_is_the_same_for_any_batches(spark, tmp_path):
    """One batch and many give the batch job's text of every closed session: several sessions of one trace,
    lines of a session in several batches, and lines that come late but within the delay."""
    from packloom.operators import traces

    t0, minute = dt.datetime(2024, 1, 1), dt.timedelta(minutes=1)
    rows = []
    for i in range(30):
        lines = ["E: x"] + [f"\tat java.util.A{j}.run(S.java:{j})" for j in range(2 + i % 5)]
        rows += [(t0 + i * 60 * minute + n * minute, i % 25, n + 10 * (i // 25), line) for n, line in enumerate(lines)]
    rows += [(t0 + (60 * i + 9) * minute, i % 25, 90, "late") for i in range(3, 30, 4)]
    schema = "ts timestamp, trace_id bigint, line_no bigint, line string"
    classes = spark.createDataFrame([("q",)], "class_name string")
    ordered = sorted(rows)
    swapped = [ordered[i ^ 1] if i ^ 1 < len(ordered) else ordered[i] for i in range(len(ordered))]
    results = []
    for name, parts in {"one": [rows], "many": [swapped[i: i + 17] for i in range(0, len(swapped), 17)]}.items():
        source, out, mark = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "mark"))
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            jobs.stream_fold_traces(spark.readStream.schema(schema).parquet(source), classes, out, mark).awaitTermination()
        got = spark.read.schema("trace_id bigint, session_start timestamp, text string").parquet(f"{out}/batch=*").collect()
        results.append({(r.trace_id, r.session_start): r.text for r in got})
        assert len(got) == len(results[-1])
    sessions = _sessions(rows, 10 * minute)
    closing = max(r[0] for r in rows) - 60 * minute
    ends = {k: max(ts for ts, trace, n, line in rows if trace == k[0] and (n, line) in v and k[1] <= ts) for k, v in sessions.items()}
    closed = {k: v for k, v in sessions.items() if ends[k] + 10 * minute <= closing}
    keyed = [(f"{k}", n, line) for k, v in closed.items() for n, line in v]
    batch = traces.fold_traces(spark.createDataFrame(keyed, "trace_id string, line_no bigint, line string"), classes).collect()
    want = {r.trace_id: r.text for r in batch}
    assert len(want) > 25 and results[0] == results[1]
    assert {f"{k}": v for k, v in results[0].items()} == want


def test_charsets(spark):
    from packloom.functions import text as T

    text = "grün 日本 𝄞 x"
    cases = {
        "plain": (text.encode(), text), "marked": (b"\xef\xbb\xbf" + text.encode(), text),
        "be": (b"\xfe\xff" + text.encode("utf-16-be"), text), "le": (b"\xff\xfe" + text.encode("utf-16-le"), text),
        "latin": ("größer, déjà vu".encode("latin-1"), "größer, déjà vu"), "empty": (b"", ""), "ascii": (b"a\nb", "a\nb"),
        "damaged": ("grün ".encode() + b"\xff!", "grün \ufffd!"), "odd": (b"\xff\xfea", "ÿþa"), "lone": (b"\xfe\xff\xd8\x00\x00a", "þÿØ\x00\x00a"),
        "only a mark": (b"\xff\xfe", ""), "none": (None, "// Error reading file: none"),
    }
    df = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, (b, _) in cases.items()], "path string, content binary")
    got = dict(df.select("path", T.read_text(F.col("content"), F.col("path"))).collect())
    assert got == {k: t for k, (_, t) in cases.items()}


def test_diff_text(spark):
    schema = "export_id bigint, repo string, path string"
    current = spark.createDataFrame([(1, "r", "b"), (1, "r", "a"), (1, "q", "a"), (1, "r", "same"), (2, "r", "x")], schema)
    last = spark.createDataFrame([(1, "r", "same"), (1, "r", "gone"), (2, "r", "x")], schema)
    sizes = spark.createDataFrame([(1, 4, 2048, 1500), (2, 1, 10, 3)], "export_id bigint, file_count bigint, size_bytes bigint, tokens bigint")
    before = spark.createDataFrame([(1, "2 files, 1.0 KB, ~9 tokens")], "export_id bigint, summary string")
    got = dict(summary.diff_text(summary.export_diff(current, last), before, sizes).collect())
    assert got == {
        1: "Export Diff Summary\n===================\n\nPrevious: 2 files, 1.0 KB, ~9 tokens\nCurrent: 4 files, 2.0 KB, ~1,500 tokens\n\n"
           "Added Files (3):\n+ a\n+ a\n+ b\n\nRemoved Files (1):\n- gone\n",
        2: "Export Diff Summary\n===================\n\nPrevious: \nCurrent: 1 files, 0.0 KB, ~3 tokens\n\n",
    }


def test_summary_by_the_setting_alone(spark, corpus, select):
    config = ExportConfig(repo_summary=True, generated_at=NOW)
    export = exports.export_selected(corpus({"a.ts": "x", "b.ts": "y"}), select("a.ts", "b.ts"), config)
    text = export.bundles().first().text
    assert text.startswith("**Repository Info**") and "01.03.2024, 12:00:00" in text and text.endswith("1: y")
    assert export.bundles(urls=spark.createDataFrame([(1, "git://here")], "export_id bigint, url string")).first().text.count("git://here") == 1
