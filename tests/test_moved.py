"""What moves through the driver and between tasks."""
import pytest

from packloom.operators import graph, inherit
from packloom.plans import exports


@pytest.fixture
def written(monkeypatch):
    """(label, columns, physical plan) of every table that is written."""
    seen = []

    def recording(module):
        real = module.materialize

        def materialize(df, label="table", *by):
            seen.append((label, df.columns, df._jdf.queryExecution().executedPlan().toString()))
            return real(df, label, *by)

        monkeypatch.setattr(module, "materialize", materialize)

    for module in (graph, exports, inherit):
        recording(module)
    return seen


CHAIN = [("r", f"f{i}", f"f{i + 1}", False) for i in range(12)] + [("r", "f12", "f0", False)]


def test_no_round_of_the_closure_is_broadcast(spark, select, written):
    edges = spark.createDataFrame(CHAIN, "repo string, src string, dst string, dst_is_dir boolean")
    reached = graph.transitive_imports(select("f0"), edges)
    assert {(r.path, r.depth) for r in reached.collect()} == {(f"f{i}", i) for i in range(1, 13)}
    assert "BroadcastHashJoin" not in reached._jdf.queryExecution().executedPlan().toString()
    rounds = [plan for label, _, plan in written if label in ("level", "levels")]
    assert len(rounds) > 3 and not any("BroadcastHashJoin" in plan for plan in rounds)


def test_dependents_are_not_broadcast(spark, corpus, select, written):
    files = corpus({"a/x.ts": "t", "a/y.ts": 'import x from "./x"\n', "a/z.ts": 'import y from "./y"\n'})
    edges = spark.createDataFrame([("r", "a/y.ts", "a/x.ts", False), ("r", "a/z.ts", "a/y.ts", False)], "repo string, src string, dst string, dst_is_dir boolean")
    found = graph.bidirectional(select("a/x.ts"), files, edges)
    assert [r.path for r in found.collect()] == ["a/y.ts"]
    plans = [plan for label, _, plan in written if label in ("importers", "level")]
    assert not any("BroadcastHashJoin" in plan for plan in plans)


def test_subtypes_are_not_broadcast(corpus, select, written):
    files = corpus({"A.java": "class A {}", "B.java": "class B extends A {}", "C.java": "class C extends B {}"})
    assert sorted(r.path for r in inherit.jvm_implementations(select("A.java"), files).collect()) == ["B.java", "C.java"]
    assert not any("BroadcastHashJoin" in plan for label, _, plan in written if label == "level")


def test_choosing_files_writes_and_moves_no_texts(corpus, select, written):
    made = {"a/x.ts": 'import y from "./y"\n', "a/y.ts": "t", ".gitignore": "*.no\n", "a/other.ts": "o"}
    files = corpus(made)
    export = exports.export_transitive_imports(files, select("a/x.ts", ".gitignore"))
    kept = export.kept()
    assert sorted(r.path for r in kept.collect()) == [".gitignore", "a/x.ts", "a/y.ts"]
    assert not any({"content", "body", "ignore_text"} & set(columns) for _, columns, _ in written)
    got = {r.path: r.body for r in export.entries.collect()}
    assert set(got) == {".gitignore", "a/x.ts", "a/y.ts"} and all(made[p].strip() in body for p, body in got.items())
