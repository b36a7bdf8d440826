"""Exports whose queries take every file: more of them than the default file limit."""
import pytest

import __spark_entry__ as contract
from packloom.config import ExportConfig
from packloom.plans import catalog, exports

WHOLE = ["export_transitive_imports", "export_tests", "export_resources", "export_last_commit"]


@pytest.mark.parametrize("name", WHOLE)
def test_sql_has_no_file_limit(name):
    assert "rk <= 200" not in contract.oracle_sql()[name]


@pytest.mark.parametrize("name", WHOLE)
def test_query_asks_for_all_files(monkeypatch, name):
    asked = []

    class Kept:
        def kept(self):
            return self

        def drop(self, _):
            return self

    def export(*args, **_):
        asked.append(next(a for a in args if isinstance(a, ExportConfig)))
        return Kept()

    monkeypatch.setattr(exports, name, export)
    class Views:
        def __getattr__(self, _):
            return None

    monkeypatch.setattr(catalog, "Corpus", lambda *_: Views())
    catalog.QUERIES[name](None, "none")
    assert [c.file_limit for c in asked] == [None]


def test_last_commit_keeps_every_file(spark, tmp_path):
    rows = [(49 + 100 * i, f"text {i}", None, None, 6) for i in range(260)]  # all in one repository and in its last commit
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        str(tmp_path / "documents.parquet"))
    files = {r.path for r in contract.queries()["scan_files"](spark, str(tmp_path)).collect()}
    got = [r.path for r in contract.queries()["export_last_commit"](spark, str(tmp_path)).collect()]
    assert len(files) > 200 and set(got) <= files and len(got) == len(set(got)) > 200


def test_related_files_beyond_the_default_limit(corpus, select):
    made = {"a/x.ts": "".join(f'import v{i} from "./m{i}"\n' for i in range(230)), **{f"a/m{i}.ts": "t" for i in range(230)}}
    files, chosen = corpus(made), select("a/x.ts")
    assert exports.export_transitive_imports(files, chosen, ExportConfig(file_limit=None)).kept().count() == 231
    assert exports.export_transitive_imports(files, chosen, ExportConfig()).kept().count() == 200
