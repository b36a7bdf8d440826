"""The driver contract, and Spark against DuckDB for a few whole queries on the smallest tables."""
import sys

import pytest

import __spark_entry__ as contract
from checks.compare import differences, duck


def test_keys():
    queries, sqls = contract.queries(), contract.oracle_sql()
    assert set(sqls) <= set(queries)
    own = {q for q in queries if q != "pipeline" and not q.startswith("op")}
    assert own - set(sqls) == {"export_implementations_of"}


def test_entry_without_the_training_data_operators(monkeypatch):
    """Whatever they need is missing: the other queries stay."""
    monkeypatch.setitem(sys.modules, "packloom.llm", None)
    queries = contract.queries()
    assert "export_selected" in queries and not any(q == "pipeline" or q.startswith("op") for q in queries)
    assert set(contract.oracle_sql()) <= set(queries)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 20 and all(r.kept_files > 0 for r in rows)


@pytest.mark.parametrize("name", ["exclusion_counts", "import_edges", "implementations", "fold_traces", "render_xml"])
def test_against_sql(spark, tables, name):
    got = contract.queries()[name](spark, tables).toPandas()
    assert differences(got, duck(tables).execute(contract.oracle_sql()[name]).df()) == []
