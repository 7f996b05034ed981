"""Every registered query next to its SQL, and the shape of the plans."""

from importlib import import_module

import pytest

import __spark_entry__ as entry
import oracle_compare as oc

SF = "/root/testdata/sf0.001"
# the training-data operators have tests of their own
MODULES = [import_module(f"driver_queries.{name}") for name in entry._SUBJECTS]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}

# Operators whose work needs Python: entity decoding, chunking, admission.
PYTHON_ALLOWED = {
    "clean_html", "policy_body", "chunk_text", "chunk_numbering", "write_policy_chunks",
    "emit_counts", "request_admission", "union_files",
}


@pytest.fixture(scope="module")
def con():
    return oc.connect(SF)


def check_plan(name, df):
    """No products, and Python only where the operator needs it."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON_ALLOWED:
        assert "Python" not in plan and "InPandas" not in plan


def planned(name):
    def query(spark, sf_dir):
        df = QUERIES[name](spark, sf_dir)
        check_plan(name, df)
        return df

    return query


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_same_rows_as_sql(spark, con, name):
    assert oc.differences(spark, con, SF, planned(name), SQL[name]) == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_has_rows(spark, name):
    assert planned(name)(spark, SF).count() > 0


def test_sql_and_queries_have_no_strays():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
