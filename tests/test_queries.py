"""Every registered core query against its SQL twin, and the driver's contract."""

import importlib

import pytest

from pulseloom.plans import feature_queries, interval_queries, pipeline, problem_queries, signal_queries
from tests.helpers import same_as_sql

MODULES = (problem_queries, interval_queries, signal_queries, feature_queries, pipeline)
CORE = {name: (q, m.oracle_sql().get(name)) for m in MODULES for name, q in m.queries().items()}


@pytest.mark.parametrize("name", [n for n, (_, sql) in CORE.items() if sql])
def test_query_equals_sql(name, spark, sf_dir, duck):
    query, sql = CORE[name]
    same_as_sql(query(spark, sf_dir), duck, sql)


@pytest.mark.parametrize("name", [n for n, (_, sql) in CORE.items() if not sql])
def test_query_without_sql_runs(name, spark, sf_dir):
    df = CORE[name][0](spark, sf_dir)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_entry_and_registry(spark, sf_dir):
    driver = importlib.import_module("__spark_entry__")
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(CORE) <= set(driver.queries())


def test_core_does_not_import_the_optional_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; from pulseloom.plans import feature_queries, interval_queries, pipeline, problem_queries, signal_queries; assert not [m for m in sys.modules if m.startswith('pulseloom.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
