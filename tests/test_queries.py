"""Every query runs on the smallest test tables; those with SQL give DuckDB's rows."""

import glob
import importlib
import os

import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(table):
    table = table[sorted(table.columns)]
    clean = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(map(str, (tuple(clean(getattr(v, "item", lambda v=v: v)()) for v in r) for r in table.itertuples(index=False))))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in entry.oracle_sql()])
def test_against_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


CORE = entry.plans.queries()


@pytest.mark.parametrize("name", [n for n in CORE if n not in entry.oracle_sql()])
def test_runs(spark, name):
    assert CORE[name](spark, DATA).count() > 0


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for f in glob.glob(f"{DATA}/*.parquet"):
        spark.read.parquet(f).limit(0).coalesce(1).write.parquet(str(d / os.path.basename(f)))
    return str(d)


@pytest.mark.parametrize("name", list(CORE))
def test_empty_tables(spark, name, empty):
    """Every query runs over tables without rows."""
    assert CORE[name](spark, empty).count() == 0


def test_columns(spark):
    want = {
        "p3_found": [("cv_id", "bigint"), ("kind", "string"), ("start_months", "int"), ("end_months", "int")],
        "p4_found": [("result_id", "bigint"), ("low_eur_year", "bigint"), ("high_eur_year", "bigint")],
        "p5_found": [("entry_id", "bigint"), ("start_norm", "string"), ("end_norm", "string")],
    }
    for name, cols in want.items():
        df = CORE[name](spark, DATA)
        assert df.dtypes == cols
        assert df.count() == df.distinct().count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_without_the_subpackage():
    """No module outside the optional subpackage imports it."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for path in glob.glob(f"{root}/sparkfolio/**/*.py", recursive=True):
        if "/llm/" not in path:
            text = open(path).read()
            assert "from ..llm" not in text and "from .llm" not in text and "sparkfolio.llm" not in text, path
