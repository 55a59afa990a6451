import importlib
import os

import pytest

DATA = "/root/testdata/sf0.001"
queries = importlib.import_module("sparkfolio.llm.queries")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", list(queries.queries()))
def test_runs(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.count() > 0


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in ("redacted_cv", "redaction", "vision_fixtures", "documents", "candidates", "detected", "role_list", "pack_limits", "mix_targets"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).coalesce(1).write.parquet(str(d / f"{t}.parquet"))
    return str(d)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_empty_tables(spark, name, empty):
    """Every query runs over tables without rows."""
    assert queries.queries()[name](spark, empty).count() == 0


def test_columns(spark):
    want = {
        "p1_found": [("field", "string"), ("rec_id", "bigint"), ("kind", "string"), ("mention", "string")], "p2_found": [("cv_id", "bigint"), ("block_no", "int"), ("lang", "string")],
        "p6_found": [("candidate_id", "bigint")], "p7_found": [("cv_id", "bigint"), ("role_id", "int")], "p10_found": [("doc_id", "bigint"), ("text_class", "string")],
    }
    for name, cols in want.items():
        df = queries.queries()[name](spark, DATA)
        assert df.dtypes == cols
        assert df.count() == df.distinct().count()
