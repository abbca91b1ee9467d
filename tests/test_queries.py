"""Every query against its SQL on the smallest tables."""

import os

import pytest

from cohortlens.catalog import all_queries, all_sql
from compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = all_sql()
# Model fits dominate the run time; the quick run keeps one of each kind.
SLOW = {
    "m7_trained_with_smote", "h6_best_model_explained", "x12_topic_study", "x4_optimal_topics",
    "r2_explained_notes",
}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    if name in SLOW and not os.environ.get("ALL_QUERIES"):
        pytest.skip("slow; set ALL_QUERIES=1")
    fn = all_queries()[name]
    if name in SQL:
        assert compare(spark, duck, fn, SQL[name], SF_DIR) is None
    else:
        assert fn(spark, SF_DIR).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(all_queries())
