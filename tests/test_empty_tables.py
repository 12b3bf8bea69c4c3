"""Queries that write, stream or iterate give a result on empty tables too."""

import pytest

from civitas.plans import QUERIES
from civitas.schemas import TABLES
from civitas.session import work_dir

KEYS = """q_stream_upsert q_stream_monthly q_stream_dedup q_stream_outcomes q_upsert q_upsert_strict q_upsert_files
    q_distinct_rollup q_scd2 q_scd2_overlap q_levels q_quantile_state q_outlier_null_group q_search_terms q_name_fuzzy
    q_csv_quarantine q_json_drift q_period_skip q_sorted_zorder q_bucketed_join q_list_tables""".split()
# a total over nothing is one row; the catalog has its tables
ROWS = {"q_distinct_rollup": 1, "q_list_tables": len(TABLES)}


@pytest.fixture(scope="module")
def empty(spark):
    root = work_dir(spark, "t-empty")
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{name}.parquet")
    return root


@pytest.mark.parametrize("key", KEYS)
def test_empty_tables(spark, empty, key):
    assert QUERIES[key](spark, empty).count() == ROWS.get(key, 0)
