"""Joins over whole tables, with keys that only one side has."""

import pytest

from plumbline.queries import QUERIES


@pytest.mark.parametrize("how, n", [("inner", 3), ("left", 4), ("right", 4), ("full", 5), ("semi", 3), ("anti", 1)])
def test_whole_join(spark, tmp_path, how, n):
    spark.createDataFrame([(1, 10), (1, 11), (2, 12), (7, 13)], "o_custkey bigint, o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(-49, "a"), (-48, "b"), (-47, "c")], "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert QUERIES[f"virtual_join_{how}"](spark, str(tmp_path)).count() == n
