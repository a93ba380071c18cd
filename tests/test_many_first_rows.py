"""Cuts to many rows: no group meets in one task, equal rows and null keys included."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators.metrics import Metric
from plumbline.plans import fuse


@pytest.mark.parametrize("n", [400, 1000, 1500, 2000, 1 << 30])
def test_as_by_sorting(spark, monkeypatch, n):
    monkeypatch.setattr(fuse, "MANY", 100)
    rows = [("a", f"{i * 7919 % 1500:05}") for i in range(1500)] + [("b", "same")] * 1200 + [(None, f"{i % 3}") for i in range(1001)] + [("c", None), ("c", "x")]
    df = spark.createDataFrame(rows, "g string, v string").repartition(4)
    got = fuse.first_rows(df, ["g"], F.col("v"), n)
    assert got.columns == ["g", "v"]
    by = {}
    for g, v in got.collect():
        by.setdefault(g, []).append(v)
    for g in ("a", "b", "c", None):
        assert sorted(by[g], key=lambda v: v or "") == sorted((v for h, v in rows if h == g), key=lambda v: v or "")[:n]
    one = fuse.first_rows(df.select("v"), [], F.col("v"), n)
    assert one.count() == min(n, len(rows)) and fuse.first_rows(df.limit(0), ["g"], F.col("v"), n).count() == 0


def test_whole_dump_is_not_sorted(spark):
    """All failing rows of a metric met in one task's window."""
    df = spark.range(40_000).select("id", F.lit("x").alias("flag"))
    got = fuse.errors(df, [Metric("f", "stringInDomain", "s", ["flag"], {"domain": ["y"]})], ["id"], 1 << 30)
    assert got.count() == 40_000 and got.select(F.col("row_data")["id"]).distinct().count() == 40_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
