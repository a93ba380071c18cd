"""Exact quantiles of a whole frame agree with ``percentile`` and gather no values in one task."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.metrics import Metric
from plumbline.plans import fuse

INF, NAN = math.inf, math.nan
SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
COLUMNS = {
    "plain": [float(x * 7919 % 2003) / 100 for x in range(2003)], "signs": [x / 3 for x in range(-50, 51)], "one": [4.5], "none": [], "same": [2.5] * 9, "pair": [1.0, 2.0],
    "wide": [s * 10.0 ** e for e in range(-308, 309, 7) for s in (-1, 1)] + [5e-324, -5e-324, 0.0, -0.0, 1.7e308, -1.7e308],
    "near": [1.0 + k * 2.0 ** -52 for k in range(300)] + [1e300, -1e300], "odd": [NAN, NAN, INF, -INF, 1.0, 2.0, 3.0], "zeros": [0.0, -0.0, 0.0, 1.0], "skewed": [1.0] * 500 + [random.Random(1).expovariate(1e-9) for _ in range(500)]}


def _key(x):
    return None if x is None else "nan" if x != x else x


@pytest.mark.parametrize("name", COLUMNS)
def test_as_percentile(spark, name):
    df = spark.createDataFrame([(x, -1.0 if x is None else 1.0) for x in [*COLUMNS[name], None]], "x double, other double").repartition(3)
    ms = [Metric(f"q{q}", "getQuantile", "s", ["x"], {"mode": "exact", "target": q}) for q in SHARES]
    got = fuse.fused(df, [*ms[:3], Metric("n", "rowCount", "s", [], {}), *ms[3:], Metric("m", "medianValue", "s", ["other"], {"mode": "exact"})]).first()
    want = df.agg(*[F.coalesce(F.percentile("x", F.lit(q)), F.lit(NAN)) for q in SHARES], F.percentile("other", F.lit(0.5))).first()
    assert got[3] == len(COLUMNS[name]) + 1
    assert [_key(x) for i, x in enumerate(got) if i != 3] == [_key(x) for x in want]


def test_no_task_gathers_values(spark):
    """Of 200,000 distinct values the sole reader of ``percentile`` took all, from each task."""
    df = spark.range(0, 200_000, 1, 4).select((F.col("id") * 31 % 200_000 / 7).alias("x"))
    got = fuse.fused(df, [Metric("m", "medianValue", "s", ["x"], {"mode": "exact"})])
    assert got.first()[0] == pytest.approx(199_999 / 14)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and plan.count("BroadcastExchange") >= 3
