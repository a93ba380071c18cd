import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import types as T

from plumbline.operators import checks as C, trend as TR

R = {i: [C.Result(i, n, v, a, ["src"])] for i, n, v, a in [
    ("metric1", "ROW_COUNT", 314.0, None), ("metric2", "COMPLETENESS", 0.921, None), ("metric4", "SUM_NUMBER", 321.456, None), ("metric6", "DISTINCT_VALUES", 314.0, None), ("zero", "X", 0.0, None), ("nan", "X", math.nan, None)]}
R["metric5"] = [C.Result("metric5", f"TOP_N_{i + 1}", 0.3, v, ["src"]) for i, v in enumerate("abc")]


@pytest.mark.parametrize("kind,spec,status", [
    ("equalTo", {"metric": "metric1", "compareMetric": "metric6"}, "Success"), ("equalTo", {"metric": "metric1", "threshold": 313}, "Failure"), ("lessThan", {"metric": "metric2", "threshold": 0.921}, "Failure"),
    ("lessThan", {"metric": "metric2", "threshold": 0.93}, "Success"), ("greaterThan", {"metric": "metric4", "compareMetric": "metric1"}, "Success"), ("greaterThan", {"metric": "metric1", "threshold": 314}, "Failure"),
    ("differByLT", {"metric": "metric1", "compareMetric": "metric4", "threshold": 0.03}, "Success"), ("differByLT", {"metric": "metric1", "compareMetric": "metric4", "threshold": 0.02}, "Failure"),
    ("differByLT", {"metric": "zero", "compareMetric": "zero", "threshold": 0.1}, "Success"), ("differByLT", {"metric": "metric1", "compareMetric": "zero", "threshold": 0.99}, "Failure"),
    ("differByLT", {"metric": "metric1", "threshold": 0.1}, "Error"), ("equalTo", {"metric": "metric5", "threshold": 1}, "Error"), ("equalTo", {"metric": "none", "threshold": 1}, "Error"),
    ("equalTo", {"metric": "metric1", "compareMetric": "none"}, "Error"), ("equalTo", {"metric": "metric1", "compareMetric": "metric6", "threshold": 1}, "Error")])
def test_snapshot(kind, spec, status):
    assert C.snapshot(kind, {"id": "c", **spec}, R).status == status


@pytest.mark.parametrize("formula,status", [
    ("{{metric1}} == {{metric6}}", "Success"), ("{{metric2}} > 0.95 || {{metric4}} < 1", "Failure"), ("{{nan}} > 1", "Error"), ("{{none}} > 1", "Error"), ("{{metric5}} > 1", "Error"), ("{{metric1}} +", "Error")])
def test_expression(formula, status):
    assert C.expression({"id": "c", "formula": formula}, R).status == status


def _history(values):
    days = [(datetime(2023, 9, 24) - timedelta(days=i), v, None, "X") for i, v in enumerate(values)]
    return lambda ids, kind, rule, window, offset: days[: int(window)] if rule == "record" else days


def test_trend_bounds():
    spec = {"id": "c", "metric": "metric1", "rule": "record", "windowSize": 3}
    h = _history([300, 310, math.nan, 1000])
    for kind, extra, status in [("averageBoundFull", {"threshold": 0.05}, "Success"), ("averageBoundFull", {"threshold": 0.02}, "Failure"), ("averageBoundUpper", {"threshold": 0.02}, "Failure"),
                                ("averageBoundLower", {"threshold": 0.0}, "Success"), ("averageBoundRange", {"thresholdLower": 0, "thresholdUpper": 0.1}, "Success")]:
        got = C.trend(kind, {**spec, **extra}, R, h)
        assert got.status == status, kind
        assert (got.lower_bound is None) == (kind == "averageBoundUpper") and (got.upper_bound is None) == (kind == "averageBoundLower")
    assert C.trend("averageBoundFull", {**spec, "threshold": 1}, R, _history([])).status == "Error"
    assert C.trend("averageBoundFull", {**spec, "threshold": 1}, R, _history([math.nan])).status == "Error"
    assert C.trend("averageBoundFull", {**spec, "metric": "metric5", "threshold": 1}, R, h).status == "Error"


def test_top_rank():
    past = lambda values: lambda *a: [(datetime(2023, 9, 24), 0.1, v, f"TOP_N_{i + 1}") for i, v in enumerate(values)]
    spec = {"id": "c", "metric": "metric5", "targetNumber": 3, "threshold": 0.5}
    assert C.trend("topNRank", spec, R, past("abd")).status == "Success"
    assert C.trend("topNRank", {**spec, "threshold": 0.4}, R, past("abd")).status == "Failure"
    assert C.trend("topNRank", spec, R, past("")).status == "Error"
    assert C.trend("topNRank", {**spec, "metric": "metric1"}, R, past("a")).status == "Error"


def test_load_checks(spark):
    flat = T.StructType.fromDDL("id string, name string, data struct<name:string,values:struct<v1:int>>")
    other = T.StructType.fromDDL("NAME string, ID string, data struct<values:struct<v1:int>,name:string>")
    run = lambda kind, **x: C.load_check(kind, {"id": "c", "source": "s", **x}, flat, {"flat": flat, "other": other}).status
    assert run("exactColumnNum", option=3) == "Success" and run("exactColumnNum", option=2) == "Failure"
    assert run("minColumnNum", option=3) == "Success" and run("minColumnNum", option=4) == "Failure"
    assert run("columnsExist", columns=["ID", "v1"]) == "Success" and run("columnsExist", columns=["x"]) == "Failure"
    assert run("schemaMatch", schema="flat") == "Success" and run("schemaMatch", schema="other") == "Failure"
    assert run("schemaMatch", schema="other", ignoreOrder=True) == "Success" and run("schemaMatch", schema="none") == "Error"
    assert C.load_check("columnsExist", {"id": "c", "source": "s", "columns": ["ID"]}, flat, {}, case_sensitive=True).status == "Failure"
    assert C.load_check("exactColumnNum", {"id": "c", "source": "s", "option": 1}, None, {}).status == "Error"


def test_statistics():
    rng = np.random.default_rng(1)
    v = rng.normal(size=11)
    past = [(datetime(2024, 1, 1) + timedelta(days=i), x) for i, x in enumerate(v)] + [(datetime(2023, 1, 1), math.nan)]
    at = datetime(2024, 1, 13)
    for kind, want in [("avg", v.mean()), ("std", v.std(ddof=1)), ("min", v.min()), ("max", v.max()), ("sum", v.sum()), ("median", np.median(v)), ("firstQuartile", np.quantile(v, 0.25)), ("thirdQuartile", np.quantile(v, 0.75))]:
        assert TR.evaluate(kind, {}, past, at)[0] == pytest.approx(want)
    assert TR.evaluate("quantile", {"quantile": 0.9}, past, at)[0] == pytest.approx(np.quantile(v, 0.9))
    a, b = np.polyfit(range(11), v, 1)
    assert TR.evaluate("linearRegression", {}, past, at)[0] == pytest.approx(a * 12 + b)
    with pytest.raises(ValueError):
        TR.evaluate("avg", {}, [], at)
    with pytest.raises(ValueError):
        TR.evaluate("linreg", {}, past[:1], at)


def test_arima():
    rng = np.random.default_rng(2)
    x = [0.0]
    for _ in range(400):
        x.append(2 + 0.6 * x[-1] + rng.normal(scale=0.1))
    assert TR.arima(np.array(x[20:]), 1, 0, 0)[0] == pytest.approx(2 + 0.6 * x[-1], abs=0.1)
    e = rng.normal(scale=0.5, size=500)
    y = 3 + e[1:] + 0.5 * e[:-1]
    assert TR.arima(y, 0, 0, 1)[0] == pytest.approx(3 + 0.5 * e[-1], abs=0.15)
    assert TR.arima(np.cumsum(y), 1, 1, 1)[0] - np.cumsum(y)[-1] == pytest.approx(3 + 0.5 * e[-1], abs=0.3)
    line = np.arange(30.0) * 2 + 5
    assert TR.arima(line + rng.normal(scale=1e-6, size=30), 1, 1, 0)[0] == pytest.approx(65, abs=1e-3)
    with pytest.raises(ValueError):
        TR.arima(np.ones(5), 1, 0, 1)
