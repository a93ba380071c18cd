"""The golden table of twelve rows: the documented value of every metric."""

import math

import pytest

from plumbline.operators.metrics import KINDS, Metric, problems
from plumbline.plans import fuse

ROWS = [
    ("monkey", "", "4", 5.94, 1, "2022-01-01", "2022-01-01"), ("monkey", "7.71", "3.14", 1.72, 2, "1999-12-31", "2000-01-01"), ("turtle", "2.54", "foo", None, None, "2005-03-03", ""),
    ("rabbit", "2.16", "3.0", 5.87, 3, None, "2010-10-18"), ("monkey", None, "-25.321", 2.54, 4, "2022-01-01", "2022-01-01"), ("", "2.54", "-25.321", 5.94, 5, "01-12-2012", "01-12-2012"),
    (None, "2.54", "[12, 35]", 5.94, 7, "12-05-2005", "25-04-2024"), ("turtle", "7.71", "true", 1.72, 8, "2022-01-01 12:31:48", "2022-01-01 07:12:34"),
    ("rabbit", "2.16", None, 5.87, 9, "2001-05-25 09:03:13", "2001-05-25 09:03:13"), ("turtle", "7.71", "4", 1.72, 10, "2011-04-07 19:48:32", "2003-09-01 12:11:10"),
    ("jaguar", "6.85", "bar", 8.26, 12, "13:03:51", "06:33:07"), ("jaguar", "6.85", "3123dasd", 8.26, 13, "15:16:17", "15:16:17")]
SCHEMA = "textCol1 string, textCol2 string, textCol3 string, numCol1 double, rangeCol int, dateCol1 string, dateCol2 string"
T1, T2, T3, N1, D1, D2 = "textCol1", "textCol2", "textCol3", "numCol1", "dateCol1", "dateCol2"
EXACT = {"mode": "exact"}
GOLDEN = [
    ("rowCount", [], {}, 12), ("distinctValues", [T1], {}, 5), ("distinctValues", [T1, T3], {}, 12), ("duplicateValues", [T1], {}, 6), ("nullValues", [T1], {}, 1), ("nullValues", [T1, T3], {}, 2),
    ("emptyValues", [T1], {}, 1), ("emptyValues", [T1, T2], {}, 2), ("completeness", [T1], {}, 0.91666), ("emptiness", [T1, T2], {"includeEmptyStrings": True}, 0.16666),
    ("sequenceCompleteness", ["rangeCol"], {"increment": 1}, 0.84615), ("minString", [T1, T2], {}, 0), ("maxString", [T1, T2], {}, 6), ("avgString", [T1], {}, 5.4545), ("avgString", [T1, T2], {}, 4.5454),
    ("stringLength", [T2], {"length": 4, "compareRule": "eq"}, 10), ("stringLength", [T2, T3], {"length": 4, "compareRule": "eq"}, 12),
    ("stringInDomain", [T1, T2], {"domain": ["rabbit", "jaguar", "2.16"]}, 6), ("stringOutDomain", [T1], {"domain": ["rabbit", "jaguar"]}, 7),
    ("stringOutDomain", [T1, T2], {"domain": ["rabbit", "jaguar", "2.16"]}, 16), ("stringValues", [D1, D2], {"compareValue": "2022-01-01"}, 4), ("regexMatch", [T2], {"regex": r"^2\.[0-9]+$"}, 5),
    ("regexMatch", [T2, N1], {"regex": r"^2\.[0-9]+$"}, 6), ("regexMismatch", [T2], {"regex": r"^2\.[0-9]+$"}, 6), ("regexMismatch", [T2, N1], {"regex": r"^2\.[0-9]+$"}, 16),
    ("formattedDate", [D1], {"dateFormat": "yyyy-MM-dd"}, 4), ("formattedDate", [D1, D2], {"dateFormat": "yyyy-MM-dd"}, 8), ("minNumber", [T2, N1], {}, 1.72), ("maxNumber", [T2, N1], {}, 8.26),
    ("sumNumber", [N1], {}, 53.78), ("sumNumber", [T2, N1], {}, 102.55), ("avgNumber", [N1], {}, 4.889), ("stdNumber", [N1], {}, 2.40475), ("castedNumber", [T3], {}, 6), ("castedNumber", [T2, T3], {}, 16),
    ("numberInDomain", [T2], {"domain": [7.71, 6.85]}, 5), ("numberInDomain", [T2, T3], {"domain": [7.71, 6.85, -25.321]}, 7), ("numberOutDomain", [T2], {"domain": [7.71, 6.85]}, 5),
    ("numberOutDomain", [T2, T3], {"domain": [7.71, 6.85, -25.321]}, 9), ("numberLessThan", [T2], {"compareValue": 4.0}, 5), ("numberLessThan", [T2, N1], {"compareValue": 4.0}, 9),
    ("numberGreaterThan", [T2], {"compareValue": 4.0}, 5), ("numberGreaterThan", [T2, N1], {"compareValue": 4.0}, 12),
    ("numberBetween", [T2], {"lowerCompareValue": 3, "upperCompareValue": 7, "includeBound": True}, 2), ("numberBetween", [T2, N1], {"lowerCompareValue": 3, "upperCompareValue": 7, "includeBound": True}, 7),
    ("numberNotBetween", [T2], {"lowerCompareValue": 3, "upperCompareValue": 7, "includeBound": True}, 8), ("numberNotBetween", [T2, N1], {"lowerCompareValue": 3, "upperCompareValue": 7, "includeBound": True}, 14),
    ("numberValues", [T2, N1], {"compareValue": 7.71}, 3), ("medianValue", [N1], EXACT, 5.87), ("firstQuantile", [N1], EXACT, 2.13), ("thirdQuantile", [N1], EXACT, 5.94), ("getQuantile", [N1], {**EXACT, "target": 0.85}, 7.1),
    ("columnEq", [D1, D2], {}, 5), ("dayDistance", [D1, D2], {"threshold": 3, "dateFormat": "yyyy-MM-dd"}, 3), ("levenshteinDistance", [T2, N1], {"threshold": 3}, 5),
    ("coMoment", [T2, N1], {}, -24.2118), ("covariance", [T2, N1], {}, -2.69), ("covarianceBessel", [T2, N1], {}, -3.026), ("approximateDistinctValues", [T1], {}, 5),
    ("approximateSequenceCompleteness", ["rangeCol"], {}, 0.84615), ("getPercentile", [N1], {"target": 5.0}, 4 / 11), ("formattedNumber", [N1], {"precision": 3, "scale": 2}, 11),
    ("formattedNumber", [N1], {"precision": 2, "scale": 1, "compareRule": "outbound"}, 11)]


def test_golden(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    metrics = [Metric(f"{i}", k, "s", c, p) for i, (k, c, p, _) in enumerate(GOLDEN)]
    got = {r[0]: r[2] for r in fuse.results(df, metrics).collect()}
    for m, (k, c, p, want) in zip(metrics, GOLDEN):
        assert got[m.id] == pytest.approx(want, abs=6e-4), (k, c, p)
    assert {m.kind for m in metrics} | {"topN"} == set(KINDS)
    assert not [x for m in metrics for x in problems(m)]


def test_one_scan(spark, tmp_path):
    """All single-pass metrics of a source are one aggregate over one scan of the columns they name."""
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = fuse.results(df, [Metric("a", "avgNumber", "", [N1]), Metric("b", "nullValues", "", [T1]), Metric("c", "rowCount")])._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert plan.count("Scan parquet") == 2  # once in the tree, once in the details
    assert "ReadSchema: struct<textCol1:string,numCol1:double>" in plan


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    want = {"rowCount": 0, "nullValues": 0, "completeness": math.nan, "emptiness": 0, "minString": 2147483647, "maxString": -2147483648, "avgString": math.nan, "minNumber": 1.7976931348623157e308,
            "maxNumber": -1.7976931348623157e308, "sumNumber": 0, "avgNumber": math.nan, "stdNumber": math.nan, "medianValue": math.nan, "getPercentile": 0, "covariance": math.nan, "distinctValues": 0,
            "duplicateValues": 0, "sequenceCompleteness": 0, "approximateDistinctValues": 0, "topN": math.nan}
    columns = {"rowCount": [], "covariance": [N1, T2]}
    ms = [Metric(k, k, "", columns.get(k, [N1]), {"target": 1.0} if k == "getPercentile" else {}) for k in want]
    got = {r[0]: r[2] for r in fuse.results(df, ms).collect()}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, nan_ok=True), k


def test_top_n(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for mode in ("exact", "approx"):
        got = fuse.top_n(df, Metric("t", "topN", "", [T1], {"targetNumber": 2, "mode": mode})).orderBy("metric_name").collect()
        assert [r.metric_name for r in got] == ["TOP_N_1", "TOP_N_2"] and {r.additional_result for r in got} == {"monkey", "turtle"}
        assert [r.result for r in got] == pytest.approx([3 / 11, 3 / 11])


def test_star_and_types(spark):
    df = spark.createDataFrame([(1, None, True), (None, "a", None)], "a int, b string, c boolean").selectExpr("*", "date'2020-01-01' as d", "timestamp'2020-01-01 00:00:01' as t", "array(1) as e")
    ms = [Metric("n", "nullValues", "", ["*"]), Metric("d", "castedNumber", "", ["d"]), Metric("t", "sumNumber", "", ["t"]), Metric("c", "sumNumber", "", ["c"]), Metric("e", "distinctValues", "", ["e", "a"]),
          Metric("f", "formattedDate", "", ["d", "t"], {"dateFormat": "yy"}), Metric("g", "emptyValues", "", ["e"])]
    got = {r[0]: r[2] for r in fuse.results(df, ms).collect()}
    assert got == {"n": 3, "d": 0, "t": 2 * 1577836801, "c": 1, "e": 2, "f": 4, "g": 0}


def test_errors(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    ms = [Metric("null", "nullValues", "", [T1]), Metric("cast", "castedNumber", "", [T3]), Metric("dup", "duplicateValues", "", [T1]), Metric("dist", "distinctValues", "", [T1]), Metric("rows", "rowCount"),
          Metric("rev", "stringValues", "", [T1], {"compareValue": "monkey", "reversed": True})]
    got = fuse.errors(df, ms, ["rangeCol"]).collect()
    n = {m.id: sum(r.metric_id == m.id for r in got) for m in ms}
    assert n == {"null": 1, "cast": 6, "dup": 6, "dist": 1, "rows": 0, "rev": 3}
    assert next(r for r in got if r.metric_id == "null").row_data == {"rangeCol": "7", "textCol1": ""}
    cut = fuse.errors(df, ms, ["rangeCol"], dump_size=2).groupBy("metric_id").count().collect()
    assert max(r["count"] for r in cut) == 2


def test_problems():
    bad = [Metric("a", "avgNumber", "", ["x", "y"]), Metric("b", "stringLength", "", ["x"], {"length": 0}), Metric("c", "nope"), Metric("d", "levenshteinDistance", "", ["x", "y"], {"threshold": 3, "normalize": True}),
           Metric("e", "getQuantile", "", ["x"], {"target": 2}), Metric("f", "columnEq", "", ["x"]), Metric("g", "rowCount", "", ["x"]), Metric("h", "nullValues")]
    assert all(problems(m) for m in bad)


def test_ambiguous_names(spark):
    with pytest.raises(ValueError, match="ambiguous"):
        fuse.lower_names(spark.range(1).selectExpr("id as a", "id as A"))
