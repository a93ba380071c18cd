"""Registered queries of the data-quality engine, with the same results in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions.formula import Formula
from .operators import checks as C, trend as TR, virtual as V
from .operators.metrics import Metric
from .plans import fuse
from .plans.spec import parse
from .sources.shared import scratch
from .streaming import windows as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _metrics(specs: list[tuple[str, str, list[str], dict[str, Any]]]) -> list[Metric]:
    return [Metric(i, kind, "", columns, params) for i, kind, columns, params in specs]


def _wide(name: str, of: str, specs: list[tuple[str, str, list[str], dict[str, Any], str | None]], sql_from: str | None = None, digits: int | None = None,
          prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Register single-pass metrics of one table as a query with one row; each has its SQL expression."""
    ms = _metrics([s[:4] for s in specs])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, of)
        wide = fuse.fused(prepare(df) if prepare else df, ms)
        value: Callable[[str], Column] = lambda c: F.round(c, digits) if digits is not None else F.col(c)
        return wide.select(*[value(f"m{i}").alias(m.id) for i, m in enumerate(ms)])

    QUERIES[name] = run
    if all(s[4] for s in specs):
        cast = (lambda e: f"round(({e})::DOUBLE, {digits})") if digits is not None else (lambda e: f"({e})::DOUBLE")
        ORACLE[name] = "SELECT " + ", ".join(f"{cast(s[4])} AS {s[0]}" for s in specs) + f" FROM {sql_from or of}"


def _count(cond: str) -> str:
    return f"coalesce(sum(CASE WHEN {cond} THEN 1 ELSE 0 END), 0)"


def _both(a: str, b: str) -> str:
    return f"coalesce(sum((CASE WHEN {a} THEN 1 ELSE 0 END) + (CASE WHEN {b} THEN 1 ELSE 0 END)), 0)"


_wide("metric_row_count", "lineitem", [("row_count", "rowCount", [], {}, "count(*)")])
_wide("metric_null_values", "events", [("nulls", "nullValues", ["value", "props"], {}, _both("value IS NULL", "props IS NULL"))])
_wide("metric_empty_values", "events", [("empties", "emptyValues", ["event_type", "props"], {}, _both("event_type = ''", "props = ''"))])
_wide("metric_completeness", "events", [
    ("filled", "completeness", ["value", "props"], {}, "(count(value) + count(props)) / (2.0 * count(*))"),
    ("filled_text", "completeness", ["event_type"], {"includeEmptyStrings": True}, "sum(CASE WHEN event_type IS NOT NULL AND event_type <> '' THEN 1 ELSE 0 END) / count(*)")], digits=12)
_wide("metric_emptiness", "events", [("emptiness", "emptiness", ["value", "props"], {}, "sum((CASE WHEN value IS NULL THEN 1 ELSE 0 END) + (CASE WHEN props IS NULL THEN 1 ELSE 0 END)) / (2.0 * count(*))")], digits=12)
_wide("metric_min_string", "customer", [("shortest", "minString", ["c_mktsegment", "c_name"], {}, "min(least(length(c_mktsegment), length(c_name)))")])
_wide("metric_max_string", "customer", [("longest", "maxString", ["c_mktsegment", "c_name"], {}, "max(greatest(length(c_mktsegment), length(c_name)))")])
_wide("metric_avg_string", "part", [("average", "avgString", ["p_name", "p_type"], {}, "sum(coalesce(length(p_name), 0) + coalesce(length(p_type), 0)) / (count(p_name) + count(p_type))")], digits=9)
_wide("metric_string_length", "customer", [
    (f"length_{rule}", "stringLength", ["c_mktsegment"], {"length": 9, "compareRule": rule}, _count(f"length(c_mktsegment) {sign} 9"))
    for rule, sign in (("eq", "="), ("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">="))])
_wide("metric_string_in_domain", "customer", [("inside", "stringInDomain", ["c_mktsegment"], {"domain": ["BUILDING", "MACHINERY"]}, _count("c_mktsegment IN ('BUILDING', 'MACHINERY')"))])
_wide("metric_string_out_domain", "customer", [("outside", "stringOutDomain", ["c_mktsegment"], {"domain": ["BUILDING", "MACHINERY"]}, _count("c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"))])
_wide("metric_string_values", "lineitem", [("equal", "stringValues", ["l_returnflag", "l_linestatus"], {"compareValue": "F"}, _both("l_returnflag = 'F'", "l_linestatus = 'F'"))])
_wide("metric_regex_match", "documents", [("found", "regexMatch", ["text"], {"regex": "[a-z]{12,}"}, _count("regexp_matches(text, '[a-z]{12,}')"))])
_wide("metric_regex_mismatch", "documents", [("missing", "regexMismatch", ["text"], {"regex": "[a-z]{12,}"}, _count("NOT regexp_matches(text, '[a-z]{12,}')"))])
_wide("metric_formatted_date", "orders", [
    ("good", "formattedDate", ["d"], {"dateFormat": "yyyy-MM-dd"}, _count("try_strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') IS NOT NULL")),
    ("bad", "formattedDate", ["o_orderpriority"], {"dateFormat": "yyyy-MM-dd"}, _count("try_strptime(o_orderpriority, '%Y-%m-%d') IS NOT NULL")),
    ("typed", "formattedDate", ["o_orderdate"], {"dateFormat": "yyyy"}, _count("o_orderdate IS NOT NULL"))], prepare=lambda df: df.withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd")))
_FORM = "l_extendedprice::VARCHAR"
_wide("metric_formatted_number", "lineitem", [
    ("inbound", "formattedNumber", ["l_extendedprice"], {"precision": 6, "scale": 1},
     _count(f"length(ltrim(replace({_FORM}, '.', ''), '0')) <= 6 AND length(split_part({_FORM}, '.', 2)) <= 1")),
    ("outbound", "formattedNumber", ["l_extendedprice"], {"precision": 6, "scale": 1, "compareRule": "outbound"},
     _count(f"length(ltrim(replace({_FORM}, '.', ''), '0')) > 6 AND length(split_part({_FORM}, '.', 2)) > 1"))])
_wide("metric_min_number", "lineitem", [("least", "minNumber", ["l_quantity", "l_extendedprice"], {}, "min(least(l_quantity, l_extendedprice))")])
_wide("metric_max_number", "lineitem", [("most", "maxNumber", ["l_quantity", "l_extendedprice"], {}, "max(greatest(l_quantity, l_extendedprice))")])
_wide("metric_sum_number", "lineitem", [("total", "sumNumber", ["l_quantity", "l_extendedprice"], {}, "sum(l_quantity + l_extendedprice)")], digits=2)
_wide("metric_avg_number", "lineitem", [("mean", "avgNumber", ["l_extendedprice"], {}, "avg(l_extendedprice)")], digits=4)
_wide("metric_std_number", "lineitem", [("deviation", "stdNumber", ["l_extendedprice"], {}, "stddev_pop(l_extendedprice)")], digits=4)
_wide("metric_casted_number", "orders", [("numbers", "castedNumber", ["o_totalprice", "o_orderpriority"], {}, _both("try_cast(o_totalprice AS DOUBLE) IS NOT NULL", "try_cast(o_orderpriority AS DOUBLE) IS NOT NULL"))])
_wide("metric_number_in_domain", "lineitem", [("inside", "numberInDomain", ["l_quantity"], {"domain": [1, 5, 10]}, _count("l_quantity IN (1, 5, 10)"))])
_wide("metric_number_out_domain", "lineitem", [("outside", "numberOutDomain", ["l_quantity"], {"domain": [1, 5, 10]}, _count("l_quantity NOT IN (1, 5, 10)"))])
_wide("metric_number_less_than", "lineitem", [
    ("less", "numberLessThan", ["l_quantity"], {"compareValue": 24}, _count("l_quantity < 24")), ("less_equal", "numberLessThan", ["l_quantity"], {"compareValue": 24, "includeBound": True}, _count("l_quantity <= 24"))])
_wide("metric_number_greater_than", "lineitem", [
    ("more", "numberGreaterThan", ["l_quantity"], {"compareValue": 24}, _count("l_quantity > 24")), ("more_equal", "numberGreaterThan", ["l_quantity"], {"compareValue": 24, "includeBound": True}, _count("l_quantity >= 24"))])
_wide("metric_number_between", "lineitem", [
    ("within", "numberBetween", ["l_quantity"], {"lowerCompareValue": 10, "upperCompareValue": 20}, _count("l_quantity > 10 AND l_quantity < 20")),
    ("within_bounds", "numberBetween", ["l_quantity"], {"lowerCompareValue": 10, "upperCompareValue": 20, "includeBound": True}, _count("l_quantity BETWEEN 10 AND 20"))])
_wide("metric_number_not_between", "lineitem", [
    ("without", "numberNotBetween", ["l_quantity"], {"lowerCompareValue": 10, "upperCompareValue": 20}, _count("l_quantity < 10 OR l_quantity > 20")),
    ("without_bounds", "numberNotBetween", ["l_quantity"], {"lowerCompareValue": 10, "upperCompareValue": 20, "includeBound": True}, _count("l_quantity <= 10 OR l_quantity >= 20"))])
_wide("metric_number_values", "lineitem", [("equal", "numberValues", ["l_quantity", "l_tax"], {"compareValue": 0.05}, _both("l_quantity = 0.05::DOUBLE", "l_tax = 0.05::DOUBLE"))])
for _name, _kind, _q in (("median", "medianValue", 0.5), ("first_quantile", "firstQuantile", 0.25), ("third_quantile", "thirdQuantile", 0.75), ("get_quantile", "getQuantile", 0.9)):
    _wide(f"metric_{_name}", "lineitem", [("quantile", _kind, ["l_extendedprice"], {"mode": "exact", "target": _q}, f"quantile_cont(l_extendedprice, {_q})")], digits=6)
_wide("metric_get_percentile", "lineitem", [("share", "getPercentile", ["l_quantity"], {"target": 25}, "avg(CASE WHEN l_quantity <= 25 THEN 1.0 ELSE 0.0 END)")], digits=12)
_wide("metric_quantiles_approx", "lineitem", [(k, k, ["l_extendedprice"], {"target": 0.9}, None) for k in ("medianValue", "firstQuantile", "thirdQuantile", "getQuantile")])
_wide("metric_column_eq", "lineitem", [("equal", "columnEq", ["l_linenumber", "q"], {}, _count("l_linenumber = l_quantity"))], prepare=lambda df: df.withColumn("q", F.col("l_quantity").cast("int")))


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    df = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select("o_orderdate", "l_shipdate")
    wide = fuse.fused(df, _metrics([("near", "dayDistance", ["o_orderdate", "l_shipdate"], {"threshold": 400})]))
    return wide.select(F.col("m0").alias("near"))


QUERIES["metric_day_distance"] = _dates
ORACLE["metric_day_distance"] = f"SELECT ({_count('abs(date_diff(' + chr(39) + 'day' + chr(39) + ', o_orderdate, l_shipdate)) < 400')})::DOUBLE AS near FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_wide("metric_levenshtein", "part", [
    ("near", "levenshteinDistance", ["p_name", "p_type"], {"threshold": 9}, _count("levenshtein(upper(p_name), upper(p_type)) < 9")),
    ("near_share", "levenshteinDistance", ["p_name", "p_type"], {"threshold": 0.85, "normalize": True},
     _count("levenshtein(upper(trim(p_name)), upper(trim(p_type)))::DOUBLE / greatest(length(trim(p_name)), length(trim(p_type))) < 0.85::DOUBLE"))])
_wide("metric_co_moment", "lineitem", [("moment", "coMoment", ["l_quantity", "l_discount"], {}, "covar_pop(l_quantity, l_discount) * regr_count(l_quantity, l_discount)")], digits=4)
_wide("metric_covariance", "lineitem", [("covariance", "covariance", ["l_quantity", "l_extendedprice"], {}, "covar_pop(l_quantity, l_extendedprice)")], digits=3)
_wide("metric_covariance_bessel", "lineitem", [("covariance", "covarianceBessel", ["l_quantity", "l_extendedprice"], {}, "covar_samp(l_quantity, l_extendedprice)")], digits=3)
_wide("metric_approx_distinct", "lineitem", [("estimate", "approximateDistinctValues", ["l_orderkey"], {}, None)])
_wide("metric_approx_sequence", "orders", [("estimate", "approximateSequenceCompleteness", ["o_orderkey"], {}, None)])


def _rows(name: str, of: str, specs: list[tuple[str, str, list[str], dict[str, Any]]], sql: str | None) -> None:
    ms = _metrics(specs)
    QUERIES[name] = lambda spark, sf_dir: fuse.results(table(spark, sf_dir, of), ms).select("metric_id", F.round("result", 9).alias("result"), "additional_result")
    if sql:
        ORACLE[name] = sql


_ONE = "SELECT '{0}' AS metric_id, round(({1})::DOUBLE, 9) AS result, NULL::VARCHAR AS additional_result FROM {2}"
_rows("metric_distinct_values", "lineitem", [("distinct", "distinctValues", ["l_partkey", "l_suppkey"], {})], _ONE.format("distinct", "count(*)", "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"))
_rows("metric_duplicate_values", "lineitem", [("duplicates", "duplicateValues", ["l_orderkey", "l_linenumber"], {})],
      _ONE.format("duplicates", "coalesce(sum(n - 1), 0)", "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"))
_rows("metric_sequence_completeness", "orders", [("complete", "sequenceCompleteness", ["o_custkey"], {"increment": 1})],
      _ONE.format("complete", "count(*) / (max(o_custkey) - min(o_custkey) + 1)", "(SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL)"))
_rows("metric_top_n", "part", [("top", "topN", ["p_brand"], {"targetNumber": 5})], """
SELECT 'top' AS metric_id, round(n::DOUBLE / (SELECT count(p_brand) FROM part), 9) AS result, p_brand AS additional_result
FROM (SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 5)""")
_rows("metric_top_n_approx", "part", [("top", "topN", ["p_brand"], {"targetNumber": 5, "mode": "approx"})], None)

# Shared scans and shuffles: many metrics of one source at once.
_PROFILE = [("rows", "rowCount", [], {}), ("null_dates", "nullValues", ["l_shipdate"], {}), ("flags", "completeness", ["l_returnflag", "l_linestatus"], {}), ("quantity", "avgNumber", ["l_quantity"], {}),
            ("price_max", "maxNumber", ["l_extendedprice"], {}), ("price_min", "minNumber", ["l_extendedprice"], {}), ("cheap", "numberLessThan", ["l_extendedprice"], {"compareValue": 1000}),
            ("lines", "distinctValues", ["l_orderkey", "l_linenumber"], {}), ("again", "duplicateValues", ["l_orderkey", "l_linenumber"], {}), ("orders", "sequenceCompleteness", ["l_orderkey"], {})]
_rows("profile_lineitem", "lineitem", _PROFILE, " UNION ALL ".join([
    _ONE.format("rows", "count(*)", "lineitem"), _ONE.format("null_dates", _count("l_shipdate IS NULL"), "lineitem"), _ONE.format("flags", "(count(l_returnflag) + count(l_linestatus)) / (2.0 * count(*))", "lineitem"),
    _ONE.format("quantity", "avg(l_quantity)", "lineitem"), _ONE.format("price_max", "max(l_extendedprice)", "lineitem"), _ONE.format("price_min", "min(l_extendedprice)", "lineitem"),
    _ONE.format("cheap", _count("l_extendedprice < 1000"), "lineitem"), _ONE.format("lines", "count(*)", "(SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"),
    _ONE.format("again", "coalesce(sum(n - 1), 0)", "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"),
    _ONE.format("orders", "count(*) / (max(l_orderkey) - min(l_orderkey) + 1)", "(SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")]))

# Derived sources


def _virtual(name: str, parents: list[str], spec: dict[str, Any], sql: str, after: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {p: table(spark, sf_dir, p) for p in parents}
        return after(V.derive_all(spark, [{"id": "derived", "parentSources": parents, **spec}], frames)["derived"])

    QUERIES[name] = run
    ORACLE[name] = sql


_virtual("virtual_sql", ["orders", "customer"], {"kind": "sql", "query": "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"},
         "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
_virtual("virtual_filter", ["lineitem"], {"kind": "filter", "expr": ["l_quantity > 45", "l_returnflag = 'R'"]}, "SELECT * FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
_virtual("virtual_select", ["orders"], {"kind": "select", "expr": ["o_orderkey", "upper(o_orderpriority) AS priority", "year(o_orderdate) AS year"]},
         "SELECT o_orderkey, upper(o_orderpriority) AS priority, year(o_orderdate)::INTEGER AS year FROM orders")
_virtual("virtual_aggregate", ["lineitem"], {"kind": "aggregate", "groupBy": ["l_returnflag", "l_linestatus"], "expr": ["count(1) AS n", "sum(l_quantity) AS quantity"]},
         "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus")


def _join(how: str) -> None:
    """All orders with all parts, whose keys are moved so that either side has some of its own."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {"bought": table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"),
                  "parts": table(spark, sf_dir, "part").select((F.col("p_partkey") + 50).alias("k"), "p_name")}
        got = V.derive_all(spark, [{"id": "j", "kind": "join", "parentSources": ["bought", "parts"], "joinBy": ["k"], "joinType": how}], frames)["j"]
        return got.fillna({c: v for c, v in (("o_orderkey", -1), ("p_name", "none")) if c in got.columns})

    low = how.lower()
    name = f"virtual_join_{low}"
    QUERIES[name] = run
    a, b = "(SELECT o_custkey AS k, o_orderkey FROM orders) a", "(SELECT p_partkey + 50 AS k, p_name FROM part) b"
    if low in ("semi", "leftsemi", "anti", "leftanti"):
        ORACLE[name] = f"SELECT k, o_orderkey FROM {a} WHERE {'NOT ' if 'anti' in low else ''}EXISTS (SELECT 1 FROM {b} WHERE b.k = a.k)"
    else:
        word = {"outer": "FULL", "full": "FULL", "fullouter": "FULL", "left": "LEFT", "leftouter": "LEFT", "right": "RIGHT", "rightouter": "RIGHT"}.get(low, "INNER")
        ORACLE[name] = f"SELECT k, coalesce(o_orderkey, -1) AS o_orderkey, coalesce(p_name, 'none') AS p_name FROM {a} {word} JOIN {b} USING (k)"


for _how in ("inner", "outer", "cross", "full", "right", "left", "semi", "anti", "fullOuter", "rightOuter", "leftOuter", "leftSemi", "leftAnti"):
    _join(_how)

# Composed metrics and checks, over columns of one result row.


def _composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = _metrics([("nulls", "numberLessThan", ["l_quantity"], {"compareValue": 10}), ("rows", "rowCount", [], {}), ("most", "maxNumber", ["l_quantity"], {})])
    wide = fuse.fused(table(spark, sf_dir, "lineitem"), ms)
    of = {m.id: F.col(f"m{i}") for i, m in enumerate(ms)}
    formulas = {"share": "100 * {{nulls}} / {{rows}}", "power": "{{most}} ^ 2 - 2 * {{most}}", "choice": "case when {{nulls}} > {{rows}} then 1 when {{most}} >= 50 then 2 else 3 end",
                "other": "if {{rows}} > 0 sqrt(abs(0 - {{most}})) else 0", "larger": "max({{nulls}}, {{most}}) + min(1, 2)"}
    return wide.select(*[F.round(Formula(f).column(of).cast("double"), 9).alias(k) for k, f in formulas.items()])


QUERIES["composed_metrics"] = _composed
ORACLE["composed_metrics"] = f"""
WITH m AS (SELECT ({_count('l_quantity < 10')})::DOUBLE AS nulls, count(*)::DOUBLE AS n, max(l_quantity)::DOUBLE AS most FROM lineitem)
SELECT round(100 * nulls / n, 9) AS share, round(most ^ 2 - 2 * most, 9) AS power, (CASE WHEN nulls > n THEN 1 WHEN most >= 50 THEN 2 ELSE 3 END)::DOUBLE AS choice,
       round(CASE WHEN n > 0 THEN sqrt(abs(0 - most)) ELSE 0 END, 9) AS other, greatest(nulls, most) + 1 AS larger FROM m"""


def _status(rows: list[C.CheckResult], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.check_id, r.status) for r in rows], "check_id string, status string")


def _results(spark: SparkSession, df: DataFrame, ms: list[Metric]) -> dict[str, list[C.Result]]:
    out: dict[str, list[C.Result]] = {}
    for r in fuse.results(df, ms).collect():  # one row a metric
        out.setdefault(r[0], []).append(C.Result(r[0], r[1], r[2], r[3]))
    return out


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _results(spark, table(spark, sf_dir, "lineitem"), _metrics([("rows", "rowCount", [], {}), ("filled", "castedNumber", ["l_quantity"], {}), ("cheap", "numberLessThan", ["l_quantity"], {"compareValue": 5})]))
    checks = [("equalTo", {"id": "equal", "metric": "rows", "compareMetric": "filled"}), ("greaterThan", {"id": "greater", "metric": "rows", "threshold": 0}), ("lessThan", {"id": "less", "metric": "cheap", "threshold": 10}),
              ("differByLT", {"id": "differ", "metric": "rows", "compareMetric": "cheap", "threshold": 0.05}), ("equalTo", {"id": "missing", "metric": "none", "threshold": 1})]
    return _status([C.snapshot(k, x, got) for k, x in checks] + [C.expression({"id": "formula", "formula": "{{rows}} > {{cheap}} && not({{cheap}} > 100000)"}, got)], spark)


QUERIES["checks_snapshot"] = _snapshot
ORACLE["checks_snapshot"] = f"""
WITH m AS (SELECT count(*) AS n, count(l_quantity) AS filled, {_count('l_quantity < 5')} AS cheap FROM lineitem),
s AS (SELECT unnest([
  struct_pack(check_id := 'equal', ok := n = filled), struct_pack(check_id := 'greater', ok := n > 0), struct_pack(check_id := 'less', ok := cheap < 10),
  struct_pack(check_id := 'differ', ok := abs(n - cheap) / cheap < 0.05), struct_pack(check_id := 'formula', ok := n > cheap AND NOT cheap > 100000)]) AS x FROM m)
SELECT x.check_id AS check_id, CASE WHEN x.ok THEN 'Success' ELSE 'Failure' END AS status FROM s UNION ALL SELECT 'missing', 'Error'"""


def _load_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "nation").schema
    checks = [("exactColumnNum", {"id": "exact", "source": "nation", "option": 3}), ("minColumnNum", {"id": "least", "source": "nation", "option": 4}),
              ("columnsExist", {"id": "exist", "source": "nation", "columns": ["N_NAME", "n_regionkey"]}), ("schemaMatch", {"id": "match", "source": "nation", "schema": "own"})]
    return _status([C.load_check(k, x, schema, {"own": schema}) for k, x in checks], spark)


QUERIES["checks_load"] = _load_checks
ORACLE["checks_load"] = "SELECT * FROM (VALUES ('exact', 'Success'), ('least', 'Failure'), ('exist', 'Success'), ('match', 'Success')) AS t(check_id, status)"

# Trends: the history is the daily value of events; each day is judged by the days before it.


def _hourly(spark: SparkSession, sf_dir: str) -> list[tuple[datetime, float]]:
    """The history that the trend queries work on: a metric result an hour, latest first, as a storage gives it."""
    rows = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("reference_date")).agg(F.count(F.lit(1)).cast("double").alias("result"))
    return sorted(((r[0], r[1]) for r in rows.collect()), reverse=True)


_HOURLY = "SELECT date_trunc('hour', ts) AS reference_date, count(*)::DOUBLE AS result FROM events GROUP BY 1"
_AT = datetime(2030, 1, 1)


def _trend_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = _hourly(spark, sf_dir)
    kinds = {"avg": "avg", "std": "std", "min": "min", "max": "max", "sum": "sum", "median": "median", "first_quartile": "firstQuartile", "third_quartile": "thirdQuartile", "quantile": "quantile"}
    row = [round(TR.evaluate(k, {"quantile": 0.9}, past, _AT)[0], 6) for k in kinds.values()]
    return spark.createDataFrame([(*row, round(TR.evaluate("linearRegression", {}, past, past[0][0])[0], 4))], ", ".join(f"{k} double" for k in [*kinds, "line"]))


QUERIES["trend_statistics"] = _trend_stats
ORACLE["trend_statistics"] = f"""
WITH h AS ({_HOURLY}), t AS (SELECT *, epoch_us(reference_date) / 3600000000.0 - min(epoch_us(reference_date)) OVER () / 3600000000.0 AS x FROM h)
SELECT round(avg(result), 6) AS avg, round(stddev_samp(result), 6) AS std, round(min(result), 6) AS min, round(max(result), 6) AS max, round(sum(result), 6) AS sum,
       round(quantile_cont(result, 0.5), 6) AS median, round(quantile_cont(result, 0.25), 6) AS first_quartile, round(quantile_cont(result, 0.75), 6) AS third_quartile,
       round(quantile_cont(result, 0.9), 6) AS quantile, round(regr_intercept(result, x) + regr_slope(result, x) * max(x), 4) AS line FROM t"""


def _trend_ar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An autoregressive forecast of the next hour, of the first order, which least squares give in closed form; with and without a difference."""
    past = _hourly(spark, sf_dir)
    return spark.createDataFrame([(f"ar1_d{d}", round(TR.evaluate("arima", {"order": [1, d, 0]}, past, _AT)[0], 4)) for d in (0, 1)], "id string, result double")


QUERIES["trend_arima"] = _trend_ar
ORACLE["trend_arima"] = f"""
WITH h AS ({_HOURLY}), d AS (SELECT reference_date, result, result - lag(result) OVER (ORDER BY reference_date) AS step FROM h),
l AS (SELECT *, lag(result) OVER w AS r1, lag(step) OVER w AS s1 FROM d WINDOW w AS (ORDER BY reference_date)),
last AS (SELECT result, step FROM d ORDER BY reference_date DESC LIMIT 1)
SELECT 'ar1_d0' AS id, round(regr_intercept(result, r1) + regr_slope(result, r1) * (SELECT result FROM last), 4) AS result FROM l
UNION ALL SELECT 'ar1_d1', round((SELECT result FROM last) + regr_intercept(step, s1) + regr_slope(step, s1) * (SELECT step FROM last), 4) FROM l"""


def _average_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hour's result checked against the average of the three before it."""
    past, rows = _hourly(spark, sf_dir), []
    for i, (at, value) in enumerate(past[:-1]):
        def history(ids, kind, rule, size, offset, i=i):
            return [(d, v, None) for d, v in past[i + 1:i + 1 + int(size)]]

        results = {"n": [C.Result("n", "ROW_COUNT", value)]}
        both = {"id": "c", "metric": "n", "rule": "record", "windowSize": 3, "threshold": 0.25}
        got = [C.trend(k, x, results, history) for k, x in (("averageBoundFull", both), ("averageBoundUpper", both), ("averageBoundLower", both),
                                                            ("averageBoundRange", {**{k: v for k, v in both.items() if k != "threshold"}, "thresholdLower": 0.1, "thresholdUpper": 0.5}))]
        rows.append((at, round(got[0].upper_bound, 6), *(g.status for g in got)))
    return spark.createDataFrame(rows, "reference_date timestamp, bound double, full string, upper string, lower string, range string")


QUERIES["checks_average_bound"] = _average_bounds
ORACLE["checks_average_bound"] = f"""
WITH h AS ({_HOURLY}), w AS (SELECT *, avg(result) OVER (ORDER BY reference_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS average FROM h)
SELECT reference_date, round(average * 1.25, 6) AS bound, CASE WHEN result >= average * 0.75 AND result <= average * 1.25 THEN 'Success' ELSE 'Failure' END AS "full",
       CASE WHEN result <= average * 1.25 THEN 'Success' ELSE 'Failure' END AS upper, CASE WHEN result >= average * 0.75 THEN 'Success' ELSE 'Failure' END AS lower,
       CASE WHEN result >= average * 0.9 AND result <= average * 1.5 THEN 'Success' ELSE 'Failure' END AS range FROM w WHERE average IS NOT NULL"""


def _top_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hour's two most frequent kinds of event checked against those of the hour before."""
    from pyspark.sql import Window

    n = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").count()
    best = n.withColumn("r", F.row_number().over(Window.partitionBy("hour").orderBy(F.desc("count"), "event_type"))).where("r <= 2").select("hour", "r", "event_type", "count")
    by: dict[datetime, list[C.Result]] = {}
    for r in sorted(best.collect()):  # two rows an hour
        by.setdefault(r[0], []).append(C.Result("top", f"TOP_N_{r[1]}", float(r[3]), r[2]))
    hours, rows = sorted(by), []
    for before, now in zip(hours, hours[1:]):
        def history(ids, kind, rule, size, offset, before=before):
            return [(before, x.result, x.additional, x.metric_name) for x in by[before]]

        rows.append((now, C.trend("topNRank", {"id": "c", "metric": "top", "targetNumber": 2, "threshold": 0.5}, {"top": by[now]}, history).status))
    return spark.createDataFrame(rows, "hour timestamp, status string")


QUERIES["checks_top_rank"] = _top_rank
ORACLE["checks_top_rank"] = """
WITH n AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS c FROM events GROUP BY 1, 2),
t AS (SELECT hour, list(event_type) AS now FROM (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY c DESC, event_type) AS r FROM n) WHERE r <= 2 GROUP BY hour),
p AS (SELECT *, lag(now) OVER (ORDER BY hour) AS before FROM t)
SELECT hour, CASE WHEN 1 - len(list_intersect(now, before)) / len(list_distinct(list_concat(now, before)))::DOUBLE <= 0.5 THEN 'Success' ELSE 'Failure' END AS status FROM p WHERE before IS NOT NULL"""

# Windows of a stream, replayed over the whole table.
_STREAM = [("rows", "rowCount", [], {}), ("mean", "avgNumber", ["value"], {}), ("errors", "stringValues", ["event_type"], {"compareValue": "error"}), ("most", "maxNumber", ["value"], {})]


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = W.windowed(table(spark, sf_dir, "events"), "ts")
    return W.all_windows({"events": df}, [Metric(i, k, "events", c, p) for i, k, c, p in _STREAM]).select("window_start", "metric_id", F.round("result", 6).alias("result"))


QUERIES["stream_windows"] = _windows
_BUCKET = "time_bucket(INTERVAL 10 MINUTE, date_trunc('second', ts), TIMESTAMP '1970-01-01')"
ORACLE["stream_windows"] = " UNION ALL ".join(
    f"SELECT {_BUCKET} AS window_start, '{i}' AS metric_id, round(({e})::DOUBLE, 6) AS result FROM events GROUP BY 1"
    for i, e in (("rows", "count(*)"), ("mean", "coalesce(avg(value), 'NaN'::DOUBLE)"), ("errors", _count("event_type = 'error'")), ("most", "coalesce(max(value), -1.7976931348623157e308)")))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = W.windowed(table(spark, sf_dir, "events"), "ts")
    return W.session_metrics(df, _metrics([("rows", "rowCount", [], {})]), "30 minutes", ["user_id"]).select("user_id", "session_start", F.col("m0").alias("rows"))


QUERIES["stream_sessions"] = _sessions
ORACLE["stream_sessions"] = """
WITH e AS (SELECT user_id, date_trunc('second', ts) AS t FROM events),
g AS (SELECT *, CASE WHEN t >= lag(t) OVER (PARTITION BY user_id ORDER BY t) + INTERVAL 30 MINUTE OR lag(t) OVER (PARTITION BY user_id ORDER BY t) IS NULL THEN 1 ELSE 0 END AS first FROM e),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY t, first DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(t) AS session_start, count(*)::DOUBLE AS rows FROM s GROUP BY user_id, k"""

# Failing rows


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = _metrics([("big", "numberLessThan", ["l_quantity"], {"compareValue": 49}), ("flag", "stringInDomain", ["l_returnflag"], {"domain": ["A", "N"]}), ("sum", "sumNumber", ["l_tax", "l_discount"], {})])
    return fuse.error_counts(table(spark, sf_dir, "lineitem"), ms)


QUERIES["error_counts"] = _errors
ORACLE["error_counts"] = f"""
SELECT 'big' AS metric_id, {_count('coalesce(l_quantity < 49, false) = false')}::BIGINT AS failures FROM lineitem UNION ALL
SELECT 'flag', {_count("coalesce(l_returnflag IN ('A', 'N'), false) = false")}::BIGINT FROM lineitem UNION ALL SELECT 'sum', {_count('l_tax IS NULL OR l_discount IS NULL')}::BIGINT FROM lineitem"""


def _error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = _metrics([("big", "numberLessThan", ["l_quantity"], {"compareValue": 49}), ("again", "duplicateValues", ["l_orderkey", "l_linenumber"], {})])
    got = fuse.errors(table(spark, sf_dir, "lineitem"), ms, ["l_orderkey"], 1 << 30)
    return got.select("metric_id", F.col("row_data")["l_orderkey"].cast("bigint").alias("l_orderkey"))


QUERIES["error_rows"] = _error_rows
ORACLE["error_rows"] = """
SELECT 'big' AS metric_id, l_orderkey FROM lineitem WHERE NOT coalesce(l_quantity < 49, false) UNION ALL
SELECT 'again', l_orderkey FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY 1) AS n FROM lineitem) WHERE n > 1"""


def _error_rows_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing rows at the default size of a dump: which rows are kept is fixed, the first by their data."""
    ms = _metrics([("flag", "stringInDomain", ["l_returnflag"], {"domain": ["A", "R"]}), ("big", "numberLessThan", ["l_quantity"], {"compareValue": 2})])
    got = fuse.errors(table(spark, sf_dir, "lineitem"), ms, ["l_orderkey", "l_linenumber"])
    return got.select("metric_id", F.to_json("row_data").alias("row_data"))


QUERIES["error_rows_capped"] = _error_rows_capped
_LINE = """'{{"l_orderkey":"' || l_orderkey || '","l_linenumber":"' || l_linenumber || '","{0}":"' || {1} || '"}}'"""
ORACLE["error_rows_capped"] = f"""
WITH e AS (SELECT 'flag' AS metric_id, {_LINE.format('l_returnflag', "coalesce(l_returnflag, '')")} AS row_data FROM lineitem WHERE NOT coalesce(l_returnflag IN ('A', 'R'), false)
UNION ALL SELECT 'big', {_LINE.format('l_quantity', "coalesce(l_quantity::VARCHAR, '')")} FROM lineitem WHERE NOT coalesce(l_quantity < 2, false))
SELECT metric_id, row_data FROM (SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY encode(row_data)) AS n FROM e) WHERE n <= 10000"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded lists: the five least prices of a supplier, and once more over its lists by ship mode."""
    from .functions import aggregates as A

    df = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_extendedprice")
    five = A.collect_lists(df, ["l_suppkey"], "l_extendedprice", 5, "least")
    parts = A.collect_lists(df, ["l_suppkey", "l_linenumber"], "l_extendedprice", 5, "parts")
    merged = A.merge_lists(parts, ["l_suppkey"], "parts", 5, "again").withColumnRenamed("l_suppkey", "k")
    return five.join(merged, F.col("l_suppkey") == F.col("k")).select("l_suppkey", F.array_join(F.transform("least", lambda x: x.cast("decimal(20,2)")), ",").alias("least"), (F.col("least") == F.col("again")).alias("same"))


QUERIES["bounded_lists"] = _lists
ORACLE["bounded_lists"] = """
SELECT l_suppkey, string_agg(l_extendedprice::DECIMAL(20,2)::VARCHAR, ',' ORDER BY l_extendedprice) AS least, true AS same
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS n FROM lineitem) WHERE n <= 5 GROUP BY l_suppkey"""


def _stream_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping metrics of windows, as a stream's closed windows give them."""
    df = W.windowed(table(spark, sf_dir, "events"), "ts")
    ms = [Metric("users", "distinctValues", "events", ["user_id", "event_type"], {}), Metric("again", "duplicateValues", "events", ["user_id"], {}), Metric("seq", "sequenceCompleteness", "events", ["user_id"], {}),
          Metric("top", "topN", "events", ["event_type"], {"targetNumber": 2})]
    return W.from_groups(W.window_groups(df, ms), ms).select("window_start", "metric_id", "metric_name", F.round("result", 9).alias("result"), "additional_result")


QUERIES["stream_groups"] = _stream_groups
ORACLE["stream_groups"] = f"""
WITH e AS (SELECT {_BUCKET} AS window_start, user_id, event_type FROM events),
u AS (SELECT window_start, user_id, count(*) AS n FROM e WHERE user_id IS NOT NULL GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, event_type) AS r, sum(n) OVER (PARTITION BY window_start) AS total
      FROM (SELECT window_start, event_type, count(*) AS n FROM e WHERE event_type IS NOT NULL GROUP BY ALL))
SELECT window_start, 'users' AS metric_id, 'DISTINCT_VALUES' AS metric_name, count(*)::DOUBLE AS result, NULL::VARCHAR AS additional_result
FROM (SELECT DISTINCT * FROM e WHERE user_id IS NOT NULL OR event_type IS NOT NULL) GROUP BY 1
UNION ALL SELECT window_start, 'again', 'DUPLICATE_VALUES', sum(n - 1)::DOUBLE, NULL FROM u GROUP BY 1
UNION ALL SELECT window_start, 'seq', 'SEQUENCE_COMPLETENESS', round(count(*) / (max(user_id) - min(user_id) + 1)::DOUBLE, 9), NULL FROM u GROUP BY 1
UNION ALL SELECT window_start, 'top', 'TOP_N_' || r, round(n / total::DOUBLE, 9), event_type FROM t WHERE r <= 2"""

# Sources, schemas, targets and storage: a table goes out through a target and comes back through a reader.


_FIELDS = [("o_orderkey", "long"), ("o_custkey", "long"), ("o_totalprice", "double"), ("o_orderpriority", "string")]
_BACK = """SELECT count(*) AS n, sum(o_custkey)::BIGINT AS customers, round(sum(o_totalprice), 1) AS price, count(DISTINCT o_orderpriority) AS kinds,
       min(o_orderpriority) AS first_kind FROM orders"""


def _round_trip(name: str, save: dict[str, Any], source: dict[str, Any], schema: dict[str, Any] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .plans.job import Engine
        from .sources import targets as TG

        path = scratch(spark, "orders")
        rows = table(spark, sf_dir, "orders").select(*[c for c, _ in _FIELDS])
        if save["kind"] == "fixed":  # there is no target of this form, so lines are laid out by hand
            rows.select(F.concat(*[F.rpad(F.coalesce(F.col(c).cast("decimal(20,2)" if k == "double" else "string").cast("string"), F.lit("")), 24, " ") for c, k in _FIELDS]).alias("value")).write.text(path)
        else:
            TG.save_virtual(rows, {**save, "path": path})
        config = {"jobConfig": {"jobId": name, "schemas": [{"id": "s", **schema}] if schema else [], "sources": {"file": [{"id": "back", "path": path, **source}]}}}
        frames, _ = Engine(spark).frames(parse(config))
        return frames["back"].df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_custkey").cast("bigint")).alias("customers"), F.round(F.sum(F.col("o_totalprice").cast("double")), 1).alias("price"),
                                     F.count_distinct("o_orderpriority").alias("kinds"), F.min("o_orderpriority").alias("first_kind"))

    QUERIES[name] = run
    ORACLE[name] = _BACK


_round_trip("source_parquet", {"kind": "parquet"}, {"kind": "parquet"})
_round_trip("source_orc", {"kind": "orc"}, {"kind": "orc"})
_round_trip("source_delimited_header", {"kind": "delimited", "delimiter": ";", "header": True}, {"kind": "delimited", "delimiter": ";", "header": True})
_round_trip("source_delimited_schema", {"kind": "delimited"}, {"kind": "delimited", "schema": "s"}, {"kind": "delimited", "schema": [{"name": c, "type": k} for c, k in _FIELDS]})
_round_trip("source_fixed_full", {"kind": "fixed"}, {"kind": "fixed", "schema": "s"}, {"kind": "fixedFull", "schema": [{"name": c, "type": k, "width": 24} for c, k in _FIELDS]})
_round_trip("source_fixed_short", {"kind": "fixed"}, {"kind": "fixed", "schema": "s"}, {"kind": "fixedShort", "schema": [f"{c}:24" for c, _ in _FIELDS]})


def _storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results kept, replaced by a later run of the same date, and read back through a history window."""
    from .sources.storage import FileStorage

    store = FileStorage(spark, scratch(spark, "store"))
    past = _hourly(spark, sf_dir)
    row = lambda d, v: {"job_id": "j", "metric_id": "n", "metric_name": "ROW_COUNT", "result": v, "reference_date": d, "execution_date": d}
    store.append("results_metric_regular", [row(d, -1.0) for d, _ in past[:5]])
    store.append("results_metric_regular", [row(d, v) for d, v in past])
    got = store.history("j", ["n"], "regular", "record", past[1][0], 24, 2)
    return spark.createDataFrame([(d, v) for d, v, *_ in got], "reference_date timestamp, result double")


QUERIES["storage_history"] = _storage
ORACLE["storage_history"] = f"SELECT reference_date, result FROM ({_HOURLY}) ORDER BY reference_date DESC LIMIT 24 OFFSET 4"


def _unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as a file target lays them out."""
    from .sources import targets as TG

    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("j").alias("job_id"), F.concat(F.lit("n_"), F.col("o_orderpriority")).alias("metric_id"), F.col("n").cast("double").alias("result"),
        F.lit(datetime(2024, 1, 1)).alias("reference_date"), F.lit(datetime(2024, 1, 2)).alias("execution_date"))
    path = scratch(spark, "results")
    TG.write_file(TG.unified(rows, "regularMetricResult"), {"kind": "delimited", "header": True, "delimiter": "\t"}, path)
    return spark.read.option("header", True).option("sep", "\t").option("escape", "\\").csv(path).select("jobId", "referenceDate", "entityType", "data")


QUERIES["target_file"] = _unified
ORACLE["target_file"] = """
SELECT 'j' AS "jobId", '2024-01-01T00:00:00.000' AS "referenceDate", 'regularMetricResult' AS "entityType",
       '{"metricId":"n_' || o_orderpriority || '","result":' || count(*) || '.0}' AS data FROM orders GROUP BY o_orderpriority"""


def _job(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.job import Engine

    config = {"jobConfig": {
        "jobId": "lineitem_quality", "sources": {"file": [{"id": "lines", "kind": "parquet", "path": f"{sf_dir}/lineitem.parquet", "keyFields": ["l_orderkey", "l_linenumber"]}]},
        "virtualSources": [{"id": "returned", "kind": "filter", "parentSources": ["lines"], "expr": ["l_returnflag = 'R'"]}],
        "metrics": {"regular": {"rowCount": [{"id": "n", "source": "lines"}, {"id": "r", "source": "returned"}], "completeness": [{"id": "c", "source": "lines", "columns": ["l_returnflag", "l_linestatus"]}],
                                "distinctValues": [{"id": "d", "source": "lines", "columns": ["l_orderkey", "l_linenumber"]}]},
                    "composed": [{"id": "share", "formula": "{{ r }} / {{ n }}"}]},
        "checks": {"snapshot": {"greaterThan": [{"id": "some", "metric": "n", "threshold": 0}]}, "expression": [{"id": "few", "formula": "{{ share }} < 0.5"}]}}}
    rs = Engine(spark, {"errorDumpSize": 10}).run(config, reference=datetime(2024, 1, 1))
    rows = [(r.metric_id, round(r.result, 9), None) for r in [*rs.regular, *rs.composed]] + [(c.check_id, None, c.status) for c in rs.checks]
    return spark.createDataFrame(rows, "id string, result double, status string")


QUERIES["job_lineitem"] = _job
ORACLE["job_lineitem"] = f"""
WITH m AS (SELECT count(*)::DOUBLE AS n, ({_count("l_returnflag = 'R'")})::DOUBLE AS r, (count(l_returnflag) + count(l_linestatus)) / (2.0 * count(*)) AS c FROM lineitem),
d AS (SELECT count(*)::DOUBLE AS d FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
SELECT 'n' AS id, n AS result, NULL::VARCHAR AS status FROM m UNION ALL SELECT 'r', r, NULL FROM m UNION ALL SELECT 'c', round(c, 9)::DOUBLE, NULL FROM m UNION ALL SELECT 'd', d, NULL FROM d
UNION ALL SELECT 'share', round(r / n, 9), NULL FROM m UNION ALL SELECT 'some', NULL, CASE WHEN n > 0 THEN 'Success' ELSE 'Failure' END FROM m
UNION ALL SELECT 'few', NULL, CASE WHEN r / n < 0.5 THEN 'Success' ELSE 'Failure' END FROM m"""


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: a profile of lineitem."""
    return QUERIES["profile_lineitem"](spark, sf_dir)
