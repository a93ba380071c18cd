"""Checks on metric results: snapshot, trend and expression checks, and load checks on schemas.

Checks work on a handful of results, so they run on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from ..functions.formula import Formula
from .metrics import display_name

SUCCESS, FAILURE, ERROR = "Success", "Failure", "Error"


@dataclass
class Result:
    """Result of a metric."""

    metric_id: str
    metric_name: str
    result: float
    additional: str | None = None
    sources: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    type: str = "regular"  #: regular, composed or trend


@dataclass
class CheckResult:
    check_id: str
    check_name: str
    status: str
    message: str
    base_metric: str | None = None
    compared_metric: str | None = None
    compared_threshold: float | None = None
    lower_bound: float | None = None
    upper_bound: float | None = None
    source_id: str = ""
    is_critical: bool = False
    description: str | None = None
    expected: str | None = None  #: of load checks
    metadata: list[str] = field(default_factory=list)


def _relative(a: float, b: float) -> float:
    """|a - b| / |b|: 0 if both are 0, 1 if only b is."""
    if b == 0:
        return 0.0 if a == 0 else 1.0
    return abs(a - b) / abs(b)


SNAPSHOT: dict[str, tuple[Callable[[float, float, float | None], bool], str]] = {
    "differByLT": (lambda a, b, t: _relative(a, b) < t, "differs by less than the threshold from"),
    "equalTo": (lambda a, b, t: a == b, "equals"),
    "lessThan": (lambda a, b, t: a < b, "is less than"),
    "greaterThan": (lambda a, b, t: a > b, "is greater than"),
}
TREND = ("averageBoundFull", "averageBoundUpper", "averageBoundLower", "averageBoundRange", "topNRank")


def bounds(kind: str, average: float, spec: dict[str, Any]) -> tuple[float | None, float | None]:
    """Bounds of an average-bound check around the average of the history."""
    low = spec.get("thresholdLower", spec.get("threshold"))
    high = spec.get("thresholdUpper", spec.get("threshold"))
    return (None if kind == "averageBoundUpper" else average * (1 - float(low)), None if kind == "averageBoundLower" else average * (1 + float(high)))


def within(x: float, low: float | None, high: float | None) -> bool:
    return (low is None or x >= low) and (high is None or x <= high)


def jaccard_distance(a: set[str], b: set[str]) -> float:
    return 1 - len(a & b) / len(a | b) if a | b else 0.0


def _out(kind: str, spec: dict[str, Any], status: str, message: str, base: list[Result], **kw: Any) -> CheckResult:
    return CheckResult(spec["id"], display_name(kind), status, message, spec.get("metric"), spec.get("compareMetric"), source_id=",".join(base[0].sources) if base else "",
                       is_critical=bool(spec.get("isCritical", False)), description=spec.get("description"), metadata=list(spec.get("metadata", [])), **kw)


def snapshot(kind: str, spec: dict[str, Any], results: dict[str, list[Result]]) -> CheckResult:
    """Compare a metric with a threshold or another metric of the same run."""
    test, words = SNAPSHOT[kind]
    base = results.get(spec["metric"], [])
    other = spec.get("compareMetric")
    threshold = None if spec.get("threshold") is None else float(spec["threshold"])
    if not base or other is not None and not results.get(other):
        missing = spec["metric"] if not base else other
        return _out(kind, spec, ERROR, f"Metric {missing} has no result.", base, compared_threshold=threshold)
    try:
        if len(base) != 1:
            raise ValueError(f"metric {spec['metric']} has {len(base)} results; one is needed")
        if kind == "differByLT":
            if other is None or threshold is None:
                raise ValueError("a metric to compare with and a threshold are both needed")
        elif (other is None) == (threshold is None):
            raise ValueError("either a metric to compare with or a threshold is needed")
        if other is not None and len(results[other]) != 1:
            raise ValueError(f"metric {other} has {len(results[other])} results; one is needed")
        right = threshold if other is None else results[other][0].result
        left = base[0].result
        ok = test(left, right, threshold)
        low = high = right
        if kind == "differByLT":
            low, high = sorted((right * (1 - threshold), right * (1 + threshold)))
        elif kind == "lessThan":
            low = None
        elif kind == "greaterThan":
            high = None
        return _out(kind, spec, SUCCESS if ok else FAILURE, f"Metric {spec['metric']} = {left}: {'it' if ok else 'it is not so that it'} {words} {other or 'the threshold'} ({right}).", base,
                    compared_threshold=threshold if kind == "differByLT" else right, lower_bound=low, upper_bound=high)
    except Exception as e:
        return _out(kind, spec, ERROR, f"{type(e).__name__}: {e}", base, compared_threshold=threshold)


def trend(kind: str, spec: dict[str, Any], results: dict[str, list[Result]], history: Callable[..., list[tuple[Any, float, str | None]]]) -> CheckResult:
    """Compare a metric with its own history; ``history(ids, type, rule, window, offset)`` gives (date, result, additional result), latest first."""
    base = results.get(spec["metric"], [])
    threshold = float(spec["threshold"]) if spec.get("threshold") is not None else None
    if not base:
        return _out(kind, spec, ERROR, f"Metric {spec['metric']} has no result.", base, compared_threshold=threshold)
    try:
        if kind == "topNRank":
            if not all(r.metric_name.startswith("TOP_N") for r in base):
                raise ValueError("a top-N metric is needed")
            n = int(spec["targetNumber"])
            rank = lambda name: int(name.rsplit("_", 1)[1])
            now = {r.additional for r in base if rank(r.metric_name) <= n}
            past = history([spec["metric"]], "regular", "record", None, spec.get("windowOffset"))
            if not past:
                raise ValueError(f"metric {spec['metric']} has no history")
            last = max(d for d, *_ in past)
            before = {a for d, _, a, name in past if d == last and rank(name) <= n}
            distance = jaccard_distance(now, before)
            return _out(kind, spec, SUCCESS if distance <= threshold else FAILURE, f"Jaccard distance of the top {n} to those before: {distance}.", base,
                        compared_threshold=threshold, lower_bound=threshold, upper_bound=threshold)
        if len(base) != 1:
            raise ValueError(f"metric {spec['metric']} has {len(base)} results; one is needed")
        if base[0].type not in ("regular", "composed"):
            raise ValueError("a regular or composed metric is needed")
        past = history([spec["metric"]], base[0].type, spec["rule"], spec["windowSize"], spec.get("windowOffset"))
        values = [v for _, v, *_ in past if not math.isnan(v)]
        if not values:
            raise ValueError(f"metric {spec['metric']} has no history")
        average = math.fsum(values) / len(values)
        low, high = bounds(kind, average, spec)
        ok = within(base[0].result, low, high)
        return _out(kind, spec, SUCCESS if ok else FAILURE, f"Metric {spec['metric']} = {base[0].result}; average of {len(values)} past results: {average}; bounds: {low}, {high}.", base,
                    compared_threshold=threshold if threshold is not None else float(spec["thresholdLower"]), lower_bound=low, upper_bound=high)
    except Exception as e:
        return _out(kind, spec, ERROR, f"{type(e).__name__}: {e}", base, compared_threshold=threshold)


def expression(spec: dict[str, Any], results: dict[str, list[Result]]) -> CheckResult:
    """A condition over metric results; a missing or NaN result is an error."""
    try:
        formula = Formula(spec["formula"], boolean=True)
        values, sources = {}, []
        for i in formula.ids:
            got = results.get(i, [])
            if len(got) != 1:
                raise ValueError(f"metric {i} has {len(got)} results; one is needed")
            if math.isnan(got[0].result):
                raise ValueError(f"metric {i} is NaN")
            values[i] = got[0].result
            sources += got[0].sources
        ok = formula.value(values)
        out = CheckResult(spec["id"], "EXPRESSION", SUCCESS if ok else FAILURE, f"{spec['formula']} is {str(ok).lower()} for {values}.", source_id=",".join(dict.fromkeys(sources)))
    except Exception as e:
        out = CheckResult(spec["id"], "EXPRESSION", ERROR, f"{type(e).__name__}: {e}")
    out.base_metric, out.is_critical, out.description = spec["formula"], bool(spec.get("isCritical", False)), spec.get("description")
    return out


# Load checks

LOAD = ("exactColumnNum", "minColumnNum", "columnsExist", "schemaMatch")


def leaf_names(schema: T.StructType) -> set[str]:
    """Names of columns and of fields of nested structures."""
    out = set()
    for f in schema.fields:
        out.add(f.name)
        if isinstance(f.dataType, T.StructType):
            out |= leaf_names(f.dataType)
    return out


def same_schema(a: T.DataType, b: T.DataType, ignore_order: bool, case_sensitive: bool) -> bool:
    """Whether names and types agree all the way down; nullability doesn't count."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        name = (lambda f: f.name) if case_sensitive else (lambda f: f.name.lower())
        x, y = a.fields, b.fields
        if ignore_order:
            x, y = sorted(x, key=name), sorted(y, key=name)
        return len(x) == len(y) and all(name(f) == name(g) and same_schema(f.dataType, g.dataType, ignore_order, case_sensitive) for f, g in zip(x, y))
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return same_schema(a.elementType, b.elementType, ignore_order, case_sensitive)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return same_schema(a.keyType, b.keyType, ignore_order, case_sensitive) and same_schema(a.valueType, b.valueType, ignore_order, case_sensitive)
    return a == b


def load_check(kind: str, spec: dict[str, Any], schema: T.StructType | None, schemas: dict[str, T.StructType], case_sensitive: bool = False) -> CheckResult:
    """Check the schema of a source; only metadata is looked at."""
    expected = ""
    try:
        if schema is None:
            raise ValueError(f"no source {spec['source']!r}")
        fold = (lambda x: x) if case_sensitive else str.lower
        if kind in ("exactColumnNum", "minColumnNum"):
            n, wanted = len(schema.fields), int(spec["option"])
            expected = str(wanted)
            ok, said = (n == wanted if kind == "exactColumnNum" else n >= wanted), f"The source has {n} columns."
        elif kind == "columnsExist":
            expected = ",".join(spec["columns"])
            there = {fold(x) for x in leaf_names(schema)}
            missing = [c for c in spec["columns"] if fold(c) not in there]
            ok, said = not missing, f"Missing columns: {missing}." if missing else "All columns exist."
        elif kind == "schemaMatch":
            expected = spec["schema"]
            if spec["schema"] not in schemas:
                raise ValueError(f"no schema {spec['schema']!r}")
            ok = same_schema(schema, schemas[spec["schema"]], bool(spec.get("ignoreOrder", False)), case_sensitive)
            said = f"The source's schema is {'' if ok else 'not '}that of {spec['schema']}."
        else:
            raise ValueError(f"no load check {kind!r}")
        status = SUCCESS if ok else FAILURE
    except Exception as e:
        status, said = ERROR, f"{type(e).__name__}: {e}"
    return CheckResult(spec["id"], display_name(kind), status, said, source_id=spec["source"], expected=expected, is_critical=bool(spec.get("isCritical", False)),
                       description=spec.get("description"), metadata=list(spec.get("metadata", [])))
