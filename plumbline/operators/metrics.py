"""The regular metrics: what each computes over a source, and which rows it calls failures.

A single-pass metric is an aggregate expression, so any number of them share
one scan.  The grouping metrics (distinct and duplicate tuples, completeness
of a sequence) and the top-N metric need a grouping of their own; the planner
shares groupings between metrics of the same columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from ..functions.aggregates import approx_distinct
from ..functions.cells import Cell, count_if, every, greatest, least, number_format, total

DATE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSZ"
MAX_INT, MIN_INT, MAX_DOUBLE, NAN = 2147483647.0, -2147483648.0, 1.7976931348623157e308, float("nan")


@dataclass
class Metric:
    """A regular metric of a job."""

    id: str
    kind: str
    source: str = ""
    columns: list[str] = field(default_factory=list)
    params: dict[str, Any] = field(default_factory=dict)
    description: str | None = None
    metadata: list[str] = field(default_factory=list)

    @property
    def name(self) -> str:
        return display_name(self.kind)

    @property
    def reversed(self) -> bool:
        return bool(self.params.get("reversed", self.kind in ("nullValues", "emptyValues", "completeness", "emptiness")))


@dataclass
class Single:
    """A single-pass metric: aggregate, value where it is null, failure condition of a row, its message."""

    value: Column
    empty: float
    fails: Column
    message: str


def display_name(kind: str) -> str:
    """``rowCount`` as ``ROW_COUNT``."""
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "_", kind).upper()


def _hits(of: Callable[[Cell, dict], Column], message: str) -> Callable[[list[Cell], Metric], Single]:
    """A metric that counts the cells for which a condition holds.

    ``reversed`` doesn't change the value: it says whether the rows with such
    cells fail, or the rows with other cells.
    """

    def build(cells: list[Cell], m: Metric) -> Single:
        hits = total([count_if(of(c, m.params)) for c in cells])
        text = f"{'Some' if m.reversed else 'Not all'} of the values in columns {[c.name for c in cells]} {message}."
        return Single(F.sum(hits), 0.0, hits > 0 if m.reversed else hits < len(cells), text)

    return build


def _compare(rule: str, a: Column, b: Any) -> Column:
    return {"eq": lambda: a == b, "lt": lambda: a < b, "lte": lambda: a <= b, "gt": lambda: a > b, "gte": lambda: a >= b}[rule]()


def _filled(c: Cell, p: dict) -> Column:
    return c.col.isNotNull() & (c.text != "") if p.get("includeEmptyStrings", False) else c.col.isNotNull()


def _share(of: Callable[[Cell, dict], Column], empty: float, filled: bool) -> Callable[[list[Cell], Metric], Single]:
    def build(cells: list[Cell], m: Metric) -> Single:
        hits = total([count_if(of(c, m.params)) for c in cells])
        bad = hits < len(cells) if filled else hits > 0
        good = hits > 0 if filled else hits < len(cells)
        return Single(F.try_divide(F.sum(hits).cast("double"), F.count(F.lit(1)).cast("double") * len(cells)), empty, bad if m.reversed else good,
                      f"Columns {[c.name for c in cells]} have {'empty' if m.reversed else 'filled'} cells.")

    return build


def _extreme(pick: Callable[[list[Column]], Column], agg: Callable[[Column], Column], of: Callable[[Cell], Column], empty: float, what: str):
    def build(cells: list[Cell], m: Metric) -> Single:
        best = pick([of(c) for c in cells])
        return Single(agg(best), empty, best.isNull(), f"No {what} in columns {[c.name for c in cells]}.")

    return build


def _number(agg: Callable[[Column, Metric], Column], empty: float = NAN):
    """A metric over the numbers of one column."""

    def build(cells: list[Cell], m: Metric) -> Single:
        d = cells[0].number
        return Single(agg(d, m), empty, d.isNull(), f"Value of column {cells[0].name} is not a number.")

    return build


_SHARES = {"medianValue": 0.5, "firstQuantile": 0.25, "thirdQuantile": 0.75}


def exact_share(m: Metric) -> float | None:
    """The share of an exact quantile; None for any other metric."""
    if m.kind not in (*_SHARES, "getQuantile") or m.params.get("mode", "approx") != "exact":
        return None
    return _SHARES[m.kind] if m.kind in _SHARES else float(m.params["target"])


def _quantile(at: float | None = None):
    def agg(d: Column, m: Metric) -> Column:
        q = float(m.params["target"]) if at is None else at
        if m.params.get("mode", "approx") == "exact":
            return F.percentile(d, F.lit(q))
        error = min(1.0, max(1e-7, float(m.params.get("accuracyError", 0.005))))
        return F.percentile_approx(d, F.lit(q), F.lit(int(max(1, round(1 / error)))))

    return _number(agg)


def _pair(agg: Callable[[Column, Column], Column]):
    """A metric over the rows in which both columns are numbers."""

    def build(cells: list[Cell], m: Metric) -> Single:
        x, y = cells[0].number, cells[1].number
        both = x.isNotNull() & y.isNotNull()
        return Single(agg(F.when(both, x), F.when(both, y)), NAN, ~both, f"Some of columns {[c.name for c in cells]} is not a number.")

    return build


def _rows(of: Callable[[list[Cell], dict], Column], message: str):
    """A metric that counts the rows for which a condition over several columns holds."""

    def build(cells: list[Cell], m: Metric) -> Single:
        hit = count_if(of(cells, m.params))
        return Single(F.sum(hit), 0.0, hit > 0 if m.reversed else hit < 1, f"Columns {[c.name for c in cells]}: {message}.")

    return build


def _levenshtein(cells: list[Cell], p: dict) -> Column:
    a, b = (F.upper(c.text) for c in cells)
    if p.get("normalize", False):
        a, b = F.trim(a), F.trim(b)
        return F.coalesce(F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b)).cast("double")),
                          F.when(a.isNotNull() & b.isNotNull(), 0.0)) < float(p["threshold"])
    return F.levenshtein(a, b) < float(p["threshold"])


def _days(cells: list[Cell], p: dict) -> Column:
    a, b = (c.moment(p.get("dateFormat", DATE_FORMAT)) for c in cells)
    return F.abs(F.datediff(a, b)) < int(p["threshold"])


def _row_count(cells: list[Cell], m: Metric) -> Single:
    return Single(F.count(F.lit(1)), 0.0, F.lit(False), "")


def _avg_string(cells: list[Cell], m: Metric) -> Single:
    lengths = total([F.coalesce(F.length(c.text), F.lit(0)) for c in cells])
    there = total([count_if(c.col.isNotNull()) for c in cells])
    return Single(F.try_divide(F.sum(lengths).cast("double"), F.sum(there).cast("double")), NAN, there < 1, f"Columns {[c.name for c in cells]} are null.")


def _sum(cells: list[Cell], m: Metric) -> Single:
    numbers = [c.number for c in cells]
    read = total([count_if(d.isNotNull()) for d in numbers])
    return Single(F.sum(total([F.coalesce(d, F.lit(0.0)) for d in numbers])), 0.0, read < len(cells), f"Some of columns {[c.name for c in cells]} is not a number.")


def rsd(params: dict) -> float:
    return float(params.get("accuracyError", 0.01))


def _approx_distinct(cells: list[Cell], m: Metric) -> Single:
    return Single(approx_distinct(cells[0].text, rsd(m.params)), 0.0, cells[0].col.isNull(), f"Column {cells[0].name} is null.")


def _approx_sequence(cells: list[Cell], m: Metric) -> Single:
    n = cells[0].integer
    whole = (F.max(n) - F.min(n)).cast("double") / float(m.params.get("increment", 1)) + 1
    return Single(F.try_divide(approx_distinct(n, rsd(m.params)).cast("double"), whole), 0.0, n.isNull(), f"Column {cells[0].name} is not an integer.")


def _bounds(c: Cell, p: dict, outside: bool) -> Column:
    d, low, high, bound = c.number, float(p["lowerCompareValue"]), float(p["upperCompareValue"]), p.get("includeBound", False)
    if outside:
        return (d <= low) | (d >= high) if bound else (d < low) | (d > high)
    return (d >= low) & (d <= high) if bound else (d > low) & (d < high)


def _numbers(p: dict) -> list[float]:
    return [float(x) for x in p["domain"]]


def _number_is(sign: str) -> Callable[[Cell, dict], Column]:
    def of(c: Cell, p: dict) -> Column:
        return _compare(sign + ("e" if p.get("includeBound", False) else ""), c.number, float(p["compareValue"]))

    return of


SINGLE: dict[str, Callable[[list[Cell], Metric], Single]] = {
    "rowCount": _row_count,
    "nullValues": _hits(lambda c, p: c.col.isNull(), "are null"),
    "emptyValues": _hits(lambda c, p: c.text == "", "are empty strings"),
    "completeness": _share(_filled, NAN, True),
    "emptiness": _share(lambda c, p: ~_filled(c, p), 0.0, False),
    "minString": _extreme(least, F.min, lambda c: F.length(c.text), MAX_INT, "text"),
    "maxString": _extreme(greatest, F.max, lambda c: F.length(c.text), MIN_INT, "text"),
    "avgString": _avg_string,
    "stringLength": _hits(lambda c, p: _compare(p["compareRule"], F.length(c.text), int(p["length"])), "have the required length"),
    "stringInDomain": _hits(lambda c, p: c.text.isin(list(p["domain"])), "are in the domain"),
    "stringOutDomain": _hits(lambda c, p: ~c.text.isin(list(p["domain"])), "are outside the domain"),
    "stringValues": _hits(lambda c, p: c.text == F.lit(str(p["compareValue"])), "equal the required value"),
    "regexMatch": _hits(lambda c, p: c.text.rlike(p["regex"]), "match the pattern"),
    "regexMismatch": _hits(lambda c, p: ~c.text.rlike(p["regex"]), "don't match the pattern"),
    "formattedDate": _hits(lambda c, p: c.moment(p.get("dateFormat", DATE_FORMAT)).isNotNull(), "follow the date format"),
    "formattedNumber": _hits(lambda c, p: number_format(c.number, int(p["precision"]), int(p["scale"]), p.get("compareRule", "inbound") == "outbound"), "follow the number format"),
    "minNumber": _extreme(least, F.min, lambda c: c.number, MAX_DOUBLE, "number"),
    "maxNumber": _extreme(greatest, F.max, lambda c: c.number, -MAX_DOUBLE, "number"),
    "sumNumber": _sum,
    "avgNumber": _number(lambda d, m: F.avg(d)),
    "stdNumber": _number(lambda d, m: F.stddev_pop(d)),
    "castedNumber": _hits(lambda c, p: c.number.isNotNull(), "are numbers"),
    "numberInDomain": _hits(lambda c, p: c.number.isin(_numbers(p)), "are in the domain"),
    "numberOutDomain": _hits(lambda c, p: F.coalesce(~c.number.isin(_numbers(p)), F.lit(False)), "are outside the domain"),
    "numberLessThan": _hits(_number_is("lt"), "are less than the bound"),
    "numberGreaterThan": _hits(_number_is("gt"), "are greater than the bound"),
    "numberBetween": _hits(lambda c, p: _bounds(c, p, False), "are within the interval"),
    "numberNotBetween": _hits(lambda c, p: _bounds(c, p, True), "are outside the interval"),
    "numberValues": _hits(lambda c, p: c.number == float(p["compareValue"]), "equal the required number"),
    "medianValue": _quantile(_SHARES["medianValue"]),
    "firstQuantile": _quantile(_SHARES["firstQuantile"]),
    "thirdQuantile": _quantile(_SHARES["thirdQuantile"]),
    "getQuantile": _quantile(),
    "getPercentile": _number(lambda d, m: F.avg(F.when(d.isNotNull(), (d <= float(m.params["target"])).cast("double"))), 0.0),
    "columnEq": _rows(lambda cs, p: every([cs[0].text == c.text for c in cs[1:]]), "the values are not equal"),
    "dayDistance": _rows(_days, "the dates are too far apart"),
    "levenshteinDistance": _rows(_levenshtein, "the texts are too far apart"),
    "coMoment": _pair(F.regr_sxy),
    "covariance": _pair(F.covar_pop),
    "covarianceBessel": _pair(F.covar_samp),
    "approximateDistinctValues": _approx_distinct,
    "approximateSequenceCompleteness": _approx_sequence,
}
GROUPING = ("distinctValues", "duplicateValues", "sequenceCompleteness")
KINDS = (*SINGLE, *GROUPING, "topN")

_ONE_COLUMN = {"avgNumber", "stdNumber", "medianValue", "firstQuantile", "thirdQuantile", "getQuantile", "getPercentile", "sequenceCompleteness",
               "approximateDistinctValues", "approximateSequenceCompleteness", "topN"}
_TWO_COLUMNS = {"dayDistance", "levenshteinDistance", "coMoment", "covariance", "covarianceBessel"}
_NEEDED = {
    "stringLength": ("length", "compareRule"), "stringInDomain": ("domain",), "stringOutDomain": ("domain",), "stringValues": ("compareValue",), "regexMatch": ("regex",),
    "regexMismatch": ("regex",), "formattedNumber": ("precision", "scale"), "numberInDomain": ("domain",), "numberOutDomain": ("domain",), "numberLessThan": ("compareValue",),
    "numberGreaterThan": ("compareValue",), "numberBetween": ("lowerCompareValue", "upperCompareValue"), "numberNotBetween": ("lowerCompareValue", "upperCompareValue"),
    "numberValues": ("compareValue",), "getQuantile": ("target",), "getPercentile": ("target",), "dayDistance": ("threshold",), "levenshteinDistance": ("threshold",),
}


def problems(m: Metric) -> list[str]:
    """What is wrong with a metric's description."""
    out = []
    if m.kind not in KINDS:
        return [f"metric {m.id}: no kind {m.kind!r}"]
    n = len(m.columns)
    star = m.columns == ["*"]
    if m.kind == "rowCount":
        if n:
            out.append(f"metric {m.id}: takes no columns")
    elif not n:
        out.append(f"metric {m.id}: needs columns")
    elif m.kind in _ONE_COLUMN and (n != 1 or star):
        out.append(f"metric {m.id}: needs exactly one column")
    elif m.kind in _TWO_COLUMNS and n != 2 and not star:
        out.append(f"metric {m.id}: needs exactly two columns")
    elif m.kind == "columnEq" and n < 2 and not star:
        out.append(f"metric {m.id}: needs two columns or more")
    out += [f"metric {m.id}: needs the parameter {x}" for x in _NEEDED.get(m.kind, ()) if x not in m.params]
    p = m.params
    if "domain" in p and not p["domain"]:
        out.append(f"metric {m.id}: the domain is empty")
    if m.kind == "getQuantile" and "target" in p and not 0 <= float(p["target"]) <= 1:
        out.append(f"metric {m.id}: target is not within [0, 1]")
    if "accuracyError" in p and not 0 < float(p["accuracyError"]) <= 1:
        out.append(f"metric {m.id}: accuracyError is not within (0, 1]")
    for x in ("length", "precision", "scale", "increment", "targetNumber", "maxCapacity"):
        if x in p and int(p[x]) <= 0:
            out.append(f"metric {m.id}: {x} is not positive")
    if m.kind == "levenshteinDistance" and "threshold" in p:
        t = float(p["threshold"])
        if p.get("normalize", False) and not 0 <= t <= 1 or not p.get("normalize", False) and t != int(t):
            out.append(f"metric {m.id}: threshold is {'not within [0, 1]' if p.get('normalize', False) else 'not an integer'}")
    if m.kind == "stringLength" and p.get("compareRule") not in (None, "eq", "lt", "lte", "gt", "gte"):
        out.append(f"metric {m.id}: no compareRule {p['compareRule']!r}")
    if m.kind == "formattedNumber" and p.get("compareRule", "inbound") not in ("inbound", "outbound"):
        out.append(f"metric {m.id}: no compareRule {p['compareRule']!r}")
    return out


def single(kind: str, cells: list[Cell], m: Metric) -> Single:
    got = SINGLE[kind](cells, m)
    got.value = F.coalesce(got.value.cast(T.DoubleType()), F.lit(got.empty).cast("double"))
    return got
