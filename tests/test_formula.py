import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from plumbline.functions.formula import Formula, FormulaError, references

VALUES = [
    ("1 + 2 * 3", 7), ("2 ^ 3 ^ 2", 64), ("-2 ^ 2", -4), ("(1 + 2) * 3", 9), ("10 / 4", 2.5), ("min(3, 2) + max(1, 5)", 7), ("abs(0 - 3) + sqrt(16)", 7), ("floor(1.7) + ceil(1.2) + round(2.5)", 6),
    ("round(0 - 2.5)", -2), ("ln(exp(2))", 2), ("LG(100)", 2), ("case when 1 > 2 then 5 when 2 > 1 then 6 else 7 end", 6), ("case when 1 > 2 then 5 end", 0), ("if 1 < 2 10 else 20", 10), ("1.5e2", 150),
    ("if (1 < 2) && not(3 < 2) 10 else 20", 10), ("100 * {{ a }} / {{b}}", 50), ("{{a}} + {{b}} - 3", 12), ("5 * {{b}} ^ 2 * 2", 1000)]
CONDITIONS = [("1 < 2", True), ("1 >= 2 || 2 <> 3", True), ("not(1 == 1)", False), ("(1 < 2) && (2 < 3)", True), ("((1 + 1) * 2 == 4)", True), ("true && false", False), ("(1 < 2 || 3 < 2) && 1 == 1", True)]


@pytest.mark.parametrize("text,want", VALUES)
def test_values(text, want):
    assert Formula(text).value({"a": 5.0, "b": 10.0}) == pytest.approx(want)


@pytest.mark.parametrize("text,want", CONDITIONS)
def test_conditions(text, want):
    assert Formula(text, boolean=True).value() is want


@pytest.mark.parametrize("text", ["", "1 +", "foo(1)", "1 < 2", "(1", "1 2", "min(1)", "sqrt(1, 2)", "case when 1 then 2 end", "$"])
def test_refused(text):
    with pytest.raises(FormulaError):
        Formula(text)


def test_doubles_never_raise():
    for text, want in [("1 / 0", math.inf), ("0 - 1 / 0", -math.inf), ("ln(0)", -math.inf), ("10 ^ 400", math.inf), ("exp(1000)", math.inf)]:
        assert Formula(text).value() == want
    for text in ("0 / 0", "sqrt(0 - 1)", "ln(0 - 1)", "(0 - 8) ^ 0.5"):
        assert math.isnan(Formula(text).value())


def test_references():
    assert references("{{ a }} + {{b}} * {{a}}") == ["a", "b"]
    with pytest.raises(KeyError):
        Formula("{{x}}").value({})


def test_column_agrees(spark):
    row = spark.range(1)
    got = row.select(*[Formula(t).column({"a": F.lit(5.0), "b": F.lit(10.0)}).cast("double").alias(f"c{i}") for i, (t, _) in enumerate(VALUES)]).first()
    assert list(got) == pytest.approx([w for _, w in VALUES])


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.integers(0, 50).map(str), lambda x: st.tuples(x, st.sampled_from("+-*"), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=12))
def test_like_python(text):
    assert Formula(text).value() == pytest.approx(eval(text))
