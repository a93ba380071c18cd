"""The formula language of composed metrics and expression checks.

Arithmetic: ``+ - * / ^`` (power associates to the left, a leading sign covers
the whole first term), ``min(a, b)``, ``max(a, b)``, ``abs sqrt floor ceil
round ln lg exp``, ``case when .. then .. else .. end`` (0 without an else)
and ``if <condition> a else b``.  Conditions: comparisons ``== <> >= <= > <``,
``&&``, ``||``, ``not(..)``, ``true``, ``false``.  Metrics are named ``{{ id }}``.

A formula is parsed once to a tree that is evaluated either on numbers (IEEE
rules: nothing raises) or as a Spark column.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z]+)|(\{\{\s*[^}]+?\s*\}\})|(&&|\|\||==|<>|>=|<=|[-+*/^()<>,']))")


class FormulaError(ValueError):
    """The text is not a formula."""


def references(text: str) -> list[str]:
    """Ids named in a formula, in order of first use."""
    return list(dict.fromkeys(m.strip() for m in re.findall(r"\{\{\s*([^}]+?)\s*\}\}", text)))


def _round(x: float) -> float:
    if math.isnan(x):
        return 0.0
    return x if math.isinf(x) else float(math.floor(x + 0.5))


def _safe(f: Callable[[float], float], bad: float = math.nan) -> Callable[[float], float]:
    def g(x: float) -> float:
        try:
            return float(f(x))
        except OverflowError:
            return math.inf
        except ValueError:
            return bad
    return g


def _div(a: float, b: float) -> float:
    if b:
        return a / b
    return math.nan if a == 0 or math.isnan(a) or math.isnan(b) else math.copysign(math.inf, a) * math.copysign(1, b)


def _pow(a: float, b: float) -> float:
    try:
        got = math.pow(a, b)
    except OverflowError:
        return -math.inf if a < 0 and b % 2 == 1 else math.inf
    except ValueError:
        return math.inf if a == 0 else math.nan
    return math.nan if a == 1 and math.isnan(b) else got


def _log(f: Callable[[float], float]) -> Callable[[float], float]:
    return lambda x: -math.inf if x == 0 else _safe(f)(x)


def _pick(f: Callable[[float, float], float]) -> Callable[[float, float], float]:
    return lambda a, b: math.nan if math.isnan(a) or math.isnan(b) else f(a, b)


_ONE: dict[str, tuple[Callable[[float], float], Callable[[Column], Column]]] = {
    "abs": (abs, F.abs), "sqrt": (_safe(math.sqrt), F.sqrt), "floor": (lambda x: x if math.isinf(x) or math.isnan(x) else float(math.floor(x)), lambda c: F.floor(c).cast("double")),
    "ceil": (lambda x: x if math.isinf(x) or math.isnan(x) else float(math.ceil(x)), lambda c: F.ceil(c).cast("double")),
    "round": (_round, lambda c: F.floor(c + 0.5).cast("double")), "ln": (_log(math.log), F.ln), "lg": (_log(math.log10), F.log10), "exp": (_safe(math.exp), F.exp),
}
_TWO: dict[str, tuple[Callable[[float, float], float], Callable[[Column, Column], Column]]] = {
    "+": (lambda a, b: a + b, lambda a, b: a + b), "-": (lambda a, b: a - b, lambda a, b: a - b), "*": (lambda a, b: a * b, lambda a, b: a * b),
    "/": (_div, F.try_divide), "^": (_pow, F.pow), "max": (_pick(max), F.greatest), "min": (_pick(min), F.least),
}
_COMPARE: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "<>": lambda a, b: a != b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b,
}


class Formula:
    """A parsed formula; ``boolean`` tells a condition from a number."""

    def __init__(self, text: str, boolean: bool = False):
        self.text, self.boolean = text, boolean
        self._tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise FormulaError(f"unreadable at {text[at:at + 20]!r} in {text!r}")
            self._tokens.append(m.group().strip())
            at = m.end()
        self._at = 0
        self.tree = self._condition() if boolean else self._expr()
        if self._at < len(self._tokens):
            raise FormulaError(f"left over: {' '.join(self._tokens[self._at:])!r} in {text!r}")
        self.ids = references(text)

    # Parser

    def _peek(self) -> str:
        return self._tokens[self._at] if self._at < len(self._tokens) else ""

    def _take(self, *wanted: str) -> str:
        got = self._peek()
        if not got or wanted and got.lower() not in wanted:
            raise FormulaError(f"expected {' or '.join(wanted) or 'more'}, found {got or 'the end'!r} in {self.text!r}")
        self._at += 1
        return got.lower() if wanted else got

    def _condition(self) -> tuple:
        left = self._both()
        while self._peek() == "||":
            self._at += 1
            left = ("or", left, self._both())
        return left

    def _both(self) -> tuple:
        left = self._fact()
        while self._peek() == "&&":
            self._at += 1
            left = ("and", left, self._fact())
        return left

    def _fact(self) -> tuple:
        word = self._peek().lower()
        if word == "not":
            self._at += 1
            self._take("(")
            inner = self._condition()
            self._take(")")
            return ("not", inner)
        if word in ("true", "false"):
            self._at += 1
            return ("bool", word == "true")
        start = self._at
        try:  # a comparison first: its left side may open with a parenthesis too
            left = self._expr()
            sign = self._take(*_COMPARE)
            return ("compare", sign, left, self._expr())
        except FormulaError:
            self._at = start
        self._take("(")
        inner = self._condition()
        self._take(")")
        return inner

    def _expr(self) -> tuple:
        word = self._peek().lower()
        if word == "case":
            self._at += 1
            arms = []
            while not arms or self._peek().lower() == "when":
                self._take("when")
                test = self._condition()
                self._take("then")
                arms.append((test, self._expr()))
            other = ("num", 0.0)
            if self._peek().lower() == "else":
                self._at += 1
                other = self._expr()
            self._take("end")
            return ("case", arms, other)
        if word == "if":
            self._at += 1
            test = self._condition()
            then = self._expr()
            self._take("else")
            return ("case", [(test, then)], self._expr())
        sign = self._take() if word in ("+", "-") else ""
        left = self._term()
        if sign == "-":
            left = ("two", "*", ("num", -1.0), left)
        while self._peek() in ("+", "-"):
            left = ("two", self._take(), left, self._term())
        return left

    def _term(self) -> tuple:
        left = self._power()
        while self._peek() in ("*", "/"):
            left = ("two", self._take(), left, self._power())
        return left

    def _power(self) -> tuple:
        left = self._factor()
        while self._peek() == "^":
            left = ("two", self._take(), left, self._factor())
        return left

    def _factor(self) -> tuple:
        got = self._take()
        if got == "(":
            inner = self._expr()
            self._take(")")
            return inner
        if got.startswith("{{"):
            return ("ref", got[2:-2].strip())
        if got[0].isdigit() or got[0] == ".":
            return ("num", float(got))
        if got == "-":  # a negative literal, as substituted values may be
            inner = self._take()
            if inner[0].isdigit() or inner[0] == ".":
                return ("num", -float(inner))
            raise FormulaError(f"misplaced sign in {self.text!r}")
        name = got.lower()
        if not name.isalpha() or self._peek() != "(":
            raise FormulaError(f"unexpected {got!r} in {self.text!r}")
        self._at += 1
        first = self._expr()
        if name in ("min", "max"):
            self._take(",")
            second = self._expr()
            self._take(")")
            return ("two", name, first, second)
        self._take(")")
        if name not in _ONE:
            raise FormulaError(f"no function {got!r}")
        return ("one", name, first)

    # Evaluation

    def value(self, of: Mapping[str, float] | None = None) -> Any:
        """Float or bool of the formula with the given metric values; an unknown id raises KeyError."""
        of = of or {}

        def go(t: tuple) -> Any:
            match t:
                case ("num", x) | ("bool", x):
                    return x
                case ("ref", x):
                    return float(of[x])
                case ("one", f, a):
                    return _ONE[f][0](go(a))
                case ("two", f, a, b):
                    return _TWO[f][0](go(a), go(b))
                case ("case", arms, other):
                    return go(next((x for test, x in arms if go(test)), other))
                case ("compare", sign, a, b):
                    return _COMPARE[sign](go(a), go(b))
                case ("not", a):
                    return not go(a)
                case ("and", a, b):
                    return bool(go(a)) & bool(go(b))
                case ("or", a, b):
                    return bool(go(a)) | bool(go(b))
            raise FormulaError(str(t))

        return go(self.tree)

    def column(self, of: Mapping[str, Column]) -> Column:
        """The formula over columns that stand for the metrics."""

        def go(t: tuple) -> Column:
            match t:
                case ("num", x) | ("bool", x):
                    return F.lit(x)
                case ("ref", x):
                    return of[x]
                case ("one", f, a):
                    return _ONE[f][1](go(a))
                case ("two", f, a, b):
                    return _TWO[f][1](go(a), go(b))
                case ("case", arms, other):
                    out = F
                    for test, x in arms:
                        out = out.when(go(test), go(x))
                    return out.otherwise(go(other))
                case ("compare", sign, a, b):
                    return _COMPARE[sign](go(a), go(b))
                case ("not", a):
                    return ~go(a)
                case ("and", a, b):
                    return go(a) & go(b)
                case ("or", a, b):
                    return go(a) | go(b)
            raise FormulaError(str(t))

        return go(self.tree)
