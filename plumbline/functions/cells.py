"""Cell expressions that never raise, whatever the ANSI mode.

A metric looks at cells (one column of one row) as text, as a number, as an
integer or as a date.  What can't be read that way is null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


@dataclass(frozen=True)
class Cell:
    """A column with its name and type."""

    name: str
    col: Column
    kind: T.DataType

    @property
    def text(self) -> Column:
        if isinstance(self.kind, T.StringType):
            return self.col
        if isinstance(self.kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(self.col)
        return self.col.cast("string")

    @property
    def number(self) -> Column:
        """As double: text is parsed, booleans are 1 and 0, timestamps are epoch seconds; dates and nested values are null."""
        if isinstance(self.kind, (T.DateType, T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.NullType)):
            return F.lit(None).cast("double")
        if isinstance(self.kind, T.DoubleType):
            return self.col
        return self.col.try_cast("double")

    @property
    def integer(self) -> Column:
        """As bigint; text with a fraction is null."""
        if isinstance(self.kind, (T.DateType, T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.NullType)):
            return F.lit(None).cast("bigint")
        return self.col.try_cast("bigint")

    def moment(self, pattern: str) -> Column:
        """As timestamp by a Spark date pattern; date and timestamp columns stand for themselves."""
        if isinstance(self.kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return self.col.cast("timestamp")
        return F.try_to_timestamp(self.text, F.lit(pattern))


def cells(df: DataFrame, names: list[str]) -> list[Cell]:
    """The named columns of ``df``; a sole ``*`` stands for all of them."""
    if list(names) == ["*"]:
        names = df.columns
    return [Cell(n, df[f"`{n}`"] if n in df.columns else df[n], _kind(df, n)) for n in names]


def _kind(df: DataFrame, name: str) -> T.DataType:
    for f in df.schema.fields:
        if f.name == name or f.name.lower() == name.lower():
            return f.dataType
    return df.select(name).schema[0].dataType


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def every(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def least(parts: list[Column]) -> Column:
    return F.least(*parts) if len(parts) > 1 else parts[0]


def greatest(parts: list[Column]) -> Column:
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def count_if(condition: Column) -> Column:
    """1 where the condition holds, else 0 (null counts as not holding)."""
    return F.when(condition, 1).otherwise(0)


def number_format(number: Column, precision: int, scale: int, outbound: bool = False) -> Column:
    """Whether a double's shortest decimal form has a precision and scale within the bounds.

    Inbound: precision and scale are at most the given ones; outbound: both
    exceed them.  Null, NaN and infinite numbers, and a precision below one,
    give false.
    """
    if precision <= 0:
        return F.lit(False)
    form = F.abs(number).cast("string")
    mantissa = F.regexp_replace(form, "E.*", "")
    power = F.coalesce(F.regexp_extract(form, r"E(-?\d+)", 1).try_cast("int"), F.lit(0))
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.", ""), "^0+", "")
    its_scale = F.length(F.substring_index(mantissa, ".", -1)) - power
    its_precision = F.greatest(F.lit(1), F.length(digits))
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    ok = ((its_precision > precision) & (its_scale > scale)) if outbound else ((its_precision <= precision) & (its_scale <= scale))
    return F.coalesce(finite & ok, F.lit(False))
