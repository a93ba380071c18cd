"""Aggregate functions of the engine as column builders, over Spark's own aggregates.

They combine within tasks before a shuffle like any built-in aggregate, and
can be used in ``groupBy().agg()``, over windows and in streams.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .cells import every

#: Working range of Spark's approximate distinct count.
RSD_RANGE = (0.005, 0.39)


def comoment(x: Column, y: Column) -> Column:
    """Sum of (x - mean x)(y - mean y) over rows in which both are there; null without such rows."""
    both = x.isNotNull() & y.isNotNull()
    return F.regr_sxy(F.when(both, x), F.when(both, y))


def collect_list_limit(c: Column, limit: int) -> Column:
    """At most ``limit`` of the values that aren't null (all for 0 or less); which ones isn't fixed.

    The cut comes after gathering: for groups of bounded size.  Any others
    take :func:`collect_lists`, which never holds more than ``limit`` values.
    """
    got = F.collect_list(c)
    return F.slice(got, 1, limit) if limit > 0 else got


def merge_list_limit(arrays: Column, limit: int) -> Column:
    """Arrays of all rows in one, cut to ``limit`` elements (all for 0 or less); each row's array is cut before it travels."""
    got = F.flatten(F.collect_list(F.slice(arrays, 1, limit) if limit > 0 else arrays))
    return F.slice(got, 1, limit) if limit > 0 else got


def collect_lists(df: DataFrame, by: list[str], column: str, limit: int, name: str = "values") -> DataFrame:
    """``by`` and for each group the first ``limit`` of its values that aren't null, in order (all for 0 or less).

    The cut comes within each task, before the shuffle and before anything is
    gathered, so no task holds more than ``limit`` values of a group.  A group
    without values has an empty list; an empty table gives an empty result.
    """
    from ..plans.fuse import first_rows

    rows = df.select(*by, F.col(column).alias("__value"))
    there = rows.where(F.col("__value").isNotNull())
    if limit > 0:
        there = first_rows(there, by, F.col("__value"), limit)
    lists = there.groupBy(*by).agg(F.sort_array(F.collect_list("__value")).alias(name))
    groups = rows.select(*by).distinct()
    pairs = [groups[c].eqNullSafe(lists[c]) for c in by]
    joined = groups.join(lists, every(pairs), "left") if by else lists
    return joined.select(*([groups[c] for c in by] if by else []), F.coalesce(lists[name], F.array().cast(lists.schema[name].dataType)).alias(name))


def merge_lists(df: DataFrame, by: list[str], arrays: str, limit: int, name: str = "values") -> DataFrame:
    """:func:`collect_lists` over the elements of arrays; each array is cut before it is taken apart."""
    cut = F.slice(F.sort_array(F.col(arrays)), 1, limit) if limit > 0 else F.col(arrays)
    return collect_lists(df.select(*by, F.explode_outer(cut).alias("__element")), by, "__element", limit, name)


def approx_distinct(c: Column, error: float = 0.01) -> Column:
    """Estimated number of distinct values, with about the given relative error.

    Down to 0.005 by Spark's own function; below that by a sketch with the
    number of registers that the error asks for, of which 2 ** 21 (an error of
    0.0006) is the most.
    """
    if error >= RSD_RANGE[0]:
        return F.approx_count_distinct(c, min(RSD_RANGE[1], error))
    size = min(21, max(4, math.ceil(math.log2((0.8326 / max(error, 1e-9)) ** 2))))
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), size)), F.lit(0))


def approx_percentile(c: Column, target: float, error: float = 0.005, direct: bool = False) -> Column:
    """The value at quantile ``target``, or with ``direct`` the share of values at or below ``target`` (exact)."""
    if direct:
        return F.avg(F.when(c.isNotNull(), (c <= target).cast("double")))
    return F.percentile_approx(c, F.lit(float(target)), F.lit(int(max(1, round(1 / error)))))


def top_n(c: Column, n: int, capacity: int = 100) -> Column:
    """Array of (item, count) of the most frequent values by a sketch of ``capacity`` counters; null counts as a value, so filter it first."""
    return F.call_function("approx_top_k", c, F.lit(n), F.lit(max(n, capacity)))
