"""Exact quantiles of columns of any size, in bounded memory.

The ranks asked for are found by narrowing: numbers are counted by bucket, the
bucket that holds a rank is taken apart in the next round, and the last round
counts single values.  Buckets are of a logarithm first (so that those of a
round lie within a sixteenth of an octave), then twice of PARTS equal widths,
which leaves some 90,000 doubles at most.  So four scans read one column each,
and of whatever table no task sends, receives or sorts more than about PARTS
rows a rank, where ``percentile`` gathers all distinct values in one task.
Bucket numbers never fall as numbers rise, so rounding can't misplace a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PARTS = 1 << 16
_OCTAVE, _SHIFT, _INF, _NAN = 16, 1100, 1 << 19, 1 << 20


def _coarse(v: Column) -> Column:
    """A bucket by sign and logarithm; zero, infinities and NaN (the largest, as Spark sorts) have their own."""
    size = F.floor((F.log2(F.abs(v)) + _SHIFT) * _OCTAVE).cast("bigint") + 1
    far = float("inf")
    return F.when(F.isnan(v), F.lit(_NAN)).when(v == far, F.lit(_INF)).when(v == -far, F.lit(-_INF)).when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("bigint")


def _fine(v: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi > lo, F.floor((v - lo) / (hi - lo) * PARTS)).otherwise(F.lit(0)).cast("bigint")


def exact_quantiles(df: DataFrame, wanted: list[tuple[Column, float]]) -> DataFrame:
    """One row with ``q0``, ``q1``, ...: the quantile of each (number column, share), interpolated as by ``percentile``; null without numbers."""
    texts = [str(c) for c, _ in wanted]
    own = list(dict.fromkeys(texts))
    numbers = [wanted[texts.index(t)][0].cast("double") for t in own]
    if len(own) == 1:
        rows = df.select(F.lit(0).alias("d"), numbers[0].alias("v"))
    else:
        rows = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("d"), c.alias("v")) for d, c in enumerate(numbers)])).alias("e")).select("e.d", "e.v")
    rows = rows.where("v is not null")
    keys = list(dict.fromkeys((own.index(t), q) for t, (_, q) in zip(texts, wanted)))
    sides = [(i, side) for i in range(len(keys)) for side in (F.floor, F.ceil)]

    def narrow(counts: DataFrame, by: list[str]) -> DataFrame:
        """The buckets that hold a rank.  ``ranks`` are those within the bucket, from 1, and null if elsewhere."""
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        got = counts.withColumn("before", before)
        held = F.transform("ranks", lambda r: F.when((r > F.col("before")) & (r <= F.col("before") + F.col("n")), r - F.col("before")))
        got = got.select("d", F.col("least").alias("lo"), F.col("most").alias("hi"), "total", held.alias("ranks"))
        return got.where(F.exists("ranks", lambda r: r.isNotNull()))

    figures = [F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")]
    first = rows.groupBy("d", _coarse(F.col("v")).alias("b")).agg(*figures).withColumn("total", F.sum("n").over(Window.partitionBy("d")))
    ranks = F.array(*[F.when(F.col("d") == keys[i][0], side((F.col("total") - 1) * F.lit(float(keys[i][1]))).cast("bigint") + 1) for i, side in sides])
    at = narrow(first.withColumn("ranks", ranks), ["d"])
    for last in (False, False, True):
        cells = F.broadcast(at.withColumnRenamed("d", "of"))  # two rows a quantile at most
        inside = rows.join(cells, (F.col("d") == F.col("of")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        bucket = F.col("v") if last else _fine(F.col("v"), F.col("lo"), F.col("hi"))
        at = narrow(inside.groupBy("d", "lo", "hi", "total", "ranks", bucket.alias("b")).agg(*figures), ["d", "lo", "hi"])
    ends = at.agg(*[F.max(F.when(F.get("ranks", F.lit(j)).isNotNull(), F.col("lo"))).alias(f"r{j}") for j in range(len(sides))],
                  *[F.max(F.when(F.col("d") == d, F.col("total"))).alias(f"n{d}") for d in range(len(own))])

    def value(d: int, q: float) -> Column:
        i = keys.index((d, q))
        a, b, place = F.col(f"r{2 * i}"), F.col(f"r{2 * i + 1}"), (F.col(f"n{d}") - 1) * F.lit(float(q))
        return F.when(a == b, a).otherwise((F.ceil(place) - place) * a + (place - F.floor(place)) * b)

    return ends.select(*[value(own.index(t), q).alias(f"q{i}") for i, (t, (_, q)) in enumerate(zip(texts, wanted))])
