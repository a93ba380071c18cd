"""From the metrics of one source to as few Spark plans as possible.

* all single-pass metrics: one global aggregate over one scan, which reads
  only the columns they name;
* exact quantiles: four more scans of their columns, for all of them together;
* grouping metrics: one two-level aggregate for each distinct list of columns;
* top-N metrics: one grouping each, cut by a sort with a limit.

The outcome is a DataFrame of a few rows; nothing runs until it is used.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.cells import cells, every
from ..operators.metrics import GROUPING, SINGLE, Metric, exact_share, single
from ..operators.quantiles import exact_quantiles
from ..sources.shared import scratch

#: Metrics computed in one aggregate; beyond it a second scan is cheaper than so wide a row.
MAX_FUSED = 250
RESULTS = T.StructType([
    T.StructField("metric_id", T.StringType()), T.StructField("metric_name", T.StringType()), T.StructField("result", T.DoubleType()),
    T.StructField("additional_result", T.StringType())])


def lower_names(df: DataFrame) -> DataFrame:
    """The frame with lower-case column names, for case-insensitive jobs; names that then clash raise."""
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"ambiguous column names: {sorted({n for n in names if names.count(n) > 1})}")
    return df if names == df.columns else df.toDF(*names)


def fused(df: DataFrame, metrics: list[Metric], by: list[Column] | None = None) -> DataFrame:
    """Single-pass metrics as one aggregate with a column for each, named ``m0``, ``m1``, ...; grouped ``by`` if given.

    Exact quantiles of a whole frame take scans of their own, see :mod:`..operators.quantiles`; those of
    groups are gathered by group.
    """
    exact = {} if by else {i: q for i, q in enumerate(map(exact_share, metrics)) if q is not None}
    aggs = [single(m.kind, cells(df, m.columns), m).value.alias(f"m{i}") for i, m in enumerate(metrics) if i not in exact]
    if by:
        return df.groupBy(*by).agg(*aggs)
    if not exact:
        return df.agg(*aggs)
    wide = exact_quantiles(df, [(cells(df, metrics[i].columns)[0].number, q) for i, q in exact.items()])
    wide = wide.select(*[F.coalesce(f"q{k}", F.lit(float("nan"))).alias(f"m{i}") for k, i in enumerate(exact)])
    if aggs:
        wide = df.agg(*aggs).crossJoin(F.broadcast(wide))  # one row on either side
    return wide.select(*[f"m{i}" for i in range(len(metrics))])


def _rows(wide: DataFrame, metrics: list[Metric], prefix: str = "m", keep: tuple[str, ...] = ()) -> DataFrame:
    parts = F.array(*[
        F.struct(F.lit(m.id).alias("metric_id"), F.lit(m.name).alias("metric_name"), F.col(f"{prefix}{i}").cast("double").alias("result"),
                 F.lit(None).cast("string").alias("additional_result")) for i, m in enumerate(metrics)])
    return wide.select(*keep, F.explode(parts).alias("r")).select(*keep, "r.*")


def _grouping_key(m: Metric, df: DataFrame) -> tuple:
    names = tuple(c.name for c in cells(df, m.columns))
    return ("integer", names) if m.kind == "sequenceCompleteness" else ("tuple", names)


def _grouped(df: DataFrame, key: tuple, metrics: list[Metric]) -> DataFrame:
    cs = cells(df, list(key[1]))
    if key[0] == "integer":
        rows = df.select(cs[0].integer.alias("k0")).where("k0 is not null")
    else:
        # A tuple counts unless all of it is null, so a tuple with some nulls is one of its own.
        rows = df.select(*[c.col.alias(f"k{i}") for i, c in enumerate(cs)]).where(~every([F.col(f"k{i}").isNull() for i in range(len(cs))]))
    groups = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    out = []
    for i, m in enumerate(metrics):
        if m.kind == "distinctValues":
            value = F.count(F.lit(1))
        elif m.kind == "duplicateValues":
            value = F.sum(F.col("n") - 1)
        else:
            value = F.try_divide(F.count(F.lit(1)).cast("double"), (F.max("k0") - F.min("k0")).cast("double") / float(m.params.get("increment", 1)) + 1)
        out.append(F.coalesce(value.cast("double"), F.lit(0.0)).alias(f"m{i}"))
    return _rows(groups.agg(*out), metrics)


def top_n(df: DataFrame, m: Metric) -> DataFrame:
    """Rows ``TOP_N_1``, ``TOP_N_2``, ...: the most frequent values with their share of the non-null cells.

    Exact by default, ties by value.  With ``mode`` ``approx`` a sketch of
    ``maxCapacity`` counters answers in one pass.
    """
    cell = cells(df, m.columns)[0]
    n = int(m.params.get("targetNumber", 10))
    rows = df.select(cell.text.alias("value")).where("value is not null")
    if m.params.get("mode", "exact") == "approx":
        cap = max(n, int(m.params.get("maxCapacity", 100)))
        got = rows.agg(F.expr(f"approx_top_k(value, {n}, {cap})").alias("top"), F.count(F.lit(1)).alias("total"))
        got = got.select("total", F.transform("top", lambda t: F.struct(t["count"].alias("n"), t["item"].alias("value"))).alias("top"))
    else:
        # The counts feed both the best and their total, and are computed once.
        counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        best = counts.orderBy(F.desc("n"), "value").limit(n).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "value"))).alias("top"))
        total = counts.agg(F.sum("n").alias("total"))
        got = best.crossJoin(F.broadcast(total)).select("total", F.transform("top", lambda t: F.struct((-t["minus"]).alias("n"), t["value"].alias("value"))).alias("top"))  # one row on either side
    # Without any value there is one row: "" and NaN.
    return got.select("total", F.posexplode_outer("top").alias("i", "t")).select(
        F.lit(m.id).alias("metric_id"), F.concat(F.lit("TOP_N_"), (F.coalesce("i", F.lit(0)) + 1).cast("string")).alias("metric_name"),
        F.when(F.col("t").isNull(), F.lit(float("nan"))).otherwise(F.try_divide(F.col("t.n").cast("double"), F.col("total").cast("double"))).alias("result"),
        F.coalesce("t.value", F.lit("")).alias("additional_result"))


def results(df: DataFrame, metrics: list[Metric]) -> DataFrame:
    """Results of regular metrics over one source: ``metric_id``, ``metric_name``, ``result``, ``additional_result``."""
    ones = [m for m in metrics if m.kind in SINGLE]
    parts = [_rows(fused(df, ones[i:i + MAX_FUSED]), ones[i:i + MAX_FUSED]) for i in range(0, len(ones), MAX_FUSED)]
    groups: dict[tuple, list[Metric]] = defaultdict(list)
    for m in metrics:
        if m.kind in GROUPING:
            groups[_grouping_key(m, df)].append(m)
    parts += [_grouped(df, key, ms) for key, ms in groups.items()]
    parts += [top_n(df, m) for m in metrics if m.kind == "topN"]
    if not parts:
        return df.sparkSession.createDataFrame([], RESULTS)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _row_data(df: DataFrame, names: list[str]) -> Column:
    both = [x for n in dict.fromkeys(names) for x in (F.lit(n), F.coalesce(cells(df, [n])[0].text, F.lit("")))]
    return F.create_map(*both) if both else F.create_map().cast("map<string,string>")


def _failure(df: DataFrame, m: Metric, names: list[str], message: str) -> Column:
    return F.struct(F.lit(m.id).alias("metric_id"), F.lit("Failure").alias("status"), F.lit(message).alias("message"), _row_data(df, names).alias("row_data"))


def failing(df: DataFrame, metrics: list[Metric], keys: list[str], more: dict[str, Column]) -> DataFrame | None:
    """Failing rows of all metrics that a row fails by itself, in one scan, with ``more`` columns; None if there is no such metric."""
    conditions = []
    for m in metrics:
        cs = cells(df, m.columns) if m.columns else []
        names = [c.name for c in cs]
        if m.kind in SINGLE and m.kind != "rowCount":
            got = single(m.kind, cs, m)
            fails, message = got.fails, got.message
        elif m.kind == "distinctValues":
            fails, message = every([c.col.isNull() for c in cs]), f"All values of columns {names} are null."
        elif m.kind == "sequenceCompleteness":
            fails, message = cs[0].integer.isNull(), f"Column {names[0]} is not an integer."
        elif m.kind == "topN":
            fails, message = cs[0].col.isNull(), f"Column {names[0]} is null."
        else:
            continue
        conditions.append(F.when(fails, _failure(df, m, [*keys, *names], message)))
    if not conditions:
        return None
    return df.select(*[c.alias(k) for k, c in more.items()], F.explode(F.filter(F.array(*conditions), lambda e: e.isNotNull())).alias("e")).select(*more, "e.*")


def errors(df: DataFrame, metrics: list[Metric], key_fields: list[str] | None = None, dump_size: int = 10000) -> DataFrame:
    """Failing rows: ``metric_id``, ``status``, ``message``, ``row_data`` (key fields and metric columns as text), at most ``dump_size`` a metric.

    Which rows are kept is fixed: the first by their data.  All single-pass
    metrics share one scan; of a group of equal tuples all but one row fail
    the metric of duplicates, and only all-null tuples fail that of distinct
    values.  For the cut see :func:`first_rows`.
    """
    keys = list(key_fields or [])
    rows_ = failing(df, metrics, keys, {})
    found = [] if rows_ is None else [rows_]
    for m in metrics:
        if m.kind != "duplicateValues":
            continue
        cs = cells(df, m.columns)
        names = [c.name for c in cs]
        need = list(dict.fromkeys([*keys, *names]))  # raw columns travel; the row's map is built for duplicates only
        rows = df.where(~every([c.col.isNull() for c in cs])).select(*[cells(df, [n])[0].col.alias(n) for n in need])
        nth = F.row_number().over(Window.partitionBy(*[c.col for c in cells(rows, names)]).orderBy(*[c.text for c in cells(rows, need)]))
        again = rows.withColumn("__nth", nth).where("__nth > 1")
        found.append(again.select(_failure(again, m, [*keys, *names], f"Values of columns {names} are duplicates.").alias("e")).select("e.*"))
    if not found:
        return df.sparkSession.createDataFrame([], "metric_id string, status string, message string, row_data map<string,string>")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return first_rows(out, ["metric_id"], F.to_json("row_data"), dump_size)


SALTS = 64  #: parts that the rows of a group are first cut in
MANY = 1 << 14  #: beyond it SALTS times the rows asked for are too many for one task
_CUT = "spark.sql.optimizer.windowGroupLimitThreshold"


def first_rows(df: DataFrame, by: list[str], order: Column, n: int) -> DataFrame:
    """The first ``n`` rows of each group.

    Cut three times to ``n`` rows: within each task before anything is
    shuffled, within each of SALTS parts of a group, and at last for the whole
    group, of which then SALTS * n rows meet in one task at most.  Spark
    places the first cut for limits up to a threshold, which is raised to ``n``.

    More than MANY rows are cut in the shared folder, at once rather than when
    the result is used, see :func:`_first_of_many`.
    """
    names = [f"__{x}" for x in ("order", "salt", "rank")]
    spark = df.sparkSession
    if n > MANY:
        return _first_of_many(df, by, order, n)
    if int(spark.conf.get(_CUT)) < n:
        spark.conf.set(_CUT, str(n))
    out = df.withColumn(names[0], order).withColumn(names[1], F.pmod(F.xxhash64(names[0]), F.lit(SALTS)))
    for keys in ([*by, names[1]], by):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(names[0]))
        out = out.withColumn(names[2], rank).where(F.col(names[2]) <= n).drop(names[2])
    return out.drop(*names[:2])


def _first_of_many(df: DataFrame, by: list[str], order: Column, n: int) -> DataFrame:
    """:func:`first_rows` of groups that may be too large for one task.

    All rows are written as they come and counted.  Groups of at most ``n``
    rows need no cut.  The others are laid out in files by ranges of their
    order, equal rows spread as any others; counts tell which files are within
    the first ``n`` rows, and only the file in which a group is cut is sorted.
    """
    spark = df.sparkSession

    def kept(rows: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        rows.write.option("maxRecordsPerFile", 0).parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    def same(rows: DataFrame, other: DataFrame) -> Column:
        return every([F.lit(True), *[rows[f"`{c}`"].eqNullSafe(other[f"__by{i}"]) for i, c in enumerate(by)]])

    columns = [F.col(f"`{c}`") for c in df.columns]
    keys = [F.col(f"`{c}`").alias(f"__by{i}") for i, c in enumerate(by)]
    rows = kept(df.withColumn("__order", order), "rows")
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > n)
    if large.isEmpty():
        return rows.select(*columns)
    large = F.broadcast(large)  # each stands for more than n rows
    small, cut = rows.join(large, same(rows, large), "left_anti"), rows.join(large, same(rows, large), "left_semi")
    at = [*[F.col(f"`{c}`") for c in by], F.col("__order"), F.col("__tie")]
    ranged = kept(cut.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*at), "ranges").withColumn("__file", F.col("_metadata.file_name"))
    files = ranged.groupBy(*keys, F.col("__file").alias("__of")).agg(F.count(F.lit(1)).alias("__size"))
    own = [f"__by{i}" for i in range(len(by))]
    before = F.sum("__size").over(Window.partitionBy(*own).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    files = F.broadcast(files.withColumn("__left", n - F.coalesce(before, F.lit(0))).where("__left > 0"))
    got = ranged.join(files, same(ranged, files) & (ranged["__file"] == files["__of"]))
    rank = F.row_number().over(Window.partitionBy(*own).orderBy("__order", "__tie"))
    last = got.where("__size > __left").withColumn("__rank", rank).where("__rank <= __left")
    return small.select(*columns).unionByName(got.where("__size <= __left").select(*columns)).unionByName(last.select(*columns))


def error_counts(df: DataFrame, metrics: list[Metric]) -> DataFrame:
    """Number of failing rows of each single-pass metric, in one scan: ``metric_id``, ``failures``."""
    ones = [m for m in metrics if m.kind in SINGLE]
    wide = df.agg(*[F.coalesce(F.sum(F.when(single(m.kind, cells(df, m.columns), m).fails, 1).otherwise(0)), F.lit(0)).alias(f"m{i}") for i, m in enumerate(ones)])
    parts = F.array(*[F.struct(F.lit(m.id).alias("metric_id"), F.col(f"m{i}").alias("failures")) for i, m in enumerate(ones)])
    return wide.select(F.explode(parts).alias("r")).select("r.*")
