"""Metrics over tumbling windows of streams, by Structured Streaming.

A stream's rows get an event time (of processing, of the event, or by an
expression), cut to seconds, and fall into windows of one size.  The windows
of all streams of a job are one query over their union, so they close
together, on the least watermark.  A closed window is a small frame of
metric results; checks, storage and targets follow in ``foreachBatch``, with
the window's start as the reference date.

Metrics that group values (distinct values, duplicates, sequences, top-N) keep
a count for each value of an open window, and are finished over the counts of
the windows that close.  Failing rows pass through the same query at once;
they wait in the shared folder until their window closes, which is never
before the batch they came in.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.cells import cells, every
from ..operators.checks import Result
from ..operators.metrics import SINGLE, Metric, single
from ..operators.virtual import SERVICE
from ..plans.fuse import failing, first_rows
from ..plans.job import Engine, ResultSet, job_hash
from ..plans.spec import Job, parse
from ..sources.readers import Source
from ..sources.shared import scratch

WINDOW, EVENT = SERVICE
TRIGGER, SIZE, WATERMARK = "10 seconds", "10 minutes", "5 minutes"
#: Where a state of a count a value would be too large, ``StreamSettings.approximate`` lets sketches stand in.
APPROXIMATE = {"distinctValues": "approximateDistinctValues", "sequenceCompleteness": "approximateSequenceCompleteness"}


@dataclass
class StreamSettings:
    trigger: str = TRIGGER
    window: str = SIZE
    watermark: str = WATERMARK
    allow_empty_windows: bool = True  #: checks without results are skipped rather than errors
    checkpoint: str | None = None
    approximate: bool = False  #: distinct values and sequences by sketches of fixed size instead of a count for each value
    error_dump: int = 1000  #: failing rows kept of each metric and window; 0: none are collected
    strict: bool = False  #: a row whose event time is behind the watermark is dropped even if its window is still open


def event_time(df: DataFrame, by: dict[str, Any] | str = "processing") -> Column:
    """The event time by ``windowBy``: ``processing``, ``event`` (the Kafka record's timestamp) or ``{custom: expression}``."""
    if isinstance(by, dict):
        by = by.get("kind", by.get("custom", by))
    how = str(by)
    if how.lower() in ("processing", "processingtime"):
        at = F.current_timestamp()
    elif how.lower() in ("event", "eventtime"):
        at = df["timestamp"]
    else:
        at = F.expr(how[7:-1] if how.lower().startswith("custom(") and how.endswith(")") else how).cast("timestamp")
    return F.date_trunc("second", at)


def windowed(df: DataFrame, by: dict[str, Any] | str = "processing", settings: StreamSettings | None = None) -> DataFrame:
    """The rows with event time and window start, under the watermark; rows without an event time are dropped."""
    s = settings or StreamSettings()
    df = df.withColumn(EVENT, event_time(df, by)).where(F.col(EVENT).isNotNull())
    if not df.isStreaming:
        return df
    df = df.withWatermark(EVENT, s.watermark)
    if s.strict:
        # Every row is its own key: nothing is deduplicated, but rows behind the watermark don't pass.
        df = df.withColumn("__row", F.expr("uuid()")).dropDuplicatesWithinWatermark(["__row"]).drop("__row")
    return df


def _stream_metric(m: Metric) -> Metric:
    """The metric, or its sketch; what has no place in an aggregate of single values raises."""
    kind = APPROXIMATE.get(m.kind, m.kind)
    if kind not in SINGLE:
        raise ValueError(f"metric {m.id}: {m.kind} isn't a single aggregate; see window_groups")
    if kind != m.kind and len(m.columns) != 1:
        raise ValueError(f"metric {m.id}: a sketch of {m.kind} over several columns isn't offered")
    return Metric(m.id, kind, m.source, m.columns, m.params, m.description, m.metadata)


def split_metrics(metrics: list[Metric], settings: StreamSettings) -> tuple[list[Metric], list[Metric]]:
    """Metrics that are one aggregate, and those that keep a count for each value."""
    ones = [m for m in metrics if m.kind in SINGLE or settings.approximate and m.kind in APPROXIMATE and len(m.columns) == 1]
    return ones, [m for m in metrics if m not in ones]


def window_groups(df: DataFrame, metrics: list[Metric], settings: StreamSettings | None = None) -> DataFrame:
    """Counts of values by window for grouping and top-N metrics: ``window_start``, ``metric_id``, ``source_id``, ``value``, ``number``, ``n``.

    All metrics share one stateful aggregate.  ``value`` is the value of a
    top-N metric or a tuple as JSON, ``number`` that of a sequence.
    """
    s = settings or StreamSettings()
    each = []
    for m in metrics:
        cs = cells(df, m.columns)
        if m.kind == "sequenceCompleteness":
            there, value, number = cs[0].integer.isNotNull(), F.lit(""), cs[0].integer.cast("bigint")
        elif m.kind == "topN":
            there, value, number = cs[0].text.isNotNull(), cs[0].text, F.lit(None).cast("bigint")
        elif m.kind in ("distinctValues", "duplicateValues"):
            there = ~every([c.col.isNull() for c in cs])
            value, number = F.to_json(F.struct(*[c.col.alias(f"k{i}") for i, c in enumerate(cs)])), F.lit(None).cast("bigint")
        else:
            raise ValueError(f"metric {m.id}: {m.kind} doesn't group values")
        each.append(F.when(there, F.struct(F.lit(m.id).alias("metric_id"), F.lit(m.source).alias("source_id"), value.alias("value"), number.alias("number"))))
    rows = df.select(EVENT, F.explode(F.filter(F.array(*each), lambda e: e.isNotNull())).alias("e"))
    got = rows.groupBy(F.window(EVENT, s.window).alias("w"), F.col("e.metric_id").alias("metric_id"), F.col("e.source_id").alias("source_id"), F.col("e.value").alias("value"),
                       F.col("e.number").alias("number")).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("w.start").alias("window_start"), "metric_id", "source_id", "value", "number", "n")


def from_groups(counts: DataFrame, metrics: list[Metric]) -> DataFrame:
    """Results of grouping and top-N metrics over the counts of closed windows: ``window_start``, ``metric_id``, ``metric_name``, ``source_id``, ``result``, ``additional_result``."""
    by, parts = ["window_start", "metric_id", "source_id"], []
    plain = [m for m in metrics if m.kind != "topN"]
    none = F.lit(None).cast("string").alias("additional_result")
    if plain:
        got = counts.where(F.col("metric_id").isin([m.id for m in plain])).groupBy(*by).agg(
            F.count(F.lit(1)).cast("double").alias("d"), F.sum(F.col("n") - 1).cast("double").alias("again"), (F.max("number") - F.min("number")).cast("double").alias("span"))
        value = F.coalesce(*[F.when(F.col("metric_id") == m.id, F.col("d") if m.kind == "distinctValues" else F.col("again") if m.kind == "duplicateValues" else
                                    F.try_divide(F.col("d"), F.col("span") / float(m.params.get("increment", 1)) + 1)) for m in plain])
        name = F.coalesce(*[F.when(F.col("metric_id") == m.id, F.lit(m.name)) for m in plain])
        parts.append(got.select("window_start", "metric_id", name.alias("metric_name"), "source_id", value.alias("result"), none))
    tops = [m for m in metrics if m.kind == "topN"]
    if tops:
        rows = counts.where(F.col("metric_id").isin([m.id for m in tops]))
        most = F.coalesce(*[F.when(F.col("metric_id") == m.id, F.lit(int(m.params.get("targetNumber", 10)))) for m in tops])
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "value"))
        total = rows.groupBy(*by).agg(F.sum("n").alias("total"))
        best = rows.withColumn("place", place).where(F.col("place") <= most).join(total, by)
        parts.append(best.select("window_start", "metric_id", F.concat(F.lit("TOP_N_"), F.col("place").cast("string")).alias("metric_name"), "source_id",
                                 (F.col("n") / F.col("total")).cast("double").alias("result"), F.col("value").alias("additional_result")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def window_errors(df: DataFrame, metrics: list[Metric], key_fields: list[str], settings: StreamSettings | None = None) -> DataFrame | None:
    """Failing rows with their window: ``window_start``, ``metric_id``, ``source_id``, ``status``, ``message``, ``row_data``; stateless, so they come at once."""
    s = settings or StreamSettings()
    df = df.withColumn("__start", F.window(EVENT, s.window)["start"])
    return failing(df, metrics, key_fields, {"window_start": F.col("__start")})


def window_metrics(df: DataFrame, metrics: list[Metric], settings: StreamSettings | None = None, slide: str | None = None) -> DataFrame:
    """Single-pass metrics for each window of one source: ``window_start`` and a column ``m0``, ``m1``, ... for each metric.

    One stateful aggregate holds all metrics of a window (a few numbers and
    sketches), whatever the number of rows.  Works alike on a batch frame,
    which replays a stream.
    """
    s = settings or StreamSettings()
    window = F.window(EVENT, s.window, slide) if slide else F.window(EVENT, s.window)
    values = [single(x.kind, cells(df, x.columns), x).value.alias(f"m{i}") for i, x in enumerate(map(_stream_metric, metrics))]
    return df.groupBy(window.alias("w")).agg(*values).select(F.col("w.start").alias("window_start"), *[f"m{i}" for i in range(len(metrics))])


def session_metrics(df: DataFrame, metrics: list[Metric], gap: str, by: list[str]) -> DataFrame:
    """Single-pass metrics for each session: rows of one key, each less than ``gap`` after the one before; ``session_end`` is ``gap`` after the last.

    Spark also joins rows exactly ``gap`` apart, so it is given a gap that is shorter by its smallest unit of time.
    """
    values = [single(m.kind, cells(df, m.columns), m).value.alias(f"m{i}") for i, m in enumerate(metrics)]
    got = df.groupBy(*by, F.session_window(EVENT, f"{gap} -1 microsecond").alias("w")).agg(*values)
    return got.select(*by, F.col("w.start").alias("session_start"), (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("session_end"), *[f"m{i}" for i in range(len(metrics))])


_BRANCHES = "window_start timestamp, metric_id string, metric_name string, source_id string, result double, value string, number bigint, n bigint, error string"


def all_branches(frames: dict[str, DataFrame], metrics: list[Metric], keys: dict[str, list[str]], settings: StreamSettings) -> DataFrame:
    """Everything a streaming job watches as one frame: single results, counts of values, and failing rows as JSON in ``error``."""
    names = [c.split()[0] for c in _BRANCHES.split(", ")]
    types = dict(c.split() for c in _BRANCHES.split(", "))

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in names])

    parts = []
    for source in dict.fromkeys(m.source for m in metrics):
        own = [m for m in metrics if m.source == source]
        ones, groups = split_metrics(own, settings)
        if ones:
            parts.append(shaped(all_windows({source: frames[source]}, ones, settings)))
        if groups:
            parts.append(shaped(window_groups(frames[source], groups, settings)))
        bad = window_errors(frames[source], own, keys.get(source, []), settings) if settings.error_dump > 0 else None
        if bad is not None:
            parts.append(shaped(bad.select("window_start", "metric_id", F.lit(source).alias("source_id"), F.to_json(F.struct("status", "message", "row_data")).alias("error"))))
    return reduce(lambda a, b: a.unionByName(b), parts)


def all_windows(frames: dict[str, DataFrame], metrics: list[Metric], settings: StreamSettings | None = None) -> DataFrame:
    """Metrics of several streams as one frame: ``window_start``, ``metric_id``, ``metric_name``, ``source_id``, ``result``."""
    by: dict[str, list[Metric]] = defaultdict(list)
    for m in metrics:
        by[m.source].append(m)
    parts = []
    for source, ms in by.items():
        wide = window_metrics(frames[source], ms, settings)
        rows = F.array(*[F.struct(F.lit(m.id).alias("metric_id"), F.lit(m.name).alias("metric_name"), F.lit(source).alias("source_id"), F.col(f"m{i}").cast("double").alias("result")) for i, m in enumerate(ms)])
        parts.append(wide.select("window_start", F.explode(rows).alias("r")).select("window_start", "r.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class StreamJob:
    """A streaming job: windows are finished as they close, in the order of their start.

    After a restart from a checkpoint, open windows go on where they were;
    the common watermark moves again once every stream has had new rows.
    """

    engine: Engine
    job: Job
    settings: StreamSettings = field(default_factory=StreamSettings)
    on_window: Callable[[ResultSet], None] | None = None
    results: list[ResultSet] = field(default_factory=list)

    @classmethod
    def build(cls, engine: Engine, config: dict[str, Any], settings: StreamSettings | None = None, **kw: Any) -> StreamJob:
        return cls(engine, parse(config, tuple(kw.pop("given", ()))), settings or StreamSettings(), **kw)

    def frames(self, given: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """All streams with event time and watermark; derived streams keep those of their parents."""
        given = {i: windowed(df, "processing" if EVENT not in df.columns else f"`{EVENT}`", self.settings) if EVENT not in df.columns else df for i, df in (given or {}).items()}
        job = self.job
        by = {x["id"]: x.get("windowBy", "processing") for _, x in job.sources}
        plain = Job(job.id, connections=job.connections, schemas=job.schemas, sources=job.sources, streaming=True)
        sources, _ = self.engine.frames(plain)
        from ..operators.virtual import derive_all

        streams = {i: windowed(s.df, by[i], self.settings) for i, s in sources.items()} | given
        return derive_all(self.engine.spark, job.virtual, streams, bool(self.engine.settings.get("allowSqlQueries", True)))

    def start(self, given: dict[str, DataFrame] | None = None, available_now: bool = False) -> StreamingQuery:
        """Start the query.  With ``available_now`` it ends when the present data are used up."""
        self.engine.spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")
        keys = {x["id"]: list(x.get("keyFields", [])) for x in [*(x for _, x in self.job.sources), *self.job.virtual]}
        self._waiting = f"{self.settings.checkpoint.rstrip('/')}/{job_hash(self.job)}-errors" if self.settings.checkpoint else scratch(self.engine.spark, "stream-errors")
        rows = all_branches(self.frames(given), self.job.metrics, keys, self.settings)
        writer = rows.writeStream.outputMode("append").foreachBatch(self._finish).queryName(f"windows_{job_hash(self.job)[:12]}")
        if self.settings.checkpoint:
            writer = writer.option("checkpointLocation", f"{self.settings.checkpoint.rstrip('/')}/{job_hash(self.job)}")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=self.settings.trigger)).start()

    def _finish(self, batch: DataFrame, batch_id: int) -> None:
        info = {m.id: m for m in self.job.metrics}
        _, groups = split_metrics(self.job.metrics, self.settings)
        spark, dump = batch.sparkSession, self.settings.error_dump
        batch = batch.persist()
        if dump > 0:  # failing rows wait for their window; a batch that is run again replaces its own
            bad = first_rows(batch.where("error is not null").select("window_start", "metric_id", "source_id", "error"), ["window_start", "metric_id"], F.col("error"), dump)
            bad.write.mode("overwrite").parquet(f"{self._waiting}/batch={batch_id}")
        rows = batch.where("result is not null").select("window_start", "metric_id", "metric_name", "source_id", "result", F.lit(None).cast("string").alias("additional_result"))
        if groups:
            rows = rows.unionByName(from_groups(batch.where("n is not null"), groups))
        by: dict[datetime, list[Result]] = defaultdict(list)
        for r in rows.collect():  # closed windows only: a row for each metric, some for a top-N
            by[r["window_start"]].append(Result(r["metric_id"], r["metric_name"], r["result"], r["additional_result"], [r["source_id"]], info[r["metric_id"]].columns))
        batch.unpersist()
        kinds = "window_start timestamp, metric_id string, source_id string, error string"
        waiting = spark.read.schema(kinds).option("recursiveFileLookup", "true").parquet(self._waiting) if dump > 0 and by else None
        for start in sorted(by):
            rs = ResultSet(self.job.id, start, datetime.now(), sorted(by[start], key=lambda r: (r.metric_id, r.metric_name)))
            if waiting is not None:
                kept = first_rows(waiting.where(F.col("window_start") == F.lit(start)), ["metric_id"], F.col("error"), dump)
                e = F.from_json("error", "status string, message string, row_data map<string,string>")
                columns = F.coalesce(*[F.when(F.col("metric_id") == m.id, F.lit(json.dumps(m.columns))) for m in self.job.metrics])
                rs.errors = kept.select("metric_id", e.alias("e"), "source_id", columns.alias("metric_columns")).select(
                    "metric_id", "e.status", "e.message", "e.row_data", "source_id", F.lit("[]").alias("source_key_fields"), "metric_columns")
            results: dict[str, list[Result]] = defaultdict(list)
            for r in rs.regular:
                results[r.metric_id].append(r)
            rs.trend = self.engine.trends(self.job, start, results, rs.faults)
            for r in rs.trend:
                results[r.metric_id].append(r)
            rs.composed = self.engine.composed(self.job.composed, results, rs.faults)
            rs.checks = self.engine.checks(self.job, start, results, skip_missing=self.settings.allow_empty_windows)
            self.results.append(self.engine.finish(self.job, rs))
            if self.on_window:
                self.on_window(rs)


def replay(source: Source, metrics: list[Metric], by: dict[str, Any] | str, settings: StreamSettings | None = None) -> DataFrame:
    """What the windows of a stream would hold, computed over a batch frame (no row is late)."""
    df = windowed(source.df, by, settings)
    return all_windows({source.id: df}, [Metric(m.id, m.kind, source.id, m.columns, m.params) for m in metrics], settings)
