"""Derived sources: sql, join, filter, select and aggregate over other sources."""

from __future__ import annotations

from functools import reduce
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

KINDS = {"sql": None, "join": 2, "filter": 1, "select": 1, "aggregate": 1}
STREAMABLE = ("filter", "select")
JOINS = ("inner", "outer", "cross", "full", "right", "left", "semi", "anti", "fullouter", "rightouter", "leftouter", "leftsemi", "leftanti")
#: Columns that a stream carries for its windows; derived streams keep them.
SERVICE = ("__window_start", "__event_time")


def order(specs: list[dict[str, Any]], known: list[str]) -> list[dict[str, Any]]:
    """Derived sources so that parents come first; an unknown parent or a cycle raises."""
    by = {s["id"]: s for s in specs}
    for s in specs:
        for p in s["parentSources"]:
            if p not in by and p not in known:
                raise ValueError(f"virtual source {s['id']}: no source {p!r}")
    try:
        return [by[x] for x in TopologicalSorter({s["id"]: [p for p in s["parentSources"] if p in by] for s in specs}).static_order()]
    except CycleError as e:
        raise ValueError(f"virtual sources refer to each other: {' -> '.join(e.args[1])}") from None


def derive(spark: SparkSession, spec: dict[str, Any], frames: dict[str, DataFrame], allow_sql: bool = True) -> DataFrame:
    """The frame of one derived source.  Everything is declared; the optimizer prunes and pushes down across the chain."""
    kind, parents = spec["kind"], spec["parentSources"]
    if kind not in KINDS:
        raise ValueError(f"virtual source {spec['id']}: no kind {kind!r}")
    if KINDS[kind] and len(parents) != KINDS[kind]:
        raise ValueError(f"virtual source {spec['id']}: {kind} takes {KINDS[kind]} parent(s), not {len(parents)}")
    if any(frames[p].isStreaming for p in parents) and kind not in STREAMABLE:
        raise ValueError(f"virtual source {spec['id']}: {kind} works on batch sources only")
    first = frames[parents[0]]
    if kind == "sql":
        if not allow_sql:
            raise PermissionError(f"virtual source {spec['id']}: SQL queries are not allowed by the application settings")
        for p in parents:
            frames[p].createOrReplaceTempView(p)
        return spark.sql(spec["query"])
    if kind == "join":
        how = spec["joinType"].lower().replace("_", "")
        if how not in JOINS:
            raise ValueError(f"virtual source {spec['id']}: no join type {spec['joinType']!r}")
        return first.alias(parents[0]).join(frames[parents[1]].alias(parents[1]), on=list(spec["joinBy"]), how=how)
    kept = [c for c in SERVICE if c in first.columns]
    if kind == "filter":
        return first.where(reduce(lambda a, b: a & b, [F.expr(f"({e})") for e in spec["expr"]]))
    if kind == "select":
        return first.selectExpr(*spec["expr"], *kept)
    return first.groupBy(*[F.col(c) for c in spec["groupBy"]]).agg(*[F.expr(e) for e in spec["expr"]])


def derive_all(spark: SparkSession, specs: list[dict[str, Any]], frames: dict[str, DataFrame], allow_sql: bool = True) -> dict[str, DataFrame]:
    """``frames`` and all derived sources; a source with ``persist`` is kept at that storage level."""
    from ..sources.readers import storage_level

    out = dict(frames)
    for spec in order(specs, list(frames)):
        df = derive(spark, spec, out, allow_sql)
        if spec.get("persist") and not df.isStreaming:
            df = df.persist(storage_level(spec["persist"]))
        out[spec["id"]] = df
    return out
