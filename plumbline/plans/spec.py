"""Job descriptions: assembling, normalising and validating them before anything runs."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..functions.formula import Formula, FormulaError, references
from ..operators import checks as C, trend as TR, virtual as V
from ..operators.metrics import KINDS, Metric, problems
from ..sources import connections as CN, readers as R, schemas as S
from ..sources.storage import duration
from ..sources.targets import RESULT_TYPES


class InvalidJob(ValueError):
    """A description with its faults."""

    def __init__(self, faults: list[str]):
        super().__init__("\n".join(faults))
        self.faults = faults


@dataclass
class Job:
    """A job, ready to be built."""

    id: str
    description: str | None = None
    connections: dict[str, dict[str, Any]] = field(default_factory=dict)
    schemas: list[dict[str, Any]] = field(default_factory=list)
    sources: list[tuple[str, dict[str, Any]]] = field(default_factory=list)
    virtual: list[dict[str, Any]] = field(default_factory=list)
    streaming: bool = False
    load_checks: list[tuple[str, dict[str, Any]]] = field(default_factory=list)
    metrics: list[Metric] = field(default_factory=list)
    composed: list[dict[str, Any]] = field(default_factory=list)
    trends: list[tuple[str, dict[str, Any]]] = field(default_factory=list)
    snapshot_checks: list[tuple[str, dict[str, Any]]] = field(default_factory=list)
    trend_checks: list[tuple[str, dict[str, Any]]] = field(default_factory=list)
    expression_checks: list[dict[str, Any]] = field(default_factory=list)
    targets: dict[str, Any] = field(default_factory=dict)
    raw: dict[str, Any] = field(default_factory=dict)


def _pairs(section: dict[str, list]) -> list[tuple[str, dict[str, Any]]]:
    return [(k, x) for k, xs in section.items() for x in xs]


def parse(config: dict[str, Any], given_sources: tuple[str, ...] = ()) -> Job:
    """A job from its description (with or without the outer ``jobConfig``); faults raise :class:`InvalidJob`."""
    c = config.get("jobConfig", config)
    faults: list[str] = []
    try:
        m, ch = c.get("metrics", {}), c.get("checks", {})
        job = Job(
            c.get("jobId", ""), c.get("jobDescription"), CN.normalize(c.get("connections", {})), list(c.get("schemas", [])), _pairs(c.get("streams") or c.get("sources", {})),
            list(c.get("virtualStreams") or c.get("virtualSources", [])), bool(c.get("streams")), _pairs(c.get("loadChecks", {})),
            [Metric(x["id"], kind, x["source"], list(x.get("columns", [])), dict(x.get("params", {})) | ({"reversed": x["reversed"]} if "reversed" in x else {}), x.get("description"), list(x.get("metadata", [])))
             for kind, x in _pairs(m.get("regular", {}))],
            list(m.get("composed", [])), _pairs(m.get("trend", {})), _pairs(ch.get("snapshot", {})), _pairs(ch.get("trend", {})), list(ch.get("expression", [])), c.get("targets", {}), c)
    except (KeyError, ValueError, AttributeError, TypeError) as e:
        raise InvalidJob([f"{type(e).__name__}: {e}"]) from e
    if c.get("streams") and c.get("sources"):
        faults.append("a job has either sources or streams")
    faults += validate(job, given_sources)
    if faults:
        raise InvalidJob(faults)
    return job


def _twice(what: str, ids: list[str]) -> list[str]:
    return [f"{what}: id {i!r} is used more than once" for i in sorted({i for i in ids if ids.count(i) > 1})]


def validate(job: Job, given: tuple[str, ...] = ()) -> list[str]:
    """All faults of a job: doubled ids, dangling references, cycles, and parameters out of range."""
    out: list[str] = []
    if not job.id:
        out.append("the job has no jobId")
    source_ids = [s["id"] for _, s in job.sources] + [v["id"] for v in job.virtual]
    known = {*source_ids, *given}
    schema_ids = {s["id"] for s in job.schemas}
    regular, composed, trends = {m.id: m for m in job.metrics}, {x["id"]: x for x in job.composed}, {x["id"]: x for _, x in job.trends}
    metric_ids = {*regular, *composed, *trends}
    out += _twice("schemas", [s["id"] for s in job.schemas]) + _twice("sources", source_ids)
    out += _twice("metrics", [m.id for m in job.metrics] + [x["id"] for x in job.composed] + [x["id"] for _, x in job.trends])
    out += _twice("checks", [x["id"] for _, x in job.snapshot_checks + job.trend_checks] + [x["id"] for x in job.expression_checks]) + _twice("load checks", [x["id"] for _, x in job.load_checks])
    for s in job.schemas:
        if s["kind"] not in S.KINDS:
            out.append(f"schema {s['id']}: no kind {s['kind']!r}")
        if s["kind"] == "registry" and ("schemaId" in s) == ("schemaSubject" in s):
            out.append(f"schema {s['id']}: either schemaId or schemaSubject is needed")
        if s["kind"] == "registry" and s.get("connection") and job.connections.get(s["connection"], {}).get("kind") != "schemaRegistry":
            out.append(f"schema {s['id']}: no schema registry {s['connection']!r}")
    for kind, s in job.sources:
        at = f"source {s['id']}"
        if kind not in R.KINDS:
            out.append(f"{at}: no kind {kind!r}")
        if job.streaming and kind not in R.STREAMABLE:
            out.append(f"{at}: {kind} can't be streamed")
        if "connection" in s:
            wanted = {"kafka": ("kafka",), "greenplum": ("greenplum",), "iceberg": ("iceberg",)}.get(kind, tuple(CN.JDBC))
            if job.connections.get(s["connection"], {}).get("kind") not in wanted:
                out.append(f"{at}: no connection {s['connection']!r} of kind {' or '.join(wanted)}")
        for key in ("schema", "keySchema", "valueSchema"):
            if kind != "hive" and s.get(key) and s[key] not in schema_ids:
                out.append(f"{at}: no schema {s[key]!r}")
        if kind == "table" and ("table" in s) == ("query" in s):
            out.append(f"{at}: either a table or a query is needed")
        if kind == "file":
            if s.get("kind") not in R.FILE_KINDS:
                out.append(f"{at}: no file kind {s.get('kind')!r}")
            if s.get("kind") == "fixed" and not s.get("schema"):
                out.append(f"{at}: a fixed-width file needs a schema")
            if s.get("kind") == "delimited" and bool(s.get("header", False)) == bool(s.get("schema")):
                out.append(f"{at}: either a header or a schema is needed")
            if job.streaming and not s.get("schema"):
                out.append(f"{at}: a file stream needs a schema")
        if kind == "kafka":
            try:
                CN.kafka_options({"servers": []}, s)
            except ValueError as e:
                out.append(f"{at}: {e}")
        for p in s.get("partitions", []) if kind == "hive" else []:
            if ("expr" in p) == ("values" in p):
                out.append(f"{at}: partition {p['name']} needs either an expression or values")
            elif "expr" in p:
                import re

                words = set(re.findall(r"(?<!['\w])[A-Za-z_]\w*(?!\w*\s*\()", re.sub(r"'[^']*'", "''", p["expr"])))
                extra = {w.lower() for w in words} - {p["name"].lower(), "and", "or", "not", "in", "between", "is", "null", "like", "rlike", "true", "false", "date", "timestamp", "cast", "as", "string", "int", "interval", "day", "days"}
                if extra:
                    out.append(f"{at}: the expression of partition {p['name']} names other columns: {sorted(extra)}")
    for v in job.virtual:
        if v["kind"] not in V.KINDS:
            out.append(f"virtual source {v['id']}: no kind {v['kind']!r}")
        elif job.streaming and v["kind"] not in V.STREAMABLE:
            out.append(f"virtual source {v['id']}: {v['kind']} can't be streamed")
        need = V.KINDS.get(v["kind"])
        if need and len(v["parentSources"]) != need:
            out.append(f"virtual source {v['id']}: {v['kind']} takes {need} parent(s)")
        if v["kind"] == "join" and v.get("joinType", "").lower().replace("_", "") not in V.JOINS:
            out.append(f"virtual source {v['id']}: no join type {v.get('joinType')!r}")
    try:
        V.order(job.virtual, [s["id"] for _, s in job.sources] + list(given))
    except ValueError as e:
        out.append(str(e))
    for m in job.metrics:
        out += problems(m)
        if m.source not in known:
            out.append(f"metric {m.id}: no source {m.source!r}")
    graph: dict[str, list[str]] = {}
    for x in job.composed:
        try:
            f = Formula(x["formula"])
            graph[x["id"]] = f.ids
            out += [f"metric {x['id']}: no metric {i!r}" for i in f.ids if i not in metric_ids]
            out += [f"metric {x['id']}: {i} is a top-N metric" for i in f.ids if i in regular and regular[i].kind == "topN"]
        except FormulaError as e:
            out.append(f"metric {x['id']}: {e}")
    for kind, x in job.trends:
        if TR.ALIASES.get(kind, kind) not in TR.KINDS:
            out.append(f"metric {x['id']}: no trend kind {kind!r}")
        look = x.get("lookupMetric")
        if look not in regular and look not in composed:
            out.append(f"metric {x['id']}: {look!r} is no regular or composed metric")
        elif look in regular and regular[look].kind == "topN":
            out.append(f"metric {x['id']}: {look} is a top-N metric")
        graph[x["id"]] = []
        out += _window_faults(f"metric {x['id']}", x)
        if kind == "arima":
            o = list(x.get("order", []))
            if len(o) != 3 or min(o, default=0) < 0 or o[0] + o[2] == 0:
                out.append(f"metric {x['id']}: the order must be three non-negative numbers with p + q > 0")
    try:
        from graphlib import CycleError, TopologicalSorter

        list(TopologicalSorter({k: [i for i in v if i in composed] for k, v in graph.items()}).static_order())
    except CycleError as e:
        out.append(f"metrics refer to each other: {' -> '.join(e.args[1])}")
    for kind, x in job.load_checks:
        if kind not in C.LOAD:
            out.append(f"load check {x['id']}: no kind {kind!r}")
        if x["source"] not in known:
            out.append(f"load check {x['id']}: no source {x['source']!r}")
        if kind == "schemaMatch" and x["schema"] not in schema_ids:
            out.append(f"load check {x['id']}: no schema {x['schema']!r}")
    for kind, x in job.snapshot_checks:
        if kind not in C.SNAPSHOT:
            out.append(f"check {x['id']}: no kind {kind!r}")
        has = ("compareMetric" in x, "threshold" in x)
        if kind == "differByLT" and has != (True, True):
            out.append(f"check {x['id']}: a metric to compare with and a threshold are both needed")
        elif kind != "differByLT" and sum(has) != 1:
            out.append(f"check {x['id']}: either a metric to compare with or a threshold is needed")
        out += [f"check {x['id']}: no metric {x[k]!r}" for k in ("metric", "compareMetric") if k in x and x[k] not in metric_ids]
    for kind, x in job.trend_checks:
        if kind not in C.TREND:
            out.append(f"check {x['id']}: no kind {kind!r}")
        if x["metric"] not in metric_ids:
            out.append(f"check {x['id']}: no metric {x['metric']!r}")
        if kind == "topNRank":
            if x["metric"] in regular and regular[x["metric"]].kind != "topN":
                out.append(f"check {x['id']}: {x['metric']} is no top-N metric")
        else:
            out += _window_faults(f"check {x['id']}", x)
    for x in job.expression_checks:
        try:
            Formula(x["formula"], boolean=True)
        except FormulaError as e:
            out.append(f"check {x['id']}: {e}")
        out += [f"check {x['id']}: no metric {i!r}" for i in references(x["formula"]) if i not in metric_ids]
    check_ids = {x["id"] for _, x in job.snapshot_checks + job.trend_checks + job.load_checks} | {x["id"] for x in job.expression_checks}
    for group, section in job.targets.items():
        for channel, spec in section.items():
            for x in spec if isinstance(spec, list) else [spec]:
                at = f"target {group}.{channel}"
                out += [f"{at}: no metric {i!r}" for i in x.get("metrics", []) if i not in metric_ids]
                out += [f"{at}: no check {i!r}" for i in x.get("checks", []) if i not in check_ids]
                out += [f"{at}: no result type {t!r}" for t in x.get("resultTypes", []) if t not in RESULT_TYPES]
                if channel == "kafka" and job.connections.get(x.get("connection", ""), {}).get("kind") != "kafka":
                    out.append(f"{at}: no Kafka connection {x.get('connection')!r}")
    return out


def _window_faults(at: str, x: dict[str, Any]) -> list[str]:
    rule = x.get("rule")
    if rule not in ("record", "datetime"):
        return [f"{at}: no rule {rule!r}"]
    out = []
    for key in ("windowSize", "windowOffset"):
        if key not in x and key == "windowOffset":
            continue
        try:
            if rule == "datetime":
                duration(x[key])
            elif int(x[key]) < (key == "windowSize"):
                raise ValueError
        except (ValueError, KeyError, TypeError):
            out.append(f"{at}: {key} {x.get(key)!r} doesn't fit the rule {rule}")
    return out
