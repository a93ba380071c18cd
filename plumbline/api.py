"""Service functions: validating descriptions, reading stored results, suggesting jobs."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from .plans import hocon
from .plans.spec import InvalidJob, parse
from .sources.storage import TABLES, Storage

#: Columns that are taken for keys by their names.
KEY_NAMES = ("login", "inn", "id")
APPLICATION_KEYS = ("applicationName", "dateTimeOptions", "enablers", "defaultSparkOptions", "storage", "email", "mattermost", "streaming", "encryption")


def validate_job(text: str, variables: dict[str, Any] | None = None) -> tuple[bool, list[str]]:
    """Whether a HOCON job description is valid, and its faults."""
    try:
        parse(hocon.loads(text, variables))
        return True, []
    except InvalidJob as e:
        return False, e.faults
    except hocon.HoconError as e:
        return False, [str(e)]


def validate_application(text: str, variables: dict[str, Any] | None = None) -> tuple[bool, list[str]]:
    """Whether HOCON application settings are valid, and their faults."""
    try:
        config = hocon.loads(text, variables)
    except hocon.HoconError as e:
        return False, [str(e)]
    app = config.get("appConfig", config)
    faults = [f"no setting {k!r}" for k in app if k not in APPLICATION_KEYS]
    storage = app.get("storage")
    if storage is not None and ("dbType" not in storage or "url" not in storage):
        faults.append("storage needs dbType and url")
    return not faults, faults


def jobs(storage: Storage, start: datetime | None = None, end: datetime | None = None) -> DataFrame | None:
    """Jobs run within a time (by default the last seven days): ``job_id`` and the last reference date."""
    rows = _between(storage.load("job_state"), start, end)
    return None if rows is None else rows.groupBy("job_id").agg(F.max("reference_date").alias("last_reference_date"))


def job_state(storage: Storage, job_id: str, reference: datetime | None = None) -> DataFrame | None:
    """The description a job was run with, at a reference date or last."""
    rows = storage.load("job_state")
    if rows is None:
        return None
    rows = rows.where(F.col("job_id") == job_id)
    return rows.where(F.col("reference_date") == F.lit(reference)) if reference else rows.orderBy(F.desc("reference_date")).limit(1)


def job_results(storage: Storage, job_id: str, start: datetime | None = None, end: datetime | None = None) -> dict[str, DataFrame]:
    """All stored results of a job within a time (by default the last seven days), by table."""
    out = {}
    for t in TABLES:
        rows = _between(storage.load(t), start, end)
        if t != "job_state" and rows is not None:
            out[t] = rows.where(F.col("job_id") == job_id)
    return out


def _between(rows: DataFrame | None, start: datetime | None, end: datetime | None) -> DataFrame | None:
    end = end or datetime.now()
    start = start or end - timedelta(days=7)
    return None if rows is None else rows.where((F.col("reference_date") >= F.lit(start)) & (F.col("reference_date") <= F.lit(end)))


_DDL = re.compile(r"^\s*create\s+(?:external\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.`\"]+)\s*\((.*)\)[^)]*$", re.I | re.S)


def parse_ddl(ddl: str) -> tuple[str, list[tuple[str, str, bool]]]:
    """(table, [(column, type, whether NOT NULL)]) of a CREATE TABLE statement."""
    m = _DDL.match(ddl.strip().rstrip(";"))
    if not m:
        raise ValueError("no CREATE TABLE statement")
    body, depth, parts, cur = re.sub(r"'(?:[^']|'')*'", "''", m[2]), 0, [], ""  # the contents of texts don't matter
    for c in body:
        depth += (c in "(<") - (c in ")>")
        if depth < 0:
            break
        if c == "," and not depth:
            parts.append(cur)
            cur = ""
        else:
            cur += c
    columns = []
    for p in [*parts, cur]:
        p = p.strip()
        if not p or re.match(r"(?i)(primary\s+key|constraint|unique|foreign\s+key|check|index|key)\b", p):
            continue
        name, _, rest = p.partition(" ")
        kind = re.match(r"\s*([\w<>:, ]+?(?:\(\s*\d+\s*(?:,\s*\d+\s*)?\))?)(?=\s+(?:not\s+null|null|default|comment|primary|unique|references|check)\b|\s*$)", rest, re.I)
        columns.append((name.strip('`"'), (kind[1] if kind else rest).strip().lower(), bool(re.search(r"(?i)not\s+null|primary\s+key", rest))))
    return m[1].replace("`", "").replace('"', ""), columns


def suggest_job(ddl: str, source: dict[str, Any] | None = None) -> dict[str, Any]:
    """A job for a table by rules of thumb: it has rows and the right number of columns, keys aren't repeated, required columns aren't null, others' completeness is measured."""
    table, columns = parse_ddl(ddl)
    short = table.split(".")[-1]
    return _suggest(short, columns, source or {"hive": [{"id": short, "schema": table.split(".")[0] if "." in table else "default", "table": short}]})


def suggest_for(df: DataFrame, name: str) -> dict[str, Any]:
    """The same for a frame's schema; run it with the frame among ``sources``."""
    return _suggest(name, [(f.name, f.dataType.simpleString(), not f.nullable) for f in df.schema.fields if not isinstance(f.dataType, T.NullType)], None)


def _suggest(name: str, columns: list[tuple[str, str, bool]], sources: dict[str, Any] | None) -> dict[str, Any]:
    keys = [c for c, _, _ in columns if c.lower() in KEY_NAMES]
    required = [c for c, _, needed in columns if needed and c not in keys]
    rest = [c for c, _, _ in columns if c not in keys and c not in required]
    at = {"source": name}
    regular: dict[str, list] = {"rowCount": [{"id": f"{name}_rows", **at}]}
    greater = [{"id": f"{name}_has_rows", "metric": f"{name}_rows", "threshold": 0}]
    equal = []
    if keys:
        regular["duplicateValues"] = [{"id": f"{name}_{c}_duplicates", **at, "columns": [c]} for c in keys]
        equal += [{"id": f"{name}_{c}_unique", "metric": f"{name}_{c}_duplicates", "threshold": 0} for c in keys]
    if required:
        regular["nullValues"] = [{"id": f"{name}_{c}_nulls", **at, "columns": [c]} for c in required]
        equal += [{"id": f"{name}_{c}_filled", "metric": f"{name}_{c}_nulls", "threshold": 0} for c in required]
    if rest:
        regular["completeness"] = [{"id": f"{name}_{c}_completeness", **at, "columns": [c]} for c in rest]
    composed = [{"id": f"{name}_{c}_null_share", "formula": f"100 * {{{{ {name}_{c}_nulls }}}} / {{{{ {name}_rows }}}}"} for c in required]
    job: dict[str, Any] = {"jobId": f"{name}_quality", "loadChecks": {"exactColumnNum": [{"id": f"{name}_columns", **at, "option": len(columns)}]},
                           "metrics": {"regular": regular, "composed": composed}, "checks": {"snapshot": {"greaterThan": greater, **({"equalTo": equal} if equal else {})}}}
    if sources:
        job["sources"] = sources
    return {"jobConfig": job}
