"""Running a job: sources, derived sources, load checks, metrics, checks, storage and targets."""

from __future__ import annotations

import hashlib
import json
import math
from collections import defaultdict
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from graphlib import TopologicalSorter
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import __version__
from ..functions.formula import Formula
from ..operators import checks as C, trend as TR
from ..operators.checks import CheckResult, Result
from ..operators.metrics import Metric
from ..operators.virtual import derive_all
from ..sources import connections as CN, readers as R, schemas as S
from ..sources.storage import TABLES, Storage, open_storage
from ..sources.targets import Targets, save_virtual
from . import fuse, hocon, secrets
from .spec import Job, parse

TOLERANCE = ("none", "critical", "all")


@dataclass
class ResultSet:
    """All results of a run; ``tables`` gives them as DataFrames."""

    job_id: str
    reference: datetime
    execution: datetime
    regular: list[Result] = field(default_factory=list)
    composed: list[Result] = field(default_factory=list)
    trend: list[Result] = field(default_factory=list)
    checks: list[CheckResult] = field(default_factory=list)
    load_checks: list[CheckResult] = field(default_factory=list)
    errors: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    summary: dict[str, Any] = field(default_factory=dict)
    faults: list[str] = field(default_factory=list)  #: metrics that failed, targets that couldn't be written

    def violations(self, tolerance: str = "none") -> list[CheckResult]:
        """Checks that a tolerance doesn't bear: ``none`` bears every outcome, ``critical`` no failure of a critical check, ``all`` no check that isn't a success."""
        every = [*self.checks, *self.load_checks]
        if tolerance.lower() == "none":
            return []
        if tolerance.lower() == "critical":
            return [c for c in every if c.is_critical and c.status == C.FAILURE]
        return [c for c in every if c.status != C.SUCCESS]

    def exit_code(self, tolerance: str = "none") -> int:
        return 1 if self.violations(tolerance) else 0


@dataclass
class Engine:
    """Settings of an application: build it once, run any number of jobs with it."""

    spark: SparkSession
    settings: dict[str, Any] = field(default_factory=dict)
    storage: Storage | None = None

    def __post_init__(self):
        if self.storage is None:
            self.storage = open_storage(self.spark, self.settings.get("storage"))

    # Building

    def frames(self, job: Job, given: dict[str, DataFrame] | None = None) -> tuple[dict[str, R.Source], dict[str, S.Schema]]:
        """All sources of a job and its schemas."""
        registries = {i: c for i, c in job.connections.items() if c["kind"] == "schemaRegistry"}
        if self.settings.get("validateConnections", True):
            for c in job.connections.values():
                CN.validate(self.spark, c)
        allow = bool(self.settings.get("allowSqlQueries", True))
        sensitive = bool(self.settings.get("enableCaseSensitivity", False))
        schemas = {x["id"]: S.read(self.spark, x, registries) for x in job.schemas}
        ctx = R.Context(job.connections, schemas, allow, job.streaming)
        sources = {i: R.Source(i, df) for i, df in (given or {}).items()}
        for kind, x in job.sources:
            sources[x["id"]] = R.read(self.spark, kind, x, ctx)
        derived = derive_all(self.spark, job.virtual, {i: s.df for i, s in sources.items()}, allow)
        for v in job.virtual:
            sources[v["id"]] = R.Source(v["id"], derived[v["id"]], list(v.get("keyFields", [])), list(v["parentSources"]))
            if v.get("save") and not job.streaming:
                save_virtual(derived[v["id"]], v["save"])
        for s in sources.values():
            s.check_keys(sensitive)
        return sources, schemas

    # Metrics

    def regular(self, metrics: list[Metric], sources: dict[str, R.Source]) -> tuple[list[Result], DataFrame | None]:
        """Regular metrics of all sources, and their failing rows as a lazy frame."""
        results, found = [], []
        by: dict[str, list[Metric]] = defaultdict(list)
        for m in metrics:
            by[m.source].append(m)
        for i, ms in by.items():
            df, keys = sources[i].df, sources[i].key_fields
            if not self.settings.get("enableCaseSensitivity", False):
                df, keys = fuse.lower_names(df), [k.lower() for k in keys]
                ms = [Metric(m.id, m.kind, m.source, [c.lower() for c in m.columns], m.params, m.description, m.metadata) for m in ms]
            info = {m.id: m for m in ms}
            for r in fuse.results(df, ms).collect():
                results.append(Result(r[0], r[1], r[2], r[3], [i], info[r[0]].columns))
            dump = int(self.settings.get("errorDumpSize", 10000))
            columns = F.create_map(*[x for m in ms for x in (F.lit(m.id), F.lit(json.dumps(m.columns)))])
            found.append(fuse.errors(df, ms, keys, dump).withColumn("source_id", F.lit(i)).withColumn("source_key_fields", F.lit(json.dumps(keys))).withColumn("metric_columns", columns[F.col("metric_id")]))
        return results, reduce(lambda a, b: a.unionByName(b), found) if found else None

    @staticmethod
    def composed(specs: list[dict[str, Any]], results: dict[str, list[Result]], faults: list[str]) -> list[Result]:
        """Composed metrics in the order of their dependencies; one that fails is NaN."""
        by = {x["id"]: x for x in specs}
        formulas = {i: Formula(x["formula"]) for i, x in by.items()}
        out = []
        for i in TopologicalSorter({i: [j for j in f.ids if j in by] for i, f in formulas.items()}).static_order():
            used = [r for j in formulas[i].ids for r in results.get(j, [])]
            try:
                values = {j: results[j][0].result for j in formulas[i].ids if len(results.get(j, [])) == 1 and not results[j][0].metric_name.startswith("TOP_N")}
                value = float(formulas[i].value(values))
            except Exception as e:
                faults.append(f"metric {i}: {type(e).__name__}: {e}")
                value = math.nan
            got = Result(i, "COMPOSED", value, None, list(dict.fromkeys(s for r in used for s in r.sources)), [], "composed")
            results[i] = [got]
            out.append(got)
        return out

    def trends(self, job: Job, reference: datetime, results: dict[str, list[Result]], faults: list[str]) -> list[Result]:
        """Trend metrics; one that fails is NaN."""
        out = []
        for kind, x in job.trends:
            info, sources = None, [s for r in results.get(x["lookupMetric"], []) for s in r.sources]
            try:
                if self.storage is None:
                    raise ValueError("no result storage")
                past_kind = "composed" if any(c["id"] == x["lookupMetric"] for c in job.composed) else "regular"
                past = self.storage.history(job.id, [x["lookupMetric"]], past_kind, x["rule"], reference, x["windowSize"], x.get("windowOffset"))
                value, info = TR.evaluate(kind, x, [(d, v) for d, v, *_ in past], reference)
            except Exception as e:
                faults.append(f"metric {x['id']}: {type(e).__name__}: {e}")
                value = math.nan
            out.append(Result(x["id"], f"TREND_{kind.upper()}", value, info, sources, [], "trend"))
        return out

    def checks(self, job: Job, reference: datetime, results: dict[str, list[Result]], skip_missing: bool = False) -> list[CheckResult]:
        """All checks but load checks; trend checks are skipped without a storage, and with ``skip_missing`` those whose metrics have no results."""
        there = lambda *ids: not skip_missing or all(results.get(i) for i in ids if i)
        out = [C.snapshot(k, x, results) for k, x in job.snapshot_checks if there(x["metric"], x.get("compareMetric"))]
        if self.storage is not None:
            def history(ids: list[str], kind: str, rule: str, size: Any, offset: Any) -> list:
                return self.storage.history(job.id, ids, kind, rule, reference, 1 if size is None else size, offset)

            out += [C.trend(k, x, results, history) for k, x in job.trend_checks if there(x["metric"])]
        return out + [C.expression(x, results) for x in job.expression_checks if there(*Formula(x["formula"], boolean=True).ids)]

    # Finishing

    def finish(self, job: Job, rs: ResultSet, save: bool = True, targets: bool = True) -> ResultSet:
        """Build the result tables, keep them in the storage and send them to the targets."""
        info = {m.id: m for m in job.metrics}
        common = {"job_id": job.id, "reference_date": rs.reference, "execution_date": rs.execution}
        notes = {**{x["id"]: x for x in job.composed}, **{x["id"]: x for _, x in job.trends}}
        text = lambda v: None if not v else json.dumps(v)
        rows: dict[str, list[dict[str, Any]]] = {t: [] for t in TABLES}
        for r in rs.regular:
            m = info[r.metric_id]
            rows["results_metric_regular"].append({**common, "metric_id": r.metric_id, "metric_name": r.metric_name, "description": m.description, "metadata": text(m.metadata), "source_id": json.dumps(r.sources),
                                                   "column_names": text(r.columns), "params": text(m.params), "result": r.result, "additional_result": r.additional})
        for kind, got in (("composed", rs.composed), ("trend", rs.trend)):
            for r in got:
                x = notes[r.metric_id]
                rows[f"results_metric_{kind}"].append({**common, "metric_id": r.metric_id, "metric_name": r.metric_name, "description": x.get("description"), "metadata": text(x.get("metadata")), "source_id": json.dumps(r.sources),
                                                       "result": r.result, "additional_result": r.additional, "formula": x.get("formula"), "params": text({k: v for k, v in x.items() if k not in ("id", "description", "metadata")})})
        for table, got in (("results_check", rs.checks), ("results_check_load", rs.load_checks)):
            for c in got:
                rows[table].append({**common, **{k: v for k, v in vars(c).items() if k != "metadata"}, "metadata": text(c.metadata)})
        rows["job_state"].append({**common, "config": json.dumps(secrets.masked(job.raw, tuple(self.settings.get("encryption", {}).get("keyFields", secrets.KEYS)), self.settings.get("encryption", {}).get("secret")), default=str),
                                  "version_info": json.dumps({"version": __version__})})
        for t, (schema, _) in TABLES.items():
            if t != "results_metric_error":
                rs.tables[t] = self.spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows[t]], schema)
        schema = TABLES["results_metric_error"][0]
        if rs.errors is None:
            rs.tables["results_metric_error"] = self.spark.createDataFrame([], schema)
        else:
            row = F.to_json("row_data")
            hidden = self.settings.get("encryption", {})
            if hidden.get("encryptErrorData", False):  # hashes are of the plain row, so that equal rows are still told by them
                plain, row = row, secrets.encrypted(row, hidden["secret"])
            else:
                plain = row
            got = rs.errors.select(
                F.lit(job.id).alias("job_id"), "metric_id", "source_id", "source_key_fields", "metric_columns", "status", "message", row.alias("row_data"),
                F.md5(F.concat("metric_id", "status", "message", plain)).alias("error_hash"), F.lit(rs.reference).alias("reference_date"), F.lit(rs.execution).alias("execution_date"))
            rs.tables["results_metric_error"] = got.dropDuplicates(["error_hash"]).persist()
        failed = [c.check_id for c in rs.checks if c.status != C.SUCCESS]
        failed_load = [c.check_id for c in rs.load_checks if c.status != C.SUCCESS]
        with_errors = sorted(r[0] for r in rs.tables["results_metric_error"].select("metric_id").distinct().collect())
        ok = not failed and not failed_load
        rs.summary = {"jobId": job.id, "jobStatus": "SUCCESS" if ok else "FAILURE", "referenceDate": rs.reference.isoformat(), "executionDate": rs.execution.isoformat(),
                      "numSources": len(job.sources) + len(job.virtual), "numMetrics": len(job.metrics) + len(job.composed) + len(job.trends), "numChecks": len(rs.checks), "numLoadChecks": len(rs.load_checks),
                      "numMetricsWithErrors": len(with_errors), "numFailedChecks": len(failed), "numFailedLoadChecks": len(failed_load),
                      "listMetricsWithErrors": with_errors, "listFailedChecks": failed, "listFailedLoadChecks": failed_load}
        if save and self.storage is not None:
            for t, df in rs.tables.items():
                if t == "results_metric_error":
                    if with_errors:
                        self.storage.save(t, df)
                elif rows[t]:
                    self.storage.save(t, df)
        if targets and job.targets:
            rs.faults += Targets(self.spark, self.settings, job.connections).run(job.targets, rs.tables, rs.summary, {*failed, *failed_load})
        return rs

    def run(self, config: dict[str, Any] | Job, *, sources: dict[str, DataFrame] | None = None, reference: datetime | None = None, execution: datetime | None = None,
            save: bool = True, targets: bool = True) -> ResultSet:
        """Run a batch job.  ``sources`` are ready-made frames besides those the job describes."""
        job = config if isinstance(config, Job) else parse(config, tuple(sources or ()))
        execution = execution or datetime.now(timezone.utc).replace(tzinfo=None)
        reference = reference or execution
        frames, schemas = self.frames(job, sources)
        rs = ResultSet(job.id, reference, execution)
        sensitive = bool(self.settings.get("enableCaseSensitivity", False))
        structs = {i: s.struct for i, s in schemas.items()}
        rs.load_checks = [C.load_check(k, x, frames[x["source"]].df.schema if x["source"] in frames else None, structs, sensitive) for k, x in job.load_checks]
        rs.regular, rs.errors = self.regular(job.metrics, frames)
        results: dict[str, list[Result]] = defaultdict(list)
        for r in rs.regular:
            results[r.metric_id].append(r)
        rs.trend = self.trends(job, reference, results, rs.faults)
        for r in rs.trend:
            results[r.metric_id].append(r)
        rs.composed = self.composed(job.composed, results, rs.faults)
        rs.checks = self.checks(job, reference, results)
        return self.finish(job, rs, save, targets)

    def run_files(self, *paths: str, variables: dict[str, Any] | None = None, **kw: Any) -> ResultSet:
        """Run a job described in HOCON files, joined in the given order."""
        return self.run(hocon.load(*paths, variables=variables), **kw)


def job_hash(job: Job) -> str:
    """Identifies a job's description, for the checkpoints of streams."""
    return hashlib.md5(json.dumps(job.raw, sort_keys=True, default=str).encode()).hexdigest()
