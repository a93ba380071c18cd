"""Targets: where results, failing rows, summaries and alerts go."""

from __future__ import annotations

import json
import re
import smtplib
import urllib.request
from email.message import EmailMessage
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

UNIFIED = "jobId string, referenceDate string, executionDate string, entityType string, data string"
RESULT_TYPES = {"regularMetrics": ("results_metric_regular", "regularMetricResult"), "composedMetrics": ("results_metric_composed", "composedMetricResult"),
                "trendMetrics": ("results_metric_trend", "trendMetricResult"), "loadChecks": ("results_check_load", "loadCheckResult"), "checks": ("results_check", "checkResult"),
                "jobState": ("job_state", "jobState"), "errors": ("results_metric_error", "metricError")}
SAVE_KINDS = ("delimited", "avro", "orc", "parquet")


def camel(name: str) -> str:
    return re.sub(r"_(\w)", lambda m: m[1].upper(), name)


def unified(rows: DataFrame, entity: str, date_format: str = "yyyy-MM-dd'T'HH:mm:ss.SSS") -> DataFrame:
    """Result rows in the five text columns that all result types share; ``data`` is JSON."""
    own = [c for c in rows.columns if c not in ("job_id", "reference_date", "execution_date")]
    return rows.select(F.col("job_id").alias("jobId"), F.date_format("reference_date", date_format).alias("referenceDate"), F.date_format("execution_date", date_format).alias("executionDate"),
                       F.lit(entity).alias("entityType"), F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in own])).alias("data"))


def folder(path: str, *parts: str) -> str:
    """Output folder of one run: job, target and dates without other signs than letters, digits and underscores."""
    return f"{path.rstrip('/')}/" + "_".join(re.sub(r"\W", "", p) for p in parts)


def write_file(df: DataFrame, save: dict[str, Any], path: str, partitions: int = 1) -> None:
    """Write to a folder, replacing what it holds."""
    kind = save["kind"]
    if kind not in SAVE_KINDS:
        raise ValueError(f"no file kind {kind!r}")
    writer = df.repartition(partitions).write.mode("overwrite")
    if kind == "delimited":
        writer.option("sep", save.get("delimiter", ",")).option("quote", save.get("quote", '"')).option("escape", save.get("escape", "\\")).option("header", bool(save.get("header", False))).csv(path)
    else:
        writer.format(kind).save(path)


def save_virtual(df: DataFrame, save: dict[str, Any]) -> None:
    """Keep a derived source as files: as many as it has partitions, for it may be large."""
    kind = save["kind"]
    writer = df.write.mode("overwrite")
    if kind == "delimited":
        writer.option("sep", save.get("delimiter", ",")).option("header", bool(save.get("header", False))).csv(save["path"])
    elif kind in SAVE_KINDS:
        writer.format(kind).save(save["path"])
    else:
        raise ValueError(f"no file kind {kind!r}")


def write_hive(df: DataFrame, schema: str, table: str) -> None:
    """Append to a catalog table whose columns must be those of the rows."""
    name = f"{schema}.{table}"
    there = [c.lower() for c in df.sparkSession.table(name).columns]
    if [c.lower() for c in df.columns] != there:
        raise ValueError(f"{name} has the columns {there}, the rows have {df.columns}")
    df.write.insertInto(name)


def kafka_messages(df: DataFrame, aggregate: bool = False) -> DataFrame:
    """``key`` and ``value`` of messages: a JSON object for each row, or one array for each entity type."""
    head = F.to_json(F.struct("jobId", "referenceDate", "executionDate", "entityType"))
    value = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"data":'), F.col("data"), F.lit("}"))  # data is JSON already
    rows = df.select("entityType", "jobId", "referenceDate", "executionDate", value.alias("value"))
    if aggregate:
        rows = rows.groupBy("entityType", "jobId", "referenceDate", "executionDate").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("value")), ","), F.lit("]")).alias("value"))
    return rows.select(F.concat_ws("@", "entityType", "jobId", "referenceDate", "executionDate", F.md5("value")).alias("key"), "value")


def write_kafka(df: DataFrame, connection: dict[str, Any], topic: str, options: dict[str, str] | None = None, aggregate: bool = False) -> None:
    kafka_messages(df, aggregate).write.format("kafka").options(**{"kafka.bootstrap.servers": ",".join(connection["servers"]), "topic": topic, **(options or {})}).save()


def render(template: str, values: dict[str, Any]) -> str:
    """A template with its ``{{ name }}`` places filled in; ``{{#name}}...{{/name}}`` stands once for each item of a list (``{{.}}``), or if the value is neither empty, 0 nor false; an unknown name is empty."""
    def block(m: re.Match) -> str:
        got = values.get(m[1])
        if isinstance(got, (list, set, tuple)):
            return "".join(render(m[2], {**values, ".": x}) for x in got)
        return render(m[2], values) if got else ""

    text = re.sub(r"\{\{#\s*([\w.]+)\s*\}\}(.*?)\{\{/\s*\1\s*\}\}", block, template, flags=re.S)
    return re.sub(r"\{\{\s*([\w.]+)\s*\}\}", lambda m: ", ".join(map(str, x)) if isinstance(x := values.get(m[1], ""), (list, set, tuple)) else str(x), text)


def template_of(spark: SparkSession, spec: dict[str, Any]) -> str | None:
    """The template of a message: given in place, or read from a file of any file system Spark knows; None without one."""
    if spec.get("template"):
        return spec["template"]
    if spec.get("templateFile"):
        return "\n".join(r[0] for r in spark.read.option("wholetext", True).text(spec["templateFile"]).collect())  # one small file
    return None


def summary_text(summary: dict[str, Any], html: bool = False) -> str:
    """The summary of a run for a reader."""
    lines = [f"{k}: {', '.join(v) if isinstance(v, list) else v}" for k, v in summary.items()]
    if html:
        return "<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in (x.split(': ', 1) for x in lines)) + "</table>"
    return "\n".join(f"* **{a}**: {b}" for a, b in (x.split(": ", 1) for x in lines))


def tsv(rows: DataFrame) -> str:
    """Rows as tab-separated text with a header, for attachments."""
    got = rows.collect()
    return "\n".join(["\t".join(rows.columns), *("\t".join("" if v is None else str(v) for v in r) for r in got)])


def send_email(config: dict[str, Any], recipients: list[str], subject: str, body: str, attachments: dict[str, str] | None = None) -> None:
    message = EmailMessage()
    message["From"], message["To"], message["Subject"] = config["address"], ", ".join(recipients), subject
    message.set_content(re.sub(r"<[^>]+>", " ", body))
    message.add_alternative(body, subtype="html")
    for name, text in (attachments or {}).items():
        message.add_attachment(text.encode(), maintype="text", subtype="tab-separated-values", filename=name)
    with smtplib.SMTP(config["host"], int(config["port"]), timeout=60) as server:
        if config.get("sslOnConnect", False):
            server.starttls()
        if config.get("username"):
            server.login(config["username"], config.get("password", ""))
        server.send_message(message)


def send_mattermost(config: dict[str, Any], recipients: list[str], body: str) -> None:
    for to in recipients:
        data = json.dumps({"channel": to, "message": body}).encode()
        request = urllib.request.Request(config["host"].rstrip("/") + "/api/v4/posts", data, {"Authorization": f"Bearer {config['token']}", "Content-Type": "application/json"})
        urllib.request.urlopen(request, timeout=60).close()


class Targets:
    """Runs the targets of a job over the tables of its results."""

    def __init__(self, spark: SparkSession, settings: dict[str, Any], connections: dict[str, dict[str, Any]]):
        self.spark, self.settings, self.connections = spark, settings, connections
        self.sent: list[tuple[str, str]] = []

    def _notify(self, channel: str, spec: dict[str, Any], subject: str, summary: dict[str, Any], attachments: dict[str, str] | None = None) -> None:
        if not self.settings.get("allowNotifications", False):
            raise PermissionError("notifications are not allowed by the application settings")
        config, template = self.settings[channel], template_of(self.spark, spec)
        subject = render(spec["subjectTemplate"], summary) if spec.get("subjectTemplate") else subject
        body = render(template, summary) if template else summary_text(summary, html=channel == "email")
        if channel == "email":
            send_email(config, spec["recipients"], subject, body, attachments)
        else:
            send_mattermost(config, spec["recipients"], body)

    def _put(self, channel: str, spec: dict[str, Any], rows: DataFrame, name: str, run: tuple[str, str, str]) -> None:
        if channel == "file":
            write_file(rows, spec["save"], folder(spec["save"]["path"], run[0], name, run[1], run[2]), int(self.settings.get("outputRepartition", 1)))
        elif channel == "hive":
            write_hive(rows, spec["schema"], spec["table"])
        elif channel == "kafka":
            write_kafka(rows, self.connections[spec["connection"]], spec["topic"], dict(x.split("=", 1) for x in spec.get("options", [])), self.settings.get("aggregatedKafkaOutput", False))

    def run(self, targets: dict[str, Any], tables: dict[str, DataFrame], summary: dict[str, Any], failed_checks: set[str]) -> list[str]:
        """Write everything; a target that fails doesn't stop the others.  Returns what went wrong."""
        wrong = []
        run = (summary["jobId"], summary["referenceDate"], summary["executionDate"])

        def attempt(name: str, f: Any) -> None:
            try:
                f()
                self.sent.append((name, "done"))
            except Exception as e:
                wrong.append(f"{name}: {type(e).__name__}: {e}")

        for channel, spec in targets.get("results", {}).items():
            parts = [unified(tables[RESULT_TYPES[t][0]], RESULT_TYPES[t][1]) for t in spec["resultTypes"]]
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            attempt(f"results.{channel}", lambda c=channel, s=spec, r=rows: self._put(c, s, r, "results", run))
        for channel, spec in targets.get("errorCollection", {}).items():
            rows = unified(self.errors(tables, spec), "metricError")
            attempt(f"errorCollection.{channel}", lambda c=channel, s=spec, r=rows: self._put(c, s, r, "errorCollection", run))
        for channel, spec in targets.get("summary", {}).items():
            if channel == "kafka":
                rows = self.spark.createDataFrame([(*run, "summaryReport", json.dumps({k: v for k, v in summary.items() if k not in ("jobId", "referenceDate", "executionDate")}))], UNIFIED)
                attempt("summary.kafka", lambda s=spec, r=rows: self._put("kafka", s, r, "summary", run))
            else:
                attach = {"metric_errors.tsv": tsv(self.errors(tables, spec))} if channel == "email" and spec.get("attachMetricErrors") else None
                attempt(f"summary.{channel}", lambda c=channel, s=spec, a=attach: self._notify(c, s, f"Data quality summary of {run[0]}", summary, a))
        for channel, specs in targets.get("checkAlerts", {}).items():
            for spec in specs:
                watched = failed_checks if not spec.get("checks") else failed_checks & set(spec["checks"])
                if watched:  # an alert is sent only if a watched check failed
                    note = {"jobId": run[0], "referenceDate": run[1], "failedChecks": sorted(watched)}
                    attempt(f"checkAlerts.{channel}.{spec['id']}", lambda c=channel, s=spec, n=note: self._notify(c, s, f"Failed checks of {run[0]}", n))
        return wrong

    @staticmethod
    def errors(tables: dict[str, DataFrame], spec: dict[str, Any]) -> DataFrame:
        """Failing rows of the named metrics (all if none is named), at most ``dumpSize`` for each."""
        from pyspark.sql import Window

        rows = tables["results_metric_error"]
        if spec.get("metrics"):
            rows = rows.where(F.col("metric_id").isin(spec["metrics"]))
        nth = F.row_number().over(Window.partitionBy("metric_id").orderBy("error_hash"))
        return rows.withColumn("__nth", nth).where(F.col("__nth") <= int(spec.get("dumpSize", 100))).drop("__nth")
