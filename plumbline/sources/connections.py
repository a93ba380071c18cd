"""Connections to outside systems, as options for Spark's own data sources."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrameReader, SparkSession

#: kind: (URL prefix, driver class)
JDBC = {
    "sqlite": ("jdbc:sqlite:", "org.sqlite.JDBC"), "postgresql": ("jdbc:postgresql://", "org.postgresql.Driver"), "postgres": ("jdbc:postgresql://", "org.postgresql.Driver"),
    "oracle": ("jdbc:oracle:thin:@", "oracle.jdbc.driver.OracleDriver"), "mysql": ("jdbc:mysql://", "com.mysql.cj.jdbc.Driver"), "mssql": ("jdbc:jtds:sqlserver://", "net.sourceforge.jtds.jdbc.Driver"),
    "h2": ("jdbc:h2:tcp://", "org.h2.Driver"), "clickhouse": ("jdbc:clickhouse://", "com.clickhouse.jdbc.ClickHouseDriver"), "greenplum": ("jdbc:postgresql://", "org.postgresql.Driver"),
    "jdbc": ("", None),
}
OTHER = ("kafka", "iceberg", "schemaRegistry")
PROBES = {"oracle": "SELECT 1 FROM dual", "mssql": "SELECT GETDATE()"}


def parameters(spec: dict[str, Any], key: str = "parameters") -> dict[str, str]:
    """``["a=b", ...]`` as a dict."""
    return dict(x.split("=", 1) for x in spec.get(key, []))


def jdbc_options(spec: dict[str, Any]) -> dict[str, str]:
    """Options of a JDBC read through the connection."""
    prefix, driver = JDBC[spec["kind"]]
    url = spec["url"] if spec["url"].startswith("jdbc:") else prefix + spec["url"]
    out = {"url": url}
    if spec.get("driver") or driver:
        out["driver"] = spec.get("driver") or driver
    for a, b in (("username", "user"), ("password", "password")):
        if spec.get(a):
            out[b] = spec[a]
    if spec.get("schema"):
        out["currentSchema"] = spec["schema"]
    return out | parameters(spec)


def jdbc_table(table: str | None, query: str | None, allow_sql: bool = True) -> str:
    """What to read: exactly one of a table and a query."""
    if (table is None) == (query is None):
        raise ValueError("either a table or a query is needed")
    if query is not None and not allow_sql:
        raise PermissionError("SQL queries are not allowed by the application settings")
    return table if query is None else f"({query}) t"


def jdbc_reader(spark: SparkSession, spec: dict[str, Any], source: dict[str, Any], allow_sql: bool = True) -> DataFrameReader:
    """A reader for a table source; ``partitionColumn`` and its bounds among the options spread the read over tasks."""
    return spark.read.format("jdbc").options(**jdbc_options(spec), dbtable=jdbc_table(source.get("table"), source.get("query"), allow_sql), **parameters(source, "options"))


def iceberg_conf(spec: dict[str, Any]) -> dict[str, str]:
    """Session settings of an Iceberg catalog."""
    at = f"spark.sql.catalog.{spec['catalogName']}"
    out = {at: "org.apache.iceberg.spark.SparkCatalog", f"{at}.type": spec.get("catalogType", "hive")}
    for a, b in (("warehouse", "warehouse"), ("catalogUri", "uri")):
        if spec.get(a):
            out[f"{at}.{b}"] = spec[a]
    return out | {f"{at}.{k}": v for k, v in parameters(spec).items()}


def kafka_options(spec: dict[str, Any], source: dict[str, Any], streaming: bool = False) -> dict[str, str]:
    """Options of a Kafka read: either topics (all plain, or all with partitions ``name@[0,1]``) or a pattern."""
    topics, pattern = source.get("topics", []), source.get("topicPattern")
    if bool(topics) == bool(pattern):
        raise ValueError("either topics or a topic pattern is needed")
    out = {"kafka.bootstrap.servers": ",".join(spec["servers"])}
    if pattern:
        out["subscribePattern"] = pattern
    elif all("@" in t for t in topics):
        out["assign"] = "{" + ",".join(f'"{n}":{p}' for n, p in (t.split("@", 1) for t in topics)) + "}"
    elif any("@" in t for t in topics):
        raise ValueError("topics with and without partitions are mixed")
    else:
        out["subscribe"] = ",".join(topics)
    out["startingOffsets"] = str(source.get("startingOffsets", "latest" if streaming else "earliest"))
    if not streaming:
        out["endingOffsets"] = str(source.get("endingOffsets", "latest"))
    return out | {f"kafka.{k}" if not k.startswith(("kafka.", "failOnDataLoss", "maxOffsets", "minPartitions")) else k: v for k, v in parameters(spec).items()} | parameters(source, "options")


def normalize(connections: dict[str, list[dict[str, Any]]]) -> dict[str, dict[str, Any]]:
    """Connections by id, each with its kind."""
    out: dict[str, dict[str, Any]] = {}
    for kind, items in connections.items():
        if kind not in JDBC and kind not in OTHER:
            raise ValueError(f"no connection kind {kind!r}")
        for c in items:
            out[c["id"]] = {**c, "kind": kind}
    return out


def validate(spark: SparkSession, spec: dict[str, Any]) -> None:
    """Try a connection before a job runs: JDBC ones answer a probe; catalogs are set up; others are only checked for form."""
    if spec["kind"] in JDBC:
        probe = PROBES.get(spec["kind"], "SELECT 1")
        spark.read.format("jdbc").options(**jdbc_options(spec), query=probe, queryTimeout="60").load().limit(1).collect()
    elif spec["kind"] == "iceberg":
        for k, v in iceberg_conf(spec).items():
            spark.conf.set(k, v)
    elif spec["kind"] == "kafka" and not spec.get("servers"):
        raise ValueError(f"connection {spec['id']}: no servers")
