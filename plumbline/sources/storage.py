"""Result storage: seven tables with upserts, and the history that trends are computed from."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timedelta
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

_S, _D, _TS, _B = T.StringType(), T.DoubleType(), T.TimestampType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in (("job_id", _S), *fields, ("reference_date", _TS), ("execution_date", _TS))])


#: table: (schema, key)
TABLES: dict[str, tuple[T.StructType, tuple[str, ...]]] = {
    "results_metric_regular": (_struct(("metric_id", _S), ("metric_name", _S), ("description", _S), ("metadata", _S), ("source_id", _S), ("column_names", _S), ("params", _S), ("result", _D),
                                       ("additional_result", _S)), ("job_id", "metric_id", "metric_name", "reference_date")),
    "results_metric_composed": (_struct(("metric_id", _S), ("metric_name", _S), ("description", _S), ("metadata", _S), ("source_id", _S), ("formula", _S), ("result", _D), ("additional_result", _S)),
                                ("job_id", "metric_id", "reference_date")),
    "results_metric_trend": (_struct(("metric_id", _S), ("metric_name", _S), ("description", _S), ("metadata", _S), ("source_id", _S), ("params", _S), ("result", _D), ("additional_result", _S)),
                             ("job_id", "metric_id", "reference_date")),
    "results_check": (_struct(("check_id", _S), ("check_name", _S), ("description", _S), ("metadata", _S), ("source_id", _S), ("base_metric", _S), ("compared_metric", _S),
                              ("compared_threshold", _D), ("lower_bound", _D), ("upper_bound", _D), ("status", _S), ("message", _S), ("is_critical", _B)), ("job_id", "check_id", "reference_date")),
    "results_check_load": (_struct(("check_id", _S), ("check_name", _S), ("description", _S), ("metadata", _S), ("source_id", _S), ("expected", _S), ("status", _S), ("message", _S),
                                   ("is_critical", _B)), ("job_id", "check_id", "reference_date")),
    "results_metric_error": (_struct(("metric_id", _S), ("source_id", _S), ("source_key_fields", _S), ("metric_columns", _S), ("status", _S), ("message", _S), ("row_data", _S), ("error_hash", _S)),
                             ("job_id", "error_hash", "reference_date")),
    "job_state": (_struct(("config", _S), ("version_info", _S)), ("job_id", "reference_date")),
}
METRIC_TABLES = {"regular": "results_metric_regular", "composed": "results_metric_composed", "trend": "results_metric_trend"}


def merged(old: DataFrame | None, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``old`` with the rows of ``new`` put in: of rows with one key the new one stays."""
    both = new.withColumn("__rank", F.lit(1))
    if old is not None:
        both = both.unionByName(old.withColumn("__rank", F.lit(2)))
    first = F.row_number().over(Window.partitionBy(*key).orderBy("__rank"))
    return both.withColumn("__first", first).where("__first = 1").drop("__rank", "__first")


_UNITS = {"d": "days", "h": "hours", "m": "minutes", "s": "seconds", "ms": "milliseconds", "w": "weeks"}


def duration(text: Any) -> timedelta:
    """A duration such as ``8d``, ``12h``, ``30m``, ``10s`` or ``2 weeks``."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]+)\s*", str(text))
    if m:
        unit = m[2].lower()
        for short, long in _UNITS.items():
            if unit in (short, long, long[:-1], {"m": "min", "s": "sec", "ms": "millis"}.get(short), {"m": "mins", "s": "secs", "ms": "milli"}.get(short)):
                return timedelta(**{long: int(m[1])})
    raise ValueError(f"no duration {text!r}")


def window(rows: DataFrame, rule: str, reference: datetime, size: Any, offset: Any = None, by: tuple[str, ...] = ("job_id", "metric_id")) -> DataFrame:
    """History rows within a trend window.

    ``record``: of each metric the last ``size`` reference dates strictly
    before ``reference``, after skipping ``offset`` of them.  ``datetime``:
    reference dates in [reference - offset - size, reference - offset).  The
    date filter is on the stored column, so it reaches the scan.
    """
    at = F.lit(reference)
    if rule == "datetime":
        end = reference - duration(offset) if offset else reference
        return rows.where((F.col("reference_date") < F.lit(end)) & (F.col("reference_date") >= F.lit(end - duration(size))))
    if rule != "record":
        raise ValueError(f"no window rule {rule!r}")
    skip = int(offset or 0)
    nth = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc("reference_date")))
    return rows.where(F.col("reference_date") < at).withColumn("__nth", nth).where((F.col("__nth") > skip) & (F.col("__nth") <= skip + int(size))).drop("__nth")


class Storage:
    """Base: reading, writing and history over some way to keep tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def load(self, table: str) -> DataFrame | None:
        raise NotImplementedError

    def save(self, table: str, rows: DataFrame) -> None:
        """Upsert rows by the table's key."""
        raise NotImplementedError

    def append(self, table: str, rows: list[dict[str, Any]]) -> None:
        """Upsert rows given as dicts."""
        schema = TABLES[table][0]
        if rows:
            self.save(table, self.spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema))

    def history(self, job_id: str, ids: list[str], kind: str, rule: str, reference: datetime, size: Any, offset: Any = None) -> list[tuple[datetime, float, str | None, str]]:
        """(reference date, result, additional result, metric name) of past results, latest first."""
        rows = self.load(METRIC_TABLES[kind])
        if rows is None:
            return []
        rows = rows.where((F.col("job_id") == job_id) & F.col("metric_id").isin(ids))
        got = window(rows, rule, reference, size, offset).select("reference_date", "result", "additional_result", "metric_name").collect()
        return sorted(((r[0], r[1], r[2], r[3]) for r in got), key=lambda r: r[0], reverse=True)


class FileStorage(Storage):
    """A Parquet folder for each table, partitioned by job: an upsert rewrites only the partitions of the jobs it has rows for."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark)
        self.path = path.rstrip("/")

    def _fs(self, at: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _recover(self, table: str) -> None:
        """Bring back what a writer that died between its two renames had put aside."""
        at, fs = self._fs(f"{self.path}/.{table}-aside")
        if fs.exists(at):
            for part in fs.listStatus(at):
                to, _ = self._fs(f"{self.path}/{table}/{part.getPath().getName()}")
                if not fs.exists(to):
                    fs.rename(part.getPath(), to)
            fs.delete(at, True)

    def load(self, table: str) -> DataFrame | None:
        at, fs = self._fs(f"{self.path}/{table}")
        self._recover(table)
        return self.spark.read.schema(TABLES[table][0]).parquet(f"{self.path}/{table}") if fs.exists(at) else None

    def save(self, table: str, rows: DataFrame) -> None:
        schema, key = TABLES[table]
        jobs = [r[0] for r in rows.select("job_id").distinct().collect()]
        old = self.load(table)
        both = merged(old.where(F.col("job_id").isin(jobs)) if old is not None else None, rows.select(*schema.fieldNames()), key)
        tmp = f"{self.path}/.{table}-{uuid.uuid4().hex}"  # written whole before it replaces what it was read from
        both.repartition("job_id").write.partitionBy("job_id").parquet(tmp)
        _, fs = self._fs(self.path)
        path = lambda x: self.spark._jvm.org.apache.hadoop.fs.Path(x)
        fs.mkdirs(path(f"{self.path}/{table}"))
        for part in fs.listStatus(path(tmp)):
            if part.isDirectory():
                to, aside = (path(f"{self.path}/{x}/{part.getPath().getName()}") for x in (table, f".{table}-aside"))
                fs.mkdirs(aside.getParent())
                fs.delete(aside, True)
                if fs.exists(to):
                    fs.rename(to, aside)  # until the new one is in its place
                fs.rename(part.getPath(), to)
                fs.delete(aside, True)
        fs.delete(path(f"{self.path}/.{table}-aside"), True)
        fs.delete(path(tmp), True)


class HiveStorage(Storage):
    """Catalog tables, partitioned by job, with dynamic partition overwrite."""

    def __init__(self, spark: SparkSession, database: str, format: str = "parquet"):
        super().__init__(spark)
        self.database, self.format = database, format

    def load(self, table: str) -> DataFrame | None:
        name = f"{self.database}.{table}"
        return self.spark.table(name).select(*TABLES[table][0].fieldNames()) if self.spark.catalog.tableExists(name) else None

    def save(self, table: str, rows: DataFrame) -> None:
        schema, key = TABLES[table]
        columns = [c for c in schema.fieldNames() if c != "job_id"] + ["job_id"]
        name, old = f"{self.database}.{table}", self.load(table)
        if old is None:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}")
            merged(None, rows, key).select(*columns).write.format(self.format).partitionBy("job_id").saveAsTable(name)
            return
        jobs = [r[0] for r in rows.select("job_id").distinct().collect()]
        kept = merged(old.where(F.col("job_id").isin(jobs)), rows, key)
        tmp = f"{self.database}.tmp_{uuid.uuid4().hex}"
        kept.select(*columns).write.format(self.format).saveAsTable(tmp)
        self.spark.table(tmp).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(name, overwrite=True)
        self.spark.sql(f"DROP TABLE {tmp}")


class JdbcStorage(Storage):
    """Tables of a database, reached through Spark's JDBC source; the driver's jar must be on the class path.

    An upsert writes the new rows beside the table, and one transaction then
    deletes the rows whose keys they have and inserts them: the history stays
    in the database, and other jobs' rows are not touched.
    """

    def __init__(self, spark: SparkSession, connection: dict[str, Any], schema: str | None = None):
        super().__init__(spark)
        from .connections import jdbc_options

        self.options, self.schema = jdbc_options(connection), schema

    def _name(self, table: str) -> str:
        return f"{self.schema}.{table}" if self.schema else table

    def _connect(self):
        jvm = self.spark._jvm
        if self.options.get("driver"):
            jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(self.options["driver"])
        properties = jvm.java.util.Properties()
        for k, v in self.options.items():
            if k not in ("url", "driver"):
                properties.setProperty(k, v)
        return jvm.java.sql.DriverManager.getConnection(self.options["url"], properties)

    def _there(self, table: str) -> bool:
        connection = self._connect()
        try:
            statement = connection.createStatement()
            try:
                statement.executeQuery(f"SELECT 1 FROM {self._name(table)} WHERE 1 = 0").close()
                return True
            except Py4JJavaError:
                return False
            finally:
                statement.close()
        finally:
            connection.close()

    def load(self, table: str) -> DataFrame | None:
        if not self._there(table):
            return None
        df = self.spark.read.format("jdbc").options(**self.options, dbtable=self._name(table)).load()
        return df.toDF(*[c.lower() for c in df.columns]).select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table][0].fields])

    def save(self, table: str, rows: DataFrame) -> None:
        schema, key = TABLES[table]
        columns = [f.name.upper() for f in schema.fields]  # Spark quotes names as they are; databases fold unquoted ones
        types = ", ".join(f"{f.name.upper()} VARCHAR(512)" for f in schema.fields if f.dataType == _S and f.name in key)  # the text type of some databases can't be compared
        new = merged(None, rows, key).toDF(*columns)

        def write(name: str) -> None:
            new.write.format("jdbc").options(**self.options, dbtable=name, createTableColumnTypes=types).mode("errorifexists").save()

        if not self._there(table):
            write(self._name(table))
            return
        beside = self._name(f"new_{uuid.uuid4().hex[:16]}")
        write(beside)
        name, quote = self._name(table), lambda c: f'"{c.upper()}"'
        same = " AND ".join(f"(b.{quote(k)} = {name}.{quote(k)} OR b.{quote(k)} IS NULL AND {name}.{quote(k)} IS NULL)" for k in key)
        list_ = ", ".join(map(quote, columns))
        connection = self._connect()
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            statement.executeUpdate(f"DELETE FROM {name} WHERE EXISTS (SELECT 1 FROM {beside} b WHERE {same})")
            statement.executeUpdate(f"INSERT INTO {name} ({list_}) SELECT {list_} FROM {beside}")
            connection.commit()
            statement.executeUpdate(f"DROP TABLE {beside}")
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()


def open_storage(spark: SparkSession, spec: dict[str, Any] | None) -> Storage | None:
    """The storage named by the application settings: ``dbType`` and ``url``."""
    if not spec:
        return None
    kind = spec["dbType"].lower()
    if kind == "file":
        return FileStorage(spark, spec["url"])
    if kind == "hive":
        return HiveStorage(spark, spec.get("schema") or spec["url"])
    return JdbcStorage(spark, {**spec, "kind": kind}, spec.get("schema"))
