"""Sources as DataFrames, batch or streaming.  Everything stays lazy: pruning and pushdown reach the scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .connections import iceberg_conf, jdbc_reader, kafka_options, parameters
from .schemas import Schema

FILE_KINDS = ("fixed", "delimited", "avro", "parquet", "orc")
KINDS = ("table", "kafka", "greenplum", "iceberg", "hive", "file", "custom")
STREAMABLE = ("kafka", "file")
_LEVELS = ("none", "disk_only", "disk_only_2", "disk_only_3", "memory_only", "memory_only_2", "memory_only_ser", "memory_only_ser_2", "memory_and_disk", "memory_and_disk_2",
           "memory_and_disk_ser", "memory_and_disk_ser_2", "off_heap")


def storage_level(name: str) -> StorageLevel:
    """A storage level by its name in any case; serialised levels are the plain ones in Python."""
    low = name.lower()
    if low not in _LEVELS:
        raise ValueError(f"no storage level {name!r}")
    return getattr(StorageLevel, low.replace("_ser", "").upper())


@dataclass
class Source:
    """A source with the fields that identify its rows."""

    id: str
    df: DataFrame
    key_fields: list[str] = field(default_factory=list)
    parents: list[str] = field(default_factory=list)

    def check_keys(self, case_sensitive: bool = False) -> None:
        """Every key field must be a column."""
        fold = (lambda x: x) if case_sensitive else str.lower
        there = {fold(c) for c in self.df.columns}
        missing = [k for k in self.key_fields if fold(k) not in there]
        if missing:
            raise ValueError(f"source {self.id}: key fields {missing} are not columns")


@dataclass
class Context:
    """What readers need besides a source's description."""

    connections: dict[str, dict[str, Any]] = field(default_factory=dict)
    schemas: dict[str, Schema] = field(default_factory=dict)
    allow_sql: bool = True
    stream: bool = False


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def fixed_width(lines: DataFrame, schema: Schema) -> DataFrame:
    """Columns cut from the ``value`` of text lines by the schema's widths; what lies beyond a line or can't be read as its type is null."""
    at, out = 1, []
    for f, w in zip(schema.struct.fields, schema.widths):
        piece = F.when(F.length("value") >= at, F.trim(F.substring("value", at, w)))
        out.append((piece if f.dataType.simpleString() == "string" else piece.try_cast(f.dataType)).alias(f.name))
        at += w
    return lines.select(*out)


def _file(spark: SparkSession, s: dict[str, Any], ctx: Context) -> DataFrame:
    kind, path = s["kind"], s["path"]
    if kind not in FILE_KINDS:
        raise ValueError(f"source {s['id']}: no file kind {kind!r}")
    if not _exists(spark, path):
        raise FileNotFoundError(f"source {s['id']}: no path {path}")
    schema = ctx.schemas[s["schema"]] if s.get("schema") else None
    reader = spark.readStream if ctx.stream else spark.read
    if kind == "fixed":
        if schema is None or not schema.widths:
            raise ValueError(f"source {s['id']}: a fixed-width file needs a schema with widths")
        return fixed_width(reader.text(path), schema)
    if kind == "delimited":
        header = bool(s.get("header", False))
        if header == (schema is not None) and not ctx.stream:
            raise ValueError(f"source {s['id']}: either a header or a schema is needed")
        reader = reader.option("header", header).option("sep", s.get("delimiter", ",")).option("quote", s.get("quote", '"')).option("escape", s.get("escape", "\\")).option(
            "mode", "PERMISSIVE" if ctx.stream else "FAILFAST")
        return (reader.schema(schema.struct) if schema else reader).csv(path)
    if ctx.stream and schema is None:
        raise ValueError(f"source {s['id']}: a file stream needs a schema")
    if kind == "avro":
        reader = reader.format("avro")
        if schema is not None and schema.avro:
            return reader.option("avroSchema", schema.avro).load(path)
        return (reader.schema(schema.struct) if schema else reader).load(path)
    return (reader.schema(schema.struct) if schema else reader).format(kind).load(path)


def _hive(spark: SparkSession, s: dict[str, Any], ctx: Context) -> DataFrame:
    df = spark.read.table(f"{s['schema']}.{s['table']}")
    tests: list[Column] = []
    for p in s.get("partitions", []):
        if ("expr" in p) == ("values" in p):
            raise ValueError(f"source {s['id']}: partition {p['name']} needs either an expression or values")
        tests.append(F.expr(p["expr"]) if "expr" in p else F.col(p["name"]).isin(list(p["values"])))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def decode(column: Column, how: str, schema: Schema | None, subtract_schema_id: bool = False) -> Column:
    """A Kafka key or value by its format."""
    if subtract_schema_id:
        column = F.substring(column, 6, 2147483647)
    if how == "binary":
        return column
    if how == "string":
        return column.cast("string")
    if schema is None:
        raise ValueError(f"format {how} needs a schema")
    if how == "json":
        return F.from_json(column.cast("string"), schema.struct)
    if how == "xml":
        return F.from_xml(column.cast("string"), schema.struct)
    if how == "avro":
        from pyspark.sql.avro.functions import from_avro

        return from_avro(column, schema.avro)
    raise ValueError(f"no format {how!r}")


def _kafka(spark: SparkSession, s: dict[str, Any], ctx: Context) -> DataFrame:
    options = kafka_options(ctx.connections[s["connection"]], s, ctx.stream)
    df = (spark.readStream if ctx.stream else spark.read).format("kafka").options(**options).load()
    out = [decode(df[c], s.get(f"{c}Format", "string"), ctx.schemas.get(s.get(f"{c}Schema", "")), bool(s.get("subtractSchemaId", False))).alias(c) for c in ("key", "value")]
    return df.select(*out, "timestamp", "topic", "partition", "offset") if ctx.stream else df.select(*out)


def _iceberg(spark: SparkSession, s: dict[str, Any], ctx: Context) -> DataFrame:
    spec = ctx.connections[s["connection"]]
    for k, v in iceberg_conf(spec).items():
        spark.conf.set(k, v)
    return spark.table(f"{spec['catalogName']}.{s.get('database', 'default')}.{s['table']}")


def _custom(spark: SparkSession, s: dict[str, Any], ctx: Context) -> DataFrame:
    reader = (spark.readStream if ctx.stream else spark.read).format(s["format"]).options(**parameters(s, "options"))
    if s.get("schema"):
        reader = reader.schema(ctx.schemas[s["schema"]].struct)
    return reader.load(s["path"]) if s.get("path") else reader.load()


def _jdbc(spark: SparkSession, s: dict[str, Any], ctx: Context) -> DataFrame:
    return jdbc_reader(spark, ctx.connections[s["connection"]], s, ctx.allow_sql).load()


READERS: dict[str, Callable[[SparkSession, dict[str, Any], Context], DataFrame]] = {
    "table": _jdbc, "greenplum": _jdbc, "kafka": _kafka, "iceberg": _iceberg, "hive": _hive, "file": _file, "custom": _custom}


def read(spark: SparkSession, kind: str, spec: dict[str, Any], ctx: Context) -> Source:
    """A source by its kind and description."""
    if kind not in READERS:
        raise ValueError(f"no source kind {kind!r}")
    if ctx.stream and kind not in (*STREAMABLE, "custom"):
        raise ValueError(f"source {spec['id']}: {kind} can't be streamed")
    df = READERS[kind](spark, spec, ctx)
    if spec.get("persist") and not ctx.stream:
        df = df.persist(storage_level(spec["persist"]))
    return Source(spec["id"], df, list(spec.get("keyFields", [])))
