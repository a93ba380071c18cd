"""Schemas of sources: delimited, fixed-width, catalog, Avro and registry ones."""

from __future__ import annotations

import json
import re
import urllib.request
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession, types as T

_SIMPLE = {"string": T.StringType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "integer": T.IntegerType(), "long": T.LongType(),
           "short": T.ShortType(), "byte": T.ByteType(), "double": T.DoubleType(), "float": T.FloatType()}
KINDS = ("delimited", "fixedFull", "fixedShort", "hive", "avro", "registry")


@dataclass
class Schema:
    id: str
    struct: T.StructType
    widths: list[int] = field(default_factory=list)
    avro: str | None = None


def data_type(name: str) -> T.DataType:
    """A declarable column type by name."""
    low = name.strip().lower()
    if low in _SIMPLE:
        return _SIMPLE[low]
    m = re.fullmatch(r"decimal\(\s*(\d+)\s*,\s*(-?\d+)\s*\)", low)
    if m:
        return T.DecimalType(int(m[1]), int(m[2]))
    raise ValueError(f"no column type {name!r}")


_AVRO = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(),
         "null": T.NullType(), "enum": T.StringType(), "fixed": T.BinaryType()}


def avro_type(node: Any, named: dict[str, Any] | None = None) -> tuple[T.DataType, bool]:
    """(Spark type, nullable) of an Avro schema."""
    named = {} if named is None else named
    if isinstance(node, str):
        return (_AVRO[node], node == "null") if node in _AVRO else avro_type(named[node], named)
    if isinstance(node, list):
        rest = [x for x in node if x != "null"]
        if len(rest) == 1:
            return avro_type(rest[0], named)[0], len(rest) < len(node)
        if set(map(str, rest)) == {"int", "long"}:
            return T.LongType(), len(rest) < len(node)
        if set(map(str, rest)) == {"float", "double"}:
            return T.DoubleType(), len(rest) < len(node)
        return T.StructType([T.StructField(f"member{i}", avro_type(x, named)[0], True) for i, x in enumerate(rest)]), len(rest) < len(node)
    kind, logical = node["type"], node.get("logicalType")
    if "name" in node:
        named[node["name"]] = node
    if logical == "date":
        return T.DateType(), False
    if logical in ("timestamp-millis", "timestamp-micros"):
        return T.TimestampType(), False
    if logical == "decimal":
        return T.DecimalType(node["precision"], node.get("scale", 0)), False
    if kind == "record":
        fields = []
        for f in node["fields"]:
            t, null = avro_type(f["type"], named)
            fields.append(T.StructField(f["name"], t, null))
        return T.StructType(fields), False
    if kind == "array":
        t, null = avro_type(node["items"], named)
        return T.ArrayType(t, null), False
    if kind == "map":
        t, null = avro_type(node["values"], named)
        return T.MapType(T.StringType(), t, null), False
    return avro_type(kind, named) if not isinstance(kind, str) or kind not in ("enum", "fixed") else (_AVRO[kind], False)


def registry_fetch(base_url: str, schema_id: int | None = None, subject: str | None = None, version: int | str = "latest", retries: int = 3, headers: dict[str, str] | None = None) -> str:
    """An Avro schema's text from a schema registry, by id or by subject."""
    if (schema_id is None) == (subject is None):
        raise ValueError("either a schema id or a subject is needed")
    url = base_url.rstrip("/") + (f"/schemas/ids/{schema_id}" if schema_id is not None else f"/subjects/{subject}/versions/{version}")
    for attempt in range(max(1, retries)):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=30) as r:
                return json.load(r)["schema"]
        except OSError:
            if attempt + 1 >= max(1, retries):
                raise
    raise AssertionError


def read(spark: SparkSession, spec: dict[str, Any], registries: dict[str, dict] | None = None) -> Schema:
    """A schema by its description."""
    kind, i = spec["kind"], spec["id"]
    if kind == "delimited":
        return Schema(i, T.StructType([T.StructField(c["name"], data_type(c["type"]), True) for c in spec["schema"]]))
    if kind == "fixedFull":
        return Schema(i, T.StructType([T.StructField(c["name"], data_type(c["type"]), True) for c in spec["schema"]]), [int(c["width"]) for c in spec["schema"]])
    if kind == "fixedShort":
        pairs = [c.rsplit(":", 1) for c in spec["schema"]]
        return Schema(i, T.StructType([T.StructField(n.strip(), T.StringType(), True) for n, _ in pairs]), [int(w) for _, w in pairs])
    if kind == "hive":
        out = {x.lower() for x in spec.get("excludeColumns", [])}
        return Schema(i, T.StructType([f for f in spark.table(f"{spec['schema']}.{spec['table']}").schema.fields if f.name.lower() not in out]))
    if kind == "avro":
        text = Path(spec["schema"]).read_text()
    elif kind == "registry":
        where = (registries or {}).get(spec.get("connection", ""), spec)
        text = registry_fetch(where["baseUrls"][0] if "baseUrls" in where else where["baseUrl"], spec.get("schemaId"), spec.get("schemaSubject"), spec.get("version", "latest"), int(where.get("retries", 3)))
    else:
        raise ValueError(f"schema {i}: no kind {kind!r}")
    t, _ = avro_type(json.loads(text))
    return Schema(i, t if isinstance(t, T.StructType) else T.StructType([T.StructField("value", t, True)]), avro=text)
