import json

import pytest
from pyspark.sql import functions as F, types as T

from plumbline.operators import virtual as V
from plumbline.sources import connections as CN, readers as R, schemas as S

SPEC = {"id": "s", "kind": "fixedFull", "schema": [{"name": "a", "type": "integer", "width": 3}, {"name": "b", "type": "string", "width": 4}, {"name": "c", "type": "decimal(5, 2)", "width": 6}]}


def test_schemas(spark, tmp_path):
    full = S.read(spark, SPEC)
    assert full.widths == [3, 4, 6] and full.struct.simpleString() == "struct<a:int,b:string,c:decimal(5,2)>"
    short = S.read(spark, {"id": "s", "kind": "fixedShort", "schema": ["x:5", "y:7"]})
    assert short.widths == [5, 7] and {f.dataType for f in short.struct} == {T.StringType()}
    avsc = {"type": "record", "name": "r", "fields": [{"name": "c1", "type": ["null", "string"]}, {"name": "c2", "type": {"type": "record", "name": "q", "fields": [{"name": "d", "type": "double"}]}},
                                                      {"name": "c3", "type": {"type": "array", "items": "int"}}, {"name": "c4", "type": {"type": "long", "logicalType": "timestamp-millis"}}]}
    (tmp_path / "x.avsc").write_text(json.dumps(avsc))
    got = S.read(spark, {"id": "s", "kind": "avro", "schema": str(tmp_path / "x.avsc")})
    assert got.struct.simpleString() == "struct<c1:string,c2:struct<d:double>,c3:array<int>,c4:timestamp>" and got.struct["c1"].nullable and not got.struct["c2"].nullable
    for name in ("string", "boolean", "date", "timestamp", "integer", "long", "short", "byte", "double", "float", "DECIMAL(10,3)"):
        S.data_type(name)
    with pytest.raises(ValueError):
        S.data_type("array<int>")


def test_files(spark, tmp_path):
    (tmp_path / "f.txt").write_text("  1ab   1.50\n xxcd\n")
    ctx = R.Context(schemas={"s": S.read(spark, SPEC), "d": S.read(spark, {"id": "d", "kind": "delimited", "schema": [{"name": "a", "type": "integer"}, {"name": "b", "type": "string"}]})})
    rows = R.read(spark, "file", {"id": "f", "kind": "fixed", "path": str(tmp_path / "f.txt"), "schema": "s"}, ctx).df.collect()
    assert [tuple(map(str, r)) for r in rows] == [("1", "ab", "1.50"), ("None", "cd", "None")]
    (tmp_path / "h.csv").write_text("a;b\n1;x\n")
    assert R.read(spark, "file", {"id": "f", "kind": "delimited", "path": str(tmp_path / "h.csv"), "header": True, "delimiter": ";"}, ctx).df.columns == ["a", "b"]
    (tmp_path / "n.csv").write_text("1,x\n2,y\n")
    assert R.read(spark, "file", {"id": "f", "kind": "delimited", "path": str(tmp_path / "n.csv"), "schema": "d"}, ctx).df.agg(F.sum("a")).first()[0] == 3
    with pytest.raises(ValueError):
        R.read(spark, "file", {"id": "f", "kind": "delimited", "path": str(tmp_path / "n.csv")}, ctx)
    with pytest.raises(FileNotFoundError):
        R.read(spark, "file", {"id": "f", "kind": "orc", "path": str(tmp_path / "none")}, ctx)
    df = spark.range(5)
    for kind in ("parquet", "orc"):
        df.write.format(kind).save(str(tmp_path / kind))
        got = R.read(spark, "file", {"id": "f", "kind": kind, "path": str(tmp_path / kind), "persist": "MEMORY_ONLY", "keyFields": ["ID"]}, ctx)
        got.check_keys()
        assert got.df.count() == 5 and got.df.storageLevel.useMemory
        got.df.unpersist()
        with pytest.raises(ValueError):
            got.check_keys(case_sensitive=True)
    assert R.read(spark, "custom", {"id": "f", "format": "json", "path": _json(tmp_path), "options": ["multiLine=false"]}, ctx).df.count() == 2
    with pytest.raises(ValueError):
        R.read(spark, "table", {"id": "f"}, R.Context(stream=True))


def _json(tmp_path):
    (tmp_path / "j.json").write_text('{"a":1}\n{"a":2}\n')
    return str(tmp_path / "j.json")


def test_hive(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS src_db")
    spark.sql("DROP TABLE IF EXISTS src_db.t")
    spark.range(10).selectExpr("id", "cast(id % 3 as string) as p").write.partitionBy("p").option("path", str(tmp_path / "t")).saveAsTable("src_db.t")
    ctx = R.Context()
    one = R.read(spark, "hive", {"id": "h", "schema": "src_db", "table": "t", "partitions": [{"name": "p", "values": ["1", "2"]}]}, ctx).df
    assert one.count() == 6 and "PartitionFilters: [p" in one._jdf.queryExecution().executedPlan().toString()
    assert R.read(spark, "hive", {"id": "h", "schema": "src_db", "table": "t", "partitions": [{"name": "p", "expr": "p = '0'"}]}, ctx).df.count() == 4
    assert S.read(spark, {"id": "s", "kind": "hive", "schema": "src_db", "table": "t", "excludeColumns": ["P"]}).struct.names == ["id"]
    spark.sql("DROP TABLE src_db.t")


def test_connections():
    got = CN.normalize({"oracle": [{"id": "o", "url": "db:1521/x", "username": "u", "password": "p"}], "jdbc": [{"id": "j", "url": "jdbc:trino://h", "driver": "d", "parameters": ["fetchSize=10"]}], "kafka": [{"id": "k", "servers": ["a:1", "b:2"]}]})
    assert CN.jdbc_options(got["o"]) == {"url": "jdbc:oracle:thin:@db:1521/x", "driver": "oracle.jdbc.driver.OracleDriver", "user": "u", "password": "p"}
    assert CN.jdbc_options(got["j"]) == {"url": "jdbc:trino://h", "driver": "d", "fetchSize": "10"}
    assert CN.jdbc_table("t", None) == "t" and CN.jdbc_table(None, "select 1") == "(select 1) t"
    for a, b in ((None, None), ("t", "q")):
        with pytest.raises(ValueError):
            CN.jdbc_table(a, b)
    with pytest.raises(PermissionError):
        CN.jdbc_table(None, "q", allow_sql=False)
    k = CN.kafka_options(got["k"], {"topics": ["x", "y"]})
    assert k["subscribe"] == "x,y" and k["startingOffsets"] == "earliest" and k["kafka.bootstrap.servers"] == "a:1,b:2"
    assert CN.kafka_options(got["k"], {"topics": ["x@[0,1]"]})["assign"] == '{"x":[0,1]}'
    assert CN.kafka_options(got["k"], {"topicPattern": "x.*"}, streaming=True)["startingOffsets"] == "latest"
    for bad in ({}, {"topics": ["x"], "topicPattern": "y"}, {"topics": ["x", "y@[1]"]}):
        with pytest.raises(ValueError):
            CN.kafka_options(got["k"], bad)
    assert CN.iceberg_conf({"catalogName": "c", "catalogType": "hadoop", "warehouse": "/w", "parameters": ["io-impl=x"]})["spark.sql.catalog.c.io-impl"] == "x"
    with pytest.raises(ValueError):
        CN.normalize({"nope": []})


def test_decode(spark):
    df = spark.createDataFrame([(b'{"a": 1}', b"\x00\x00\x00\x00\x01abc", b"<r><a>2</a></r>")], "j binary, s binary, x binary")
    schema = S.Schema("s", T.StructType.fromDDL("a int"))
    got = df.select(R.decode(df["j"], "json", schema)["a"], R.decode(df["s"], "string", None, True), R.decode(df["x"], "xml", schema)["a"], R.decode(df["j"], "binary", None)).first()
    assert list(got)[:3] == [1, "abc", 2]


def test_virtual(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "id int, name string, entity string")
    b = spark.createDataFrame([(2, "d"), (3, "e")], "id int, description string")
    specs = [{"id": "last", "kind": "aggregate", "parentSources": ["joined"], "groupBy": ["entity"], "expr": ["count(1) as n", "max(description) as m"]},
             {"id": "joined", "kind": "join", "parentSources": ["picked", "b"], "joinBy": ["id"], "joinType": "leftOuter"}, {"id": "picked", "kind": "filter", "parentSources": ["a"], "expr": ["id > 0", "name is not null"]},
             {"id": "q", "kind": "sql", "parentSources": ["a", "b"], "query": "select a.id from a join b on a.id = b.id"}, {"id": "s", "kind": "select", "parentSources": ["a"], "expr": ["upper(name) as n"], "persist": "memory_only"}]
    got = V.derive_all(spark, specs, {"a": a, "b": b})
    assert {tuple(r) for r in got["last"].collect()} == {("p", 1, None), ("q", 1, "d")}
    assert [r.id for r in got["q"].collect()] == [2] and {r.n for r in got["s"].collect()} == {"X", "Y"}
    for bad in ({"kind": "join", "parentSources": ["a"], "joinBy": ["id"], "joinType": "inner"}, {"kind": "filter", "parentSources": ["a", "b"], "expr": ["true"]}, {"kind": "nope", "parentSources": ["a"]},
                {"kind": "filter", "parentSources": ["z"], "expr": ["true"]}, {"kind": "filter", "parentSources": ["v"], "expr": ["true"]}, {"kind": "join", "parentSources": ["a", "b"], "joinBy": ["id"], "joinType": "odd"}):
        with pytest.raises(ValueError):
            V.derive_all(spark, [{"id": "v", **bad}], {"a": a, "b": b})
    with pytest.raises(PermissionError):
        V.derive(spark, specs[3], {"a": a, "b": b}, allow_sql=False)


@pytest.mark.parametrize("how", V.JOINS)
def test_joins(spark, how):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, l string"), spark.createDataFrame([(2, "d"), (3, "e")], "id int, r string")
    n = V.derive(spark, {"id": "v", "kind": "join", "parentSources": ["a", "b"], "joinBy": ["id"], "joinType": how}, {"a": a, "b": b}).count()
    want = 3 if how in ("outer", "full", "fullouter") else 2 if how in ("left", "leftouter", "right", "rightouter") else 1
    assert n == want


def test_storage_levels():
    for name in R._LEVELS:
        R.storage_level(name.upper())
    with pytest.raises(ValueError):
        R.storage_level("tape")
