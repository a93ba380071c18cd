import json
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline import api
from plumbline.plans import hocon, secrets
from plumbline.plans.job import Engine
from plumbline.plans.spec import InvalidJob, parse
from plumbline.sources import storage as ST, targets as TG

JOB = """
base = "%(base)s"   // where outputs go
jobConfig: {
  jobId: "quality of t"
  sources: { file: [{id: "t", kind: parquet, path: ${base}"/in", keyFields: ["ID"]}] }
  virtualSources: [
    {id: "v", kind: "filter", parentSources: ["t"], expr: ["id < 5"], save: {kind: "orc", path: ${base}"/v"}}
  ]
  loadChecks: { exactColumnNum: [{id: "lc", source: "t", option: 3}], minColumnNum: [{id: "lc2", source: "v", option: 9, isCritical: true}] }
  metrics: {
    regular: {
      rowCount: [{id: "rows", source: "t"}, {id: "few", source: "v", description: "rows of v"}]
      nullValues: [{id: "nulls", source: "t", columns: ["Name"]}]
      topN: [{id: "top", source: "t", columns: ["grp"], params: {targetNumber: 2}}]
    }
    composed: [{id: "share", formula: "100 * {{ nulls }} / {{ rows }}"}, {id: "twice", formula: "2 * {{ share }}"}, {id: "bad", formula: "{{ twice }} + {{ trend }}"}]
    trend: { avg: [{id: "trend", lookupMetric: "rows", rule: "record", windowSize: 3}] }
  }
  checks: {
    snapshot: { greaterThan: [{id: "some", metric: "rows", threshold: 0}], lessThan: [{id: "clean", metric: "share", threshold: 1, isCritical: true}] }
    trend: { averageBoundFull: [{id: "steady", metric: "rows", rule: "datetime", windowSize: "8d", threshold: 0.1}], topNRank: [{id: "rank", metric: "top", targetNumber: 2, threshold: 0.1}] }
    expression: [{id: "e", formula: "{{ few }} < {{ rows }}"}]
  }
  targets: {
    results: { file: {resultTypes: [regularMetrics, composedMetrics, trendMetrics, checks, loadChecks, jobState], save: {kind: "delimited", path: ${base}"/results", header: true}} }
    errorCollection: { file: {metrics: ["nulls"], dumpSize: 1, save: {kind: "parquet", path: ${base}"/errors"}} }
    summary: { email: {recipients: ["a@b"]} }
    checkAlerts: { mattermost: [{id: "al", checks: ["clean"], recipients: ["@x"]}, {id: "quiet", checks: ["some"], recipients: ["@x"]}] }
  }
}
"""


def test_run(spark, tmp_path):
    base = str(tmp_path)
    spark.range(10).select("id", F.when(F.col("id") % 3 != 0, "n").alias("Name"), (F.col("id") % 2).cast("string").alias("grp")).write.parquet(f"{base}/in")
    engine = Engine(spark, {"storage": {"dbType": "file", "url": f"{base}/store"}, "errorDumpSize": 3})
    config = hocon.loads(JOB % {"base": base})
    first = datetime(2024, 1, 1)
    for day in range(3):
        rs = engine.run(config, reference=first + timedelta(days=day))
        again = engine.run(config, reference=first + timedelta(days=day))  # replaces the results of the day
    for rs in (rs, again):
        value = {r.metric_id: r.result for r in [*rs.regular, *rs.composed, *rs.trend]}
        assert value["rows"] == 10 and value["few"] == 5 and value["nulls"] == 4 and value["share"] == 40 and value["twice"] == 80 and value["trend"] == 10 and value["bad"] == 90
        status = {c.check_id: c.status for c in [*rs.checks, *rs.load_checks]}
        assert status == {"some": "Success", "clean": "Failure", "steady": "Success", "rank": "Success", "e": "Success", "lc": "Success", "lc2": "Failure"}
    assert rs.exit_code("none") == 0 and [c.check_id for c in rs.violations("critical")] == ["clean", "lc2"] and rs.exit_code("all") == 1
    assert rs.summary["jobStatus"] == "FAILURE" and rs.summary["listMetricsWithErrors"] == ["nulls"]
    assert engine.storage.load("results_metric_regular").count() == 15 and engine.storage.load("results_check").count() == 15
    assert engine.storage.load("results_metric_error").count() == 9
    assert spark.read.orc(f"{base}/v").count() == 5
    out = spark.read.option("header", True).csv(TG.folder(f"{base}/results", "quality of t", "results", rs.summary["referenceDate"], rs.summary["executionDate"]))
    assert out.columns == ["jobId", "referenceDate", "executionDate", "entityType", "data"] and out.count() == 5 + 3 + 1 + 5 + 2 + 1
    # Notifications are off: the summary and the one alert with a failed check are refused; nothing else failed.
    assert len(rs.faults) == 2 and all("PermissionError" in f for f in rs.faults)
    assert api.jobs(engine.storage, datetime(2023, 12, 31), datetime(2024, 2, 1)).first()[0] == "quality of t"
    assert json.loads(api.job_state(engine.storage, "quality of t").first()["config"])["jobId"] == "quality of t"
    assert api.job_results(engine.storage, "quality of t", datetime(2023, 12, 31), datetime(2024, 2, 1))["results_check_load"].count() == 6


def test_without_storage(spark):
    config = {"jobId": "j", "metrics": {"regular": {"rowCount": [{"id": "n", "source": "s"}]}, "trend": {"avg": [{"id": "t", "lookupMetric": "n", "rule": "record", "windowSize": 2}]}},
              "checks": {"trend": {"averageBoundFull": [{"id": "c", "metric": "n", "rule": "record", "windowSize": 1, "threshold": 1}]}}}
    rs = Engine(spark).run(config, sources={"s": spark.range(3)})
    assert rs.regular[0].result == 3 and math.isnan(rs.trend[0].result) and not rs.checks and len(rs.faults) == 1


@pytest.mark.parametrize("change,says", [
    ({"jobId": ""}, "no jobId"), ({"metrics": {"regular": {"rowCount": [{"id": "a", "source": "x"}]}}}, "no source"), ({"metrics": {"regular": {"nope": [{"id": "a", "source": "s", "columns": ["x"]}]}}}, "no kind"),
    ({"metrics": {"regular": {"rowCount": [{"id": "a", "source": "s"}, {"id": "a", "source": "s"}]}}}, "more than once"), ({"metrics": {"composed": [{"id": "a", "formula": "{{b}}"}, {"id": "b", "formula": "{{a}}"}]}}, "each other"),
    ({"metrics": {"composed": [{"id": "a", "formula": "1 +"}]}}, "metric a"), ({"metrics": {"composed": [{"id": "a", "formula": "{{x}}"}]}}, "no metric"),
    ({"checks": {"snapshot": {"equalTo": [{"id": "a", "metric": "m", "threshold": 1}]}}}, "no metric"), ({"checks": {"snapshot": {"differByLT": [{"id": "a", "metric": "m", "threshold": 1}]}}}, "both needed"),
    ({"virtualSources": [{"id": "v", "kind": "filter", "parentSources": ["w"], "expr": ["true"]}, {"id": "w", "kind": "filter", "parentSources": ["v"], "expr": ["true"]}]}, "each other"),
    ({"schemas": [{"id": "r", "kind": "registry"}]}, "schemaSubject"), ({"sources": {"file": [{"id": "f", "kind": "fixed", "path": "p"}]}}, "needs a schema"),
    ({"sources": {"hive": [{"id": "f", "schema": "a", "table": "b", "partitions": [{"name": "p", "expr": "p > other"}]}]}}, "other columns"), ({"sources": {"table": [{"id": "f", "connection": "c", "table": "t"}]}}, "no connection"),
    ({"metrics": {"trend": {"avg": [{"id": "t", "lookupMetric": "z", "rule": "datetime", "windowSize": "3"}]}}}, "windowSize"), ({"streams": {"kafka": []}, "virtualStreams": [{"id": "v", "kind": "sql", "parentSources": ["s"], "query": ""}]}, "can't be streamed"),
    ({"targets": {"results": {"file": {"resultTypes": ["odd"]}}}}, "no result type"), ({"targets": {"summary": {"kafka": {"connection": "x", "topic": "t"}}}}, "no Kafka"), ({"loadChecks": {"schemaMatch": [{"id": "a", "source": "s", "schema": "q"}]}}, "no schema"),
    ({"checks": {"expression": [{"id": "a", "formula": "1 + 1"}]}}, "check a"), ({"metrics": {"trend": {"arima": [{"id": "t", "lookupMetric": "z", "rule": "record", "windowSize": 9, "order": [0, 1, 0]}]}}}, "order")])
def test_faults(change, says):
    with pytest.raises(InvalidJob, match=says):
        parse({"jobId": "j", **change}, ("s",))


def test_hocon(tmp_path, monkeypatch):
    monkeypatch.setenv("SOME_HOME", "/home/x")
    (tmp_path / "inc.conf").write_text("inc { a: 1 }")
    got = hocon.loads('''
      # comment
      a = 1, b: [1, 2,
        3] // more
      c { d.e: text with spaces , f: """raw \\d "q" """ }
      c.g = ${a}
      path = ${SOME_HOME}"/data/"${v}
      opt = ${?nothing}
      arr = ${b} [4]
      arr += 5
      url = "http://x:80/y"
      quoted."a.b" = true
      n: null, neg: -1.5e3
      include "inc.conf"
      inc { b: 2 }
    ''', {"v": "7"}, tmp_path)
    assert got["a"] == 1 and got["b"] == [1, 2, 3] and got["c"] == {"d": {"e": "text with spaces"}, "f": 'raw \\d "q" ', "g": 1} and got["path"] == "/home/x/data/7" and "opt" not in got
    assert got["url"] == "http://x:80/y" and got["quoted"] == {"a.b": True} and got["n"] is None and got["neg"] == -1500 and got["inc"] == {"a": 1, "b": 2}
    for bad in ("a: ", "{ a: 1", "a: [1", "a: ${nope}", 'a: "x', "a: ${a}"):
        with pytest.raises(hocon.HoconError):
            hocon.loads(bad)


def test_window(spark):
    days = [datetime(2024, 1, d) for d in (1, 2, 3, 5, 8)]
    rows = spark.createDataFrame([("j", "m", d, float(i)) for i, d in enumerate(days)], "job_id string, metric_id string, reference_date timestamp, result double")
    got = lambda *a: sorted(r.result for r in ST.window(rows, *a).collect())
    assert got("record", days[4], 2) == [2, 3] and got("record", days[4], 2, 1) == [1, 2] and got("record", days[0], 3) == []
    assert got("datetime", days[4], "5d") == [2, 3] and got("datetime", days[4], "3d", "4d") == [0, 1, 2] and got("datetime", days[4], "7d") == [0, 1, 2, 3]
    assert ST.duration("90 minutes") == timedelta(minutes=90) and ST.duration("2w") == timedelta(weeks=2)
    with pytest.raises(ValueError):
        ST.duration("soon")


def test_hive_storage(spark):
    spark.sql("DROP DATABASE IF EXISTS dq_store CASCADE")
    s = ST.open_storage(spark, {"dbType": "hive", "url": "dq_store"})
    row = {"job_id": "j", "config": "{}", "version_info": "1", "reference_date": datetime(2024, 1, 1), "execution_date": datetime(2024, 1, 1)}
    s.append("job_state", [row])
    s.append("job_state", [{**row, "version_info": "2"}, {**row, "job_id": "k"}])
    assert sorted((r.job_id, r.version_info) for r in s.load("job_state").collect()) == [("j", "2"), ("k", "1")]
    spark.sql("DROP DATABASE dq_store CASCADE")


def test_secrets():
    hidden = secrets.encrypt("pässword", "key")
    assert secrets.decrypt(hidden, "key") == "pässword" and hidden != secrets.encrypt("pässword", "key")
    with pytest.raises(ValueError):
        secrets.decrypt(hidden, "other")
    got = secrets.masked({"a": [{"Password": "x", "b": 1}], "secretKey": "y"}, key="k")
    assert secrets.decrypt(got["a"][0]["Password"], "k") == "x" and got["a"][0]["b"] == 1 and secrets.masked({"password": "x"}) == {"password": "*****"}


def test_kafka_messages(spark):
    rows = spark.createDataFrame([("j", "r", "e", "check", '{"a":1}'), ("j", "r", "e", "check", '{"a":2}')], TG.UNIFIED)
    got = [json.loads(r.value) for r in TG.kafka_messages(rows).collect()]
    assert got[0]["data"] == {"a": 1} and got[0]["entityType"] == "check"
    one = TG.kafka_messages(rows, aggregate=True).collect()
    assert len(one) == 1 and len(json.loads(one[0].value)) == 2 and one[0].key.startswith("check@j@r@e@")


def test_api(spark):
    ok, faults = api.validate_job("jobConfig { jobId: x }")
    assert ok and not faults
    assert not api.validate_job("jobConfig { jobId: x, metrics { composed: [{id: a, formula: \"{{z}}\"}] } }")[0] and not api.validate_job("{")[0]
    assert api.validate_application('appConfig { storage { dbType: file, url: "x" } }')[0] and not api.validate_application("appConfig { storage { dbType: file } }")[0]
    table, columns = api.parse_ddl("CREATE TABLE IF NOT EXISTS db.`t` (id BIGINT NOT NULL, price DECIMAL(10, 2) COMMENT 'a, b', name varchar(20) NOT NULL, PRIMARY KEY (id)) PARTITIONED BY (d string);")
    assert table == "db.t" and columns == [("id", "bigint", True), ("price", "decimal(10, 2)", False), ("name", "varchar(20)", True)]
    job = api.suggest_job("create table db.t (id bigint, name string not null, note string)")
    assert parse(job).id == "t_quality"
    df = spark.createDataFrame([(1, "a"), (1, None)], "id int, note string")
    rs = Engine(spark).run(api.suggest_for(df, "t"), sources={"t": df})
    assert {c.check_id: c.status for c in rs.checks} == {"t_has_rows": "Success", "t_id_unique": "Failure"}


def test_server(spark, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    from plumbline.server import serve

    engine = Engine(spark, {"storage": {"dbType": "file", "url": str(tmp_path / "s")}})
    engine.run({"jobId": "a b", "metrics": {"regular": {"rowCount": [{"id": "n", "source": "t"}]}}}, sources={"t": spark.range(4)}, reference=datetime(2024, 1, 1))
    server = serve(engine.storage, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}/api/{path}", body and body.encode()), timeout=60) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert call("validation/job-config", "jobConfig {jobId: x}")[0] == 200 and call("validation/job-config", "jobConfig {}")[0] == 406
        assert call("validation/app-config", "appConfig {odd: 1}")[0] == 406
        assert call("config/heuristics", "create table t (id int)")[1]["jobConfig"]["jobId"] == "t_quality" and call("config/heuristics", "drop table t")[0] == 400
        days = "?start-dt=2023-12-31&end-dt=2024-01-02"
        assert call(f"storage/jobs{days}")[1][0]["job_id"] == "a b" and call("storage/jobs/a%20b/state")[1][0]["job_id"] == "a b"
        assert call(f"storage/jobs/a%20b/results{days}")[1]["results_metric_regular"][0]["result"] == 4 and call("nope")[0] == 404
    finally:
        server.shutdown()


def test_aggregates(spark):
    from plumbline.functions import aggregates as A

    df = spark.createDataFrame([(1.0, 2.0, [1, 2]), (2.0, 1.0, [3]), (4.0, None, None), (None, 3.0, [4, 5, 6])], "x double, y double, a array<int>")
    got = df.agg(A.comoment(F.col("x"), F.col("y")).alias("c"), A.collect_list_limit(F.col("x"), 2).alias("l"), A.collect_list_limit(F.col("x"), 0).alias("all"), A.merge_list_limit(F.col("a"), 4).alias("m"),
                 A.merge_list_limit(F.col("a"), 0).alias("ma"), A.approx_distinct(F.col("x"), 1e-9).alias("d"), A.approx_percentile(F.col("x"), 0.5).alias("q"), A.approx_percentile(F.col("x"), 2.0, direct=True).alias("s")).first()
    assert got.c == -0.5 and len(got.l) == 2 and sorted(got["all"]) == [1, 2, 4] and len(got.m) == 4 and sorted(got.ma) == [1, 2, 3, 4, 5, 6] and got.d == 3 and got.q == 2 and got.s == pytest.approx(2 / 3)
    top = spark.createDataFrame([("a",), ("a",), ("b",)], "v string").agg(A.top_n(F.col("v"), 1).alias("t")).first().t
    assert [(t["item"], t["count"]) for t in top] == [("a", 2)]
