"""Database storage, templates, encrypted rows, bounded lists, sketches of high accuracy, failing rows and grouping metrics of streams."""

import json
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.functions import aggregates as A
from plumbline.operators.metrics import Metric
from plumbline.plans import fuse, secrets
from plumbline.plans.job import Engine
from plumbline.sources import connections as CN
from plumbline.sources.readers import Context, read
from plumbline.sources.storage import JdbcStorage, FileStorage
from plumbline.sources.targets import render, template_of
from plumbline.streaming import windows as W

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
START = datetime(2024, 1, 1)


def _row(day, value, job="j"):
    return {"job_id": job, "metric_id": "n", "metric_name": "ROW_COUNT", "result": value, "reference_date": START + timedelta(days=day), "execution_date": START}


def test_database_storage(spark, tmp_path):
    spec = {"id": "d", "kind": "jdbc", "url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": DERBY}
    CN.validate(spark, spec) if False else None
    store = JdbcStorage(spark, spec)
    assert store.load("results_metric_regular") is None
    store.append("results_metric_regular", [_row(d, float(d)) for d in range(5)] + [_row(0, 9.0, "other")])
    store.append("results_metric_regular", [_row(4, 40.0), _row(5, 5.0)])
    got = {(r.job_id, r.reference_date): r.result for r in store.load("results_metric_regular").collect()}
    assert len(got) == 7 and got["j", START + timedelta(days=4)] == 40.0 and got["other", START] == 9.0
    assert [v for _, v, *_ in store.history("j", ["n"], "regular", "record", START + timedelta(days=5), 2)] == [40.0, 3.0]
    # The same database as a source.
    ctx = Context({"d": {**spec, "id": "d"}})
    one = read(spark, "table", {"id": "t", "connection": "d", "query": "SELECT COUNT(*) AS N FROM results_metric_regular"}, ctx)
    assert one.df.first()[0] == 7
    assert read(spark, "table", {"id": "t", "connection": "d", "table": "results_metric_regular"}, ctx).df.count() == 7


def test_files_put_aside_come_back(spark, tmp_path):
    store = FileStorage(spark, str(tmp_path))
    store.append("results_metric_regular", [_row(0, 1.0)])
    (tmp_path / ".results_metric_regular-aside").mkdir()
    (tmp_path / "results_metric_regular" / "job_id=j").rename(tmp_path / ".results_metric_regular-aside" / "job_id=j")  # a writer died here
    assert store.load("results_metric_regular").count() == 1 and not (tmp_path / ".results_metric_regular-aside").exists()


def test_templates(spark, tmp_path):
    values = {"jobId": "j", "n": 3, "listFailedChecks": ["a", "b"], "none": []}
    assert render("{{ jobId }}: {{n}} {{listFailedChecks}}{{unknown}}", values) == "j: 3 a, b"
    assert render("{{#listFailedChecks}}<{{.}}>{{/listFailedChecks}}{{#none}}x{{/none}}{{#n}}y{{/n}}", values) == "<a><b>y"
    (tmp_path / "t.txt").write_text("Job\n{{ jobId }}")
    assert template_of(spark, {"templateFile": str(tmp_path / "t.txt")}) == "Job\n{{ jobId }}" and template_of(spark, {}) is None


def test_messages_use_templates(spark, monkeypatch):
    from plumbline.sources import targets as TG

    sent = []
    monkeypatch.setattr(TG, "send_email", lambda config, to, subject, body, attachments=None: sent.append((to, subject, body)))
    monkeypatch.setattr(TG, "send_mattermost", lambda config, to, body: sent.append((to, body)))
    run = TG.Targets(spark, {"allowNotifications": True, "email": {}, "mattermost": {}}, {})
    summary = {"jobId": "j", "referenceDate": "d", "executionDate": "e", "listFailedChecks": ["c"]}
    wrong = run.run({"summary": {"email": {"recipients": ["x"], "subjectTemplate": "Of {{jobId}}", "template": "Failed: {{listFailedChecks}}"}, "mattermost": {"recipients": ["@y"], "template": "{{jobId}}!"}},
                     "checkAlerts": {"email": [{"id": "a", "recipients": ["z"], "template": "{{failedChecks}} failed"}]}}, {}, summary, {"c"})
    assert not wrong and sent == [(["x"], "Of j", "Failed: c"), (["@y"], "j!"), (["z"], "Failed checks of j", "c failed")]


def test_encrypted_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "k int, v string")
    config = {"jobId": "e", "metrics": {"regular": {"nullValues": [{"id": "n", "source": "t", "columns": ["v"]}], "completeness": [{"id": "c", "source": "t", "columns": ["v"]}]}}}
    plain = Engine(spark).run(config, sources={"t": df}).tables["results_metric_error"].collect()
    hidden = Engine(spark, {"encryption": {"secret": "s3cret", "encryptErrorData": True}}).run(config, sources={"t": df}).tables["results_metric_error"]
    assert {r.error_hash for r in plain} == {r.error_hash for r in hidden.collect()} and all("{" not in r.row_data for r in hidden.collect())
    assert {r[0] for r in hidden.select(secrets.decrypted(F.col("row_data"), "s3cret")).collect()} == {r.row_data for r in plain}


def test_bounded_lists(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", None), (None, 3), (None, 1)], "k string, v int")
    got = {r.k: r["values"] for r in A.collect_lists(df, ["k"], "v", 3).collect()}
    assert got == {"a": [0, 1, 2], "b": [], None: [1, 3]}
    arrays = df.groupBy("k").agg(F.collect_list("v").alias("v")).union(spark.createDataFrame([("a", [-1])], "k string, v array<int>"))
    assert {r.k: r["values"] for r in A.merge_lists(arrays, ["k"], "v", 3).collect()} == {"a": [-1, 0, 1], "b": [], None: [1, 3]}
    assert {r.k: len(r["values"]) for r in A.collect_lists(df, ["k"], "v", 0).collect()} == {"a": 50, "b": 0, None: 2}
    assert A.collect_lists(df.limit(0), ["k"], "v", 3).count() == 0 and A.collect_lists(df, [], "v", 2).first()[0] == [0, 1]


def test_sketches_of_high_accuracy(spark):
    df = spark.range(200_000)
    n = df.agg(A.approx_distinct(F.col("id"), 0.001)).first()[0]
    assert abs(n - 200_000) < 800 and df.limit(0).agg(A.approx_distinct(F.col("id"), 0.001)).first()[0] == 0


def test_first_rows_are_cut_in_tasks(spark):
    df = spark.range(30_000).select((F.col("id") % 2).alias("g"), F.col("id"))
    got = fuse.first_rows(df, ["g"], F.col("id"), 5000)
    assert {r[0]: (r[1], r[2]) for r in got.groupBy("g").agg(F.count("id"), F.max("id")).collect()} == {0: (5000, 9998), 1: (5000, 9999)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert fuse.first_rows(df.limit(0), ["g"], F.col("id"), 3).count() == 0


def test_top_n_scans_once(spark, tmp_path):
    spark.createDataFrame([(x,) for x in "aabbbc"], "v string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    got = fuse.top_n(df, Metric("t", "topN", "x", ["v"], {"targetNumber": 2}))
    assert [(r.metric_name, round(r.result, 3), r.additional_result) for r in got.collect()] == [("TOP_N_1", 0.5, "b"), ("TOP_N_2", 0.333, "a")]
    ran = got.collect() and got._jdf.queryExecution().executedPlan()
    final = str(ran.toString()).split("== Initial Plan ==")[0]
    assert final.count("FileScan") + final.count("Scan parquet") <= 2 and ("ReusedExchange" in final or final.count("Scan parquet") == 1)
    for mode in ("exact", "approx"):
        none = fuse.top_n(df.where("v = 'z'"), Metric("t", "topN", "x", ["v"], {"mode": mode})).collect()
        assert [(r.metric_name, r.additional_result) for r in none] == [("TOP_N_1", "")] and none[0].result != none[0].result


def _write(path, name, rows):
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{name}.json").write_text("\n".join(json.dumps({"ts": (START + timedelta(seconds=s)).isoformat(), "user": u, "value": v}) for s, u, v in rows))


@pytest.mark.parametrize("approximate", [False, True])
def test_streams_group_and_collect_errors(spark, tmp_path, approximate):
    rows = [(1, "u", 1.0), (2, "u", 3.0), (3, "v", None), (4, "w", 3.0), (5, "u", 5.0), (700, "x", None), (701, "x", 1.0)]
    _write(tmp_path / "a", "0", rows[:3])
    config = {"jobId": f"g{approximate}", "metrics": {"regular": {
        "distinctValues": [{"id": "users", "source": "a", "columns": ["user"]}], "sequenceCompleteness": [{"id": "seq", "source": "a", "columns": ["value"]}],
        "completeness": [{"id": "full", "source": "a", "columns": ["value"]}], **({} if approximate else {
            "duplicateValues": [{"id": "again", "source": "a", "columns": ["user", "value"]}], "topN": [{"id": "top", "source": "a", "columns": ["user"], "params": {"targetNumber": 2}}]})}}}
    engine = Engine(spark, {"storage": {"dbType": "file", "url": str(tmp_path / "store")}})
    job = W.StreamJob.build(engine, config, W.StreamSettings(trigger="0 seconds", approximate=approximate, checkpoint=str(tmp_path / "ck")), given=("a",))
    q = job.start({"a": W.windowed(spark.readStream.schema("ts timestamp, user string, value double").json(str(tmp_path / "a")), "ts", job.settings)})
    q.processAllAvailable()
    _write(tmp_path / "a", "1", rows[3:])
    q.processAllAvailable()
    _write(tmp_path / "a", "2", [(9000, "z", 1.0)])
    q.processAllAvailable()
    q.stop()
    got = {(rs.reference, r.metric_id, r.metric_name): (r.result, r.additional) for rs in job.results for r in rs.regular}
    assert {rs.reference for rs in job.results} == {START, START + timedelta(minutes=10)}
    by = {(d, i): v for (d, i, _), v in got.items() if i != "top"}
    assert by[START, "users"][0] == 3 and by[START, "seq"][0] == pytest.approx(0.6) and by[START, "full"][0] == pytest.approx(0.8)
    if not approximate:
        assert by[START, "again"][0] == 0 and by[START + timedelta(minutes=10), "again"][0] == 0
        top = {n: v for (d, i, n), v in got.items() if (d, i) == (START, "top")}
        assert top == {"TOP_N_1": (0.6, "u"), "TOP_N_2": (0.2, "v")}
    errors = {rs.reference: Counter(r.metric_id for r in rs.tables["results_metric_error"].collect()) for rs in job.results}
    assert errors[START]["full"] == 1 and errors[START + timedelta(minutes=10)]["full"] == 1
    stored = engine.storage.load("results_metric_error").where("metric_id = 'full'").collect()
    assert {r.reference_date for r in stored} == {START, START + timedelta(minutes=10)} and all('"value":""' in r.row_data for r in stored)
