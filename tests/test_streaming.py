import json
from datetime import datetime, timedelta

import pytest

from plumbline.operators.metrics import Metric
from plumbline.plans.job import Engine
from plumbline.streaming import windows as W

START = datetime(2024, 1, 1)
SCHEMA = "ts timestamp, user string, value double"


def _write(path, name, rows):
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{name}.json").write_text("\n".join(json.dumps({"ts": (START + timedelta(seconds=s)).isoformat(), "user": u, "value": v}) for s, u, v in rows))


CONFIG = {"jobId": "s", "metrics": {"regular": {"rowCount": [{"id": "n", "source": "a"}], "sumNumber": [{"id": "sum", "source": "a", "columns": ["value"]}], "distinctValues": [{"id": "users", "source": "b", "columns": ["user"]}]},
                                    "composed": [{"id": "mean", "formula": "{{ sum }} / {{ n }}"}]},
          "checks": {"snapshot": {"greaterThan": [{"id": "some", "metric": "n", "threshold": 1}]}}}


def test_two_streams(spark, tmp_path):
    """Windows close on the least watermark of both streams; each runs composed metrics, checks and storage."""
    _write(tmp_path / "a", "0", [(1, "u", 1.0), (100, "v", 3.0), (700, "u", 5.0)])
    _write(tmp_path / "b", "0", [(5, "u", 1.0), (6, "u", 1.0), (7, "w", 1.0)])
    later = [(3000, "u", 1.0)]
    seen = []
    engine = Engine(spark, {"storage": {"dbType": "file", "url": str(tmp_path / "store")}})
    job = W.StreamJob.build(engine, CONFIG, W.StreamSettings(trigger="0 seconds", checkpoint=str(tmp_path / "ck")), given=("a", "b"), on_window=seen.append)

    frames = {i: W.windowed(spark.readStream.schema(SCHEMA).json(str(tmp_path / i)), "ts", job.settings) for i in "ab"}
    q = job.start(frames)
    q.processAllAvailable()
    _write(tmp_path / "a", "1", later)
    q.processAllAvailable()
    assert not seen  # the other stream holds its windows open
    _write(tmp_path / "b", "1", later)
    q.processAllAvailable()
    q.stop()
    got = {(rs.reference, r.metric_id): r.result for rs in seen for r in [*rs.regular, *rs.composed]}
    assert got[START, "n"] == 2 and got[START, "sum"] == 4 and got[START, "mean"] == 2 and got[START, "users"] == 2 and got[START + timedelta(minutes=10), "n"] == 1
    assert {rs.reference: [c.status for c in rs.checks] for rs in seen} == {START: ["Success"], START + timedelta(minutes=10): ["Failure"]}
    assert engine.storage.load("results_metric_regular").count() == 5


def test_replay_and_sessions(spark):
    df = spark.createDataFrame([(START + timedelta(seconds=s), u, v) for s, u, v in [(0, "a", 1.0), (599, "a", 2.0), (600, "b", 4.0), (10000, "a", 1.0)]], SCHEMA)
    ev = W.windowed(df, {"custom": "ts"})
    got = {(r.window_start, r.metric_id): r.result for r in W.all_windows({"x": ev}, [Metric("n", "rowCount", "x"), Metric("m", "maxNumber", "x", ["value"])]).collect()}
    assert got[START, "n"] == 2 and got[START, "m"] == 2 and got[START + timedelta(minutes=10), "m"] == 4
    assert W.session_metrics(ev, [Metric("n", "rowCount", "x")], "15 minutes", ["user"]).count() == 3
    assert W.window_metrics(ev, [Metric("n", "rowCount", "x")], slide="5 minutes").count() > 3
    with pytest.raises(ValueError):
        W.window_metrics(ev, [Metric("t", "topN", "x", ["user"])])
    with pytest.raises(ValueError):
        W.window_metrics(ev, [Metric("t", "distinctValues", "x", ["user", "value"])])


def test_derived_stream(spark, tmp_path):
    _write(tmp_path / "a", "0", [(1, "u", 1.0), (2, "v", 2.0), (3000, "u", 9.0)])
    config = {"jobId": "d", "streams": {}, "virtualStreams": [{"id": "f", "kind": "filter", "parentSources": ["a"], "expr": ["value > 1"]}, {"id": "p", "kind": "select", "parentSources": ["f"], "expr": ["value * 2 as twice"]}],
              "metrics": {"regular": {"sumNumber": [{"id": "s", "source": "p", "columns": ["twice"]}]}}}
    job = W.StreamJob.build(Engine(spark), config, given=("a",))
    frames = {"a": W.windowed(spark.readStream.schema(SCHEMA).json(str(tmp_path / "a")), "ts")}
    job.start(frames, available_now=True).awaitTermination(120)
    assert [(rs.reference, rs.regular[0].result) for rs in job.results] == [(START, 4.0)]


@pytest.mark.parametrize("strict,n", [(False, 2), (True, 1)])
def test_late_rows(spark, tmp_path, strict, n):
    """A late row of an open window counts by default and is dropped in strict mode."""
    _write(tmp_path / "a", "0", [(60, "u", 1.0), (720, "u", 1.0)])
    config = {"jobId": f"late{strict}", "metrics": {"regular": {"rowCount": [{"id": "n", "source": "a"}]}}}
    job = W.StreamJob.build(Engine(spark), config, W.StreamSettings(trigger="0 seconds", strict=strict), given=("a",))
    q = job.start({"a": W.windowed(spark.readStream.schema(SCHEMA).json(str(tmp_path / "a")), "ts", job.settings)})
    q.processAllAvailable()
    _write(tmp_path / "a", "1", [(360, "u", 1.0)])
    q.processAllAvailable()
    _write(tmp_path / "a", "2", [(9000, "u", 1.0)])
    q.processAllAvailable()
    q.stop()
    assert {rs.reference: rs.regular[0].result for rs in job.results}[START] == n
