"""Rows exactly a gap apart belong to two sessions."""

from datetime import datetime, timedelta

import duckdb

from plumbline.operators.metrics import Metric
from plumbline.queries import ORACLE, QUERIES
from plumbline.streaming import windows as W

AT = datetime(2024, 1, 1)


def test_rows_a_gap_apart(spark, tmp_path):
    rows = [(1, 0.7), (1, 1800.1), (1, 3599.0), (2, 0.0), (2, 1799.0), (3, 5.0)]
    events = spark.createDataFrame([(u, AT + timedelta(seconds=s)) for u, s in rows], "user_id bigint, ts timestamp")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, QUERIES["stream_sessions"](spark, str(tmp_path)).collect()))
    assert got == sorted(duckdb.execute(ORACLE["stream_sessions"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall())
    assert [r[2] for r in got] == [1.0, 2.0, 2.0, 1.0]
    ends = W.session_metrics(W.windowed(events, "ts"), [Metric("n", "rowCount", "x")], "30 minutes", ["user_id"]).where("user_id = 3").first()
    assert (ends.session_start, ends.session_end) == (AT + timedelta(seconds=5), AT + timedelta(seconds=1805))
