from datetime import datetime, timedelta

import pytest

from tidemark.streaming import incidents

T0 = datetime(2026, 1, 1)
COLUMNS = "ts timestamp, seq long, server_id string, site string, scope string, channel string, channel_type string, event string, error_category string, error_message string, works boolean"


def events(spark, rows):
    """rows: (hours, event, category, scope, works)"""
    return spark.createDataFrame([(T0 + timedelta(hours=h), k, "s", "w", scope, "ch", "smtp", e, c, "", ok) for k, (h, e, c, scope, ok) in enumerate(rows)], COLUMNS)


CASES = [
    (0, "backup_skipped", "", "full", True), (1, "backup_failed", "a", "full", True), (2, "backup_failed", "a", "full", True), (25, "backup_failed", "a", "full", True), (26, "backup_failed", "b", "full", True),
    (27, "backup_succeeded", "", "database_only", True), (28, "backup_succeeded", "", "full", True), (29, "backup_succeeded", "", "full", True), (30, "backup_failed", "a", "full", False), (31, "backup_failed", "a", "full", True),
    (32, "backup_succeeded", "", "full", False), (33, "backup_succeeded", "", "full", True), (34, "backup_succeeded", "", "full", True),
]


@pytest.mark.parametrize(("n", "attempts"), list(enumerate([0, 1, 1, 2, 3, 3, 4, 4, 5, 6, 7, 8, 8], 1)))
def test_attempts(n, attempts):
    import pandas as pd

    states, sent = {}, 0
    for h, e, c, scope, ok in CASES[:n]:
        event = {"key": scope, "ts": pd.Timestamp(T0) + pd.Timedelta(hours=h), "channel": "ch", "channel_type": "smtp", "event": e, "fingerprint": c, "works": ok}
        states[scope], attempt = incidents.step(states.get(scope, ("", None)), event)
        sent += attempt is not None
    assert sent == attempts


def test_batch(spark):
    assert incidents.deliveries(events(spark, CASES)).count() == 8


def test_webhooks_get_everything(spark):
    six = ["backup_succeeded", "backup_skipped", "backup_failed", "backup_failed", "backup_succeeded", "backup_succeeded"]
    rows = [(T0 + timedelta(hours=k), k, "s", "w", "full", ch, kind, e, "a", "", True) for k, e in enumerate(six) for ch, kind in (("hook", "webhook"), ("mail", "smtp"))]
    got = incidents.deliveries(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sum(r.channel == "hook" for r in got) == 6 and not any(r.recovery for r in got if r.channel == "hook")
    assert [r.recovery for r in sorted((r for r in got if r.channel == "mail"), key=lambda r: r.ts)] == [False, True]


def test_stream_equals_batch(spark, tmp_path):
    df = events(spark, CASES)
    df.where("seq < 6").write.parquet(str(tmp_path / "in"))
    df.where("seq >= 6").write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = incidents.stream_deliveries(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, incidents.deliveries(df).collect()))


def test_daily_counts_over_a_stream(spark, tmp_path):
    rows = [(T0 + timedelta(hours=h), "success") for h in (1, 2, 25, 26, 80)]
    spark.createDataFrame(rows, "started_at timestamp, status string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("started_at timestamp, status string").parquet(str(tmp_path / "in"))
    q = incidents.daily_counts(stream).writeStream.format("memory").queryName("daily_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.day.day, r.runs) for r in spark.table("daily_counts").collect()) == [(1, 2), (2, 2), (4, 1)]
