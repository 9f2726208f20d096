"""Cases of the run history, with the values that they must give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history, operations, report
from tidemark.sources import schemas

T0 = datetime(2026, 8, 1, 12)


def runs(spark, rows):
    """rows: (id, site, scope, status, started_at, millis)"""
    full = [(i, s, c, st, False, at, None if st == "running" else at + timedelta(milliseconds=ms), ms, "", "", at, at) for i, s, c, st, at, ms in rows]
    return spark.createDataFrame(full, schemas.RUNS)


def packages(spark, rows):
    """rows: (run_id, kind, name, destination, size, status)"""
    return spark.createDataFrame([(str(k), r, kind, n, d, f"k{k}", size, "", st, "", T0) for k, (r, kind, n, d, size, st) in enumerate(rows)], schemas.PACKAGES)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("failed", -6), ("running", -4), ("cancelled", -2), ("failed", 0)], 4),
        ([("failed", -6), ("success", -4), ("cancelled", -2), ("failed", 0)], 2),
        ([("failed", -6), ("no_change", -4), ("cancelled", -2), ("failed", 0)], 2),
        ([("failed", -25), ("failed", 0)], 1),
        ([("failed", -30), ("failed", 0)], 1),
        ([("failed", -24), ("success", 0)], 2),
    ],
)
def test_streak(spark, rows, want):
    df = runs(spark, [(str(k), "a", "full", st, T0 + timedelta(hours=h), 0) for k, (st, h) in enumerate(rows)])
    assert [r.streak for r in history.failure_streak(df).collect()] == [want]


def test_streak_of_full_runs_only(spark):
    rows = [("1", "a", "full", "failed", T0, 0), ("2", "a", "database_only", "success", T0 + timedelta(hours=1), 0), ("3", "a", "full", "failed", T0 + timedelta(hours=2), 0), ("4", "a", "database_only", "failed", T0 + timedelta(hours=3), 0)]
    assert [r.streak for r in history.failure_streak(runs(spark, rows)).collect()] == [2]


def test_streak_of_nothing(spark):
    assert history.failure_streak(runs(spark, [])).count() == 0


def test_last_good(spark):
    df = runs(spark, [("a", "web", "full", "success", T0.replace(hour=10), 0), ("b", "web", "full", "no_change", T0.replace(hour=11), 0), ("c", "web", "full", "failed", T0.replace(hour=12), 0), ("d", "web", "database_only", "success", T0.replace(hour=13), 0)])
    pick = lambda *before: [r.id for r in history.last_good(df, *before).collect()]
    assert pick() == ["b"]
    assert pick(T0.replace(hour=11)) == ["a"]
    assert pick(T0.replace(hour=10)) == []
    seen = {r.id: r.last_good and r.last_good.id for r in history.with_last_good(df).collect()}
    assert seen == {"a": None, "b": "a", "c": "b", "d": "b"}


def test_last_good_of_runs_that_started_together(spark):
    """The smallest id counts, within a month and carried over its end, as it does for last_good."""
    at = [T0, T0, T0 + timedelta(hours=1), T0 + timedelta(days=40)]
    df = runs(spark, [(i, "web", "full", "success" if k < 2 else "failed", t, 0) for k, (i, t) in enumerate(zip(("20", "1000", "c", "d"), at, strict=True))])
    seen = {r.id: r.last_good and r.last_good.id for r in history.with_last_good(df).collect()}
    assert seen == {"20": None, "1000": None, "c": "1000", "d": "1000"}
    assert [r.id for r in history.last_good(df).collect()] == ["1000"]


def test_lifecycle(spark):
    start = datetime(2026, 7, 23, 3)
    df = runs(spark, [("r", "web", "full", "running", start, 0)])
    ends = spark.createDataFrame([("r", "success", start + timedelta(seconds=2), "", "")], "id string, status string, finished_at timestamp, error_category string, error_message string")
    (row,) = history.finish_runs(df, ends).collect()
    assert (row.status, row.duration_millis) == ("success", 2000)


def test_delivery_once(spark):
    new = spark.createDataFrame([("daily", "2026-08-01")] * 2 + [("daily", "2026-08-02")], "report_type string, period string")
    done = spark.createDataFrame([("daily", "2026-08-02")], new.schema)
    assert [tuple(r) for r in history.deliver_once(done, new).collect()] == [("daily", "2026-08-01")]


@pytest.fixture
def month(spark):
    utc = lambda d, h: datetime(2026, 8, d, h) - timedelta(hours=8)
    r = runs(spark, [("run-1", "site-a", "full", "success", utc(1, 1), 90_000), ("run-2", "site-a", "full", "skipped", utc(3, 2), 10_000), ("run-3", "site-b", "full", "no_change", utc(3, 3), 20_000)])
    p = packages(spark, [("run-1", "files", "files", "local", 100, "stored"), ("run-1", "files", "files", "s3", 100, "stored"), ("run-1", "database", "mysql", "s3", 50, "failed"), ("run-3", "files", "files", "local", 25, "stored")])
    return r, p


def test_monthly_report(month):
    r, p = month
    out = report.monthly(r, p, ["destination"], "2026-08-01", "Asia/Makassar")
    days = {str(x.day): x for x in out.where("level = 'day'").collect()}
    assert len(days) == 31
    assert (days["2026-08-01"].total_runs, days["2026-08-01"].duration_seconds, days["2026-08-01"].total_bytes) == (1, 90, 100)
    assert (days["2026-08-02"].total_runs, days["2026-08-02"].average_seconds) == (0, 0)
    (m,) = out.where("level = 'month'").collect()
    assert (m.total_runs, m.successful, m.skipped, m.no_change, m.duration_seconds, m.average_seconds, m.total_bytes) == (3, 1, 1, 1, 120, 40, 125)
    sites = {x.site_name: x for x in out.where("level = 'site'").collect()}
    assert (sites["site-a"].total_runs, sites["site-a"].skipped, sites["site-a"].total_bytes) == (2, 1, 100)
    assert {x.level for x in report.monthly(r, p, ["destination"], "2026-08-01", "Asia/Makassar", include_empty=False).collect()} == {"day", "month", "site", "day_site"}


def test_destinations_and_merge(month):
    r, p = month
    got = {x.name: (x.total_packages, x.stored, x.failed, x.total_bytes) for x in report.by_destination(r, p).collect()}
    assert got == {"local": (2, 2, 0, 125), "s3": (2, 1, 1, 100)}
    one = report.by_destination(r, p)
    assert {x.name: x.total_bytes for x in report.merge_destinations(one, one).collect()} == {"local": 250, "s3": 200}


def test_partial_counts_as_partial_only(spark):
    (x,) = report.period(runs(spark, [("a", "s", "full", "partial", T0, 0)]), packages(spark, []), ["destination"]).collect()
    assert (x.total_runs, x.partial, x.successful, x.failed, x.total_bytes) == (1, 1, 0, 0, 0)


def test_site_summary(spark):
    sites = spark.createDataFrame([("web", True, "full", ["s3"], 7), ("db", False, "full", ["home"], 3)], schemas.SITES)
    at = lambda h: T0 + timedelta(hours=h)
    r = runs(spark, [("1", "web", "full", "success", at(0), 1000), ("2", "web", "full", "running", at(1), 0), ("3", "db", "full", "success", at(0), 0), ("4", "gone", "full", "success", at(0), 0)])
    p = packages(spark, [("1", "files", "f", "s3", 100, "stored"), ("1", "files", "f", "home", 40, "stored"), ("1", "database", "d", "s3", 10, "stored")])
    got = {x.name: x for x in history.site_summary(sites, r, p).collect()}
    assert set(got) == {"web", "db"}
    assert (got["web"].state, got["db"].state) == ("running", "disabled")
    assert (got["web"].successes, got["web"].total_bytes, got["web"].last_duration_millis) == (1, 110, None)
    idle = {x.name: x for x in history.site_summary(sites, r.where("status <> 'running'"), p).collect()}
    assert (idle["web"].state, idle["web"].last_bytes, idle["web"].last_status) == ("idle", 110, "success")


def test_unchanged_and_gate(spark):
    r = runs(spark, [("1", "w", "full", "success", T0, 0), ("2", "w", "full", "success", T0 + timedelta(hours=3), 0), ("3", "w", "full", "success", T0 + timedelta(hours=27), 0)])
    p = packages(spark, [("1", "files", "f", "a", 5, "stored"), ("2", "files", "f", "a", 5, "stored"), ("3", "files", "f", "a", 6, "stored")])
    assert {x.run_id: x.unchanged for x in history.unchanged(r, p).collect()} == {"2": True, "3": False}
    assert {x.id: x.skipped for x in history.interval_gate(r).collect()} == {"1": False, "2": True, "3": False}


def test_unchanged_since_one_of_two_that_started_together(spark):
    r = runs(spark, [("20", "w", "full", "success", T0, 0), ("1000", "w", "full", "success", T0, 0), ("3", "w", "full", "success", T0 + timedelta(hours=3), 0)])
    p = packages(spark, [("20", "files", "f", "a", 6, "stored"), ("1000", "files", "f", "a", 5, "stored"), ("3", "files", "f", "a", 5, "stored")])
    assert [(x.run_id, x.old_id, x.unchanged) for x in history.unchanged(r, p).collect()] == [("3", "1000", True)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_unchanged_in_an_hour_that_the_zone_of_the_session_skips(spark, zone):
    """Times without a zone are compared as they stand, and runs of no site are of no common one."""
    at = datetime(2026, 3, 8, 2, 45)
    rows = [(i, site, "full", "success", at + timedelta(minutes=m)) for i, site, m in (("a", "w", 0), ("b", "w", 25), ("c", "w", 45), ("x", None, 0), ("y", None, 5))]
    p = packages(spark, [(i, "files", "f", "d", 5, "stored") for i in "abcxy"])
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        r = spark.createDataFrame(rows, "id string, site_name string, scope string, status string, started_at timestamp_ntz")
        assert sorted((x.run_id, x.old_id, x.unchanged) for x in history.unchanged(r, p).collect()) == [("b", "a", True), ("c", "b", True)]
        assert [x.id for x in history.last_good(r.where("site_name = 'w' AND id < 'c'")).collect()] == ["b"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_activity(spark):
    r = runs(spark, [("1", "a", "full", "running", T0, 0), ("2", "a", "full", "running", T0 + timedelta(hours=2), 0), ("3", "b", "full", "running", T0, 0), ("4", "c", "full", "running", T0, 0)])
    locks = spark.createDataFrame([("a", True, 7, T0 + timedelta(hours=1)), ("b", False, 8, T0), ("d", True, 9, T0)], schemas.LOCKS)
    got = sorted((x.site_name, x.state, x.run_id or "") for x in history.activity(locks, r).collect())
    assert got == [("a", "running", "2"), ("a", "stale", "1"), ("b", "stale", "3"), ("b", "unknown", ""), ("c", "stale", "4"), ("d", "running", "")]


def test_tables_locks_and_codes(spark):
    tables = spark.createDataFrame([("t1", "MyISAM", 1), ("t2", "InnoDB", 2), ("t3", "Aria", 3), ("a.t4", "Aria", 4), ("t4", "InnoDB", 5)], "name string, engine string, position int")
    lines = spark.createDataFrame([("db.t1\tcheck\tstatus\tOK",), ("db.t2\tcheck\twarning\tslow",), ("db.t2\tcheck\terror\tCorrupt",), ("db.a.t4\tcheck\tStatus\t ok ",), ("db.t9\tcheck\tstatus\tOK",), ("broken line",)], "line string")
    health = operations.table_health(tables, operations.parse_checks(lines))
    assert sorted((x.name, x.engine, x.healthy) for x in health.collect()) == [("a.t4", "Aria", True), ("db.t9", "", True), ("t1", "MyISAM", True), ("t2", "InnoDB", False), ("t2", "InnoDB", False)]
    assert [(x.name, x.repair) for x in operations.repair_gate(health).collect()] == [("t2", False)] * 2
    locks = spark.createDataFrame([("a", True, T0, True), ("b", False, T0, True), ("c", True, T0 + timedelta(hours=5), True), ("d", False, T0, False)], "id string, exclusive boolean, at timestamp, readable boolean")
    got = {x.id: x.meaning for x in operations.lock_conflicts(locks, True, "2026-08-01 13:00:00").collect()}
    assert got == {"a": "stale_exclusive", "b": "remove", "c": "conflict", "d": "invalid"}
    assert {x.id for x in operations.stale_locks(locks, "2026-08-01 13:00:00").collect()} == {"a", "b", "d"}
    codes = spark.createDataFrame([("",), ("config",), ("weird",), (None,), ("preflight",), ("execution",), ("storage",), ("cancellation",), ("persistence",), ("lock",)], "c string").select(operations.exit_code(F.col("c")).alias("x"))
    assert [x.x for x in codes.collect()] == [0, 2, 1, 0, 3, 4, 4, 4, 1, 1]
