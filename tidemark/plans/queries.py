"""Queries of the reference workloads over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import chunking, numbers, paths, sealing, text
from tidemark.operators import graph, history, integrity, inventory, operations, report, snapshots
from tidemark.sources import repository
from tidemark.sources.adapters import view, with_clause
from tidemark.streaming import incidents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The order in which copies of one source count as first.
FIRST = ["line", "part", "supp"]


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(views: str = "", sql: str | None = None):
    """Registers f(views) under its name; sql follows the WITH clause of the named views."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = (with_clause(*views.split()) if views else "") + sql
        return f

    return register


def ts(c: str):
    return F.date_format(F.col(c).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias(c)


STATUS_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {n}" for s, n in (("success", "successful"), *((x, x) for x in ("partial", "failed", "cancelled", "skipped", "no_change"))))
SECONDS = "CAST(coalesce(sum(duration_millis // 1000), 0) AS BIGINT) AS duration_seconds, CAST(CASE WHEN count(*) > 0 THEN sum(duration_millis // 1000) // count(*) ELSE 0 END AS BIGINT) AS average_seconds"
FIRST_COPIES = """first_copies AS (SELECT run_id, arg_min(size, (line, part, supp)) AS size FROM packages WHERE status = 'stored' GROUP BY run_id, source_kind, source_name),
sized AS (SELECT r.*, coalesce(b.bytes, 0) AS bytes FROM runs r LEFT JOIN (SELECT run_id, CAST(sum(size) AS BIGINT) AS bytes FROM first_copies GROUP BY run_id) b ON r.id = b.run_id)"""
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


# run history ---------------------------------------------------------------------------------------------------


@query("runs", f"SELECT id, site_name, status, {TS.format('started_at')} FROM runs ORDER BY runs.started_at DESC, id LIMIT 20")
def history_list(v):
    return history.list_runs(v.runs, limit=20).select("id", "site_name", "status", ts("started_at"))


@query("runs packages", "SELECT id, count(run_id) AS packages, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM runs LEFT JOIN packages ON id = run_id WHERE site_name = 'site-7' GROUP BY id")
def history_details(v):
    own = history.with_packages(v.runs.where("site_name = 'site-7'"), v.packages)
    return own.select("id", F.size("packages").cast("bigint").alias("packages"), F.aggregate("packages", F.lit(0).cast("bigint"), lambda a, p: a + p["size"]).alias("bytes"))


@query("runs", f"SELECT id, site_name, {TS.format('started_at')} FROM runs WHERE status = 'running'")
def running_runs(v):
    return history.list_running(v.runs).select("id", "site_name", ts("started_at"))


@query("runs", f"SELECT id, {TS.format('started_at')} FROM runs WHERE runs.started_at >= TIMESTAMP '1997-03-01' AND runs.started_at < TIMESTAMP '1997-03-15'")
def runs_in_range(v):
    return history.list_range(v.runs, F.lit("1997-03-01").cast("timestamp_ntz"), F.lit("1997-03-15").cast("timestamp_ntz")).select("id", ts("started_at"))


@query("packages", "SELECT run_id, source_kind, source_name, destination, size FROM packages WHERE status = 'stored'")
def stored_packages(v):
    return history.stored_packages(v.packages).select("run_id", "source_kind", "source_name", "destination", "size")


GOOD = "scope = 'full' AND status IN ('success', 'no_change')"


@query("runs", f"SELECT site_name, arg_max(id, started_at) AS id FROM runs WHERE {GOOD} AND started_at < TIMESTAMP '1999-01-01' GROUP BY site_name")
def last_good(v):
    return history.last_good(v.runs, F.lit("1999-01-01").cast("timestamp_ntz")).select("site_name", "id")


@query("runs", f"SELECT r.id, g.id AS good_id FROM runs r ASOF LEFT JOIN (SELECT * FROM runs WHERE {GOOD}) g ON r.site_name = g.site_name AND r.started_at > g.started_at")
def last_good_asof(v):
    return history.with_last_good(v.runs).select("id", F.col("last_good.id").alias("good_id"))


@query("event_runs", """
, near AS (SELECT e.*, max(started_at) OVER (PARTITION BY site_name) AS anchor FROM event_runs e WHERE scope = 'full'),
steps AS (SELECT *, lag(started_at) OVER w AS later FROM near WHERE started_at >= anchor - INTERVAL 24 HOUR WINDOW w AS (PARTITION BY site_name ORDER BY started_at DESC, id)),
ends AS (SELECT *, CASE WHEN later IS NOT NULL AND (status IN ('success', 'no_change') OR later - started_at > INTERVAL 24 HOUR) THEN 1 ELSE 0 END AS e FROM steps),
ended AS (SELECT *, sum(e) OVER (PARTITION BY site_name ORDER BY started_at DESC, id ROWS UNBOUNDED PRECEDING) AS n FROM ends)
SELECT site_name, count(*) FILTER (n = 0) AS streak FROM ended GROUP BY site_name""")
def failure_streak(v):
    return history.failure_streak(v.event_runs)


@query("event_runs", f"""
SELECT r.id, NOT r.forced AND g.started_at IS NOT NULL AND r.started_at - g.started_at < INTERVAL 24 HOUR AS skipped
FROM event_runs r ASOF LEFT JOIN (SELECT * FROM event_runs WHERE {GOOD}) g ON r.site_name = g.site_name AND r.started_at > g.started_at""")
def interval_gate(v):
    return history.interval_gate(v.event_runs).select("id", "skipped")


@query("runs packages", f"""
, pairs AS (SELECT r.id AS run_id, g.id AS old_id FROM runs r ASOF LEFT JOIN (SELECT * FROM runs WHERE {GOOD}) g ON r.site_name = g.site_name AND r.started_at > g.started_at WHERE r.scope = 'full' AND g.id IS NOT NULL),
s AS (SELECT run_id, source_kind, source_name, max(size) AS v FROM packages WHERE status = 'stored' GROUP BY ALL),
n AS (SELECT p.run_id, s.source_kind, s.source_name, s.v FROM pairs p JOIN s ON p.run_id = s.run_id),
o AS (SELECT p.run_id, s.source_kind, s.source_name, s.v FROM pairs p JOIN s ON p.old_id = s.run_id),
b AS (SELECT coalesce(n.run_id, o.run_id) AS run_id, bool_and(coalesce(n.v = o.v, false)) AS unchanged FROM n FULL JOIN o ON n.run_id = o.run_id AND n.source_kind = o.source_kind AND n.source_name = o.source_name GROUP BY 1)
SELECT p.run_id, p.old_id, coalesce(b.unchanged, false) AS unchanged FROM pairs p LEFT JOIN b ON p.run_id = b.run_id""")
def unchanged(v):
    return history.unchanged(v.runs, v.packages)


@query("runs packages sites", """
, per_source AS (SELECT run_id, max(size) AS size FROM packages GROUP BY run_id, source_kind, source_name),
bytes AS (SELECT run_id, CAST(sum(size) AS BIGINT) AS bytes FROM per_source GROUP BY run_id),
r AS (SELECT runs.*, b.bytes, row_number() OVER (PARTITION BY site_name ORDER BY started_at DESC, id) AS nr FROM runs LEFT JOIN bytes b ON runs.id = b.run_id),
a AS (SELECT site_name, count(*) FILTER (status = 'success') AS successes, CAST(coalesce(sum(bytes) FILTER (status = 'success'), 0) AS BIGINT) AS total_bytes FROM r GROUP BY 1)
SELECT name, CASE WHEN NOT enabled THEN 'disabled' WHEN l.status = 'running' THEN 'running' ELSE 'idle' END AS state, coalesce(successes, 0) AS successes, coalesce(total_bytes, 0) AS total_bytes,
       l.status AS last_status, CASE WHEN l.finished_at IS NOT NULL THEN l.duration_millis END AS last_duration_millis, CASE WHEN l.status = 'success' THEN coalesce(l.bytes, 0) END AS last_bytes
FROM sites LEFT JOIN a ON name = a.site_name LEFT JOIN (SELECT * FROM r WHERE nr = 1) l ON name = l.site_name""")
def site_summary(v):
    return history.site_summary(v.sites, v.runs, v.packages)


@query("runs packages", """
, own AS (SELECT p.* FROM packages p SEMI JOIN runs r ON p.run_id = r.id), s AS (SELECT max(size) AS size FROM own GROUP BY run_id, source_kind, source_name)
SELECT (SELECT count(*) FROM runs) AS runs, count(*) AS packages, CAST(sum(size) AS BIGINT) AS bytes, (SELECT count(DISTINCT destination) FROM own) AS destinations FROM s""")
def history_totals(v):
    return history.history_totals(v.runs, v.packages)


@query("packages", """
, s AS (SELECT run_id, max(size) AS size FROM packages GROUP BY run_id, source_kind, source_name), d AS (SELECT run_id, count(DISTINCT destination) AS destinations FROM packages GROUP BY run_id)
SELECT s.run_id, count(*) AS sources, CAST(sum(size) AS BIGINT) AS bytes, any_value(destinations) AS destinations FROM s JOIN d ON s.run_id = d.run_id GROUP BY s.run_id""")
def logical_size(v):
    return history.logical_size(v.packages)


@query("runs", "SELECT id, CASE WHEN status = 'success' AND error_message <> '' THEN 'warning' WHEN status = 'no_change' AND error_category = 'retention' THEN 'warning' WHEN error_message <> '' THEN 'error' ELSE '' END AS severity FROM runs")
def run_warnings(v):
    return history.warnings(v.runs).select("id", "severity")


@query("runs locks", """
, active AS (SELECT site_name, id AS run_id, started_at FROM runs WHERE status = 'running'),
own AS (SELECT l.site_name, CASE WHEN l.verified THEN 'running' ELSE 'unknown' END AS state, arg_max(a.run_id, a.started_at) FILTER (l.verified AND a.started_at >= l.acquired_at) AS run_id
        FROM locks l LEFT JOIN active a ON l.site_name = a.site_name GROUP BY l.site_name, l.verified, l.pid)
SELECT * FROM own UNION ALL SELECT site_name, 'stale', run_id FROM active a WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.run_id = a.run_id)""")
def activity(v):
    return history.activity(v.locks, v.runs)


@query("locks", """
, s AS (SELECT pid, count(DISTINCT site_name) AS shares FROM locks GROUP BY pid), w AS (SELECT bool_and(verified) AS every FROM locks WHERE site_name IN ('site-1', 'site-4', 'site-21'))
SELECT l.site_name, verified AND shares = 1 AND every AS stop FROM locks l JOIN s ON l.pid = s.pid, w WHERE l.site_name IN ('site-1', 'site-4', 'site-21')""")
def stop_plan(v):
    return history.stop_plan(v.locks, ["site-1", "site-4", "site-21"]).select("site_name", "stop")


FACTS = """, facts AS (SELECT id, seq % 31 <> 0 AS locked, seq % 17 = 0 AS within_interval, forced, status = 'cancelled' AS cancelled, CASE WHEN status = 'failed' THEN 'source' END AS fatal_category,
 CASE WHEN seq % 3 = 0 THEN 'full' ELSE 'incremental' END AS mode, scope, CASE WHEN status = 'partial' THEN seq % 3 ELSE 0 END AS skipped, CASE WHEN status = 'partial' THEN seq % 2 ELSE 0 END AS classified_missing,
 seq % 5 <> 0 AS has_previous, status = 'no_change' AS same_sizes, seq % 13 = 0 AS retention_warning, seq % 19 = 0 AS database_warning FROM runs)"""


@query("runs", FACTS + """
, w AS (SELECT *, CASE WHEN database_warning THEN 'maintenance' WHEN retention_warning THEN 'retention' ELSE '' END AS warn FROM facts)
SELECT id, CASE WHEN NOT locked OR (within_interval AND NOT forced) THEN 'skipped' WHEN cancelled THEN 'cancelled' WHEN fatal_category IS NOT NULL THEN 'failed'
  WHEN mode = 'full' AND scope = 'full' AND skipped = 0 AND has_previous AND same_sizes THEN 'no_change' WHEN skipped > 0 THEN 'partial' ELSE 'success' END AS run_status,
  CASE WHEN NOT locked THEN 'already_running' WHEN within_interval AND NOT forced THEN 'minimum_interval' WHEN cancelled OR fatal_category IS NOT NULL THEN coalesce(fatal_category, '')
  WHEN skipped > 0 THEN CASE WHEN classified_missing = skipped THEN 'source_disappeared' ELSE 'source' END ELSE warn END AS category FROM w""")
def run_status(v):
    facts = v.runs.selectExpr(
        "id", "seq % 31 <> 0 AS locked", "seq % 17 = 0 AS within_interval", "forced", "status = 'cancelled' AS cancelled", "CASE WHEN status = 'failed' THEN 'source' END AS fatal_category",
        "CASE WHEN seq % 3 = 0 THEN 'full' ELSE 'incremental' END AS mode", "scope", "CASE WHEN status = 'partial' THEN seq % 3 ELSE 0 END AS skipped", "CASE WHEN status = 'partial' THEN seq % 2 ELSE 0 END AS classified_missing",
        "seq % 5 <> 0 AS has_previous", "status = 'no_change' AS same_sizes", "seq % 13 = 0 AS retention_warning", "seq % 19 = 0 AS database_warning",
    )
    return history.run_status(facts).select("id", F.col("status").alias("run_status"), "category")


@query("runs", "SELECT DISTINCT 'daily' AS report_type, strftime(started_at, '%Y-%m-%d') AS period FROM runs WHERE strftime(started_at, '%Y-%m-%d') NOT IN (SELECT strftime(started_at, '%Y-%m-%d') FROM runs WHERE status = 'failed')")
def report_once(v):
    new = v.runs.select(F.lit("daily").alias("report_type"), F.date_format("started_at", "yyyy-MM-dd").alias("period"))
    done = v.runs.where("status = 'failed'").select(F.lit("daily").alias("report_type"), F.date_format("started_at", "yyyy-MM-dd").alias("period"))
    return history.deliver_once(done, new)


# reports --------------------------------------------------------------------------------------------------------


@query("runs packages", f", {FIRST_COPIES} SELECT count(*) AS total_runs, {STATUS_COUNTS}, {SECONDS}, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM sized")
def period_report(v):
    return report.period(v.runs, v.packages, FIRST)


@query("runs packages", f", {FIRST_COPIES} SELECT site_name, count(*) AS total_runs, {STATUS_COUNTS}, {SECONDS}, CAST(sum(bytes) AS BIGINT) AS total_bytes, arg_max(status, started_at) AS last_status FROM sized GROUP BY site_name")
def site_report(v):
    return report.by_site(v.runs, v.packages, FIRST).drop("last_run_at")


@query("runs packages", """
SELECT destination AS name, count(*) AS total_packages, count(*) FILTER (status = 'stored') AS stored, count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(size) FILTER (status = 'stored'), 0) AS BIGINT) AS total_bytes
FROM packages WHERE run_id IN (SELECT id FROM runs) GROUP BY destination""")
def destination_report(v):
    return report.by_destination(v.runs, v.packages)


@query("runs packages", f", {FIRST_COPIES} SELECT site_name, count(*) AS total_runs, {STATUS_COUNTS}, {SECONDS}, CAST(sum(bytes) AS BIGINT) AS total_bytes, arg_max(status, started_at) AS last_status FROM sized WHERE started_at + INTERVAL 8 HOUR >= TIMESTAMP '1997-06-10' AND started_at + INTERVAL 8 HOUR < TIMESTAMP '1997-06-11' GROUP BY site_name")
def daily_report(v):
    return report.daily(v.runs, v.packages, FIRST, "1997-06-10", "Asia/Makassar").drop("last_run_at")


@query("runs packages", f"""
, {FIRST_COPIES}, m AS (SELECT *, strftime(started_at + INTERVAL 8 HOUR, '%Y-%m-%d') AS day FROM sized WHERE started_at + INTERVAL 8 HOUR >= TIMESTAMP '1997-06-01' AND started_at + INTERVAL 8 HOUR < TIMESTAMP '1997-07-01'),
g AS (SELECT day, site_name, count(*) AS total_runs, {STATUS_COUNTS}, {SECONDS}, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes,
 CASE WHEN grouping(day) = 1 AND grouping(site_name) = 1 THEN 'month' WHEN grouping(day) = 1 THEN 'site' WHEN grouping(site_name) = 1 THEN 'day' ELSE 'day_site' END AS level
 FROM m GROUP BY GROUPING SETS ((day, site_name), (day), (site_name), ()))
SELECT * FROM g UNION ALL SELECT strftime(d, '%Y-%m-%d'), NULL, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 'day' FROM range(TIMESTAMP '1997-06-01', TIMESTAMP '1997-07-01', INTERVAL 1 DAY) t(d) WHERE strftime(d, '%Y-%m-%d') NOT IN (SELECT day FROM m)""")
def monthly_report(v):
    return report.monthly(v.runs, v.packages, FIRST, "1997-06-01", "Asia/Makassar").withColumn("day", F.col("day").cast("string"))


# object inventories ----------------------------------------------------------------------------------------------

PARSED = """
, split AS (SELECT *, split_part(key, '/', 1) AS d, split_part(key, '/', 2) AS n FROM objects),
parsed AS (SELECT *, CASE WHEN regexp_matches(n, '^[0-9]{2}\\.[0-9]{2}\\.[0-9]{2}-') AND regexp_matches(d, '^[0-9]{2}-[A-Z][a-z]+-[0-9]{4}$') THEN strptime(d || '/' || substring(n, 1, 8), '%d-%B-%Y/%H.%M.%S') - INTERVAL 8 HOUR
    WHEN regexp_matches(n, '^[0-9]{2}-[0-9]{2}-[0-9]{2}-') THEN CASE WHEN regexp_matches(d, '^[0-9]{4}') THEN strptime(d || '/' || substring(n, 1, 8), '%Y-%m-%d/%H-%M-%S') ELSE strptime(d || '/' || substring(n, 1, 8), '%d-%B-%Y/%H-%M-%S') END END AS created_at FROM split),
keyed AS (SELECT *, CASE WHEN created_at IS NOT NULL THEN d || '/' || substring(n, 1, 8) || CASE WHEN instr(substring(n, 10), '-') > 0 THEN '-' || split_part(substring(n, 10), '-', 1) ELSE '' END END AS set_key FROM parsed),
sets AS (SELECT destination, site_name, set_key, min(created_at) AS created_at, bool_or(ends_with(key, '-.backup-complete')) AS complete, count(*) FILTER (NOT ends_with(key, '-.backup-complete')) AS packages,
  CAST(coalesce(sum(size) FILTER (NOT ends_with(key, '-.backup-complete')), 0) AS BIGINT) AS bytes FROM keyed WHERE set_key IS NOT NULL GROUP BY ALL)"""
ZONE = "Asia/Makassar"


@query("objects", PARSED + f"SELECT key, set_key, {TS.format('created_at')} FROM keyed")
def parse_keys(v):
    return inventory.parse_packages(v.objects, ZONE).select("key", "set_key", ts("created_at"))


@query("objects", PARSED + f"SELECT destination, site_name, set_key, {TS.format('created_at')}, complete, packages, bytes FROM sets")
def backup_sets(v):
    return inventory.backup_sets(v.objects, ZONE).select("destination", "site_name", "set_key", ts("created_at"), "complete", "packages", "bytes")


@query("objects", PARSED + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY destination, site_name ORDER BY created_at DESC, set_key DESC) AS nr FROM sets WHERE complete)
SELECT destination, site_name, set_key, row_number() OVER (PARTITION BY destination, site_name ORDER BY created_at, set_key) AS position FROM ranked WHERE nr > 7""")
def retention_plan(v):
    return inventory.retention_plan(inventory.backup_sets(v.objects, ZONE), 7).select("destination", "site_name", "set_key", F.col("position").cast("bigint").alias("position"))


@query("objects", PARSED + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY destination, site_name ORDER BY created_at DESC, set_key DESC) AS nr FROM sets WHERE complete),
own AS (SELECT k.* FROM keyed k SEMI JOIN (SELECT * FROM ranked WHERE nr > 7) r ON k.destination = r.destination AND k.site_name = r.site_name AND k.set_key = r.set_key)
SELECT destination, site_name, key, CAST((row_number() OVER (PARTITION BY destination, site_name ORDER BY key) - 1) // 10 AS BIGINT) AS batch FROM own""")
def delete_batches(v):
    plan = inventory.retention_plan(inventory.backup_sets(v.objects, ZONE), 7)
    return inventory.delete_batches(v.objects, plan, ZONE, 10).select("destination", "site_name", "key", F.col("batch").cast("bigint").alias("batch"))


@query("objects", PARSED + f"SELECT destination, site_name, key, CASE WHEN ends_with(key, '.sql.gz') THEN 'database' ELSE 'files' END AS kind, {TS.format('created_at')} FROM keyed WHERE set_key IS NOT NULL AND NOT ends_with(key, '-.backup-complete')")
def object_list(v):
    return inventory.object_list(v.objects, ZONE).select("destination", "site_name", "key", "kind", ts("created_at"))


@query("objects sites", PARSED + "SELECT destination, site_name, key FROM keyed WHERE set_key IS NOT NULL AND ends_with(key, '-src-1.sql.gz') AND site_name IN (SELECT name FROM sites WHERE enabled)")
def link_eligible(v):
    sources = v.sites.select(F.col("name").alias("site_name"), "enabled", F.lit("src-1").alias("source_name"))
    return inventory.link_eligible(v.objects, sources, ZONE).select("destination", "site_name", "key")


@query("runs packages", f"""
, l AS (SELECT site_name, arg_max(id, started_at) AS run_id FROM runs WHERE {GOOD} GROUP BY site_name),
have AS (SELECT r.site_name, p.object_key, p.size + CASE WHEN p.line % 3 = 0 THEN 1 ELSE 0 END AS size FROM packages p JOIN runs r ON p.run_id = r.id WHERE p.destination = 'dest-1' AND p.line % 5 <> 0),
e AS (SELECT l.site_name, p.object_key, p.size FROM l LEFT JOIN packages p ON l.run_id = p.run_id AND p.status = 'stored' AND p.destination = 'dest-1')
SELECT site_name, 'missing_backup' AS type, NULL AS object_key FROM (SELECT DISTINCT site_name FROM runs) WHERE site_name NOT IN (SELECT site_name FROM l)
UNION ALL SELECT e.site_name, CASE WHEN e.object_key IS NULL THEN 'missing_package_history' ELSE 'package_verification' END, e.object_key FROM e LEFT JOIN have h ON e.object_key = h.object_key AND e.site_name = h.site_name WHERE e.object_key IS NULL OR h.size IS NULL OR h.size <> e.size""")
def check_full(v):
    own = v.packages.join(v.runs.select(F.col("id").alias("run_id"), "site_name"), "run_id").where("line % 5 <> 0")
    have = own.select("destination", "site_name", F.col("object_key").alias("key"), (F.col("size") + F.when(F.col("line") % 3 == 0, 1).otherwise(0)).alias("size"))
    return inventory.check_full(v.runs, v.packages, have, "dest-1")


@query("sites site_destinations", "SELECT s.name AS site_name, d.destination, 'config/' || s.name || '.yaml' AS object_key FROM sites s, (SELECT DISTINCT destination FROM site_destinations WHERE site_name IN (SELECT name FROM sites WHERE enabled)) d")
def config_copies(v):
    return inventory.config_copies(v.site_destinations, v.sites)


# snapshots ------------------------------------------------------------------------------------------------------


@query("blobs index_entries", "SELECT DISTINCT type, id, length FROM blobs WHERE id NOT IN (SELECT id FROM index_entries)")
def blob_dedup(v):
    return snapshots.new_blobs(v.blobs.select("type", "id", "length"), v.index_entries)


@query("blobs index_entries", "SELECT count(*) AS blobs, CAST(coalesce(sum(length), 0) AS BIGINT) AS data_added FROM (SELECT DISTINCT type, id, length FROM blobs WHERE id NOT IN (SELECT id FROM index_entries))")
def data_added(v):
    return snapshots.data_added(v.blobs, v.index_entries)


@query("snapshots", "SELECT a.id AS key, arg_max(b.id, b.time) AS parent FROM snapshots a LEFT JOIN snapshots b ON a.root = b.root AND b.time < a.time GROUP BY a.id")
def parent_snapshot(v):
    own = v.snapshots.select("id", "time", F.array("root").alias("paths"), F.expr("cast(array() as array<string>)").alias("excludes"))
    return snapshots.parent_snapshot(own.select(F.col("id").alias("key"), "paths", "excludes", F.col("time").alias("before")), own)


VERSIONS = """, old AS (SELECT path, size, doc_id % 3 AS mode FROM files WHERE doc_id % 10 < 8), new AS (SELECT path, size, CASE WHEN doc_id % 4 = 0 THEN 7 ELSE doc_id % 3 END AS mode FROM files WHERE doc_id % 10 > 0),
c AS (SELECT new.*, CASE WHEN old.path IS NULL THEN 'new' WHEN old.mode = new.mode AND old.size = new.size THEN 'unmodified' ELSE 'changed' END AS change FROM new LEFT JOIN old ON new.path = old.path) """


def versions(v):
    columns = [F.lit("file").alias("type"), F.array("id").alias("content")]
    old = v.files.where("doc_id % 10 < 8").select("path", "size", (F.col("doc_id") % 3).alias("mode"), *columns)
    new = v.files.where("doc_id % 10 > 0").select("path", "size", F.when(F.col("doc_id") % 4 == 0, 7).otherwise(F.col("doc_id") % 3).alias("mode"), *columns)
    return old, snapshots.classify(new, old, ("size", "mode"))


@query("files", VERSIONS + "SELECT path, change FROM c")
def change_classification(v):
    return versions(v)[1].select("path", "change")


@query("files", VERSIONS + "SELECT path FROM old WHERE path NOT IN (SELECT path FROM new)")
def deleted_paths(v):
    old, new = versions(v)
    return snapshots.deleted(new, old).select("path")


@query("files", VERSIONS + """SELECT count(*) FILTER (change = 'new') AS files_new, count(*) FILTER (change = 'changed') AS files_changed, count(*) FILTER (change = 'unmodified') AS files_unmodified,
CAST(sum(size) AS BIGINT) AS total_bytes_processed, CAST(coalesce(sum(size) FILTER (change <> 'unmodified'), 0) AS BIGINT) AS data_added FROM c""")
def snapshot_summary(v):
    new = versions(v)[1]
    added = new.where("change <> 'unmodified'").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("data_added"))
    return snapshots.snapshot_summary(new, added)


@query("snapshots", "SELECT substring(id, 1, 8) AS short_id, k * 100 AS size, id FROM snapshots")
def snapshot_list(v):
    own = v.snapshots.select("id", "time", F.struct((F.col("k") * 100).alias("total_bytes_processed")).alias("summary"))
    return snapshots.snapshot_list(own).select("short_id", "size", "id")


@query()
def pack_plan(v):
    return snapshots.pack_plan(v.blobs.dropDuplicates(["id"]), 64 << 10, 4)


@query("files", """
, l3 AS (SELECT parent AS path, sha256('{"nodes":[' || string_agg('{"name":"' || name || '","type":"file"' || coalesce(',"id":"' || id || '"', '') || coalesce(',"size":' || size, '') || '}', ',' ORDER BY name) || ']}' || chr(10)) AS tree, CAST(sum(size) AS BIGINT) AS size FROM (SELECT parent, split_part(path, '/', -1) AS name, id, size FROM files) f GROUP BY parent),
l2 AS (SELECT '/' || split_part(path, '/', 2) AS path, sha256('{"nodes":[' || string_agg('{"name":"' || name || '","type":"dir"' || coalesce(',"id":"' || tree || '"', '') || coalesce(',"size":' || size, '') || '}', ',' ORDER BY name) || ']}' || chr(10)) AS tree, CAST(sum(size) AS BIGINT) AS size FROM (SELECT path, split_part(path, '/', -1) AS name, tree, size FROM l3) f GROUP BY 1),
l1 AS (SELECT '' AS path, sha256('{"nodes":[' || string_agg('{"name":"' || name || '","type":"dir"' || coalesce(',"id":"' || tree || '"', '') || coalesce(',"size":' || size, '') || '}', ',' ORDER BY name) || ']}' || chr(10)) AS tree, CAST(sum(size) AS BIGINT) AS size FROM (SELECT substring(path, 2) AS name, tree, size FROM l2) f)
SELECT path, tree FROM l3 UNION ALL SELECT path, tree FROM l2 UNION ALL SELECT path, tree FROM l1""")
def tree_build(v):
    return snapshots.build_trees(v.files.select("path", "id", "size"), 3)


@query("files", "SELECT CAST(sum(size) AS BIGINT) AS size FROM files WHERE NOT regexp_matches(path, '^/src1/') AND NOT regexp_matches(path, '/[0-9]*7$')")
def size_estimate(v):
    return snapshots.size_estimate(v.files.withColumn("excluded", paths.excluded("path", ["/src1", "*7"], "/")))


@query()
def chunk_files(v):
    """Small bounds, so that documents are cut."""
    return chunking.chunk_files(v.files.select("path", F.encode("text", "UTF-8").alias("content")), least=512, most=8192, bits=10)


# reachability and checks -----------------------------------------------------------------------------------------

REACH = """, reach(tree) AS (SELECT 'root-' || CAST(k AS STRING) FROM snapshots WHERE k IN (1, 2) UNION SELECT e.subtree FROM reach r JOIN edges e ON r.tree = e.tree),
live AS (SELECT DISTINCT c.id FROM leaf_content c WHERE c.tree IN (SELECT tree FROM reach)) """


@query("snapshots edges", ", reach(tree) AS (SELECT 'root-' || CAST(k AS STRING) FROM snapshots WHERE k IN (1, 2) UNION SELECT e.subtree FROM reach r JOIN edges e ON r.tree = e.tree) SELECT tree FROM reach")
def reachable_trees(v):
    return graph.reachable_trees(v.snapshots.where("k IN (1, 2)").select("tree"), v.edges)


def nodes(v):
    links = v.edges.select(F.col("tree").alias("tree_id"), F.col("subtree").alias("name"), F.lit("dir").alias("type"), F.lit(0).cast("bigint").alias("size"), F.expr("cast(null as array<string>)").alias("content"), "subtree")
    leaves = v.leaf_content.select(F.col("tree").alias("tree_id"), F.col("id").alias("name"), F.lit("file").alias("type"), F.lit(1).cast("bigint").alias("size"), F.array("id").alias("content"), F.lit(None).cast("string").alias("subtree"))
    return links.unionByName(leaves)


@query("snapshots edges leaf_content index_entries pack_files", REACH + """
, x AS (SELECT pack_id, bool_or(id IN (SELECT id FROM live)) AS alive FROM index_entries GROUP BY 1)
SELECT coalesce(x.pack_id, p.pack_id) AS pack_id, CASE WHEN alive THEN 'keep' WHEN x.pack_id IS NOT NULL THEN 'dead' ELSE 'orphan' END AS action, coalesce(size, 0) AS bytes FROM x FULL JOIN pack_files p ON x.pack_id = p.pack_id""")
def sweep_plan(v):
    return graph.sweep_plan(v.index_entries, v.pack_files, graph.mark(v.snapshots.where("k IN (1, 2)"), nodes(v)))


@query("snapshots", "SELECT id, tag = 'site:a' AND row_number() OVER (PARTITION BY tag ORDER BY time DESC, id DESC) > 1 AS forgotten FROM snapshots")
def forget_plan(v):
    return graph.forget(v.snapshots.withColumn("tags", F.array("tag")), "site:a", 1).select("id", "forgotten")


@query("snapshots edges leaf_content index_entries", """
, reach(snapshot_id, tree) AS (SELECT id, tree FROM snapshots UNION SELECT r.snapshot_id, e.subtree FROM reach r JOIN edges e ON r.tree = e.tree),
need AS (SELECT 'tree' AS type, tree AS id, snapshot_id FROM reach UNION SELECT 'data', c.id, r.snapshot_id FROM reach r JOIN leaf_content c ON r.tree = c.tree)
SELECT type, id, min(snapshot_id) AS snapshot_id FROM need WHERE NOT (type = 'data' AND id IN (SELECT id FROM index_entries)) GROUP BY type, id""")
def missing_blobs(v):
    return graph.missing_blobs(v.snapshots, nodes(v), v.index_entries)


@query("snapshots edges leaf_content", """
, walk(path, type, subtree) AS (SELECT '/' || subtree, 'dir', subtree FROM edges WHERE tree = 'root-2' UNION ALL SELECT w.path || '/' || e.subtree, 'dir', e.subtree FROM walk w JOIN edges e ON w.subtree = e.tree),
every AS (SELECT path, type FROM walk UNION ALL SELECT w.path || '/' || c.id, 'file' FROM walk w JOIN leaf_content c ON w.subtree = c.tree)
SELECT path, type, CASE WHEN NOT ends_with(path, '3') THEN 'create' WHEN type = 'dir' THEN 'keep' ELSE 'conflict' END AS action FROM every""")
def restore_plan(v):
    own = v.snapshots.where("k = 2").select("tree")
    there = graph.paths_of(own, nodes(v)).where(F.col("path").endswith("3")).select("path", "type")
    return graph.restore_plan(own, nodes(v), there).select("path", "type", "action")


BLOB_LISTS = """, own AS (SELECT DISTINCT pack_id, id, length FROM blobs WHERE substring(id, 4, 1) <> '9'),
headers AS (SELECT pack_id, id, length, CAST(coalesce(sum(length) OVER (PARTITION BY pack_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at FROM own)
"""


def headers(v, every: bool = False):
    from pyspark.sql import Window as W

    own = v.blobs.where("true" if every else "substring(id, 4, 1) <> '9'").select("pack_id", "id", "length").distinct()
    w = W.partitionBy("pack_id").orderBy("id")
    return own.select("pack_id", (F.row_number().over(w) - 1).alias("ordinal"), F.lit("data").alias("type"), "id", F.coalesce(F.sum("length").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"), "length", F.lit(False).alias("compressed"), F.lit(0).cast("bigint").alias("uncompressed_length"))


@query("blobs", BLOB_LISTS + "SELECT pack_id, id, start_at AS start FROM headers")
def pack_offsets(v):
    return snapshots.pack_offsets(headers(v).drop("offset")).select("pack_id", "id", F.col("offset").alias("start"))


def findings(v):
    index = headers(v, every=True).join(v.index_entries.select("index_id", "id"), "id").drop("compressed", "ordinal")
    packs = v.pack_files.withColumn("pack_id", F.sha2("pack_id", 256))
    rename = lambda df: df.withColumn("pack_id", F.sha2("pack_id", 256))
    files = v.snapshots.select(F.lit("key").alias("kind"), "id", F.when(F.col("k") == 1, "bad seal").otherwise("ok").alias("status"))
    return integrity.check(v.snapshots.where("k IN (1, 2)"), nodes(v), rename(index), rename(headers(v)), packs, files)


FINDINGS = """
, own AS (SELECT DISTINCT pack_id, id, length FROM blobs),
every AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY pack_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM own),
fewer AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY pack_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM own WHERE substring(id, 4, 1) <> '9'),
ix AS (SELECT e.* FROM every e SEMI JOIN index_entries i ON e.id = i.id),
r2(snapshot_id, tree) AS (SELECT id, tree FROM snapshots WHERE k IN (1, 2) UNION SELECT r.snapshot_id, e.subtree FROM r2 r JOIN edges e ON r.tree = e.tree),
need AS (SELECT tree AS id FROM r2 UNION SELECT c.id FROM r2 r JOIN leaf_content c ON r.tree = c.tree WHERE c.id NOT IN (SELECT id FROM ix)),
want AS (SELECT pack_id, string_agg(id || '@' || start_at, ',' ORDER BY start_at, id) AS l FROM ix GROUP BY 1), have AS (SELECT pack_id, string_agg(id || '@' || start_at, ',' ORDER BY start_at, id) AS l FROM fewer GROUP BY 1),
f AS (SELECT 'missing_blob' AS type, id FROM need UNION ALL SELECT 'missing_pack', sha256(pack_id) FROM want WHERE pack_id NOT IN (SELECT pack_id FROM pack_files)
UNION ALL SELECT 'orphaned_pack', sha256(pack_id) FROM pack_files WHERE pack_id NOT IN (SELECT pack_id FROM want)
UNION ALL SELECT 'broken_pack', sha256(w.pack_id) FROM want w LEFT JOIN have h ON w.pack_id = h.pack_id WHERE w.pack_id IN (SELECT pack_id FROM pack_files) AND w.l IS DISTINCT FROM h.l
UNION ALL SELECT 'broken_key', id FROM snapshots WHERE k = 1)
"""


@query("snapshots edges leaf_content index_entries pack_files blobs", FINDINGS + "SELECT type, id FROM f")
def integrity_check(v):
    return findings(v).select("type", "id")


@query("snapshots edges leaf_content index_entries pack_files blobs", FINDINGS + "SELECT type, count(*) AS findings FROM f GROUP BY type")
def findings_by_type(v):
    return integrity.by_type(findings(v))


EVERY_FINDING = FINDINGS.rstrip() + """,
r5(snapshot_id, tree) AS (SELECT id, tree FROM snapshots UNION SELECT r.snapshot_id, e.subtree FROM r5 r JOIN edges e ON r.tree = e.tree),
every_need AS (SELECT tree AS id FROM r5 UNION SELECT c.id FROM r5 r JOIN leaf_content c ON r.tree = c.tree WHERE c.id NOT IN (SELECT id FROM ix)),
every_f AS (SELECT type, id FROM f WHERE type NOT IN ('missing_blob', 'broken_key') UNION ALL SELECT 'missing_blob', id FROM every_need
UNION ALL SELECT CASE k WHEN 0 THEN 'broken_config' WHEN 1 THEN 'broken_key' WHEN 2 THEN 'broken_index' ELSE 'broken_snapshot' END, id FROM snapshots WHERE k < 4
UNION ALL SELECT DISTINCT 'corrupt_blob', id FROM blobs WHERE substring(id, 5, 1) = 'a')
"""


@query("snapshots edges leaf_content index_entries pack_files blobs", EVERY_FINDING + "SELECT type, id FROM every_f")
def integrity_check_full(v):
    """integrity_check over all snapshots, files of all kinds and the bytes of all blobs."""
    index = headers(v, every=True).join(v.index_entries.select("index_id", "id"), "id").drop("compressed", "ordinal")
    rename = lambda df: df.withColumn("pack_id", F.sha2("pack_id", 256))
    files = v.snapshots.selectExpr("CASE k WHEN 0 THEN 'config' WHEN 1 THEN 'key' WHEN 2 THEN 'index' ELSE 'snapshot' END AS kind", "id", "CASE WHEN k < 4 THEN 'bad seal' ELSE 'ok' END AS status")
    return integrity.check(v.snapshots, nodes(v), rename(index), rename(headers(v)), rename(v.pack_files), files, rename(blob_bytes(v)).distinct()).select("type", "id")


@query("index_entries snapshots", "SELECT count(DISTINCT index_id) AS index_files, count(DISTINCT pack_id) AS packs, count(DISTINCT (type, id)) AS blobs, (SELECT count(*) FROM snapshots) AS snapshots FROM index_entries")
def check_counters(v):
    return integrity.counters(v.snapshots, v.index_entries)


@query("blobs", ", own AS (SELECT DISTINCT pack_id, id, length FROM blobs) SELECT pack_id, id, length FROM own")
def repair_index(v):
    own = headers(v, every=True)
    packs = own.groupBy("pack_id").agg((F.sum("length") + F.count("*") * 37).alias("size"))
    return integrity.repair_index(own, packs).select("pack_id", "id", "length")


def blob_bytes(v):
    """All blobs with their bytes, of which some were changed."""
    return v.files.select("id", F.concat(F.lit("pack-"), F.substring("id", 1, 2)).alias("pack_id"), F.encode(F.when(F.substring("id", 5, 1) == "a", F.concat("text", F.lit("!"))).otherwise(F.col("text")), "UTF-8").alias("data"))


@query("blobs", "SELECT DISTINCT id, pack_id FROM blobs WHERE substring(id, 5, 1) = 'a'")
def corrupt_blobs(v):
    return integrity.corrupt(blob_bytes(v)).select("id", "pack_id").distinct()


# operations -------------------------------------------------------------------------------------------------------

CHECKS = """, checks AS (SELECT CASE WHEN p_partkey % 70 = 1 THEN 'gone.' || full_name || 'x' ELSE full_name END AS table_name, CASE WHEN p_size % 9 = 0 THEN 'error' ELSE 'status' END AS type, CASE WHEN p_size % 7 = 0 THEN 'Corrupt' ELSE ' OK ' END AS message FROM tables WHERE p_partkey % 50 <> 0),
named AS (SELECT c.table_name, arg_min(t.name, t.position) AS name, arg_min(t.engine, t.position) AS engine FROM (SELECT DISTINCT table_name FROM checks) c JOIN tables t ON c.table_name = t.name OR ends_with(c.table_name, '.' || t.name) GROUP BY c.table_name),
health AS (SELECT coalesce(n.name, c.table_name) AS name, coalesce(n.engine, '') AS engine, c.message, lower(trim(c.type)) = 'status' AND lower(trim(c.message)) = 'ok' AS healthy FROM checks c LEFT JOIN named n ON c.table_name = n.table_name) """


def checks(v):
    return v.tables.where("p_partkey % 50 <> 0").selectExpr("CASE WHEN p_partkey % 70 = 1 THEN 'gone.' || full_name || 'x' ELSE full_name END AS table_name", "CASE WHEN p_size % 9 = 0 THEN 'error' ELSE 'status' END AS type", "CASE WHEN p_size % 7 = 0 THEN 'Corrupt' ELSE ' OK ' END AS message")


@query("tables", CHECKS + "SELECT name, engine, message, healthy FROM health")
def table_health(v):
    return operations.table_health(v.tables, checks(v)).select("name", "engine", "message", "healthy")


@query("tables", CHECKS + "SELECT name, lower(engine) IN ('myisam', 'aria') AS repairable, (SELECT bool_and(lower(engine) IN ('myisam', 'aria')) FROM health WHERE NOT healthy) AS repair FROM health WHERE NOT healthy")
def repair_gate(v):
    return operations.repair_gate(operations.table_health(v.tables, checks(v))).select("name", "repairable", "repair")


CATEGORY = "CASE seq % 9 WHEN 0 THEN 'config' WHEN 1 THEN 'preflight' WHEN 2 THEN 'execution' WHEN 3 THEN 'storage' WHEN 4 THEN 'persistence' WHEN 5 THEN 'cancellation' WHEN 6 THEN 'internal' WHEN 7 THEN '' END"


@query("runs", f", c AS (SELECT id, {CATEGORY} AS category FROM runs) SELECT id, CASE WHEN category IS NULL OR category = '' THEN 0 WHEN category = 'config' THEN 2 WHEN category = 'preflight' THEN 3 WHEN category IN ('execution', 'storage', 'cancellation') THEN 4 ELSE 1 END AS code FROM c")
def exit_codes(v):
    return v.runs.select("id", operations.exit_code(F.expr(CATEGORY)).alias("code"))


@query("runs", """SELECT id, CASE WHEN seq % 11 = 0 THEN 'invalid' WHEN TIMESTAMP '1998-01-01' - started_at > INTERVAL 30 MINUTE THEN CASE WHEN seq % 2 = 0 THEN 'stale_exclusive' ELSE 'remove' END ELSE 'conflict' END AS meaning FROM runs""")
def lock_conflicts(v):
    locks = v.runs.select("id", (F.col("seq") % 2 == 0).alias("exclusive"), F.col("started_at").alias("at"), (F.col("seq") % 11 != 0).alias("readable"))
    return operations.lock_conflicts(locks, True, "1998-01-01 00:00:00").select("id", "meaning")


@query("runs", "SELECT id FROM runs WHERE seq % 11 = 0 OR TIMESTAMP '1998-01-01' - started_at > INTERVAL 30 MINUTE")
def stale_locks(v):
    locks = v.runs.select("id", F.col("started_at").alias("at"), (F.col("seq") % 11 != 0).alias("readable"))
    return operations.stale_locks(locks, "1998-01-01 00:00:00").select("id")


@query("", """WITH c AS (SELECT 'c' || n_nationkey AS name FROM nation WHERE n_nationkey % 4 <> 3), r AS (SELECT 'e' || n_regionkey AS event, n_nationkey AS position, 'c' || (n_nationkey % 10) AS a, 'c' || (n_nationkey % 7) AS b FROM nation),
f AS (SELECT event, position, 0 AS nr, a AS channel FROM r UNION ALL SELECT event, position, 1, b FROM r), m AS (SELECT event, channel, min((position, nr)) AS first FROM f WHERE channel IN (SELECT name FROM c) GROUP BY 1, 2)
SELECT event, channel, row_number() OVER (PARTITION BY event ORDER BY first) AS rank FROM m""")
def route_channels(v):
    c = v.nation.where("n_nationkey % 4 <> 3").selectExpr("'c' || n_nationkey AS name", "'smtp' AS type")
    r = v.nation.selectExpr("'e' || n_regionkey AS event", "n_nationkey AS position", "array('c' || (n_nationkey % 10), 'c' || (n_nationkey % 7)) AS channels")
    return operations.route_channels(r, c).select("event", "channel", F.col("rank").cast("bigint").alias("rank"))


@query("sites", "SELECT name, backup_mode AS lane, row_number() OVER (PARTITION BY backup_mode ORDER BY name) AS position FROM sites WHERE enabled")
def batch_lanes(v):
    return operations.lanes(v.sites).select("name", "lane", F.col("position").cast("bigint").alias("position"))


@query("sites storages site_destinations", "SELECT 'unknown_destination' AS rule, site_name AS name FROM site_destinations WHERE destination NOT IN (SELECT name FROM storages)")
def config_findings(v):
    return operations.config_findings(v.sites, v.storages, v.site_destinations)


@query("tables", "SELECT name, CASE WHEN p_size % 5 = 0 THEN 'skipped' WHEN p_size % 7 <> 0 THEN 'passed' ELSE 'failed' END AS status, (SELECT count(*) FROM tables WHERE p_size % 5 <> 0 AND p_size % 7 = 0) = 0 AS passed FROM tables")
def doctor_checks(v):
    own = v.tables.selectExpr("p_partkey AS position", "name", "p_size % 7 <> 0 AS ok", "p_size % 5 <> 0 AS available", "'' AS message")
    return operations.doctor(own).select("name", "status", "passed")


@query("event_runs", "SELECT id, CAST(floor((epoch_us(lead(started_at) OVER (PARTITION BY site_name ORDER BY started_at, id)) - epoch_us(started_at)) / 1000) AS BIGINT) AS millis FROM event_runs")
def stage_times(v):
    return operations.stage_times(v.event_runs.select(F.col("site_name").alias("run_id"), F.col("id").alias("stage"), F.col("started_at").alias("at"))).select(F.col("stage").alias("id"), "millis")


INCIDENTS = """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nr, event_id, ts,
  CASE event_type WHEN 'purchase' THEN 'backup_succeeded' WHEN 'signup' THEN 'backup_skipped' ELSE 'backup_failed' END AS event, CASE event_type WHEN 'error' THEN 'source' ELSE event_type END AS category FROM events),
m AS (SELECT user_id, nr, event_id, event, category AS mark, ts AS last, event = 'backup_failed' AS sends, false AS recovery, CASE WHEN event = 'backup_failed' THEN category ELSE '' END AS open FROM e WHERE nr = 1
 UNION ALL SELECT e.user_id, e.nr, e.event_id, e.event, CASE WHEN x.sends AND NOT x.heals THEN e.category ELSE m.mark END, CASE WHEN x.sends AND NOT x.heals THEN e.ts ELSE m.last END, x.sends, x.heals,
   CASE WHEN x.heals THEN '' WHEN x.sends THEN e.category ELSE m.open END
 FROM m JOIN e ON m.user_id = e.user_id AND e.nr = m.nr + 1, LATERAL (SELECT e.event = 'backup_succeeded' AND m.open <> '' AS heals, (e.event = 'backup_succeeded' AND m.open <> '') OR (e.event = 'backup_failed' AND (m.open <> e.category OR e.ts - m.last >= INTERVAL 24 HOUR)) AS sends) x)
SELECT event_id, event, recovery FROM m WHERE sends"""


def incident_events(v):
    event = F.when(F.col("event_type") == "purchase", "backup_succeeded").when(F.col("event_type") == "signup", "backup_skipped").otherwise("backup_failed")
    category = F.when(F.col("event_type") == "error", "source").otherwise(F.col("event_type"))
    return v.events.select("ts", F.col("event_id").alias("seq"), F.lit("s").alias("server_id"), F.concat(F.lit("site-"), F.col("user_id")).alias("site"), F.lit("full").alias("scope"), F.col("user_id").cast("string").alias("channel"), F.lit("smtp").alias("channel_type"), event.alias("event"), category.alias("error_category"), F.lit("").alias("error_message"))


@query("", INCIDENTS)
def incident_deliveries(v):
    ids = v.events.select("event_id", F.col("ts").alias("at"), F.col("user_id").cast("string").alias("channel"))
    sent = incidents.deliveries(incident_events(v))
    return sent.join(ids, (sent["channel"] == ids["channel"]) & (sent["ts"].cast("timestamp_ntz") == ids["at"].cast("timestamp_ntz"))).select("event_id", "event", "recovery")


# functions ---------------------------------------------------------------------------------------------------------


@query("runs", "SELECT id, CASE WHEN d < 60 THEN d || ' s' WHEN d < 3600 THEN (d // 60) || ' min' WHEN (d % 3600) // 60 = 0 THEN (d // 3600) || ' h' ELSE (d // 3600) || ' h ' || ((d % 3600) // 60) || ' min' END AS human FROM (SELECT id, duration_millis // 20 AS d FROM runs)")
def human_durations(v):
    return v.runs.select("id", text.human_duration(F.expr("duration_millis div 20")).alias("human"))


@query("runs", "SELECT id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || ((s % 3600) // 60) || 'm' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm' || (s % 60) || 's' ELSE s || 's' END AS compact FROM (SELECT id, duration_millis // 100 AS s FROM runs)")
def compact_durations(v):
    return v.runs.select("id", text.compact_duration(F.expr("(duration_millis div 100) * 1000")).alias("compact"))


@query("packages", "SELECT object_key, line, part, CASE WHEN size >= 1048576 THEN printf('%.1f MiB', size / 1048576) WHEN size >= 1024 THEN printf('%.1f KiB', size / 1024) ELSE size || ' B' END AS human FROM packages")
def human_sizes(v):
    return v.packages.select("object_key", "line", "part", text.human_bytes("size").alias("human"))


DESCRIBED = ", d AS (SELECT site_name, count(*) FILTER (seq % 3 <> 0) AS total, count(*) FILTER (status = 'failed' AND seq % 3 <> 0) AS failed, count(*) FILTER (status = 'partial' AND seq % 3 <> 0) AS partial FROM runs WHERE strftime(started_at, '%Y-%m') = '1997-06' GROUP BY site_name) "


@query("runs", DESCRIBED + """SELECT site_name, CASE WHEN total = 0 THEN 'We have not detected any backup runs for this period.' || chr(10) || chr(10) || '**Recommended steps:**' || chr(10) || '1. Verify that your application schedule or cron job is actively running.' || chr(10) || '2. Ensure the P history database is accessible.'
 WHEN failed > 0 THEN 'Backup activity was recorded, but we detected **' || failed || ' failed run(s)** during this period.' || chr(10) || chr(10) || '**Recommended steps:**' || chr(10) || '1. Check your storage configuration destination (`dest-1`).' || chr(10) || '2. Inspect the failed backup logs and attempt to force a backup by running `p backup run ' || site_name || ' --force` to ensure the backup process is functioning correctly.'
 WHEN partial > 0 THEN 'Backup activity was recorded, but we detected **' || partial || ' incomplete run(s)** during this period. Some source entries were not included.' || chr(10) || chr(10) || '**Recommended steps:**' || chr(10) || '1. Check the source data and local backup logs.' || chr(10) || '2. Run `p backup run ' || site_name || ' --force` to complete the snapshot.'
 ELSE 'All scheduled backup activities were recorded successfully for this period. No further action is required.' END AS description FROM d""")
def report_descriptions(v):
    own = v.runs.where("date_format(started_at, 'yyyy-MM') = '1997-06'").groupBy("site_name").agg(F.count_if(F.expr("seq % 3 <> 0")).alias("total"), F.count_if(F.expr("status = 'failed' AND seq % 3 <> 0")).alias("failed"), F.count_if(F.expr("status = 'partial' AND seq % 3 <> 0")).alias("partial"))
    return own.select("site_name", text.report_description(F.col("total"), F.col("failed"), F.col("partial"), F.lit("dest-1"), "site_name", "P", "p").alias("description"))


@query("runs", "SELECT id, CASE status WHEN 'success' THEN 'Backup succeeded' WHEN 'failed' THEN 'Backup failed' WHEN 'partial' THEN 'Backup incomplete' WHEN 'cancelled' THEN 'Backup cancelled' WHEN 'skipped' THEN 'Backup skipped' WHEN 'no_change' THEN 'No changes detected' ELSE status END || ' for ' || site_name AS headline FROM runs")
def headlines(v):
    return v.runs.select("id", text.headline("status", "site_name").alias("headline"))


MESSAGES = "CASE seq % 6 WHEN 0 THEN 'Lost connection to server' WHEN 1 THEN 'Incorrect key file for table' WHEN 2 THEN 'open /var/lib/x: denied' WHEN 3 THEN 'see https://host/a?b=1' WHEN 4 THEN 'password=abc, rest' ELSE '' END"


@query("runs", f", m AS (SELECT id, {MESSAGES} AS message FROM runs) SELECT id, CASE WHEN contains(message, 'Lost connection') THEN 'transient' WHEN contains(message, 'Incorrect key') THEN 'corruption' ELSE 'other' END AS class FROM m")
def error_classes(v):
    return v.runs.select("id", text.error_class(F.expr(MESSAGES)).alias("class"))


@query("runs", f", m AS (SELECT id, {MESSAGES} AS message FROM runs) SELECT id, regexp_replace(regexp_replace(regexp_replace(message, 'https?://[^\\s]+', '<redacted-url>', 'g'), 'password=[^\\s,;]+', 'password=<redacted>', 'g'), '(^|\\s)/[^\\s,;:]+', '\\1<redacted-path>', 'g') AS redacted, CASE WHEN message = '' THEN '-' WHEN message LIKE '%/%' OR message LIKE '%password%' THEN '[redacted]' ELSE message END AS field FROM m")
def redaction(v):
    return v.runs.select("id", text.redact(F.expr(MESSAGES)).alias("redacted"), text.safe_field(F.expr(MESSAGES)).alias("field"))


@query("files", "SELECT path, regexp_matches(path, '^/src1(/.*)?$') OR regexp_matches(path, '^/src2/fr(/.*)?$') OR regexp_matches(path, '/[^/]*9$') OR regexp_matches(path, '^/src[34]/de/1[^/]*$') AS excluded FROM files")
def exclude_match(v):
    return v.files.select("path", paths.excluded("path", ["/src1", "src2/fr/**", "*9", "/src[34]/de/1*"], "/").alias("excluded"))


@query("objects", "SELECT key, key <> '' AND NOT contains(key, '\\') AND NOT starts_with(key, '/') AND len(list_filter(string_split(key, '/'), lambda x: x IN ('', '.', '..'))) = 0 AS safe, regexp_matches(site_name, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AS safe_name FROM (SELECT site_name, CASE WHEN size % 5 = 0 THEN '../' || key WHEN size % 5 = 1 THEN '/' || key ELSE key END AS key FROM objects)")
def key_safety(v):
    own = v.objects.withColumn("key", F.when(F.col("size") % 5 == 0, F.concat(F.lit("../"), "key")).when(F.col("size") % 5 == 1, F.concat(F.lit("/"), "key")).otherwise(F.col("key")))
    return own.select("key", paths.safe_key("key").alias("safe"), paths.safe_name("site_name").alias("safe_name"))


@query("runs", """, s AS (SELECT id, CAST(duration_millis * 20000000 AS BIGINT) AS size FROM runs), p AS (SELECT id, size, CASE WHEN size > 5497558138880 THEN NULL WHEN size // 8388608 >= 10000 THEN size // 10000 + 1 ELSE 8388608 END AS part FROM s)
SELECT id, part AS part_size, CASE WHEN part IS NOT NULL THEN greatest(1, (size + part - 1) // part) END AS parts FROM p""")
def multipart_plan(v):
    own = v.runs.select("id", (F.col("duration_millis") * 20_000_000).alias("size"))
    return own.select("id", numbers.part_size("size").alias("part_size"), F.when(numbers.part_size("size").isNotNull(), numbers.parts("size")).alias("parts"))


@query("runs", ", s AS (SELECT id, (duration_millis - 100000) * 10000 AS size FROM runs) SELECT id, CASE WHEN size > 0 THEN size + greatest(size // 10, 67108864) END AS needed FROM s")
def temporary_space(v):
    return v.runs.select("id", numbers.space_needed((F.col("duration_millis") - 100_000) * 10_000).alias("needed"))


@query("", "SELECT event_id, sha256('s' || chr(0) || user_id || chr(0) || 'full' || chr(0) || event_type) AS key FROM events")
def incident_keys(v):
    return v.events.select("event_id", text.incident_key(F.lit("s"), F.col("user_id").cast("string"), F.lit("full"), F.col("event_type")).alias("key"))


# notifications, listings and formats ---------------------------------------------------------------------------------

COPIES = """
, copies AS (SELECT run_id, source_kind, source_name, arg_min(size, (destination, object_key, size)) AS size, arg_min(object_key, (destination, object_key, size)) AS key FROM packages WHERE status = 'stored' GROUP BY run_id, source_kind, source_name),
told AS (SELECT run_id, count(*) AS items, CAST(sum(size) AS BIGINT) AS bytes, array_to_string((list(key ORDER BY source_kind, source_name))[1:2], ',') AS keys FROM copies GROUP BY run_id) """


@query("packages", COPIES + "SELECT * FROM told")
def notify_payload(v):
    return history.payload(v.packages, 2).select("run_id", "items", "bytes", F.array_join("keys", ",").alias("keys"))


@query("runs packages", COPIES + f""", d AS (SELECT r.id, r.seq, r.status, {CATEGORY} AS category, seq % 10 = 0 AS recovery, coalesce(items, 0) AS items, coalesce(bytes, 0) AS bytes FROM runs r LEFT JOIN told ON r.id = told.run_id),
p AS (SELECT *, CASE WHEN items = 0 THEN '' ELSE ' ' || items || CASE WHEN items = 1 THEN ' item (' ELSE ' items (' END || CASE WHEN bytes >= 1048576 THEN printf('%.1f MiB', bytes / 1048576) WHEN bytes >= 1024 THEN printf('%.1f KiB', bytes / 1024) ELSE bytes || ' B' END || CASE WHEN items = 1 THEN ') was prepared.' ELSE ') were prepared.' END END AS prepared FROM d)
SELECT id, CASE WHEN recovery THEN 'A complete backup is available again. The previous backup incident has recovered.' WHEN status = 'success' THEN 'The backup completed successfully.' || prepared
 WHEN status = 'partial' THEN 'The snapshot was saved, but ' || (seq % 5) || ' source entries could not be read. Run the backup again to complete it.'
 WHEN status = 'skipped' AND seq % 2 = 0 THEN 'No backup was created because minimum_interval has not elapsed since the last successful backup.'
 WHEN status = 'no_change' THEN 'The new backup is identical to the last one.' || CASE WHEN seq % 3 = 0 THEN ' Likely an idle app, or the database dump silently failed.' ELSE '' END
 ELSE CASE WHEN status = 'cancelled' THEN 'The backup was stopped before it finished.' WHEN status = 'skipped' THEN 'An unexpected problem stopped the backup.' WHEN category = 'config' THEN 'A setting needs attention. The backup configuration was rejected, so the backup did not run.'
  WHEN category = 'preflight' THEN 'The backup did not start. A check before the backup failed.' WHEN category = 'execution' THEN 'The backup ended with an execution error.' WHEN category = 'storage' THEN 'The backup ran but could not be saved to its destination.'
  WHEN category = 'persistence' THEN 'The backup finished but its result could not be recorded in the history database.' ELSE 'An unexpected problem stopped the backup.' END || prepared END AS description FROM p""")
def notify_descriptions(v):
    own = v.runs.join(history.payload(v.packages).withColumnRenamed("run_id", "id"), "id", "left")
    category = F.when(F.col("status") == "skipped", F.expr("CASE WHEN seq % 2 = 0 THEN 'minimum_interval' ELSE 'already_running' END")).otherwise(F.coalesce(F.expr(CATEGORY), F.lit("")))
    told = text.description(F.col("status"), category, F.coalesce("items", F.lit(0)), F.coalesce("bytes", F.lit(0)), F.expr("seq % 5"), F.expr("seq % 10 = 0"), F.expr("seq % 3 = 0"))
    return own.select("id", told.alias("description"))


@query("packages", "SELECT run_id, max(line % 7) AS files_skipped FROM packages GROUP BY run_id")
def max_skipped(v):
    return history.max_skipped(v.packages.select("run_id", "destination", F.expr("line % 7").alias("files_skipped")))


@query("runs packages sites storages site_destinations", """
, per_source AS (SELECT run_id, max(size) AS size FROM packages GROUP BY run_id, source_kind, source_name),
sums AS (SELECT run_id, CAST(sum(size) AS BIGINT) AS bytes FROM per_source GROUP BY run_id),
good AS (SELECT site_name, count(*) AS successes, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM runs JOIN sums ON runs.id = sums.run_id WHERE status = 'success' GROUP BY site_name),
places AS (SELECT site_name, string_agg(destination || ' (' || type || ')', ', ' ORDER BY destination) AS destinations FROM site_destinations JOIN storages ON destination = storages.name GROUP BY site_name)
SELECT s.name, backup_mode, keep_last, coalesce(total_bytes, 0) AS total_bytes, coalesce(destinations, '') AS destinations FROM sites s LEFT JOIN good ON s.name = good.site_name LEFT JOIN places p ON s.name = p.site_name""")
def site_overview(v):
    return history.site_overview(v.sites, v.runs, v.packages, v.site_destinations, v.storages).select("name", "backup_mode", "keep_last", "total_bytes", "destinations")


@query("sites runs locks", "SELECT name FROM sites UNION SELECT site_name FROM runs WHERE status = 'running' UNION SELECT site_name FROM locks")
def site_names(v):
    return history.site_names(v.sites, v.runs, v.locks)


@query("tables", CHECKS + "SELECT bool_and(healthy) AS healthy FROM health")
def overall_health(v):
    return operations.overall_health(operations.table_health(v.tables, checks(v)))


@query("snapshots edges leaf_content index_entries pack_files", REACH + """
, x AS (SELECT pack_id, bool_or(id IN (SELECT id FROM live)) AS alive FROM index_entries GROUP BY 1)
SELECT count(*) AS packs_removed, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes_reclaimed FROM x FULL JOIN pack_files p ON x.pack_id = p.pack_id WHERE alive IS NOT TRUE""")
def reclaimed(v):
    return graph.reclaimed(graph.sweep_plan(v.index_entries, v.pack_files, graph.mark(v.snapshots.where("k IN (1, 2)"), nodes(v))))


@query("snapshots edges leaf_content index_entries pack_files blobs", FINDINGS.rstrip() + """,
r6(snapshot_id, tree) AS (SELECT id, tree FROM snapshots UNION SELECT r.snapshot_id, e.subtree FROM r6 r JOIN edges e ON r.tree = e.tree),
lost AS (SELECT tree AS id, snapshot_id FROM r6 UNION SELECT c.id, r.snapshot_id FROM r6 r JOIN leaf_content c ON r.tree = c.tree WHERE c.id NOT IN (SELECT id FROM ix)),
every_line AS (SELECT 'missing_blob ' || id || ' (snapshot ' || min(snapshot_id) || ')' AS line FROM lost GROUP BY id
 UNION ALL SELECT 'missing_pack ' || pack_id || ' (' || count(*) || ' blobs)' FROM ix WHERE pack_id NOT IN (SELECT pack_id FROM pack_files) GROUP BY pack_id),
placed AS (SELECT row_number() OVER (ORDER BY line) AS position, line FROM every_line)
SELECT position, line FROM placed WHERE position <= 20 UNION ALL SELECT 21, 'and ' || (count(*) - 20) || ' more findings (see --findings-file)' FROM placed HAVING count(*) > 20""")
def finding_lines(v):
    index = headers(v, every=True).join(v.index_entries.select("index_id", "id"), "id").drop("compressed", "ordinal")
    found = integrity.missing(v.snapshots, nodes(v), index).unionByName(integrity.missing_packs(index, v.pack_files))
    return integrity.report_lines(found, 20).select(F.col("position").cast("bigint").alias("position"), "line")


@query("files", """
SELECT path, CASE WHEN doc_id % 10 >= 8 THEN 'missing' WHEN doc_id % 4 = 0 THEN 'size' WHEN doc_id % 7 = 0 THEN 'checksum' ELSE 'ok' END AS state FROM files""")
def package_verify(v):
    have = v.files.where("doc_id % 10 < 8").selectExpr("path AS key", "coalesce(size, 0) + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS size", "CASE WHEN doc_id % 5 <> 0 OR doc_id % 7 = 0 THEN concat(coalesce(id, ''), CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END) END AS sha256")
    return inventory.verify_packages(have, v.files.selectExpr("path AS key", "coalesce(size, 0) AS size", "coalesce(id, '') AS sha256")).select(F.col("key").alias("path"), "state")


MOVED = "SELECT index_id, pack_id, type, id, 0 AS \"offset\", length FROM index_entries UNION ALL SELECT CASE WHEN substring(id, 5, 1) = '1' THEN 'iz' ELSE 'ia' END, 'moved', type, id, 0, length FROM index_entries WHERE substring(id, 4, 1) = '0'"


@query("index_entries", f", moved AS ({MOVED}) SELECT type, id, arg_max(pack_id, index_id) AS pack_id FROM moved GROUP BY type, id")
def latest_index(v):
    moved = v.index_entries.where("substring(id, 4, 1) = '0'").selectExpr("CASE WHEN substring(id, 5, 1) = '1' THEN 'iz' ELSE 'ia' END AS index_id", "'moved' AS pack_id", "type", "id", "length")
    return snapshots.latest_index(v.index_entries.unionByName(moved).withColumn("offset", F.lit(0))).select("type", "id", "pack_id")


@query("", """WITH e AS (SELECT n_nationkey AS k, CASE n_regionkey WHEN 0 THEN 'backup_succeeded' WHEN 1 THEN 'no_change' WHEN 2 THEN 'backup_skipped' WHEN 3 THEN 'backup_failed' ELSE 'backup_partial' END AS event FROM nation),
r AS (SELECT event, 'c' || (k % 8) AS channel FROM e), p AS (SELECT DISTINCT channel FROM r WHERE event IN ('backup_failed', 'backup_partial') AND channel NOT IN ('c2', 'c5'))
SELECT event, channel FROM r UNION SELECT 'backup_succeeded', channel FROM p UNION SELECT 'no_change', channel FROM p""")
def recovery_routes(v):
    routed = v.nation.selectExpr("CASE n_regionkey WHEN 0 THEN 'backup_succeeded' WHEN 1 THEN 'no_change' WHEN 2 THEN 'backup_skipped' WHEN 3 THEN 'backup_failed' ELSE 'backup_partial' END AS event", "'c' || (n_nationkey % 8) AS channel")
    channels = v.nation.where("n_nationkey < 8").selectExpr("'c' || n_nationkey AS name", "CASE WHEN n_nationkey IN (2, 5) THEN 'webhook' ELSE 'smtp' END AS type")
    return incidents.recovery_routes(routed, channels)


@query("event_runs", """
, l AS (SELECT id, CAST(id AS BIGINT) AS done, lag(CAST(id AS BIGINT)) OVER w AS before, (epoch_us(started_at) - epoch_us(lag(started_at) OVER w)) / 1e6 AS spent FROM event_runs WINDOW w AS (PARTITION BY site_name ORDER BY started_at, CAST(id AS BIGINT))),
r AS (SELECT id, done, CASE WHEN spent > 0 THEN (done - before) / spent END AS rate FROM l)
SELECT id, CAST(floor(rate * 1000) AS BIGINT) AS millirate, CAST(floor(CASE WHEN rate > 0 THEN greatest(0, 1000000 - done) / rate END) AS BIGINT) AS seconds_left FROM r""")
def progress_rates(v):
    own = v.event_runs.select("id", F.col("site_name").alias("run_id"), F.col("started_at").alias("at"), F.col("id").cast("bigint").alias("done"), F.lit(1_000_000).alias("total"))
    return operations.rates(own).select("id", F.floor(F.col("rate") * 1000).alias("millirate"), F.floor("seconds_left").alias("seconds_left"))


@query("files", """
SELECT path, substring(given, 1, 8) AS short_id, regexp_full_match(given, '[0-9a-fA-F]{64}') AS valid, chr(96) || replace(named, chr(96), chr(96) || chr(96)) || chr(96) AS quoted, split_part(path, '/', -1) AS base,
 named IN ('', '.', '..') OR contains(named, '/') OR doc_id % 3 = 0 AS unsafe
FROM (SELECT path, doc_id, CASE doc_id % 3 WHEN 0 THEN upper(id) WHEN 1 THEN id || '0' ELSE id END AS given, CASE doc_id % 5 WHEN 0 THEN '..' WHEN 1 THEN source || '/' || lang WHEN 2 THEN '' ELSE source || chr(96) || lang END AS named FROM files) f""")
def file_formats(v):
    given = F.expr("CASE doc_id % 3 WHEN 0 THEN upper(id) WHEN 1 THEN id || '0' ELSE id END")
    named = F.expr("CASE doc_id % 5 WHEN 0 THEN '..' WHEN 1 THEN source || '/' || lang WHEN 2 THEN '' ELSE source || '`' || lang END")
    unsafe = paths.unsafe_node(named, F.lit("file"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 'tree' END"))
    return v.files.select("path", text.short_id(given).alias("short_id"), text.valid_id(given).alias("valid"), text.quote_identifier(named).alias("quoted"), paths.root_name("path").alias("base"), unsafe.alias("unsafe"))


@query("runs", """
SELECT id, strftime(started_at, '%Y-%m-%dT%H:%M:%SZ') AS at, (seq % 3) || CASE WHEN seq % 3 = 1 THEN ' item' ELSE ' items' END AS items, 'a/' || site_name AS prefix, CASE WHEN seq % 4 = 0 THEN site_name END AS site,
 CASE seq % 4 WHEN 0 THEN 'backups/' || site_name || '/x' WHEN 1 THEN 'backups/' || site_name ELSE 'x' END AS key_given FROM runs""")
def run_formats(v):
    key = F.expr("CASE seq % 4 WHEN 0 THEN 'backups/' || site_name || '/x' WHEN 1 THEN 'backups/' || site_name ELSE 'x' END")
    return v.runs.select("id", text.utc_text("started_at").alias("at"), text.plural(F.expr("seq % 3"), "item").alias("items"), paths.join_prefix("/a/", F.col("site_name"), "").alias("prefix"), paths.site_of_key(key, "backups").alias("site"), key.alias("key_given"))


@query("files", "SELECT doc_id AS position, path, lang || CASE WHEN nr = 1 THEN '' ELSE '-' || (nr - 1) END AS name FROM (SELECT doc_id, parent AS path, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nr FROM files) f")
def unique_names(v):
    return snapshots.unique_names(v.files.select(F.col("doc_id").alias("position"), F.col("parent").alias("path"))).select("position", "path", "name")


@query("runs", """
, s AS (SELECT id, site_name AS site, CASE seq % 4 WHEN 0 THEN 'local' WHEN 1 THEN 's3' WHEN 2 THEN 'r2' ELSE 'ftp' END AS type, CASE WHEN seq % 5 = 0 THEN '' ELSE '/data/' END AS directory, CASE WHEN seq % 7 = 0 THEN '' ELSE 'b' END AS bucket,
 CASE seq % 3 WHEN 0 THEN '' WHEN 1 THEN 'store.example/' ELSE 'http://store.example' END AS endpoint, CASE WHEN seq % 11 < 5 THEN '' ELSE 'p/q' END AS prefix, CASE WHEN seq % 13 < 6 THEN '' ELSE 'srv' END AS server FROM runs),
b AS (SELECT *, CASE WHEN server = '' THEN 'repository/' || site ELSE 'backups/srv/' || site || '/incremental-backup' END AS below FROM s)
SELECT id, CASE WHEN type = 'local' AND directory <> '' THEN '/data/' || below WHEN type IN ('s3', 'r2') AND bucket <> '' THEN 's3:' || CASE endpoint WHEN '' THEN 's3.amazonaws.com' WHEN 'store.example/' THEN 'https://store.example' ELSE endpoint END || '/b/' || CASE WHEN prefix = '' THEN '' ELSE 'p/q/' END || below END AS url FROM b""")
def repository_urls(v):
    own = v.runs.selectExpr(
        "id", "site_name AS site", "CASE seq % 4 WHEN 0 THEN 'local' WHEN 1 THEN 's3' WHEN 2 THEN 'r2' ELSE 'ftp' END AS type", "CASE WHEN seq % 5 = 0 THEN '' ELSE '/data/' END AS directory", "CASE WHEN seq % 7 = 0 THEN '' ELSE 'b' END AS bucket",
        "CASE seq % 3 WHEN 0 THEN '' WHEN 1 THEN 'store.example/' ELSE 'http://store.example' END AS endpoint", "CASE WHEN seq % 11 < 5 THEN '' ELSE 'p/q' END AS prefix", "CASE WHEN seq % 13 < 6 THEN '' ELSE 'srv' END AS server",
    )
    return own.select("id", paths.repository_url(own).alias("url"))


@query("files", "SELECT path, CAST(coalesce(size, 0) AS BIGINT) AS bytes FROM files")
def chunk_bytes(v):
    """Chunks cover each file from its start to its end; empty files have none."""
    chunks = chunking.chunk_files(v.files.select("path", F.encode("text", "UTF-8").alias("content")), least=512, most=8192, bits=10)
    return v.files.select("path").join(chunks.groupBy("path").agg(F.sum("length").alias("bytes"), F.avg("length").alias("mean")), "path", "left").select("path", F.coalesce("bytes", F.lit(0)).alias("bytes"))


# renderers, documents and single steps ---------------------------------------------------------------------------------

HUMAN = "CASE WHEN {0} >= 1099511627776 THEN printf('%.1f TiB', {0} / 1099511627776) WHEN {0} >= 1073741824 THEN printf('%.1f GiB', {0} / 1073741824) WHEN {0} >= 1048576 THEN printf('%.1f MiB', {0} / 1048576) WHEN {0} >= 1024 THEN printf('%.1f KiB', {0} / 1024) ELSE {0} || ' B' END"
LASTED = """CASE WHEN duration_millis = 0 THEN '0s' WHEN duration_millis < 1000 THEN duration_millis || 'ms' ELSE CASE WHEN duration_millis >= 3600000 THEN duration_millis // 3600000 || 'h' ELSE '' END
 || CASE WHEN duration_millis >= 60000 THEN duration_millis % 3600000 // 60000 || 'm' ELSE '' END || duration_millis % 60000 // 1000 || CASE WHEN duration_millis % 1000 = 0 THEN '' ELSE rtrim('.' || lpad(CAST(duration_millis % 1000 AS VARCHAR), 3, '0'), '0') END || 's' END"""


@query("runs packages", f"""
, per AS (SELECT run_id, max(size) AS size FROM packages GROUP BY run_id, source_kind, source_name), sums AS (SELECT run_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM per GROUP BY run_id),
places AS (SELECT run_id, count(DISTINCT destination) AS d FROM packages GROUP BY run_id),
cells AS (SELECT started_at, id, status AS c0, site_name AS c1, strftime(started_at, '%d-%B-%Y') AS c2, CASE WHEN status = 'running' THEN 'in progress' ELSE {LASTED} END AS c3,
 CAST(coalesce(n, 0) AS VARCHAR) AS c4, CAST(coalesce(d, 0) AS VARCHAR) AS c5, {HUMAN.format("coalesce(bytes, 0)")} AS c6 FROM runs LEFT JOIN sums s ON id = s.run_id LEFT JOIN places p ON id = p.run_id),
w AS (SELECT greatest(6, max(length(c0))) AS w0, greatest(4, max(length(c1))) AS w1, greatest(7, max(length(c2))) AS w2, greatest(8, max(length(c3))) AS w3, greatest(8, max(length(c4))) AS w4, greatest(12, max(length(c5))) AS w5, greatest(12, max(length(c6))) AS w6 FROM cells),
total AS (SELECT count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT 1 AS one, max(size) AS bytes FROM packages SEMI JOIN runs ON run_id = runs.id GROUP BY run_id, source_kind, source_name) x)
SELECT 0 AS section, '' AS run_id, rpad('STATUS', CAST(w0 + 2 AS INT), ' ') || rpad('SITE', CAST(w1 + 2 AS INT), ' ') || rpad('STARTED', CAST(w2 + 2 AS INT), ' ') || rpad('DURATION', CAST(w3 + 2 AS INT), ' ') || rpad('PACKAGES', CAST(w4 + 2 AS INT), ' ') || rpad('DESTINATIONS', CAST(w5 + 2 AS INT), ' ') || rpad('LOGICAL SIZE', CAST(w6 + 2 AS INT), ' ') || 'RUN ID' AS line FROM w
UNION ALL SELECT 1, id, rpad(c0, CAST(w0 + 2 AS INT), ' ') || rpad(c1, CAST(w1 + 2 AS INT), ' ') || rpad(c2, CAST(w2 + 2 AS INT), ' ') || rpad(c3, CAST(w3 + 2 AS INT), ' ') || rpad(c4, CAST(w4 + 2 AS INT), ' ') || rpad(c5, CAST(w5 + 2 AS INT), ' ') || rpad(c6, CAST(w6 + 2 AS INT), ' ') || id FROM cells, w
UNION ALL SELECT 2, id, 'Run ' || id || CASE WHEN status = 'partial' OR status = 'success' AND error_message <> '' OR status = 'no_change' AND error_category = 'retention' AND error_message <> '' THEN ' warning [' ELSE ' error [' END
 || CASE WHEN error_category = '' THEN 'unknown' ELSE error_category END || ']: ' || CASE WHEN error_message = '' THEN 'message unavailable' ELSE error_message END FROM runs
 WHERE status IN ('failed', 'partial', 'cancelled') OR status = 'success' AND error_message <> '' OR status = 'no_change' AND error_category = 'retention' AND error_message <> ''
UNION ALL SELECT 3, '', chr(10) || r.n || ' runs, ' || t.n || ' logical packages, ' || d.n || ' destinations, ' || {HUMAN.format("t.bytes")} || ' logical total'
 FROM total t, (SELECT count(*) AS n FROM runs) r, (SELECT count(DISTINCT destination) AS n FROM packages SEMI JOIN runs ON run_id = runs.id) d""")
def history_text(v):
    return history.history_lines(v.runs, v.packages).select("section", F.coalesce("run_id", F.lit("")).alias("run_id"), "line")


@query("index_entries pack_files", """
, f AS (SELECT 'missing_pack' AS type, pack_id FROM (SELECT DISTINCT pack_id FROM index_entries) x WHERE pack_id NOT IN (SELECT pack_id FROM pack_files) UNION ALL SELECT 'broken_snapshot', NULL FROM region WHERE r_regionkey > 2),
k AS (SELECT type, count(*) AS n FROM f GROUP BY type) SELECT 'check shop/home: ' || CASE WHEN count(*) = 0 THEN 'healthy' ELSE 'problems found (' || string_agg(n || ' ' || type, ', ' ORDER BY type) || ')' END AS line FROM k""")
def check_summary(v):
    broken = integrity.broken_snapshots(v.region.selectExpr("'snap-' || r_regionkey AS id", "CASE WHEN r_regionkey > 2 THEN NULL ELSE 'root' END AS tree"))
    lost = integrity.missing_packs(v.index_entries.withColumn("offset", F.lit(0)), v.pack_files)
    return integrity.check_summary(broken.unionByName(lost), "shop", "home")


@query("index_entries pack_files", "SELECT DISTINCT pack_id FROM index_entries WHERE pack_id NOT IN (SELECT pack_id FROM pack_files)")
def new_packs(v):
    return integrity.new_packs(v.index_entries, v.pack_files)


@query("files", "SELECT path, 'in' AS state FROM files WHERE parent = '/src1/en' OR starts_with(path, '/src2/') OR path = '/src3' UNION ALL SELECT '/src', 'lost' UNION ALL SELECT '/src1/e', 'lost' UNION ALL SELECT '/src3/none', 'lost'")
def include_check(v):
    inside, lost = paths.included(v.files, ["/src1/en", "/src2", "/src", "/src1/e", "/src3/none"])
    return inside.select("path", F.lit("in").alias("state")).unionByName(lost.select(F.col("include").alias("path"), F.lit("lost").alias("state")))


@query("files", "SELECT path, parent = base OR starts_with(parent, base || '/') AS inside FROM (SELECT path, parent, CASE doc_id % 3 WHEN 0 THEN '/' || source WHEN 1 THEN parent ELSE substring(parent, 1, 5) END AS base FROM files) f")
def path_containment(v):
    base = F.expr("CASE doc_id % 3 WHEN 0 THEN '/' || source WHEN 1 THEN parent ELSE substring(parent, 1, 5) END")
    return v.files.select("path", paths.contains(base, F.col("parent")).alias("inside"))


@query("files", "SELECT id FROM (SELECT DISTINCT id FROM files) f WHERE starts_with(id, '0') AND (SELECT count(DISTINCT id) FROM files WHERE starts_with(id, '0')) = 1 UNION ALL SELECT min(id) FROM files")
def resolve_prefix(v):
    """An id's beginning names it if it is the only one; a whole id always does."""
    ids = v.files.select("id").where("id IS NOT NULL").distinct()
    least = v.spark.sql("SELECT min(id) AS id FROM {f}", f=ids)
    whole = ids.join(least, "id", "left_semi")
    return snapshots.resolve(ids, "0").unionByName(snapshots.resolve(whole, ""))


@query("runs packages", """
SELECT destination AS name, count(*) AS total_packages, count(*) FILTER (status = 'stored') AS stored, count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(size) FILTER (status = 'stored'), 0) AS BIGINT) AS total_bytes
FROM packages SEMI JOIN runs ON run_id = runs.id GROUP BY destination""")
def merged_destinations(v):
    """Summaries of two halves of the runs, as one: partial results merge to what the whole gives."""
    halves = [report.by_destination(v.runs.where(f"seq % 2 = {k}"), v.packages) for k in (0, 1)]
    return report.merge_destinations(*halves)


ENDS = "started_at + INTERVAL '1' SECOND * (CAST(seq AS INT) % 100 - 20)"


@query("runs", f"""
, e AS (SELECT id, started_at, duration_millis AS had, status AS was, seq % 3 = 0 AS ends, {ENDS} AS done FROM runs)
SELECT id, CASE WHEN ends THEN 'success' ELSE was END AS status, CASE WHEN ends THEN greatest(0, (epoch_us(done) - epoch_us(started_at)) // 1000) ELSE had END AS duration_millis FROM e
UNION ALL SELECT 'given-' || n_nationkey, 'running', 0 FROM nation""")
def run_ends(v):
    """Runs that are created and end: what lasted less than nothing lasted nothing, and the latest end of a run counts."""
    known = v.runs.select("id", "seq", "started_at", "status", "finished_at", "error_category", "error_message", "duration_millis")
    ends = known.where("seq % 3 = 0").selectExpr("id", "'success' AS status", f"{ENDS} AS finished_at", "'' AS error_category", "'' AS error_message")
    early = ends.selectExpr("id", "'failed' AS status", "finished_at - INTERVAL '1' MINUTE AS finished_at", "error_category", "error_message")
    new = v.nation.selectExpr("'given-' || n_nationkey AS id", "n_nationkey AS seq", "TIMESTAMP_NTZ '2026-01-01' AS started_at", "'running' AS status", "CAST(NULL AS TIMESTAMP_NTZ) AS finished_at", "'' AS error_category", "'' AS error_message", "CAST(0 AS BIGINT) AS duration_millis")
    return history.finish_runs(history.create_run(known, new), ends.unionByName(early)).select("id", "status", "duration_millis")


@query("runs", """
SELECT id, 'outer' || CASE WHEN error_message = '' THEN '' ELSE ': ' || error_message END AS chain, CASE WHEN seq % 4 = 0 THEN repeat('x', 200) WHEN seq % 4 = 1 THEN repeat('é', 100) ELSE site_name END AS first,
 '```' || chr(10) || CASE WHEN seq % 2 = 0 THEN repeat('y', 1015) || '…' ELSE '''''''' || repeat('y', 4) END || chr(10) || '```' AS fenced FROM runs""")
def message_texts(v):
    stderr = F.expr("concat('\\n  \\n ', CASE WHEN seq % 4 = 0 THEN repeat('x', 300) WHEN seq % 4 = 1 THEN repeat('é', 101) ELSE site_name END, ' \\nnext')")
    block = F.expr("CASE WHEN seq % 2 = 0 THEN repeat('y', 2000) ELSE concat('```', repeat('y', 4)) END")
    return v.runs.select("id", text.cause_chain(F.array(F.lit("outer"), F.concat(F.lit(" "), "error_message"), F.lit("outer"))).alias("chain"), text.first_line(stderr).alias("first"), text.fence(block).alias("fenced"))


@query("tables", "SELECT full_name AS table_name, 'check' AS op, CASE WHEN p_size % 9 = 0 THEN 'error' ELSE 'status' END AS type, 'a' || chr(9) || 'b' AS message FROM tables WHERE p_partkey % 5 <> 0")
def check_lines(v):
    lines = v.tables.selectExpr("CASE WHEN p_partkey % 5 = 0 THEN concat(full_name, '\\t', 'noise') ELSE concat_ws('\\t', full_name, 'check', CASE WHEN p_size % 9 = 0 THEN 'error' ELSE 'status' END, 'a', 'b') END AS line")
    return operations.parse_checks(lines)


@query("runs", "SELECT id, strftime(started_at + INTERVAL 3 HOUR, '%d-%B-%Y/%H.%M.%S') || CASE WHEN seq % 3 = 0 THEN '' ELSE '-' || substring('ab' || lpad(id, 12, '0'), 1, 8) END || '-files.tar.gz' AS key FROM runs")
def package_keys(v):
    run = F.expr("CASE WHEN seq % 3 = 0 THEN '' ELSE 'a-b' || lpad(id, 12, '0') END")
    return v.runs.select("id", inventory.format_key(F.col("started_at"), F.lit("files.tar.gz"), run, "Etc/GMT-3").alias("key"))


@query("index_entries", "SELECT index_id, pack_id, type, id, 7 AS \"offset\", length, CASE WHEN substring(id, 4, 1) < '8' THEN length + 1 ELSE 0 END AS uncompressed_length FROM index_entries")
def index_decode(v):
    """Documents of indexes, one for each, decoded into the rows that they were made of."""
    blob = F.struct("id", "type", F.lit(7).alias("offset"), "length", F.when(F.expr("substring(id, 4, 1) < '8'"), F.col("length") + 1).alias("uncompressed_length"))
    packs = v.index_entries.groupBy("index_id", "pack_id").agg(F.collect_list(blob).alias("blobs")).groupBy("index_id").agg(F.collect_list(F.struct(F.col("pack_id").alias("id"), "blobs")).alias("packs"))
    return repository.index_entries(packs.select(F.lit("index").alias("kind"), F.col("index_id").alias("id"), F.lit("ok").alias("status"), F.to_json(F.struct("packs")).alias("document")))


@query("runs", "SELECT id, CASE WHEN seq % 10 <> 0 THEN strftime(started_at, '%Y-%m-%d %H:%M:%S') END AS time, 'tree-' || id AS tree, site_name AS tag, CASE WHEN seq % 2 = 0 THEN duration_millis ELSE 0 END AS bytes FROM runs WHERE seq % 7 <> 0")
def snapshot_decode(v):
    """Documents of snapshots: broken ones are left out, times that aren't are null, unknown fields are passed over."""
    at = F.when(F.expr("seq % 10 = 0"), "soon").otherwise(text.utc_text("started_at"))
    doc = F.struct(at.alias("time"), F.concat(F.lit("tree-"), "id").alias("tree"), F.array("site_name").alias("tags"), F.struct(F.expr("CASE WHEN seq % 2 = 0 THEN duration_millis END").alias("total_bytes_processed")).alias("summary"), F.lit(1).alias("other"))
    docs = v.runs.select(F.lit("snapshot").alias("kind"), "id", F.expr("CASE WHEN seq % 7 = 0 THEN 'tag differs' ELSE 'ok' END AS status"), F.to_json(doc).alias("document"))
    return repository.snapshots(docs).select("id", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), "tree", F.col("tags")[0].alias("tag"), F.coalesce("summary.total_bytes_processed", F.lit(0)).alias("bytes"))


@query("files", "SELECT parent AS tree_id, path AS name, 'file' AS type, coalesce(size, 0) AS size, 1 AS pieces, true AS ordered FROM files WHERE source <> 'src1' UNION ALL SELECT parent, path, 'file', coalesce(size, 0), 1, count(*) OVER (PARTITION BY parent) < 2 FROM files WHERE source = 'src1'")
def tree_decode(v):
    """Documents of trees, decoded into nodes; a tree whose names don't ascend says so."""
    node = F.struct(F.col("path").alias("name"), F.lit("file").alias("type"), F.coalesce("size", F.lit(0)).alias("size"), F.array(F.coalesce("id", F.lit("x"))).alias("content"))
    up = F.sort_array(F.collect_list(node))
    trees = v.files.groupBy("parent", "source").agg(up.alias("up")).select(F.col("parent").alias("tree_id"), F.to_json(F.struct(F.when(F.col("source") == "src1", F.reverse("up")).otherwise(F.col("up")).alias("nodes"))).alias("document"))
    return repository.tree_nodes(trees).select("tree_id", "name", "type", F.col("size").cast("bigint").alias("size"), F.size("content").cast("bigint").alias("pieces"), "ordered")


@query("files", "SELECT DISTINCT 'data' AS type, id, size, true AS compressed FROM files WHERE size > 0 AND substring(id, 1, 1) <> '0' UNION ALL SELECT 'tree', sha256(''), 0, false")
def saved_packs(v):
    """Texts that are saved, packed, read from their packs' own lists and opened: each comes back once, as it was."""
    keys = sealing.Keys(b"e" * 32, b"k" * 16, b"r" * 16)
    blobs = v.files.select(F.lit("data").alias("type"), F.encode("text", "UTF-8").alias("data")).where("length(data) > 0").unionByName(v.spark.range(1).select(F.lit("tree").alias("type"), F.encode(F.lit(""), "UTF-8").alias("data")))
    known = v.files.where("substring(id, 1, 1) = '0'").select(F.lit("data").alias("type"), "id")
    stored = snapshots.packs(snapshots.save_blobs(blobs, known, keys), keys, 64 << 10, 4)
    stored = graph.settled(stored)
    own = integrity.unpack(repository.pack_headers(stored.select(F.col("pack_id").alias("id"), "content"), keys), stored.select("pack_id", "content"), keys)
    return own.where(F.sha2("data", 256) == F.col("id")).select("type", "id", F.octet_length("data").cast("bigint").alias("size"), "compressed")
