"""Operational tables: locks, database tables, routes, diagnostics, schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STALE = "INTERVAL '30' MINUTE"
REPAIRABLE = ("myisam", "aria")
#: The exit code of each category of errors; any other category exits with 1.
EXIT_CODES = {"config": 2, "preflight": 3, "execution": 4, "storage": 4, "cancellation": 4}


def lock_conflicts(locks: DataFrame, mine_exclusive: bool, now) -> DataFrame:
    """locks(id, exclusive, at, readable) with what each means to a new lock: ok, remove, conflict, stale_exclusive, invalid."""
    stale = F.lit(now).cast("timestamp_ntz") - F.col("at").cast("timestamp_ntz") > F.expr(STALE)
    both_shared = ~F.col("exclusive") & F.lit(not mine_exclusive)
    meaning = F.when(~F.col("readable"), "invalid").when(both_shared, "ok").when(stale & F.col("exclusive"), "stale_exclusive").when(stale, "remove").otherwise("conflict")
    return locks.withColumn("meaning", meaning)


def stale_locks(locks: DataFrame, now) -> DataFrame:
    """What an unlock removes: stale or unreadable locks of any kind."""
    return locks.where(~F.col("readable") | (F.lit(now).cast("timestamp_ntz") - F.col("at").cast("timestamp_ntz") > F.expr(STALE)))


def parse_checks(lines: DataFrame) -> DataFrame:
    """lines(line) of tab-separated results: table, operation, kind, message; others are dropped."""
    parts = F.split("line", "\t", 4)
    return lines.where(F.size(parts) == 4).select(parts[0].alias("table_name"), parts[1].alias("op"), parts[2].alias("type"), parts[3].alias("message"))


def healthy(kind: str = "type", message: str = "message"):
    return (F.lower(F.trim(kind)) == "status") & (F.lower(F.trim(message)) == "ok")


def table_health(tables: DataFrame, checks: DataFrame) -> DataFrame:
    """A row for each of checks(table_name, op, type, message): its table's name and engine, and whether it says ok.

    A check is about the first of tables(name, engine, position) whose name it gives, alone or behind a dot;
    without one it keeps its own name and has no engine.
    """
    ends = F.expr("transform(sequence(1, size(split(table_name, '[.]'))), k -> substring_index(table_name, '.', -k))")
    first = checks.select("table_name").distinct().select("table_name", F.explode(ends).alias("__end")).join(tables.select(F.col("name").alias("__end"), F.struct("position", F.col("name").alias("table"), "engine").alias("t")), "__end").groupBy("table_name").agg(F.min("t").alias("t"))
    return checks.join(first, "table_name", "left").select(F.coalesce("t.table", "table_name").alias("name"), F.coalesce("t.engine", F.lit("")).alias("engine"), *(c for c in checks.columns if c != "table_name"), healthy().alias("healthy"))


def overall_health(health: DataFrame) -> DataFrame:
    """One row: whether every check says ok; null if there is none, which is an error of the check itself."""
    return health.agg(F.bool_and("healthy").alias("healthy"))


def repair_gate(health: DataFrame) -> DataFrame:
    """Unhealthy checks, and whether their tables are repaired: all, and only if every one's engine can be."""
    sick = health.where("NOT healthy").withColumn("repairable", F.lower("engine").isin(*REPAIRABLE))
    gate = sick.agg(F.coalesce(F.bool_and("repairable"), F.lit(True)).alias("repair"))
    return sick.crossJoin(F.broadcast(gate))  # the gate is one row


def route_channels(routes: DataFrame, channels: DataFrame) -> DataFrame:
    """routes(event, position, channels) -> event, channel in the order of first mention, unknown channels dropped."""
    flat = routes.select("event", "position", F.posexplode("channels").alias("at", "channel")).join(channels.select(F.col("name").alias("channel"), F.col("type").alias("channel_type")), "channel")
    first = flat.groupBy("event", "channel", "channel_type").agg(F.min(F.struct("position", "at")).alias("first"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy("event").orderBy("first"))).drop("first")


def doctor(checks: DataFrame) -> DataFrame:
    """checks(position, name, ok, available, message) with status: skipped where the tool is missing; passed is false if any failed."""
    status = F.when(~F.col("available"), "skipped").when(F.col("ok"), "passed").otherwise("failed")
    out = checks.withColumn("status", status)
    return out.crossJoin(F.broadcast(out.agg(F.count_if(F.col("status") == "failed").alias("failures")))).withColumn("passed", F.col("failures") == 0)


def config_findings(sites: DataFrame, storages: DataFrame, site_destinations: DataFrame) -> DataFrame:
    """Rules on the configuration: safe names, something to keep, at least one destination, only known destinations."""
    from tidemark.functions.paths import safe_name

    row = lambda df, rule: df.select(F.lit(rule).alias("rule"), F.col("name"))
    known = storages.select(F.col("name").alias("destination"))
    return (
        row(sites.where(~safe_name("name")), "unsafe_name").unionByName(row(sites.where("keep_last < 1"), "keep_last"))
        .unionByName(row(sites.join(site_destinations, sites["name"] == site_destinations["site_name"], "left_anti"), "no_destination"))
        .unionByName(site_destinations.join(known, "destination", "left_anti").select(F.lit("unknown_destination").alias("rule"), F.col("site_name").alias("name")))
    )


def lanes(sites: DataFrame) -> DataFrame:
    """Two lanes, full and incremental, each in the order of names."""
    lane = F.when(F.col("backup_mode") == "incremental", "incremental").otherwise("full")
    return sites.where("enabled").withColumn("lane", lane).withColumn("position", F.row_number().over(W.partitionBy("lane").orderBy("name")))


def stage_times(events: DataFrame) -> DataFrame:
    """events(run_id, stage, at): milliseconds from each stage's start to the next event of the run."""
    w = W.partitionBy("run_id").orderBy("at", "stage")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return events.withColumn("millis", F.floor((micros(F.lead("at").over(w)) - micros(F.col("at"))) / 1000))


def rates(progress: DataFrame) -> DataFrame:
    """progress(run_id, at, done, total): bytes a second since the report before, and seconds left at that rate."""
    w = W.partitionBy("run_id").orderBy("at", "done")
    spent = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.lag("at").over(w).cast("timestamp"))) / 1e6
    rate = F.when(spent > 0, (F.col("done") - F.lag("done").over(w)) / spent)
    return progress.withColumn("rate", rate).withColumn("seconds_left", F.when(F.col("rate") > 0, F.greatest(F.lit(0), F.col("total") - F.col("done")) / F.col("rate")))


def exit_code(category):
    """What a command exits with: 0 without an error."""
    out = F.when(category.isNull() | (category == ""), 0)
    for name, code in EXIT_CODES.items():
        out = out.when(category == name, code)
    return out.otherwise(1)
