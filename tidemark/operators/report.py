"""Period, site and destination reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.schemas import REPORT_STATUSES

#: What a run's copies add up to by destination.
DESTINATION = "name, total_packages, stored, failed, total_bytes"


def local(c: Column | str, zone: str) -> Column:
    """A UTC time as wall-clock time of the zone, whatever the session's zone is."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(c).cast("timestamp_ntz") if isinstance(c, str) else c)


def counts() -> list[Column]:
    return [F.count("*").alias("total_runs"), *(F.count_if(F.col("status") == s).alias("successful" if s == "success" else s) for s in REPORT_STATUSES)]


def seconds() -> list[Column]:
    """Whole seconds of each run before they are summed; the average is truncated, and 0 without runs."""
    total = F.coalesce(F.sum(F.expr("duration_millis div 1000")), F.lit(0))
    return [total.alias("duration_seconds"), F.when(F.count("*") > 0, F.floor(total / F.count("*"))).otherwise(0).cast("bigint").alias("average_seconds")]


def logical_bytes(packages: DataFrame, order: list[str]) -> DataFrame:
    """Per run: the size of the first stored copy of each source, by `order`."""
    first = packages.where("status = 'stored'").groupBy("run_id", "source_kind", "source_name").agg(F.min_by("size", F.struct(*order)).alias("size"))
    return first.groupBy("run_id").agg(F.sum("size").alias("bytes"))


def with_bytes(runs: DataFrame, packages: DataFrame, order: list[str]) -> DataFrame:
    sized = logical_bytes(packages, order)
    return runs.join(sized, runs["id"] == sized["run_id"], "left").drop("run_id").withColumn("bytes", F.coalesce("bytes", F.lit(0)))


def period(runs: DataFrame, packages: DataFrame, order: list[str]) -> DataFrame:
    """One row over all runs."""
    return with_bytes(runs, packages, order).agg(*counts(), *seconds(), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))


def by_site(runs: DataFrame, packages: DataFrame, order: list[str]) -> DataFrame:
    """A row for each site, with its newest run; of equal times the smaller id."""
    newest = F.struct(-F.unix_micros(F.col("started_at").cast("timestamp")), F.col("id"))
    return with_bytes(runs, packages, order).groupBy("site_name").agg(
        *counts(), *seconds(), F.sum("bytes").alias("total_bytes"), F.min_by("status", newest).alias("last_status"), F.max("started_at").alias("last_run_at")
    )


def by_destination(runs: DataFrame, packages: DataFrame) -> DataFrame:
    own = packages.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    return own.groupBy(F.col("destination").alias("name")).agg(
        F.count("*").alias("total_packages"), F.count_if(F.col("status") == "stored").alias("stored"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(F.col("status") == "stored", F.col("size"))), F.lit(0)).alias("total_bytes"),
    )


def merge_destinations(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two destination summaries as one."""
    return left.unionByName(right).groupBy("name").agg(*(F.sum(c).alias(c) for c in ("total_packages", "stored", "failed", "total_bytes")))


def day_range(day: str, zone: str) -> tuple[Column, Column]:
    """UTC bounds of a report day: 24 hours from the zone's midnight."""
    start = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.lit(day).cast("timestamp_ntz"))
    return start, start + F.expr("INTERVAL '24' HOUR")


def month_range(month: str, zone: str) -> tuple[Column, Column]:
    """UTC bounds of a calendar month of the zone; month is its first day."""
    first = F.lit(month).cast("date")
    at = lambda d: F.convert_timezone(F.lit(zone), F.lit("UTC"), d.cast("timestamp_ntz"))
    return at(first), at(F.add_months(first, 1))


def in_range(runs: DataFrame, bounds: tuple[Column, Column]) -> DataFrame:
    started = F.col("started_at").cast("timestamp_ntz")
    return runs.where((started >= bounds[0]) & (started < bounds[1]))


def monthly(runs: DataFrame, packages: DataFrame, order: list[str], month: str, zone: str, include_empty: bool = True) -> DataFrame:
    """All levels of a month in one pass: overall, by day, by site, by day and site.

    level tells them apart.  With include_empty every day of the month is there, empty ones without runs.
    """
    own = with_bytes(in_range(runs, month_range(month, zone)), packages, order).withColumn("day", local("started_at", zone).cast("date"))
    out = own.groupingSets([[F.col("day"), F.col("site_name")], [F.col("day")], [F.col("site_name")], []], "day", "site_name").agg(
        *counts(), *seconds(), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), F.grouping("day").alias("gd"), F.grouping("site_name").alias("gs")
    )
    level = F.when((F.col("gd") == 1) & (F.col("gs") == 1), "month").when(F.col("gd") == 1, "site").when(F.col("gs") == 1, "day").otherwise("day_site")
    out = out.withColumn("level", level).drop("gd", "gs")
    if include_empty:
        first = F.lit(month).cast("date")
        days = runs.sparkSession.range(1).select(F.explode(F.sequence(first, F.date_sub(F.add_months(first, 1), 1))).alias("day"))
        numbers = [c for c in out.columns if c not in ("day", "site_name", "level")]
        per_day = days.join(out.where("level = 'day'").drop("level", "site_name"), "day", "left").select("day", F.lit(None).cast("string").alias("site_name"), *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), F.lit("day").alias("level"))
        out = out.where("level <> 'day'").unionByName(per_day)
    return out


def daily(runs: DataFrame, packages: DataFrame, order: list[str], day: str, zone: str) -> DataFrame:
    """A row for each site of a day."""
    return by_site(in_range(runs, day_range(day, zone)), packages, order)
