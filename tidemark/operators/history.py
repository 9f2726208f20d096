"""Run history: scans, as-of lookups, streaks, gates, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from tidemark.functions import text
from tidemark.sources.schemas import GOOD

DAY = "INTERVAL '24' HOUR"


def is_good() -> Column:
    """A run that later runs may rely on: the whole site, and success or no change."""
    return (F.col("scope") == "full") & F.col("status").isin(*GOOD)


def micros(df: DataFrame, name: str = "started_at") -> Column:
    """A time in microseconds; one without a zone counts as it stands, since the session's zone may skip or repeat an hour."""
    if isinstance(df.schema[name].dataType, TimestampType):
        return F.unix_micros(name)
    since = F.col(name).cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(18,6)") * 1000000).cast("bigint")


def with_packages(runs: DataFrame, packages: DataFrame) -> DataFrame:
    """Each run with its packages as a sorted array, empty where there are none."""
    nested = packages.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("source_kind", "source_name", "destination", "object_key", "size", "status"))).alias("packages"))
    joined = runs.join(nested, runs["id"] == nested["run_id"], "left").drop("run_id")
    return joined.withColumn("packages", F.coalesce("packages", F.expr("array()").cast(nested.schema["packages"].dataType)))


def list_runs(runs: DataFrame, site: str | None = None, limit: int = 0) -> DataFrame:
    """Newest first; a site and a limit if given (the limit is the feature: a page of history)."""
    out = runs.where(F.col("site_name") == site) if site else runs
    out = out.orderBy(F.col("started_at").desc(), F.col("id"))
    return out.limit(limit) if limit > 0 else out


def list_running(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'running'").orderBy(F.col("started_at").desc(), F.col("id"))


def list_range(runs: DataFrame, start, end) -> DataFrame:
    """[start, end), oldest first."""
    return runs.where((F.col("started_at") >= start) & (F.col("started_at") < end)).orderBy("started_at", "id")


def stored_packages(packages: DataFrame, run_id: str | None = None) -> DataFrame:
    out = packages.where("status = 'stored'")
    return (out.where(F.col("run_id") == run_id) if run_id else out).orderBy("run_id", "source_kind", "source_name", "destination")


def create_run(runs: DataFrame, new: DataFrame) -> DataFrame:
    """runs with new rows: a random id where there is none."""
    return runs.unionByName(new.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.uuid())))


def finish_runs(runs: DataFrame, finishes: DataFrame) -> DataFrame:
    """Applies finish(id, status, finished_at, error_category, error_message); a run's latest one counts."""
    last = finishes.groupBy("id").agg(F.max_by(F.struct("status", "finished_at", "error_category", "error_message"), "finished_at").alias("f"))
    out = runs.join(last, "id", "left")
    spent = F.greatest(F.lit(0), F.unix_millis(F.col("f.finished_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))).cast("bigint")
    return out.select(*(
        F.when(F.col("f").isNotNull(), F.col(f"f.{c}")).otherwise(F.col(c)).alias(c) if c in ("status", "finished_at", "error_category", "error_message")
        else F.when(F.col("f").isNotNull(), spent).otherwise(F.col(c)).alias(c) if c == "duration_millis" else F.col(c) for c in runs.columns
    ))


def last_good(runs: DataFrame, before=None) -> DataFrame:
    """One row per site: its newest good run, strictly before a time if given."""
    good = runs.where(is_good())
    if before is not None:
        good = good.where(F.col("started_at") < before)
    return good.groupBy("site_name").agg(F.min_by(F.struct("id", "status", "started_at"), F.struct(-micros(good), F.col("id"))).alias("r")).select("site_name", F.col("r.id").alias("id"), F.col("r.status").alias("status"), F.col("r.started_at").alias("started_at"))


def with_last_good(runs: DataFrame) -> DataFrame:
    """As-of join: each run with the newest good run of its site that started strictly earlier.

    Runs that start together don't see each other; of good ones that did, that with the smallest id counts, as in
    last_good.  Runs of no site see none.  Windows reach over thirty days of a site, so that a site with very many
    runs isn't one task's; the last good run of each, one row for it, is carried to the next.
    """
    good = F.when(is_good() & F.col("site_name").isNotNull() & F.col("__at").isNotNull(), F.struct((-F.col("__at")).alias("back"), "id", "started_at"))
    own = runs.withColumn("__at", micros(runs)).withColumn("__span", F.floor(F.col("__at") / (30 * 86400 * 1000000)))
    carry = W.partitionBy("site_name").orderBy("__span").rowsBetween(W.unboundedPreceding, -1)
    before = own.groupBy("site_name", "__span").agg(F.min(good).alias("__good")).select("site_name", "__span", F.last("__good", ignorenulls=True).over(carry).alias("__before"))
    w = W.partitionBy("site_name", "__span").orderBy("__at").rangeBetween(W.unboundedPreceding, -1)
    seen = own.withColumn("__within", F.min(good).over(w)).alias("r").join(before.alias("b"), F.col("r.site_name").eqNullSafe(F.col("b.site_name")) & F.col("r.__span").eqNullSafe(F.col("b.__span")), "left")
    found = seen.withColumn("__found", F.coalesce("r.__within", "b.__before"))
    return found.select(*(F.col(f"r.{c}") for c in runs.columns), F.when(F.col("__found").isNotNull(), F.struct("__found.started_at", "__found.id")).alias("last_good"))


def failure_streak(runs: DataFrame) -> DataFrame:
    """One row per site: bad full runs in a row up to the newest one; runs of other scopes don't count.

    Runs of 24 hours up to the newest are looked at, newest first; the newest counts whatever it is;
    a good run or a gap of more than 24 hours ends the streak.
    """
    runs = runs.where("scope = 'full'")
    anchor = runs.groupBy("site_name").agg(F.max("started_at").alias("anchor"))
    near = runs.join(anchor, "site_name").where(F.col("started_at") >= F.col("anchor") - F.expr(DAY))
    w = W.partitionBy("site_name").orderBy(F.col("started_at").desc(), F.col("id"))
    later = F.lag("started_at").over(w)
    ends = later.isNotNull() & (F.col("status").isin(*GOOD) | (later - F.col("started_at") > F.expr(DAY)))
    marked = near.withColumn("ends", ends.cast("int"))
    open_ = F.sum("ends").over(w.rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("ended", open_).groupBy("site_name").agg(F.count_if(F.col("ended") == 0).alias("streak"))


def interval_gate(runs: DataFrame, hours: int = 24) -> DataFrame:
    """Whether each run would start: it is skipped if the last good one is younger than the interval, unless forced."""
    seen = with_last_good(runs)
    young = F.col("last_good").isNotNull() & (F.col("started_at") - F.col("last_good.started_at") < F.expr(f"INTERVAL '{hours}' HOUR"))
    return seen.withColumn("skipped", ~F.col("forced") & young)


def unchanged(runs: DataFrame, packages: DataFrame, by: str = "size") -> DataFrame:
    """For full runs with an earlier good one: whether all sources are there again with equal sizes (or `by`)."""
    pairs = with_last_good(runs).where("scope = 'full' AND last_good IS NOT NULL").select(F.col("id").alias("run_id"), F.col("last_good.id").alias("old_id"))
    first = packages.where("status = 'stored'").groupBy("run_id", "source_kind", "source_name").agg(F.max(by).alias("v"))
    now = pairs.join(first, "run_id").select("run_id", "source_kind", "source_name", F.col("v").alias("new_v"))
    old = pairs.join(first.withColumnRenamed("run_id", "old_id"), "old_id").select("run_id", "source_kind", "source_name", F.col("v").alias("old_v"))
    both = now.join(old, ["run_id", "source_kind", "source_name"], "full").groupBy("run_id").agg(F.bool_and(F.coalesce(F.col("new_v") == F.col("old_v"), F.lit(False))).alias("unchanged"))
    return pairs.join(both, "run_id", "left").withColumn("unchanged", F.coalesce("unchanged", F.lit(False)))


def logical_size(packages: DataFrame) -> DataFrame:
    """Per run: sources, bytes (the largest copy of each source, of any status), destinations."""
    per = packages.groupBy("run_id", "source_kind", "source_name").agg(F.max("size").alias("size"))
    sizes = per.groupBy("run_id").agg(F.count("*").alias("sources"), F.sum("size").alias("bytes"))
    places = packages.groupBy("run_id").agg(F.count_distinct(F.nullif("destination", F.lit(""))).alias("destinations"))
    return sizes.join(places, "run_id")


def site_summary(sites: DataFrame, runs: DataFrame, packages: DataFrame) -> DataFrame:
    """A row per site: state, successes and their bytes, and what the latest run was; other sites' runs don't count."""
    sized = runs.join(logical_size(packages).select(F.col("run_id").alias("id"), "bytes"), "id", "left")
    newest = F.struct(-F.unix_micros(F.col("started_at").cast("timestamp")), F.col("id"))
    per = sized.groupBy("site_name").agg(
        F.count_if(F.col("status") == "success").alias("successes"), F.sum(F.when(F.col("status") == "success", F.col("bytes"))).alias("bytes"),
        F.min_by(F.struct("status", "started_at", "finished_at", "duration_millis", "bytes"), newest).alias("last"),
    )
    return per.join(sites, per["site_name"] == sites["name"], "right").select(
        "name",
        F.when(~F.col("enabled"), "disabled").when(F.col("last.status") == "running", "running").otherwise("idle").alias("state"),
        F.coalesce("successes", F.lit(0)).alias("successes"), F.coalesce("bytes", F.lit(0)).alias("total_bytes"),
        F.col("last.status").alias("last_status"), F.when(F.col("last.finished_at").isNotNull(), F.col("last.duration_millis")).alias("last_duration_millis"),
        F.when(F.col("last.status") == "success", F.coalesce("last.bytes", F.lit(0))).alias("last_bytes"),
    )


def site_overview(sites: DataFrame, runs: DataFrame, packages: DataFrame, site_destinations: DataFrame, storages: DataFrame) -> DataFrame:
    """site_summary with mode, what is kept, and the known destinations as `name (type)` in the order of names; by name."""
    known = site_destinations.join(storages.select(F.col("name").alias("destination"), "type"), "destination")
    places = known.groupBy(F.col("site_name").alias("name")).agg(F.array_join(F.sort_array(F.collect_set(F.concat("destination", F.lit(" ("), "type", F.lit(")")))), ", ").alias("destinations"))
    own = sites.select("name", "backup_mode", "keep_last")
    return site_summary(sites, runs, packages).join(own, "name").join(places, "name", "left").withColumn("destinations", F.coalesce("destinations", F.lit(""))).orderBy("name")


def site_names(sites: DataFrame, runs: DataFrame, locks: DataFrame) -> DataFrame:
    """Every site that is configured, has a running row or holds a lock, each once."""
    running = runs.where("status = 'running'").select(F.col("site_name").alias("name"))
    return sites.select("name").unionByName(running).unionByName(locks.select(F.col("site_name").alias("name"))).distinct()


def payload(packages: DataFrame, most: int = 10) -> DataFrame:
    """What a notification says of each run: stored sources, each counted once, their bytes and the first `most` keys.

    Of the copies of a source the one at the first destination counts; keys go by kind and name.
    """
    copy = F.min(F.struct("destination", "object_key", "size")).alias("copy")
    first = packages.where("status = 'stored'").groupBy("run_id", "source_kind", "source_name").agg(copy)
    ranked = first.withColumn("nr", F.row_number().over(W.partitionBy("run_id").orderBy("source_kind", "source_name")))
    keys = F.sort_array(F.collect_list(F.when(F.col("nr") <= most, F.struct("nr", "copy.object_key"))))
    return ranked.groupBy("run_id").agg(F.count("*").alias("items"), F.sum("copy.size").alias("bytes"), keys["object_key"].alias("keys"))


def max_skipped(summaries: DataFrame) -> DataFrame:
    """summaries(run_id, destination, files_skipped): what a run skipped is the most of any destination, not the sum."""
    return summaries.groupBy("run_id").agg(F.max("files_skipped").alias("files_skipped"))


def history_totals(runs: DataFrame, packages: DataFrame) -> DataFrame:
    """One row: runs, logical packages, distinct destinations over all, bytes."""
    own = packages.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    per = own.groupBy("run_id", "source_kind", "source_name").agg(F.max("size").alias("size"))
    return (
        runs.agg(F.count("*").alias("runs")).crossJoin(per.agg(F.count("*").alias("packages"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")))
        .crossJoin(own.agg(F.count_distinct(F.nullif("destination", F.lit(""))).alias("destinations")))
    )  # each side is one row


def warnings(runs: DataFrame) -> DataFrame:
    """Runs that ended well with a remark: a success with a message, or no change with a retention warning."""
    message = F.coalesce("error_message", F.lit(""))
    severity = F.when((F.col("status") == "success") & (message != ""), "warning").when((F.col("status") == "no_change") & (F.col("error_category") == "retention") & (message != ""), "warning").when(message != "", "error").otherwise("")
    return runs.withColumn("severity", severity)


HEADING = ("STATUS", "SITE", "STARTED", "DURATION", "PACKAGES", "DESTINATIONS", "LOGICAL SIZE", "RUN ID")


def history_lines(runs: DataFrame, packages: DataFrame) -> DataFrame:
    """A history as a person reads it: (section, started_at, run_id, line).

    Section 0 is the heading, or says that there is nothing; 1 has a line for each run in columns as wide as
    their widest text and two spaces; 2 a line for each run that ended badly or with a remark; 3 the totals.
    It is read by section, newest first, then by id.
    """
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    sized = runs.join(logical_size(packages).withColumnRenamed("run_id", "id"), "id", "left")
    lasted = F.when((F.col("status") == "running") & F.col("finished_at").isNull(), "in progress").otherwise(text.exact_duration("duration_millis"))
    started = F.date_format(F.col("started_at").cast("timestamp_ntz"), "dd-MMMM-yyyy")
    fields = (text.safe_field("status"), text.safe_field("site_name"), started, lasted, number("sources"), number("destinations"), text.human_bytes(F.coalesce("bytes", F.lit(0))), text.safe_field("id"))
    cells = sized.select("started_at", "id", *(f.alias(f"c{k}") for k, f in enumerate(fields)))
    widths = cells.agg(*(F.greatest(F.max(F.length(f"c{k}")), F.lit(len(HEADING[k]))).alias(f"w{k}") for k in range(7)))
    padded = lambda texts: F.concat(*(F.rpad(t, F.col(f"w{k}") + 2, F.lit(" ")) for k, t in enumerate(texts[:7])), texts[7])
    row = lambda df, section, line: df.select(F.lit(section).alias("section"), "started_at", F.col("id").alias("run_id"), line.alias("line"))
    lone = lambda df: df.withColumn("started_at", F.lit(None).cast(runs.schema["started_at"].dataType)).withColumn("id", F.lit(None).cast("string"))
    empty = cells.agg(F.count("*").alias("n"))
    head = row(lone(widths.crossJoin(empty)), 0, F.when(F.col("n") == 0, "No backup history found for the selected filters.").otherwise(padded([F.lit(x) for x in HEADING])))
    lines = row(cells.crossJoin(widths), 1, padded([F.col(f"c{k}") for k in range(8)]))  # widths are one row
    judged = warnings(runs)
    kind = F.when((F.col("status") == "partial") | (F.col("severity") == "warning"), "warning").otherwise("error")
    told = lambda c, none: F.when(F.coalesce(c, F.lit("")) == "", none).otherwise(text.safe_field(c))
    remark = F.concat(F.lit("Run "), text.safe_field("id"), F.lit(" "), kind, F.lit(" ["), told(F.col("error_category"), "unknown"), F.lit("]: "), told(F.col("error_message"), "message unavailable"))
    remarks = row(judged.where((F.col("severity") == "warning") | F.col("status").isin("failed", "partial", "cancelled")), 2, remark)
    total = lone(history_totals(runs, packages)).where("runs > 0")
    parts = [text.plural("runs", "run"), text.plural("packages", "logical package"), text.plural("destinations", "destination"), F.concat(text.human_bytes("bytes"), F.lit(" logical total"))]
    return head.unionByName(lines).unionByName(remarks).unionByName(row(total, 3, F.concat(F.lit("\n"), F.concat_ws(", ", *parts))))


def activity(locks: DataFrame, runs: DataFrame) -> DataFrame:
    """Running, unknown and stale work of each site, from held locks and running rows.

    A verified lock is running, with the newest run that started at or after it; a lock that can't be
    verified is unknown; running rows that no verified lock explains are stale.
    """
    active = runs.where("status = 'running'").select("site_name", F.col("id").alias("run_id"), "started_at")
    held = locks.join(active, "site_name", "left")
    match = F.when(F.col("verified") & (F.col("started_at") >= F.col("acquired_at")), F.struct("started_at", "run_id"))
    own = held.groupBy("site_name", "verified", "pid").agg(F.max(match).alias("m")).select("site_name", F.when(F.col("verified"), "running").otherwise("unknown").alias("state"), F.col("m.run_id").alias("run_id"))
    stale = active.join(own.where("run_id IS NOT NULL").select("run_id"), "run_id", "left_anti").select("site_name", F.lit("stale").alias("state"), "run_id")
    return own.unionByName(stale)


def stop_plan(locks: DataFrame, sites: list[str] | None = None) -> DataFrame:
    """What a stop would signal: all targets must be verified, and one process may not serve other sites."""
    shared = locks.groupBy("pid").agg(F.count_distinct("site_name").alias("shares"))
    out = locks.join(shared, "pid", "left")
    if sites is not None:
        out = out.where(F.col("site_name").isin(sites)).withColumn("allowed", F.col("verified") & (F.col("shares") == 1))
    else:
        out = out.withColumn("allowed", F.col("verified"))
    whole = out.agg(F.coalesce(F.bool_and("verified"), F.lit(True)).alias("all_verified"))
    return out.crossJoin(whole).withColumn("stop", F.col("allowed") & F.col("all_verified"))  # the right side is one row


def run_status(facts: DataFrame) -> DataFrame:
    """status, category, silent and recorded of facts(locked, within_interval, forced, cancelled, fatal_category,
    mode, scope, skipped, classified_missing, has_previous, same_sizes, retention_warning, database_warning)."""
    warn = F.when(F.col("database_warning"), "maintenance").when(F.col("retention_warning"), "retention").otherwise("")
    gone = (F.col("skipped") > 0) & (F.col("classified_missing") == F.col("skipped"))
    same = (F.col("mode") == "full") & (F.col("scope") == "full") & (F.col("skipped") == 0) & F.col("has_previous") & F.col("same_sizes")
    interval = F.col("within_interval") & ~F.col("forced")
    cases = [
        (~F.col("locked"), "skipped", F.lit("already_running"), True, False),
        (interval, "skipped", F.lit("minimum_interval"), False, False),
        (F.col("cancelled"), "cancelled", F.coalesce("fatal_category", F.lit("")), False, True),
        (F.col("fatal_category").isNotNull(), "failed", F.col("fatal_category"), False, True),
        (same, "no_change", warn, False, True),
        (gone, "partial", F.lit("source_disappeared"), True, True),
        (F.col("skipped") > 0, "partial", F.lit("source"), False, True),
        (F.lit(True), "success", warn, False, True),
    ]
    out = facts
    for name, pick in (("status", 1), ("category", 2), ("silent", 3), ("recorded", 4)):
        value = F
        for case in cases:
            value = value.when(case[0], case[pick] if isinstance(case[pick], Column) else F.lit(case[pick]))
        out = out.withColumn(f"__{name}", value)
    return out.withColumnsRenamed({f"__{n}": n for n in ("status", "category", "silent", "recorded")}) if not {"status", "category", "silent", "recorded"} & set(facts.columns) else out


def deliver_once(deliveries: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new(report_type, period, ...) that were not delivered yet, each period once."""
    return new.dropDuplicates(["report_type", "period"]).join(deliveries, ["report_type", "period"], "left_anti")
