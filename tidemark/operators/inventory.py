"""Object inventories: key parsing, backup sets, completeness, retention, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ending of the object that completes a set (a setting), and objects of one delete request.
MARKER = ".backup-complete"
DELETE_BATCH = 1000

#: Names of the months in keys.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_LONG, _SHORT = r"\d{2}-[A-Z][a-z]+-\d{4}", r"\d{4}-\d{2}-\d{2}"
_DOTS, _DASHES = r"\d{2}\.\d{2}\.[0-5]\d", r"\d{2}-\d{2}-[0-5]\d"


def _moment(key: Column, seconds: Column | None = None) -> Column:
    """The time that a key of a date, a slash and a time says, whichever marks stand between; null where there is none such.

    Parts are taken by their places, each once, so that generated code stays small.
    """
    long = F.substring(key, 3, 1) == "-"
    slash = F.instr(key, "/")
    number = lambda at, n: F.substring(key, at, F.lit(n)).try_cast("int")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(key, F.lit(4), slash - 9)).cast("int")
    year, month, day = F.when(long, number(slash - 4, 4)).otherwise(number(F.lit(1), 4)), F.when(long, month).otherwise(number(F.lit(6), 2)), F.when(long, number(F.lit(1), 2)).otherwise(number(F.lit(9), 2))
    second = F.substring(key, slash + 7, F.lit(2)).try_cast("decimal(18,6)") if seconds is None else seconds
    return F.try_make_timestamp_ntz(year, month, day, number(slash + 1, 2), number(slash + 4, 2), second)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, from columns that are: nothing is folded into what stands above or below."""
    return df.drop(name).select("*", F.inline(F.array(F.struct(value.alias(name)))))


def _to_utc(at: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), at)


def parse_packages(objects: DataFrame, zone: str = "UTC") -> DataFrame:
    """objects(key = date/package) with set_key and created_at (UTC, no zone), null where a key is no package.

    Dots mean local time of the zone, with the long date only; dashes mean UTC, with either date.  A set
    ends at the first dash after the time.
    """
    key = F.col("key")
    good = key.rlike(rf"^({_LONG}/{_DOTS}|({_LONG}|{_SHORT})/{_DASHES})-[^/]*$")
    at = F.when(good, _moment(key))
    name = F.instr("key", "/") + 1
    local = F.substring("key", name + 2, F.lit(1)) == "."
    rest = F.substring("key", name + 9, F.length("key"))
    end = F.instr(rest, "-")
    whole = F.substring("key", F.lit(1), F.when(end > 0, name + 7 + end).otherwise(name + 7))
    out = _once(objects, "created_at", F.when(local, _to_utc(at, zone)).otherwise(at))
    return out.withColumn("set_key", F.when(F.col("created_at").isNotNull(), whole))


def parse_set(sets: DataFrame, zone: str = "UTC") -> DataFrame:
    """sets(set_key) with created_at of current and legacy forms, null where it is none of them."""
    key = F.col("set_key")
    iso = key.rlike(rf"^{_SHORT}T{_DASHES}\.\d{{9}}Z$")
    dotted = key.rlike(rf"^{_LONG}/{_DOTS}(-[^/]*)?$")
    dashed = key.rlike(rf"^({_LONG}|{_SHORT})/{_DASHES}(-[^/]*)?$")
    fraction = key.rlike(rf"^{_LONG}/{_DASHES}\.\d{{9}}$")
    # all forms are brought to date/time; a fraction is cut to microseconds
    plain = F.when(iso, F.concat(F.substring(key, 1, 10), F.lit("/"), F.substring(key, 12, 8))).when(dotted | dashed | fraction, key)
    behind = F.instr(key, ".")
    part = F.concat(F.substring(plain, F.instr(plain, "/") + 7, F.lit(2)), F.when(iso | fraction, F.substring(key, behind, F.lit(7))).otherwise(F.lit("")))
    at = _moment(plain, part.try_cast("decimal(18,6)"))
    return _once(sets, "created_at", F.when(dotted, _to_utc(at, zone)).otherwise(at))


def format_key(created_at: Column, name: Column, run_id: Column | None, zone: str) -> Column:
    """dd-MMMM-yyyy/HH.mm.ss[-run]-name in the zone's time; the run's first 8 characters without dashes."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), created_at.cast("timestamp_ntz"))
    run = F.lit("") if run_id is None else F.when(F.coalesce(run_id, F.lit("")) != "", F.concat(F.lit("-"), F.substring(F.replace(run_id, F.lit("-"), F.lit("")), 1, 8))).otherwise("")
    return F.concat(F.date_format(local, "dd-MMMM-yyyy/HH.mm.ss"), run, F.lit("-"), name)


def is_marker(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return key.endswith(f"-{MARKER}")


def backup_sets(objects: DataFrame, zone: str = "UTC") -> DataFrame:
    """A row for each set of a site at a destination: when, whether its marker is there, packages and bytes without it."""
    marker = is_marker("key")
    return parse_packages(objects, zone).where("set_key IS NOT NULL").groupBy("destination", "site_name", "set_key").agg(
        F.min("created_at").alias("created_at"), F.bool_or(marker).alias("complete"), F.count_if(~marker).alias("packages"), F.coalesce(F.sum(F.when(~marker, F.col("size"))), F.lit(0)).alias("bytes")
    )


def retention_plan(sets: DataFrame, keep_last: int) -> DataFrame:
    """Complete sets beyond the newest keep_last, with the order in which they are deleted (oldest first)."""
    if keep_last < 1:
        raise ValueError("keep_last must be at least 1")
    by = ["destination", "site_name"]
    newest = W.partitionBy(*by).orderBy(F.col("created_at").desc(), F.col("set_key").desc())
    oldest = W.partitionBy(*by).orderBy("created_at", "set_key")
    gone = sets.where("complete").withColumn("__rank", F.row_number().over(newest)).where(F.col("__rank") > keep_last)
    return gone.withColumn("position", F.row_number().over(oldest)).drop("__rank")


def delete_batches(objects: DataFrame, plan: DataFrame, zone: str = "UTC", size: int = DELETE_BATCH) -> DataFrame:
    """Objects of the planned sets in batches of one request each."""
    keys = ["destination", "site_name", "set_key"]
    own = parse_packages(objects, zone).join(plan.select(*keys), keys, "left_semi")
    return own.withColumn("batch", F.floor((F.row_number().over(W.partitionBy("destination", "site_name").orderBy("key")) - 1) / size))


def object_list(objects: DataFrame, zone: str = "UTC", site: str | None = None) -> DataFrame:
    """Packages of all sets, markers excluded, newest set first; databases are told by their ending."""
    out = parse_packages(objects, zone).where(F.col("set_key").isNotNull() & ~is_marker("key"))
    out = out.where(F.col("site_name") == site) if site else out
    kind = F.when(F.col("key").endswith(".sql.gz"), "database").otherwise("files")
    return out.withColumn("kind", kind).orderBy(F.col("created_at").desc(), "destination", "site_name", "key")


def link_eligible(objects: DataFrame, sources: DataFrame, zone: str = "UTC") -> DataFrame:
    """Objects that a download link may be made for: valid keys of an enabled database source of their site."""
    named = sources.where("enabled").select("site_name", F.concat(F.lit("-"), "source_name", F.lit(".sql.gz")).alias("ending"))
    own = parse_packages(objects, zone).where("set_key IS NOT NULL").alias("o")
    # equi-join on the site, so that endings are compared within it only
    return own.join(F.broadcast(named).alias("s"), (F.col("o.site_name") == F.col("s.site_name")) & F.col("o.key").endswith(F.col("s.ending")), "left_semi")


def check_full(runs: DataFrame, packages: DataFrame, objects: DataFrame, destination: str) -> DataFrame:
    """Findings on each site's last good run at one destination."""
    from tidemark.operators.history import last_good

    last = last_good(runs).select("site_name", F.col("id").alias("run_id"))
    own = packages.where((F.col("status") == "stored") & (F.col("destination") == destination)).select("run_id", "source_kind", "source_name", "object_key", F.col("size").alias("want"))
    expected = last.join(own, "run_id", "left")
    have = objects.where(F.col("destination") == destination).select(F.col("site_name").alias("__site"), F.col("key").alias("object_key"), F.col("size").alias("have"))
    found = expected.join(have, (expected["object_key"] == have["object_key"]) & (expected["site_name"] == have["__site"]), "left").drop(have["object_key"]).drop("__site")
    missing = runs.select("site_name").distinct().join(last, "site_name", "left_anti").select("site_name", F.lit("missing_backup").alias("type"), F.lit(None).cast("string").alias("object_key"))
    rest = found.select(
        "site_name",
        F.when(F.col("object_key").isNull(), "missing_package_history").when(F.col("have").isNull() | (F.col("have") != F.col("want")), "package_verification").alias("type"),
        "object_key",
    ).where("type IS NOT NULL")
    return missing.unionByName(rest)


def config_copies(site_destinations: DataFrame, sites: DataFrame) -> DataFrame:
    """Every site's configuration at every destination that an enabled site uses (few sites, fewer destinations)."""
    enabled = sites.where("enabled").select("name")
    used = site_destinations.join(enabled, site_destinations["site_name"] == enabled["name"], "left_semi").select("destination").distinct()
    return sites.select(F.col("name").alias("site_name")).crossJoin(F.broadcast(used)).withColumn("object_key", F.concat(F.lit("config/"), "site_name", F.lit(".yaml")))


def verify_packages(objects: DataFrame, expected: DataFrame) -> DataFrame:
    """expected(key, size, sha256) against objects(key, size, sha256): ok, missing, size or checksum."""
    have = objects.select("key", F.col("size").alias("__size"), F.col("sha256").alias("__sha"))
    state = F.when(F.col("__size").isNull(), "missing").when(F.col("__size") != F.col("size"), "size").when(F.col("__sha").isNotNull() & (F.col("__sha") != F.col("sha256")), "checksum").otherwise("ok")
    return expected.join(have, "key", "left").withColumn("state", state).drop("__size", "__sha")
