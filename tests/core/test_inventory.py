from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import paths, text
from tidemark.operators import inventory

ZONE = "Asia/Makassar"


#: Each form, each bound, and each near miss of the grammar of keys; local times are eight hours ahead.
SETS = {
    "2031-02-28/23-59-59": datetime(2031, 2, 28, 23, 59, 59), "28-February-2031/23-59-59": datetime(2031, 2, 28, 23, 59, 59), "2031-02-28/23-59-59-any thing": datetime(2031, 2, 28, 23, 59, 59),
    "01-March-2031/07.59.59": datetime(2031, 2, 28, 23, 59, 59), "01-March-2031/07.59.59-r1": datetime(2031, 2, 28, 23, 59, 59), "29-February-2032/00-00-00": datetime(2032, 2, 29), "29-February-2031/00-00-00": None, "2031-02-29/00-00-00": None,
    "2031-12-31T23-59-59.000001999Z": datetime(2031, 12, 31, 23, 59, 59, 1), "31-December-2031/23-59-59.999999999": datetime(2031, 12, 31, 23, 59, 59, 999999), "2031-12-31T23-59-59.00001Z": None, "2031-12-31/23-59-59.999999999": None,
    "2031-03-01/07.59.59": None, "31-Dec-2031/00-00-00": None, "31-december-2031/00-00-00": None, "31-December-2031/24-00-00": None, "31-December-2031/00-60-00": None, "31-December-2031/00-00-60": None, "31-December-2031/00-00-00x": None, "31-December-2031": None, "31-December-2031/00-00": None, "/00-00-00": None, "": None, "1-March-2031/00-00-00": None, "31-December-2031/00-00-00/x": None,
}


def test_set_forms(spark):
    got = {r.set_key: r.created_at for r in inventory.parse_set(spark.createDataFrame([(k,) for k in SETS], "set_key string"), ZONE).collect()}
    assert got == SETS


def test_packages_and_format(spark):
    at = datetime(2031, 2, 28, 23, 59, 59)
    want = {
        "01-March-2031/07.59.59-r1-a.tar.gz": ("01-March-2031/07.59.59-r1", at), "28-February-2031/23-59-59-r1-a-b.tar": ("28-February-2031/23-59-59-r1", at), "2031-02-28/23-59-59-a.tar.gz": ("2031-02-28/23-59-59", at), "2031-02-28/23-59-59-": ("2031-02-28/23-59-59", at),
        "2031-03-01/07.59.59-a": (None, None), "01-March-2031/07.59.59": (None, None), "30-February-2031/00.00.00-a": (None, None), "01-March-2031/07.59.59-a/b": (None, None), "a": (None, None), "": (None, None), None: (None, None),
    }
    got = {r.key: (r.set_key, r.created_at) for r in inventory.parse_packages(spark.createDataFrame([(k,) for k in want], "key string"), ZONE).collect()}
    assert got == want
    times = spark.createDataFrame([(datetime(2031, 12, 31, 20, 4, 5), ""), (at, "r1")], "at timestamp, run string")
    keys = [r.k for r in times.select(inventory.format_key(F.col("at"), F.lit("a.tar.gz"), F.col("run"), ZONE).alias("k")).collect()]
    assert keys == ["01-January-2032/04.04.05-a.tar.gz", "01-March-2031/07.59.59-r1-a.tar.gz"]


def test_generated_code_of_key_parsing_is_small(spark):
    """No stage falls back to interpretation: whole stages compile within the JVM's limit of a method."""
    df = spark.createDataFrame([("d", "s", "01-March-2031/07.59.59-r1-a", 1)] * 3, "destination string, site_name string, key string, size long")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        sets = inventory.backup_sets(df, ZONE)
        assert sets.count() == 1 and inventory.retention_plan(sets, 1).count() == 0
        assert inventory.delete_batches(df, sets.withColumn("position", F.lit(1)), ZONE, 10).count() == 3
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_retention(spark):
    rows = [("d", "s", f"k{d}", datetime(2026, 1, d), ok) for d, ok in ((3, True), (1, True), (2, True), (4, False))]
    sets = spark.createDataFrame(rows, "destination string, site_name string, set_key string, created_at timestamp, complete boolean")
    assert [r.set_key for r in inventory.retention_plan(sets, 2).collect()] == ["k1"]
    with pytest.raises(ValueError, match="keep_last"):
        inventory.retention_plan(sets, 0)


@pytest.mark.parametrize(
    ("pattern", "path", "want"),
    [("*.tmp", "/srv/site/deep/skip.tmp", True), ("cache/**", "/srv/site/cache/deep/file", True), ("cache/**", "/srv/site/cache", True), ("cache/**", "/cache/file", False), ("/srv/site/cache", "/srv/site/cache/file", True), ("/srv/*", "/srv/site/x", False), ("a[bc]?", "/srv/site/abd", True)],
)
def test_excludes(spark, pattern, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(paths.excluded("p", [pattern], "/srv/site")).first()[0] is want


@pytest.mark.parametrize("pattern", ["[", "**/cache"])
def test_bad_patterns(pattern):
    with pytest.raises(paths.BadPattern):
        paths.exclude_regex(pattern, "/srv")


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert [one(text.human_bytes(F.lit(n).cast("bigint"))) for n in (5, 1023, 1024, 1280, 1536, 5 << 20, 3 << 30)] == ["5 B", "1023 B", "1.0 KiB", "1.2 KiB", "1.5 KiB", "5.0 MiB", "3.0 GiB"]
    assert [one(text.human_duration(F.lit(n))) for n in (45, 240, 3600, 3720)] == ["45 s", "4 min", "1 h", "1 h 2 min"]
    assert [one(text.compact_duration(F.lit(n))) for n in (2000, 90_000, 3_600_000)] == ["2s", "1m30s", "1h0m0s"]
    assert one(text.redact(F.lit("see https://h/x password=abc in /var/lib/x, ok"))) == "see <redacted-url> password=<redacted> in <redacted-path>, ok"
    assert [one(text.safe_field(F.lit(s))) for s in ("", " a  b ", "x /etc", "my token", "http://x")] == ["-", "a b", "[redacted]", "[redacted]", "[redacted]"]
    assert one(text.first_line(F.lit("\n  \n first \nsecond"))) == "first"
    assert one(text.first_line(F.lit("é" * 150))) == "é" * 100
    assert one(text.cause_chain(F.array(F.lit("a"), F.lit("b"), F.lit("a")))) == "a: b"
    assert one(text.error_class(F.lit("Lost connection; marked as crashed"))) == "transient"
