"""Texts of histories and checks, scans of folders, sealed packs, months of runs, restores of unsafe trees."""

import hashlib
from datetime import datetime, timedelta

import pytest
import zstandard
from pyspark.sql import functions as F

from tests.core.test_history import T0, packages, runs
from tidemark.functions import paths, sealing, text
from tidemark.operators import graph, history, integrity, snapshots
from tidemark.sources import filesystem, repository, schemas
from tidemark.streaming import incidents

KEYS = sealing.Keys(b"e" * 32, b"k" * 16, b"r" * 16)


@pytest.mark.parametrize(("millis", "want"), [(0, "0s"), (345, "345ms"), (2000, "2s"), (2250, "2.25s"), (90_500, "1m30.5s"), (3_600_000, "1h0m0s"), (3_723_004, "1h2m3.004s")])
def test_exact_duration(spark, millis, want):
    assert spark.range(1).select(text.exact_duration(F.lit(millis))).first()[0] == want


def test_history_lines(spark):
    df = runs(spark, [("r1", "shop", "full", "failed", T0, 90_500), ("r2", "a", "full", "running", T0, 0)])
    p = packages(spark, [("r1", "files", "x", "home", 1536, "stored"), ("r1", "files", "x", "away", 1536, "stored")])
    got = {(r.section, r.run_id): r.line for r in history.history_lines(df, p).collect()}
    assert got == {
        (0, None): "STATUS   SITE  STARTED         DURATION     PACKAGES  DESTINATIONS  LOGICAL SIZE  RUN ID",
        (1, "r1"): "failed   shop  01-August-2026  1m30.5s      1         2             1.5 KiB       r1",
        (1, "r2"): "running  a     01-August-2026  in progress  0         0             0 B           r2",
        (2, "r1"): "Run r1 error [unknown]: message unavailable",
        (3, None): "\n2 runs, 1 logical package, 2 destinations, 1.5 KiB logical total",
    }
    assert [r.line for r in history.history_lines(df.limit(0), p).collect()] == ["No backup history found for the selected filters."]


def test_last_good_over_months(spark):
    at = [T0 - timedelta(days=95), T0 - timedelta(days=40), T0 - timedelta(days=1), T0, T0, T0 + timedelta(hours=1)]
    states = ["success", "failed", "failed", "success", "failed", "no_change"]
    rows = [(str(k), "a", "full", st, t, 0) for k, (st, t) in enumerate(zip(states, at, strict=True))]
    df = runs(spark, [*rows, ("x", "b", "full", "failed", T0, 0)])
    got = {r.id: r.last_good.id if r.last_good else None for r in history.with_last_good(df).collect()}
    brute = {i: max(((t, j) for j, s, _, st, t, _ in rows if s == site and st in schemas.GOOD and t < when), default=(None, None))[1] for i, site, _, _, when, _ in [*rows, ("x", "b", "", "", T0, 0)]}
    assert got == brute == {"0": None, "1": "0", "2": "0", "3": "0", "4": "0", "5": "3", "x": None}


def test_check_texts(spark, tmp_path):
    rows = [("missing_pack", "p", None, "p", 3, None), ("missing_blob", "b", "s", None, None, "data"), ("missing_blob", "a", "s", None, None, "data")]
    found = spark.createDataFrame(rows, schemas.FINDINGS)
    assert integrity.check_summary(found, "shop", "home").first().line == "check shop/home: problems found (2 missing_blob, 1 missing_pack)"
    assert integrity.check_summary(found.limit(0), "shop", "home").first().line == "check shop/home: healthy"
    integrity.write_findings(found, f"{tmp_path}/t")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t").collect()) == ["missing_blob a (snapshot s)", "missing_blob b (snapshot s)", "missing_pack p (3 blobs)"]
    integrity.write_findings(found, f"{tmp_path}/j", "json")
    assert spark.read.schema(schemas.FINDINGS).json(f"{tmp_path}/j").count() == 3
    integrity.write_findings(found.limit(0), f"{tmp_path}/none")
    assert (tmp_path / "none" / "_SUCCESS").exists()


def test_new_packs(spark):
    lists = [spark.createDataFrame([(x,) for x in ids], "pack_id string") for ids in ("aabc", "bd")]
    assert sorted(r.pack_id for r in integrity.new_packs(*lists).collect()) == ["a", "c"]


def test_sealed_blobs(spark):
    plain = [b"one", b"two" * 100, b"three"]
    packed = [plain[0], zstandard.ZstdCompressor().compress(plain[1]), plain[2]]
    sealed = [sealing.seal(x, KEYS, bytes([k]) * 16) for k, x in enumerate(packed)]
    sealed[2] = sealed[2][:-1] + bytes([sealed[2][-1] ^ 1])  # a damaged tag
    ids = [hashlib.sha256(x).hexdigest() for x in plain]
    at = [0, len(sealed[0]), len(sealed[0]) + len(sealed[1])]
    rows = [("i", "p", "data", ids[k], at[k], len(sealed[k]), 300 if k == 1 else 0) for k in range(3)] + [("i", "p", "data", "f" * 64, 10_000, 5, 0)]
    entries = spark.createDataFrame(rows, schemas.INDEX_ENTRIES)
    packs = spark.createDataFrame([("p", bytearray(b"".join(sealed)))], "pack_id string, content binary")
    found = {r.id: r.detail for r in integrity.corrupt(integrity.unpack(entries, packs, KEYS)).collect()}
    assert found == {ids[2]: "unreadable", "f" * 64: "unreadable"}
    assert integrity.corrupt(integrity.unpack(entries, packs)).count() == 4  # without keys nothing can be read


def test_included(spark):
    nodes = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/c/d",)], "path string")
    inside, lost = paths.included(nodes, ["/a", "/c/x", "/c"])
    assert "Join" not in inside._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.path for r in inside.collect()) == ["/a", "/a/b", "/c/d"] and [r.include for r in lost.collect()] == ["/c/x"]
    assert [r.include for r in paths.included(nodes.limit(0), ["/a"])[1].collect()] == ["/a"]


def test_folder_scan(spark, tmp_path):
    for name in ("a/b/one.txt", "a/two.log", "cache/deep/x", "top"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"x" * len(name))
    found = filesystem.scan(spark, f"file://{tmp_path}", ["cache", "*.log"])
    got = {r.path.removeprefix(str(tmp_path)): (r.type, r.size, r.name, r.parent.removeprefix(str(tmp_path))) for r in found.collect()}
    assert got == {"/a": ("dir", 0, "a", ""), "/a/b": ("dir", 0, "b", "/a"), "/a/b/one.txt": ("file", 11, "one.txt", "/a/b"), "/top": ("file", 3, "top", "")}
    assert filesystem.scan(spark, str(tmp_path)).where("type = 'file'").count() == 4


@pytest.mark.parametrize("bad", [("..", "dir", None), ("a/b", "file", None), ("f", "symlink", "t2"), (None, "file", None)])
def test_unsafe_restore(spark, bad):
    columns = "tree_id string, name string, type string, size bigint, content array<string>, subtree string"
    nodes = spark.createDataFrame([("t", "ok", "file", 1, [], None), ("t", bad[0], bad[1], 0, None, bad[2])], columns)
    there = spark.createDataFrame([], "path string, type string")
    with pytest.raises(Exception, match="invalid name"):
        graph.restore_plan(spark.createDataFrame([("t",)], "tree string"), nodes, there).collect()


def test_period_once_for_good(spark, tmp_path):
    """A period that comes again after a long time passes once."""
    schema = "report_type string, period string, created_at timestamp"
    for k, day in enumerate((1, 2, 20)):
        spark.createDataFrame([("daily", "2026-01-01", datetime(2026, 1, day)), ("daily", f"2026-01-{day:02}", datetime(2026, 1, day))], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = incidents.once_per_period(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"))
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.period for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["2026-01-01", "2026-01-02", "2026-01-20"]


def test_save_path(spark):
    """Repeated, known and empty blobs; packs open again, and close once their payloads reach the size."""
    known = spark.createDataFrame([("data", hashlib.sha256(b"known").hexdigest())], "type string, id string")
    data = [("data", x) for x in (b"a" * 5000, b"a" * 5000, b"", b"known", b"b")] + [("tree", b"b"), ("data", None)]
    saved = snapshots.save_blobs(spark.createDataFrame([(t, bytearray(x) if x is not None else None) for t, x in data], "type string, data binary"), known, KEYS)
    got = {(r.type, r.id): (bytes(r.payload), r.length, r.uncompressed_length) for r in saved.collect()}
    name = lambda x: hashlib.sha256(x).hexdigest()
    assert set(got) == {("data", name(b"a" * 5000)), ("data", name(b"")), ("data", name(b"b")), ("tree", name(b"b"))}
    assert got["data", name(b"")][1:] == (sealing.EXTENSION, 0) and got["data", name(b"a" * 5000)][2] == 5000
    assert all(len(p) == n for p, n, _ in got.values())
    for size, want in ((1, 4), (1 << 20, 2)):
        packed = snapshots.packs(saved, KEYS, size, 1)
        heads = repository.pack_headers(packed.select(F.col("pack_id").alias("id"), "content"), KEYS)
        opened = {(r.type, r.id): bytes(r.data) for r in integrity.unpack(heads, packed.select("pack_id", "content"), KEYS).collect()}
        assert packed.count() == want and opened == {k: x for k in got for t, x in data if x is not None and (t, name(x)) == k}


def test_safe_field_looks_once(spark):
    """Each word hides a field in any case; the text is lowered once, not for each word."""
    words = ["://", ":\\", "../", "..\\", *text.SENSITIVE]
    cases = [(f"a {w.upper()} b", "[redacted]") for w in words] + [("/etc", "[redacted]"), ("a \n /x", "[redacted]"), ("a/b", "a/b"), ("awsx: pass word", "awsx: pass word"), (".. /", "[redacted]"), ("..x", "..x"), (" \t", "-"), (None, "-")]
    df = spark.createDataFrame(cases, "s string, want string").withColumn("got", text.safe_field("s"))
    assert [r.got for r in df.collect()] == [w for _, w in cases]
    assert df._jdf.queryExecution().analyzed().toString().count("lower(") == 1
