import hashlib
import json
from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import chunking
from tidemark.operators import graph, integrity, snapshots


@pytest.fixture(scope="module")
def store(spark):
    """Two snapshots of one tag and one of another: a shared leaf, a pack only the oldest needs, an orphan."""
    snaps = spark.createDataFrame([("s1", datetime(2026, 1, 1), "t1", ["site:a"]), ("s2", datetime(2026, 1, 2), "t2", ["site:a"]), ("s3", datetime(2026, 1, 1), "t3", ["site:b"])], "id string, time timestamp, tree string, tags array<string>")
    nodes = spark.createDataFrame(
        [("t1", "d", "dir", None, "shared"), ("t1", "old", "file", ["b1"], None), ("t2", "d", "dir", None, "shared"), ("t2", "new", "file", ["b2", "b4"], None), ("shared", "f", "file", ["b3"], None), ("t3", "x", "file", ["b5"], None)],
        "tree_id string, name string, type string, content array<string>, subtree string",
    ).withColumn("size", F.lit(1))
    rows = [("tree", t, "p-trees") for t in ("t2", "shared", "t3")] + [("tree", "t1", "p-old"), ("data", "b1", "p-old"), ("data", "b2", "p-new"), ("data", "b4", "p-new"), ("data", "b3", "p-shared"), ("data", "b5", "p-other")]
    entries = spark.createDataFrame([("i", p, t, b, 0, 1, 0) for t, b, p in rows], "index_id string, pack_id string, type string, id string, offset bigint, length bigint, uncompressed_length bigint")
    packs = spark.createDataFrame([(p, 10) for p in ("p-trees", "p-old", "p-new", "p-shared", "p-other", "p-orphan")], "pack_id string, size bigint")
    return snaps, nodes, entries, packs


def test_forget_and_prune(store):
    snaps, nodes, entries, packs = store
    gone, plan = graph.forget_and_prune(snaps, nodes, entries, packs, "site:a", 1)
    assert [r.id for r in gone.collect()] == ["s1"]
    assert {r.pack_id: r.action for r in plan.collect()} == {"p-trees": "keep", "p-old": "dead", "p-new": "keep", "p-shared": "keep", "p-other": "keep", "p-orphan": "orphan"}
    gone, plan = graph.forget_and_prune(snaps, nodes, entries, packs, "site:none", 1)
    assert gone.count() == 0 and {r.pack_id for r in plan.where("action <> 'keep'").collect()} == {"p-orphan"}
    with pytest.raises(ValueError, match="keep_last"):
        graph.forget(snaps, "site:a", 0)


def test_missing_blob_names_the_smallest_snapshot(store):
    snaps, nodes, entries, _ = store
    got = {(r.type, r.id): r.snapshot_id for r in graph.missing_blobs(snaps, nodes, entries.where("id NOT IN ('b3', 'b4')")).collect()}
    assert got == {("data", "b3"): "s1", ("data", "b4"): "s2"}


def test_restore_plan(spark, store):
    snaps, nodes, _, _ = store
    there = spark.createDataFrame([("/d", "dir"), ("/new", "dir")], "path string, type string")
    got = {r.path: r.action for r in graph.restore_plan(snaps.where("id = 's2'"), nodes, there).collect()}
    assert got == {"/d": "keep", "/d/f": "create", "/new": "conflict"}
    assert [r.path for r in graph.restore_plan(snaps.where("id = 's2'"), nodes, there, ["/d/f"]).collect()] == ["/d/f"]


def test_findings(spark):
    ids = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(4)]
    entries = spark.createDataFrame([("i", ids[0], "data", "x", 0, 5, 0), ("i", ids[1], "data", "y", 0, 5, 0), ("i", ids[2], "data", "z", 0, 5, 0)], "index_id string, pack_id string, type string, id string, offset bigint, length bigint, uncompressed_length bigint")
    headers = spark.createDataFrame([(ids[0], 0, "tree", "x", 0, 5, False, 0), (ids[1], 0, "data", "y", 1, 5, False, 0)], "pack_id string, ordinal int, type string, id string, offset bigint, length bigint, compressed boolean, uncompressed_length bigint")
    packs = spark.createDataFrame([(ids[0], 99), (ids[1], 99), (ids[3], 99), ("note.txt", 1)], "pack_id string, size bigint")
    snaps = spark.createDataFrame([("s", None)], "id string, tree string")
    nodes = spark.createDataFrame([], "tree_id string, name string, type string, content array<string>, subtree string")
    files = spark.createDataFrame([("key", "k", "bad"), ("config", "c", "ok"), ("index", "i", "bad")], "kind string, id string, status string")
    data = spark.createDataFrame([(hashlib.sha256(b"ok").hexdigest(), "p", b"ok"), ("0" * 64, "p", b"no"), ("1" * 64, "p", None)], "id string, pack_id string, data binary")
    got = [(r.type, r.id) for r in integrity.check(snaps, nodes, entries, headers, packs, files, data).collect()]
    assert got == sorted([("broken_snapshot", "s"), ("broken_pack", ids[1]), ("missing_pack", ids[2]), ("orphaned_pack", ids[3]), ("broken_key", "k"), ("broken_index", "i"), ("corrupt_blob", "0" * 64), ("corrupt_blob", "1" * 64)])


def test_repair_aborts_as_a_whole(spark):
    headers = spark.createDataFrame([("p", 0, "data", "x", 0, 5, False, 0), ("p", 1, "data", "y", 5, 5, False, 0), ("q", 0, "data", "z", 3, 5, False, 0)], "pack_id string, ordinal int, type string, id string, offset bigint, length bigint, compressed boolean, uncompressed_length bigint")
    packs = lambda *p: spark.createDataFrame([(x, 200) for x in p], "pack_id string, size bigint")
    assert integrity.repair_index(headers, packs("p")).count() == 2
    with pytest.raises(Exception, match="nothing was changed"):
        integrity.repair_index(headers, packs("p", "q")).collect()


def test_unpack(spark):
    import zstandard

    body = b"hello" * 20
    small = zstandard.ZstdCompressor().compress(body)
    entries = spark.createDataFrame([("p", hashlib.sha256(b"raw").hexdigest(), 0, 3, 0), ("p", hashlib.sha256(body).hexdigest(), 3, len(small), 100), ("p", "far", 3, 999, 0)], "pack_id string, id string, offset bigint, length bigint, uncompressed_length bigint")
    packs = spark.createDataFrame([("p", b"raw" + small)], "pack_id string, content binary")
    assert [r.id for r in integrity.corrupt(integrity.unpack(entries, packs)).collect()] == ["far"]


def test_pack_plan_fills_in_order(spark):
    blobs = spark.range(500).selectExpr("'data' AS type", "sha2(cast(id AS string), 256) AS id", "1 + id % 37 AS length")
    rows = snapshots.pack_plan(blobs, 100, 3).collect()
    by_lane = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.id):
        by_lane[r.lane].append(r)
    assert len(rows) == 500
    for own in by_lane.values():
        used, pack = 0, 0
        for r in own:
            assert r.pack == pack
            used += r.length
            if used >= 100:
                used, pack = 0, pack + 1


def test_trees_follow_content(spark):
    files = spark.createDataFrame([("/a/x/1", "i1", 3), ("/a/y/1", "i1", 3), ("/b/x/1", "i1", 3)], "path string, id string, size bigint")
    trees = {r.path: r.tree for r in snapshots.build_trees(files, 3).collect()}
    assert set(trees) == {"", "/a", "/b", "/a/x", "/a/y", "/b/x"}
    assert trees["/a/x"] == trees["/a/y"] == trees["/b/x"] != trees["/a"]
    changed = {r.path: r.tree for r in snapshots.build_trees(files.withColumn("id", F.when(F.col("path") == "/b/x/1", "i2").otherwise(F.col("id"))), 3).collect()}
    assert changed["/a"] == trees["/a"] and changed[""] != trees[""] and changed["/b"] != trees["/b"]


def test_names_parents_and_estimates(spark):
    roots = spark.createDataFrame([(0, "/srv/www"), (1, "/opt/www/"), (2, "/"), (3, "/x/www")], "position int, path string")
    assert {r.path: r.name for r in snapshots.unique_names(roots).collect()} == {"/srv/www": "www", "/opt/www/": "www-1", "/": "root", "/x/www": "www-2"}
    at = lambda d: datetime(2026, 1, d)
    old = spark.createDataFrame([("a", at(1), ["/s"], None), ("b", at(2), ["/s"], []), ("c", at(2), ["/s"], []), ("d", at(3), ["/s", "/t"], [])], "id string, time timestamp, paths array<string>, excludes array<string>")
    wanted = spark.createDataFrame([("k", ["/s"], [], at(9)), ("none", ["/t", "/s"], [], at(9))], "key string, paths array<string>, excludes array<string>, before timestamp")
    assert {r.key: r.parent for r in snapshots.parent_snapshot(wanted, old).collect()} == {"k": "b", "none": None}
    assert [r.id for r in snapshots.resolve(old, "latest").collect()] == ["d"]
    assert [r.id for r in snapshots.resolve(old, "b").collect()] == ["b"]
    files = spark.createDataFrame([("/a", 5, False), ("/a", 5, False), ("/b", 7, True)], "path string, size bigint, excluded boolean")
    assert snapshots.size_estimate(files).first().size == 5
    assert snapshots.size_estimate(files.where("excluded")).first().size == -1


def test_reusable_directories(spark):
    now = spark.createDataFrame([("/a", "", "dir", None), ("/a/1", "/a", "file", True), ("/a/b", "/a", "dir", None), ("/a/b/2", "/a/b", "file", True), ("/c", "", "dir", None), ("/c/3", "/c", "file", False)], "path string, parent string, type string, same boolean")
    got = {r.path: r.reused for r in snapshots.reusable_directories(now, now, 3).collect()}
    assert got == {"": False, "/a": True, "/a/b": True, "/c": False}


def test_chunks():
    assert chunking.irreducible(chunking.POLYNOMIAL) and chunking.degree(chunking.POLYNOMIAL) == 53
    assert not chunking.irreducible(chunking.multiply(0b111, 0b1011))
    data = np.random.default_rng(42).bytes(400_000)
    own = lambda d: chunking.chunks(d, least=2048, most=32_768, bits=12)
    found = own(data)
    assert found == own(data) and sum(n for _, n in found) == len(data) and chunking.chunks(b"") == []
    assert all(2048 <= n <= 32_768 for _, n in found[:-1])
    assert 4000 < len(data) / len(found) < 9000
    other = data[:200_000] + b"!" + data[200_000:]
    assert len({other[a : a + n] for a, n in own(other)} - {data[a : a + n] for a, n in found}) <= 3
    # the fingerprint that tables give is the polynomial remainder of the window
    window = data[:64]
    want = chunking.modulo(int.from_bytes(window, "big"), chunking.POLYNOMIAL)
    t = chunking.tables(chunking.POLYNOMIAL, 64)
    got = 0
    for place in range(64):
        got ^= int(t[place][window[63 - place]])
    assert got == want


def test_deep_trees(spark):
    """Fifty levels: every directory gets its tree, and each follows from the one below."""
    names = [f"d{k}" for k in range(49)]
    files = spark.createDataFrame([("/" + "/".join([*names, "f"]), "i", 7), ("/d0/g", "j", 1)], "path string, id string, size bigint")
    found = {r.path: r.tree for r in snapshots.build_trees(files, 50).collect()}
    below, size = {"name": "f", "type": "file", "id": "i", "size": 7}, 7
    for k in range(49, -1, -1):
        nodes = [below] + ([{"name": "g", "type": "file", "id": "j", "size": 1}] if k == 1 else [])
        size += 1 if k == 1 else 0
        tree = hashlib.sha256((json.dumps({"nodes": nodes}, separators=(",", ":")) + "\n").encode()).hexdigest()
        assert found.pop("".join(f"/{n}" for n in names[:k])) == tree
        below = {"name": names[k - 1], "type": "dir", "id": tree, "size": size}
    assert not found


def test_parents_at_equal_times_and_without_snapshots(spark):
    at = lambda d: datetime(2026, 1, d)
    old = spark.createDataFrame([("z", at(2), ["/s"], None), ("y", at(2), ["/s"], None), ("x", at(1), ["/s"], ["e"])], "id string, time timestamp, paths array<string>, excludes array<string>")
    wanted = spark.createDataFrame([("same", ["/s"], None, at(2)), ("later", ["/s"], [], at(3)), ("other", ["/s"], ["e"], at(3))], "key string, paths array<string>, excludes array<string>, before timestamp")
    assert {r.key: r.parent for r in snapshots.parent_snapshot(wanted, old).collect()} == {"same": None, "later": "y", "other": "x"}
    assert {r.key: r.parent for r in snapshots.parent_snapshot(wanted, old.limit(0)).collect()} == {"same": None, "later": None, "other": None}


def test_chunks_of_a_batch_take_bounded_memory():
    """A batch of 32 MB is neither copied as a whole nor answered by one batch; files without bytes have no chunks."""
    import tracemalloc

    import pyarrow as pa

    class Catch:
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    run = chunking.chunk_files(Catch(), least=512, most=1024, bits=10)
    contents = [bytes(np.random.default_rng(k).integers(0, 256, 4096, np.uint8)) for k in range(50)]
    rows = [contents[k % 50] for k in range(8000)] + [None, b""]
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(len(rows))]), pa.array(rows, pa.binary())], names=["path", "content"])
    del rows
    tracemalloc.start()
    sizes, lengths, seen = [], 0, {}
    for out in run([batch]):
        sizes.append(out.num_rows)
        lengths += sum(out.column("length").to_pylist())
        for path, start, n, name in zip(*(c.to_pylist() for c in out.columns), strict=True):
            if int(path) < 50:
                seen.setdefault(int(path), []).append((start, n))
                assert name == hashlib.sha256(contents[int(path)][start : start + n]).hexdigest()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == {k: chunking.chunks(x, least=512, most=1024, bits=10) for k, x in enumerate(contents)}
    assert lengths == 8000 * 4096 and max(sizes) < chunking.ROWS + 8 and peak < 16 << 20
