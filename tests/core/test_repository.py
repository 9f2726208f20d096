import hashlib
import json
import time
from base64 import b64encode

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.functions import sealing
from tidemark.sources import repository

KEYS = sealing.Keys(bytes(range(32)), bytes(range(16)), bytes(range(16, 32)))


def test_known_answers():
    text = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8).reshape(1, 16)
    assert sealing.blocks(text, bytes(range(32))).tobytes().hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert sealing.blocks(text, bytes(range(16))).tobytes().hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    key = bytes.fromhex("85d6be7857556d337f4452fe42d506a80103808afb0db2fd4abff6af4149f51b")
    assert sealing.poly1305(b"Cryptographic Forum Research Group", key[:16], key[16:]).hex() == "a8061dc1305136c6c22b8baf0c0127a9"


@pytest.mark.parametrize("size", [0, 1, 16, 1000])
def test_seal_round_trip(size):
    plain = bytes(k % 251 for k in range(size))
    box = sealing.seal(plain, KEYS, b"\xff" * 16)
    assert len(box) == size + sealing.EXTENSION and sealing.unseal(box, KEYS) == plain
    with pytest.raises(sealing.Unreadable):
        sealing.unseal(box[:-1] + bytes([box[-1] ^ 1]), KEYS)


def test_key_file():
    inner = json.dumps({"mac": {"k": b64encode(KEYS.mac_k).decode(), "r": b64encode(KEYS.mac_r).decode()}, "encrypt": b64encode(KEYS.encrypt).decode()}).encode()
    outer = sealing.password_keys("pw", b"salt", 1024, 8, 1)
    doc = json.dumps({"kdf": "scrypt", "N": 1024, "r": 8, "p": 1, "salt": b64encode(b"salt").decode(), "data": b64encode(sealing.seal(inner, outer, b"\0" * 16)).decode()})
    assert sealing.master_keys(doc, "pw") == KEYS
    with pytest.raises(sealing.Unreadable):
        sealing.master_keys(doc, "other")


def test_whole_repository(spark, tmp_path):
    name = lambda data: hashlib.sha256(data).hexdigest()
    seal = lambda data: sealing.seal(data, KEYS, b"\x07" * 16)

    def put(folder, data):
        at = tmp_path / folder / (name(data)[:2] if folder == "data" else "")
        at.mkdir(parents=True, exist_ok=True)
        (at / name(data)).write_bytes(data)
        return name(data)

    blob = seal(b"hello")
    entry = bytes([0]) + len(blob).to_bytes(4, "little") + hashlib.sha256(b"hello").digest()
    head = seal(entry)
    pack = put("data", blob + head + len(head).to_bytes(4, "little"))
    bad = put("data", b"xx")
    doc = {"packs": [{"id": pack, "blobs": [{"id": name(b"hello"), "type": "data", "offset": 0, "length": len(blob)}]}]}
    index = put("index", seal(b"\x02" + zstandard.ZstdCompressor().compress(json.dumps(doc).encode())))
    put("index", b"\0" * 40)
    snap = put("snapshots", seal(json.dumps({"time": "2026-01-02T03:04:05Z", "tree": "t", "paths": ["/a"], "tags": ["site:a"], "unknown": 1}).encode()))
    (tmp_path / "config").write_bytes(seal(b"{}"))
    (tmp_path / "index" / "note.txt").write_text("x")

    every = repository.files(spark, f"file://{tmp_path}", ("config", "pack", "index", "snapshot"))
    assert sorted(r.kind for r in every.collect()) == ["config", "index", "index", "pack", "pack", "snapshot"]
    docs = repository.opened(every.where("kind <> 'pack'"), KEYS)
    assert [(r.kind, r.status) for r in docs.where("status <> 'ok'").collect()] == [("index", "tag differs")]
    assert [(r.index_id, r.pack_id, r.id, r.uncompressed_length) for r in repository.index_entries(docs).collect()] == [(index, pack, name(b"hello"), 0)]
    (s,) = repository.snapshots(docs).collect()
    assert (s.id, s.tree, s.paths, s.tags) == (snap, "t", ["/a"], ["site:a"])
    headers = {r.pack_id: r for r in repository.pack_headers(every.where("kind = 'pack'"), KEYS).collect()}
    assert (headers[pack].id, headers[pack].length, headers[pack].status) == (name(b"hello"), len(blob), "ok")
    assert headers[bad].id is None and headers[bad].status != "ok"


def test_trees(spark):
    rows = [("t", json.dumps({"nodes": [{"name": "a", "type": "file"}, {"name": "b", "type": "dir", "subtree": "x"}]})), ("u", json.dumps({"nodes": [{"name": "b", "type": "file"}, {"name": "a", "type": "file"}]})), ("v", json.dumps({"nodes": [{"name": "z", "type": "file", "content": ["i"]}]}))]
    got = {(r.tree_id, r.name): (r.ordered, r.content) for r in repository.tree_nodes(spark.createDataFrame(rows, "tree_id string, document string")).collect()}
    assert got == {("t", "a"): (True, []), ("t", "b"): (True, None), ("u", "b"): (False, []), ("u", "a"): (False, []), ("v", "z"): (True, ["i"])}


def test_many_texts_at_once():
    """As text by text with whole numbers: lengths around blocks and stretches, counters that overflow, what doesn't open."""
    texts = [bytes(k % 251 for k in range(n)) for n in (0, 1, 15, 16, 17, 100, 65_535, 65_536, 65_552, 70_000)] + [b"\xff" * 66_000]
    ivs = [b"\xff" * 16 if k % 2 else bytes(8) + b"\xff" * 8 for k in range(len(texts))]
    sealed = sealing.seal_all(texts, KEYS, ivs)
    key, p = int.from_bytes(KEYS.mac_r, "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF, (1 << 130) - 5
    aes = lambda x, k: sealing.blocks(np.frombuffer(x, np.uint8).reshape(-1, 16), k).tobytes()
    for text, iv, got in zip(texts, ivs, sealed, strict=True):
        stream = aes(b"".join(((int.from_bytes(iv, "big") + k) % (1 << 128)).to_bytes(16, "big") for k in range(-(-len(text) // 16))), KEYS.encrypt)
        body, total = bytes(a ^ b for a, b in zip(text, stream)), 0  # noqa: B905
        for k in range(0, len(body), 16):
            total = (total + int.from_bytes(body[k : k + 16] + b"\x01", "little")) * key % p
        assert got == iv + body + ((total + int.from_bytes(aes(iv, KEYS.mac_k), "little")) % (1 << 128)).to_bytes(16, "little")
    damaged = [x[:-1] + bytes([x[-1] ^ 1]) for x in sealed]
    assert sealing.unseal_all([None, b"short", *damaged, *sealed], KEYS) == [None] * (2 + len(damaged)) + texts
    assert sealing.seal_all([], KEYS, []) == sealing.unseal_all([], KEYS) == []


def test_large_trees_take_linear_time(spark):
    """Two trees of 40,000 names, one of which ends out of order; comparing by place took minutes."""
    nodes = F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda k: F.struct(F.lpad(F.when((k == 40_000) & (F.col("id") == 1), 0).otherwise(k).cast("string"), 6, "0").alias("name"), F.lit("file").alias("type")))
    trees = spark.range(2).select(F.col("id").cast("string").alias("tree_id"), F.to_json(F.struct(nodes.alias("nodes"))).alias("document"))
    began = time.monotonic()
    got = {(r.tree_id, r.ordered): r["count"] for r in repository.tree_nodes(trees).groupBy("tree_id", "ordered").count().collect()}
    assert got == {("0", True): 40_000, ("1", False): 40_000}
    assert time.monotonic() - began < 60


def test_object_inventory(spark, tmp_path):
    at = tmp_path / "backups" / "web" / "12-October-2026"
    at.mkdir(parents=True)
    (at / "02.25.26-12345678-files.tar.gz").write_bytes(b"123")
    (row,) = repository.objects(spark, "home", f"file://{tmp_path}").collect()
    assert (row.destination, row.site_name, row.key, row.size) == ("home", "web", "12-October-2026/02.25.26-12345678-files.tar.gz", 3)
