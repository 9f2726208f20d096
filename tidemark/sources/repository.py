"""Repository files as tables: layout, sealed documents, indexes, snapshots, trees, pack headers.

Files are read by Spark's binaryFile source, so any store that Spark reads will do.  Bytes are opened in
Arrow batches; what can't be opened keeps its row, with the reason in `status`.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.sealing import EXTENSION, Keys, Unreadable, unseal
from tidemark.sources.schemas import PACK_HEADERS

KINDS = {"keys": "key", "data": "pack", "index": "index", "snapshots": "snapshot", "locks": "lock"}
INDEX = "struct<packs:array<struct<id:string,blobs:array<struct<id:string,type:string,offset:bigint,length:bigint,uncompressed_length:bigint>>>>>"
SNAPSHOT = (
    "struct<time:string,parent:string,tree:string,paths:array<string>,hostname:string,username:string,excludes:array<string>,tags:array<string>,"
    "summary:struct<files_new:int,files_changed:int,files_unmodified:int,data_added:bigint,total_files_processed:int,total_bytes_processed:bigint,total_duration:double>>"
)
TREE = "struct<nodes:array<struct<name:string,type:string,mode:bigint,mtime:string,ctime:string,uid:bigint,gid:bigint,inode:decimal(20,0),device_id:decimal(20,0),size:decimal(20,0),links:decimal(20,0),linktarget:string,linktarget_raw:string,device:decimal(20,0),content:array<string>,subtree:string>>>"


def files(spark: SparkSession, root: str, kinds: tuple[str, ...] = ("config", "key", "pack", "index", "snapshot", "lock")) -> DataFrame:
    """kind, id, size, content of a repository's files; other files are left out."""
    root = root.rstrip("/")
    folders = {v: k for k, v in KINDS.items()}
    paths = [f"{root}/config" if k == "config" else f"{root}/{folders[k]}" for k in kinds]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    parts = F.regexp_extract_all("path", F.lit(r"/(keys|data/[0-9a-f]{2}|index|snapshots|locks)/([0-9a-f]{64})$"), F.lit(0))
    folder = F.regexp_extract("path", r"/(keys|data|index|snapshots|locks)/(?:[0-9a-f]{2}/)?[0-9a-f]{64}$", 1)
    kind = F.when(F.col("path").endswith("/config"), "config")
    for name, k in KINDS.items():
        kind = kind.when((folder == name) & (F.size(parts) > 0), k)
    return found.select(kind.alias("kind"), F.substring_index("path", "/", -1).alias("id"), F.col("length").alias("size"), "content").where("kind IS NOT NULL")


def expanded(plain: bytes) -> bytes:
    """A document's JSON: bare, behind 0x01, or compressed behind 0x02."""
    if plain[:1] == b"\x02":
        return zstandard.ZstdDecompressor().decompressobj().decompress(plain[1:])
    return plain[1:] if plain[:1] == b"\x01" else plain


def opened(documents: DataFrame, keys: Keys | None) -> DataFrame:
    """documents(kind, id, content) with document (JSON text) and status; without keys contents are not sealed."""

    def run(batches):
        for batch in batches:
            texts, states = [], []
            for data in batch.column("content").to_pylist():
                try:
                    texts.append(expanded(unseal(data, keys) if keys else data).decode())
                    states.append("ok")
                except (Unreadable, zstandard.ZstdError, UnicodeDecodeError) as e:
                    texts.append(None)
                    states.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("id"), pa.array(texts, pa.string()), pa.array(states)], names=["kind", "id", "document", "status"])

    return documents.select("kind", "id", "content").mapInArrow(run, "kind string, id string, document string, status string")


def index_entries(documents: DataFrame) -> DataFrame:
    """A row for each blob of opened indexes."""
    doc = documents.where("kind = 'index' AND status = 'ok'").select(F.col("id").alias("index_id"), F.from_json("document", INDEX).alias("d"))
    packs = doc.select("index_id", F.explode("d.packs").alias("p"))
    return packs.select("index_id", F.col("p.id").alias("pack_id"), F.explode("p.blobs").alias("b")).select("index_id", "pack_id", "b.type", "b.id", "b.offset", "b.length", F.coalesce("b.uncompressed_length", F.lit(0)).alias("uncompressed_length"))


def snapshots(documents: DataFrame) -> DataFrame:
    doc = documents.where("kind = 'snapshot' AND status = 'ok'").select("id", F.from_json("document", SNAPSHOT).alias("d"))
    return doc.select("id", F.expr("try_to_timestamp(d.time)").alias("time"), *(f"d.{c}" for c in ("parent", "tree", "paths", "hostname", "username", "excludes", "tags", "summary")))


def tree_nodes(trees: DataFrame) -> DataFrame:
    """trees(tree_id, document) -> nodes, and whether a tree's names ascend strictly in byte order.

    Neighbours are compared in one walk: an array that is looked up by place within a lambda is made again each time.
    """
    doc = trees.select("tree_id", F.from_json("document", TREE).alias("d"))
    names = F.transform("d.nodes", lambda n: n["name"])
    rest = F.size("d.nodes") - 1
    ascending = F.forall(F.zip_with(F.slice(names, F.lit(1), rest), F.slice(names, F.lit(2), rest), lambda a, b: a < b), lambda x: x)
    return doc.withColumn("ordered", F.when(F.size("d.nodes") < 2, True).otherwise(ascending)).select("tree_id", "ordered", F.explode("d.nodes").alias("n")).select(
        "tree_id", "ordered", "n.*"
    ).withColumn("content", F.when(F.col("type") == "file", F.coalesce("content", F.expr("cast(array() as array<string>)"))).otherwise(F.col("content")))


class BadPack(ValueError):
    """A pack whose list of blobs can't be read or doesn't fit."""


def entries(data: bytes, keys: Keys | None) -> list[tuple[int, str, str, int, int, bool, int]]:
    """(ordinal, type, id, offset, length, compressed, uncompressed length) from a whole pack's bytes."""
    size = int.from_bytes(data[-4:], "little") if len(data) >= 4 else -1
    if size < (EXTENSION if keys else 1) or size + 4 > len(data):
        raise BadPack(f"header of {size} bytes")
    head = data[len(data) - 4 - size : len(data) - 4]
    head = unseal(head, keys) if keys else head
    out, at, offset = [], 0, 0
    while at < len(head):
        kind, packed = head[at], head[at] in (2, 3)
        end = at + (41 if packed else 37)
        if kind > 3 or end > len(head):
            raise BadPack(f"entry {len(out)}")
        length = int.from_bytes(head[at + 1 : at + 5], "little")
        full = int.from_bytes(head[at + 5 : at + 9], "little") if packed else 0
        out.append((len(out), "tree" if kind in (1, 3) else "data", head[end - 32 : end].hex(), offset, length, packed, full))
        at, offset = end, offset + length
    if not out or offset != len(data) - 4 - size:
        raise BadPack("lengths differ from the payload")
    return out


def pack_headers(packs: DataFrame, keys: Keys | None) -> DataFrame:
    """packs(id, content) -> a row for each blob, with status; an unreadable pack gives one row without a blob."""

    def run(batches):
        for batch in batches:
            rows = []
            for pack, data in zip(batch.column("id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows += [(pack, *e, "ok") for e in entries(data, keys)]
                except (BadPack, Unreadable) as e:
                    rows.append((pack, *[None] * 7, str(e)))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string())
            names = ["pack_id", "ordinal", "type", "id", "offset", "length", "compressed", "uncompressed_length", "status"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return packs.select("id", "content").mapInArrow(run, PACK_HEADERS + ", status string")


def objects(spark: SparkSession, destination: str, root: str) -> DataFrame:
    """An object inventory from a folder or bucket: site, key below it, size and time; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    below = F.regexp_extract("path", r"/([^/]+)/([^/]+/[^/]+)$", 2)
    return found.select(F.lit(destination).alias("destination"), F.regexp_extract("path", r"/([^/]+)/([^/]+/[^/]+)$", 1).alias("site_name"), below.alias("key"), "size", "modified_at")
