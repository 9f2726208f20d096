"""Content-addressed snapshots: dedup, change classification, trees, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.sealing import Keys, seal, seal_all
from tidemark.operators.graph import settled

#: Bytes of payload at which a pack is closed.
PACK = 16 << 20
#: What makes a file the same as before.
METADATA = ("name", "type", "mode", "mtime", "ctime", "uid", "gid", "inode", "device_id", "size", "links", "linktarget", "linktarget_raw", "device")


def new_blobs(blobs: DataFrame, index: DataFrame) -> DataFrame:
    """Blobs(type, id, length, ...) that the index lacks, each once; type and id together name a blob."""
    return blobs.dropDuplicates(["type", "id"]).join(index.select("type", "id"), ["type", "id"], "left_anti")


def data_added(blobs: DataFrame, index: DataFrame) -> DataFrame:
    return new_blobs(blobs, index).agg(F.count("*").alias("blobs"), F.coalesce(F.sum("length"), F.lit(0)).alias("data_added"))


def latest_index(entries: DataFrame, order: str = "index_id") -> DataFrame:
    """One entry for each (type, id): the one loaded last."""
    rest = [c for c in entries.columns if c not in ("type", "id")]
    return entries.groupBy("type", "id").agg(F.max_by(F.struct(*rest), F.struct(order, "pack_id", "offset")).alias("e")).select("type", "id", *(F.col(f"e.{c}") for c in rest))


def parent_snapshot(wanted: DataFrame, snapshots: DataFrame) -> DataFrame:
    """For wanted(key, paths, excludes, before): the latest earlier snapshot with the same ordered paths and excludes.

    Tags and hosts don't matter; of equal times the smaller id.  Without one the parent is null.
    """
    none = F.expr("cast(array() as array<string>)")
    fields = ["paths", F.coalesce("excludes", none).alias("excludes")]
    # of equal times the smallest id stands for all, and a wanted row comes before the snapshots of its own time
    old = snapshots.groupBy(*fields, F.col("time").alias("at")).agg(F.min("id").alias("id")).withColumn("key", F.lit(None).cast(wanted.schema["key"].dataType)).withColumn("kind", F.lit(1))
    new = wanted.select(*fields, F.col("before").alias("at"), F.lit(None).cast(snapshots.schema["id"].dataType).alias("id"), "key", F.lit(0).alias("kind"))
    w = W.partitionBy("paths", "excludes").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    return old.unionByName(new).withColumn("parent", F.last("id", ignorenulls=True).over(w)).where("kind = 0").select("key", "parent")


def same_metadata(a: str, b: str, columns=METADATA) -> Column:
    return F.struct(*(F.col(f"{a}.{c}") for c in columns)).eqNullSafe(F.struct(*(F.col(f"{b}.{c}") for c in columns)))


def classify(now: DataFrame, parent: DataFrame, columns: tuple[str, ...] = METADATA, key: str = "path") -> DataFrame:
    """now(path, ...) with change: unmodified (a file with content and the same metadata), changed, new, or null for others."""
    a, b = now.alias("a"), parent.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left")
    kept = (F.col("b.type") == "file") & F.col("b.content").isNotNull() & same_metadata("a", "b", columns)
    change = F.when(F.col("a.type") == "file", F.when(F.coalesce(kept, F.lit(False)), "unmodified").when(F.col(f"b.{key}").isNotNull(), "changed").otherwise("new"))
    return joined.select("a.*", change.alias("change"))


def deleted(now: DataFrame, parent: DataFrame, key: str = "path") -> DataFrame:
    return parent.join(now.select(key), key, "left_anti")


def snapshot_summary(classified: DataFrame, added: DataFrame) -> DataFrame:
    """One row: files by change, bytes read or kept, bytes added."""
    files = classified.agg(
        F.count_if(F.col("change") == "new").alias("files_new"), F.count_if(F.col("change") == "changed").alias("files_changed"), F.count_if(F.col("change") == "unmodified").alias("files_unmodified"),
        F.coalesce(F.sum(F.when(F.col("change").isNotNull(), F.col("size"))), F.lit(0)).alias("total_bytes_processed"),
    )
    return files.crossJoin(added.select("data_added"))  # both are one row


def reusable_directories(entries: DataFrame, parent_entries: DataFrame, depth: int) -> DataFrame:
    """Directories below which nothing changed: path -> reused.

    entries(path, parent, type, same): same tells whether a child that is no directory is unmodified.  From
    the deepest level up, a directory is reused if it has the same children as before and all are unchanged.
    """
    names = lambda df: df.groupBy("parent").agg(F.sort_array(F.collect_set("path")).alias("children"))
    equal = names(entries).join(names(parent_entries).withColumnRenamed("children", "old"), "parent", "left").select(F.col("parent").alias("path"), F.coalesce(F.col("children") == F.col("old"), F.lit(False)).alias("same_set"))
    state = entries.select("path", "parent", "type", F.size(F.split("path", "/")).alias("depth"), F.when(F.col("type") != "dir", F.col("same")).alias("ok"))
    out = None
    for level in range(depth, 0, -1):
        below = state.where(F.col("depth") == level + 1)
        below = below.join(out, "path", "left").withColumn("ok", F.coalesce("reused", "ok")).drop("reused") if out is not None else below
        done = equal.where(F.size(F.split("path", "/")) == level).join(below.groupBy(F.col("parent").alias("path")).agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok")), "path", "left")
        found = settled(done.select("path", (F.col("same_set") & F.coalesce("ok", F.lit(False))).alias("reused")))  # else plans would double with each level
        out = found if out is None else out.unionByName(found)
    return out


def build_trees(files: DataFrame, depth: int) -> DataFrame:
    """Merkle trees of files(path, id, size), absolute paths of up to `depth` names: a row (path, tree) for each directory.

    A tree's id is the hash of its children as canonical JSON, sorted by name in byte order, with a line
    end; levels are hashed from the deepest up, one shuffle and one checkpoint for each, so that the plan
    stays as small for deep trees as for flat ones.
    """
    node = files.select(
        F.substring_index("path", "/", -1).alias("name"), F.lit("file").alias("type"), F.col("id"), F.col("size"), F.regexp_replace("path", "/[^/]*$", "").alias("parent")
    )
    level, out = node.withColumn("depth", F.size(F.split("parent", "/"))).where(F.col("depth") == depth), None
    for d in range(depth, 0, -1):
        trees = settled(level.groupBy("parent").agg(
            F.sha2(F.concat(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("name", "type", "id", "size"))).alias("nodes"))), F.lit("\n")), 256).alias("tree"), F.sum("size").alias("size")
        ))
        out = trees.select(F.col("parent").alias("path"), "tree") if out is None else out.unionByName(trees.select(F.col("parent").alias("path"), "tree"))
        up = trees.select(
            F.substring_index("parent", "/", -1).alias("name"), F.lit("dir").alias("type"), F.col("tree").alias("id"), "size", F.regexp_replace("parent", "/[^/]*$", "").alias("parent"), F.lit(d - 1).alias("depth")
        )
        below = node.select("*", F.size(F.split("parent", "/")).alias("depth")).where(F.col("depth") == d - 1)
        level = below.unionByName(up)
    return out


def pack_offsets(headers: DataFrame) -> DataFrame:
    """Where each blob of a pack starts: the lengths of those before it."""
    w = W.partitionBy("pack_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    return headers.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)))


def pack_plan(blobs: DataFrame, size: int = PACK, lanes: int = 64) -> DataFrame:
    """blobs(type, id, length) with lane and pack: within a lane packs are filled in the order of ids and closed at `size`.

    Filling depends on order, so it runs lane by lane; lanes are given by hash, as many writers would work
    at once, and no lane needs more memory than one batch.
    """
    import pandas as pd

    def run(batches):
        state, last = (0, 0), None
        for pdf in batches:
            packs, used, pack = [], *state
            for t, lane, n in zip(pdf["type"], pdf["lane"], pdf["length"], strict=True):
                if (t, lane) != last:
                    last, used, pack = (t, lane), 0, 0
                packs.append(pack)
                used += int(n)
                if used >= size:
                    used, pack = 0, pack + 1
            state = used, pack
            yield pdf.assign(pack=pd.Series(packs, index=pdf.index, dtype="int64"))

    own = blobs.select("type", "id", F.col("length").cast("bigint").alias("length"), F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int").alias("lane"))
    # one partition holds whole lanes, in order, so the fill streams through it
    return own.repartition("type", "lane").sortWithinPartitions("type", "lane", "id").mapInPandas(run, "type string, id string, length bigint, lane int, pack bigint")


def save_blobs(blobs: DataFrame, index: DataFrame, keys: Keys) -> DataFrame:
    """type, id, payload, length and uncompressed_length of blobs(type, data) that the index lacks, each once.

    Data is compressed unless it is empty, which an uncompressed_length of 0 tells, then sealed under a fresh
    counter; length is that of the payload.  A counter is random, so the rows are settled before they are given.
    """

    def run(batches):
        import os

        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor()
        for batch in batches:
            data = batch.column("data").to_pylist()
            payload = seal_all([pack.compress(x) if x else x for x in data], keys, [os.urandom(16) for _ in data])
            rest = [pa.array(payload, pa.binary()), pa.array([len(x) for x in payload], pa.int64()), pa.array([len(x) for x in data], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("type"), batch.column("id"), *rest], names=["type", "id", "payload", "length", "uncompressed_length"])

    named = blobs.select("type", F.sha2("data", 256).alias("id"), "data").where("data IS NOT NULL")
    return settled(new_blobs(named, index).select("type", "id", "data").mapInArrow(run, "type string, id string, payload binary, length bigint, uncompressed_length bigint"))


def packs(saved: DataFrame, keys: Keys, size: int = PACK, lanes: int = 64) -> DataFrame:
    """pack_id, type, content: saved blobs one after the other, the sealed list of them, and its length.

    Packs are those of pack_plan by lengths of payloads; a task holds one pack, which is `size` and a blob at most.
    """

    def run(pdf):
        import hashlib

        import pandas as pd

        pdf = pdf.sort_values("id")
        head = b"".join(
            bytes([(t == "tree") + 2 * (full > 0)]) + int(n).to_bytes(4, "little") + (int(full).to_bytes(4, "little") if full else b"") + bytes.fromhex(i)
            for t, i, n, full in zip(pdf["type"], pdf["id"], pdf["length"], pdf["uncompressed_length"], strict=True)
        )
        body = b"".join(pdf["payload"])
        # the counter of the list comes from the payloads, so that a task that runs again gives the same pack
        listed = seal(head, keys, hashlib.sha256(body + head).digest()[:16])
        content = body + listed + len(listed).to_bytes(4, "little")
        return pd.DataFrame({"pack_id": [hashlib.sha256(content).hexdigest()], "type": [pdf["type"].iloc[0]], "content": [content]})

    placed = saved.join(pack_plan(saved, size, lanes).select("type", "id", "lane", "pack"), ["type", "id"])
    return placed.groupBy("type", "lane", "pack").applyInPandas(run, "pack_id string, type string, content binary")


def unique_names(roots: DataFrame) -> DataFrame:
    """roots(position, path) with names: the n-th repetition of a basename gets -n."""
    base = F.when(F.regexp_replace("path", "/+$", "") == "", "root").otherwise(F.substring_index(F.regexp_replace("path", "/+$", ""), "/", -1))
    named = roots.withColumn("base", base)
    nr = F.row_number().over(W.partitionBy("base").orderBy("position"))
    return named.withColumn("name", F.when(nr == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), (nr - 1).cast("string")))).drop("base")


def snapshot_list(snapshots: DataFrame) -> DataFrame:
    """Newest first, with short ids and sizes."""
    return snapshots.select(F.substring("id", 1, 8).alias("short_id"), "time", F.coalesce(F.col("summary.total_bytes_processed"), F.lit(0)).alias("size"), "id").orderBy(F.col("time").desc(), "id")


def resolve(snapshots: DataFrame, wanted: str) -> DataFrame:
    """The snapshot that an id, a unique beginning of one, or `latest` stands for; no row for none or several."""
    if wanted == "latest":
        return snapshots.orderBy(F.col("time").desc(), "id").limit(1)
    found = snapshots.where(F.col("id").startswith(wanted))
    return found.crossJoin(found.agg(F.count("*").alias("__n"))).where("__n = 1").drop("__n")


def size_estimate(files: DataFrame) -> DataFrame:
    """Bytes of all included files, each path once; -1 stands for unknown."""
    return files.dropDuplicates(["path"]).where(~F.col("excluded")).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total")).select(F.when(F.col("total") <= 0, F.lit(-1)).otherwise(F.col("total")).cast("bigint").alias("size"))
