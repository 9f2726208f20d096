"""Exact deduplication by a log-structured merge index.

* **Memtable.** Each task keeps a table digest -> (smallest id, rows) of bounded size.  When full it
  is flushed as runs, sorted by digest, one for each digest range, with a Bloom filter of its digests.
* **Compaction.** All runs of a digest range meet in one task (a run holds each digest once, so a
  group of copies, however large, gives one entry for each run).  A newer run's digests are
  first put to the filter of what is merged so far; those that cannot be there are appended,
  the others are merged, keeping the smallest identifier and adding up the rows.
* **Hits.** Only digests with more than one row leave the index, with a filter of fixed size over all
  of them: texts that it excludes stand alone, and their bytes are not moved.  A hit counts once its
  bytes equal those of the row that stays; rows that share a digest but not the bytes are grouped by bytes.

Texts are equal when identical after replacing each run of ASCII white space by one space; null is
the empty text.  Of equal texts the row with the smallest doc_id stays; a null doc_id is larger than
all others; rows that repeat both doc_id and text count as the one document and stay together.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import raw, slices, stored

#: Entries of a memtable before it is flushed.
MEMTABLE = 200_000
#: Rows that one digest range is planned for.
RANGE_ROWS = 1_000_000
#: Bits of a run's filter for each of its digests, and how many of them a digest sets.
FILTER_BITS, FILTER_HASHES = 12, 4
#: Bits of the one filter over all hits, in blocks; where hits outgrow it, more bytes move and results stay the same.
HIT_BITS, HIT_BLOCK = 1 << 23, 1 << 17
#: Stands for a null identifier while numbers are compared.
NO_ID = np.iinfo(np.int64).max


def normalised(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space, at the ends too."""
    words = text.split()
    if not words:
        return b" " if text else b""
    head = b" " if text[:1].isspace() else b""
    return head + b" ".join(words) + (b" " if text[-1:].isspace() else b"")


def digest(text: bytes, size: int = 32) -> bytes:
    return hashlib.sha256(text).digest()[:size].ljust(32, b"\0")


class Filter:
    """A Bloom filter over digests, which are evenly spread already."""

    def __init__(self, digests: np.ndarray | None = None, bits: np.ndarray | None = None):
        if bits is None:
            size = max(64, len(digests) * FILTER_BITS)
            bits = np.zeros((size + 7) // 8, np.uint8)
            places = self._places(digests, len(bits) * 8).ravel()
            np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
        self.bits = bits

    @staticmethod
    def _places(digests: np.ndarray, size: int) -> np.ndarray:
        a, b = digests[:, 1], digests[:, 2] | np.uint64(1)
        with np.errstate(over="ignore"):
            return np.stack([((a + np.uint64(k) * b) % np.uint64(size)).astype(np.int64) for k in range(FILTER_HASHES)], 1)

    def may_have(self, digests: np.ndarray) -> np.ndarray:
        places = self._places(digests, len(self.bits) * 8)
        return ((self.bits[places >> 3] >> (places & 7)) & 1).all(1)


def order(digests: np.ndarray) -> np.ndarray:
    return np.lexsort(digests.T[::-1])


def merged(digests: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each digest, sorted: the smallest identifier and all rows."""
    if not len(ids):
        return digests, ids, rows
    at = order(digests)
    digests, ids, rows = digests[at], ids[at], rows[at]
    first = np.flatnonzero(np.concatenate([[True], (digests[1:] != digests[:-1]).any(1)]))
    return digests[first], np.minimum.reduceat(ids, first), np.add.reduceat(rows, first)


def compacted(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, Filter]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges runs two by two, of about equal size; digests that the other run's filter excludes skip the merge."""
    level = sorted(runs, key=lambda r: len(r[1]))
    while len(level) > 1:
        (da, ia, ra, fa), (db, ib, rb, _) = level.pop(0), level.pop(0)
        both = fa.may_have(db)
        d, i, r = merged(np.concatenate([da, db[both]]), np.concatenate([ia, ib[both]]), np.concatenate([ra, rb[both]]))
        d, i, r = np.concatenate([d, db[~both]]), np.concatenate([i, ib[~both]]), np.concatenate([r, rb[~both]])
        run = (d, i, r, Filter(d))
        level.insert(next((k for k, x in enumerate(level) if len(x[1]) >= len(i)), len(level)), run)
    return level[0][:3]


RUN = "part int, digests binary, ids binary, counts binary, filter binary"
HIT = "digest binary, keep_id long, group_size long"


def _flushed(table: dict[bytes, list[int]], parts: int) -> Iterator[pa.RecordBatch]:
    if not table:
        return
    keys = sorted(table)
    digests = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 4).astype(np.uint64)
    values = np.array([table[k] for k in keys], np.int64)
    part = ((digests[:, 0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    ends = np.searchsorted(part, np.arange(parts), side="right")
    starts = np.concatenate([[0], ends[:-1]])
    out = [
        {"part": p, "digests": digests[a:b].tobytes(), "ids": values[a:b, 0].tobytes(), "counts": values[a:b, 1].tobytes(), "filter": Filter(digests[a:b]).bits.tobytes()}
        for p, (a, b) in enumerate(zip(starts, ends, strict=True))
        if b > a
    ]
    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("part", pa.int32()), *((k, pa.binary()) for k in ("digests", "ids", "counts", "filter"))]))
    table.clear()


def _flush(parts: int, size: int, memtable: int):
    def run(batches):
        table: dict[bytes, list[int]] = {}
        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), raw(batch), strict=True):
                doc = NO_ID if doc is None else doc
                entry = table.setdefault(digest(normalised(text), size), [doc, 0])
                entry[0] = min(entry[0], doc)
                entry[1] += 1
            if len(table) >= memtable:
                yield from _flushed(table, parts)
        yield from _flushed(table, parts)

    return run


def _compact(table: pa.Table) -> pa.Table:
    unpack = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
    runs = [
        (d.reshape(-1, 4), i, c, Filter(bits=f))
        for d, i, c, f in zip(unpack("digests", np.uint64), unpack("ids", np.int64), unpack("counts", np.int64), unpack("filter", np.uint8), strict=True)
    ]
    d, ids, counts = compacted(runs)
    hit = counts > 1
    keys = d[hit].astype(">u8").tobytes()
    return pa.table({
        "digest": pa.array([keys[k : k + 32] for k in range(0, len(keys), 32)], pa.binary()),
        "keep_id": pa.array(ids[hit], pa.int64()),
        "group_size": pa.array(counts[hit], pa.int64()),
    })


def _blocks(batches):
    """The filter's bits that a task's hits set, block by block."""
    bits = np.zeros(HIT_BITS // 8, np.uint8)
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").reshape(-1, 4).astype(np.uint64)
        places = Filter._places(keys, HIT_BITS).ravel()
        np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
    size = HIT_BLOCK // 8
    used = [(k, bits[k * size : (k + 1) * size].tobytes()) for k in range(HIT_BITS // HIT_BLOCK) if bits[k * size : (k + 1) * size].any()]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in used], pa.int32()), pa.array([b for _, b in used], pa.binary())], names=["block", "bits"])


def _either(batches):
    """One row for each block that the batches have, however many rows they hold."""
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, b in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            blocks[k] = blocks[k] | np.frombuffer(b, np.uint8) if k in blocks else np.frombuffer(b, np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], names=["block", "bits"])


def hit_filter(hits: DataFrame) -> Filter:
    """A filter of HIT_BITS bits, whatever the number of hits."""
    kind = "block int, bits binary"
    bits = np.zeros(HIT_BITS // 8, np.uint8)
    for row in hits.select("digest").mapInArrow(_blocks, kind).repartition("block").mapInArrow(_either, kind).toLocalIterator():
        bits[row["block"] * HIT_BLOCK // 8 : (row["block"] + 1) * HIT_BLOCK // 8] |= np.frombuffer(row["bits"], np.uint8)
    return Filter(bits=bits)


def _digested(size: int, known: Filter):
    """Digests of all rows; the bytes, packed, only of those that may be hits."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            texts = [normalised(x) for x in raw(batch)]
            keys = [digest(x, size) for x in texts]
            maybe = known.may_have(np.frombuffer(b"".join(keys), ">u8").reshape(-1, 4).astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()), pa.array([pack.compress(x) if m else None for x, m in zip(texts, maybe, strict=True)], pa.binary())],
                names=["doc_id", "digest", "sha", "packed"],
            )

    return run


def exact_groups(docs: DataFrame, memtable: int = MEMTABLE, digest_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs(doc_id, text).

    `digest_bytes` below 32 weakens the digests, so that tests reach the rows whose bytes differ.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(8, -(-docs.count() // RANGE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = docs.mapInArrow(_flush(parts, digest_bytes, memtable), RUN)
    hits = stored(runs.groupBy("part").applyInArrow(_compact, HIT), "exact-hits")

    rows = docs.mapInArrow(_digested(digest_bytes, hit_filter(hits)), "doc_id long, digest binary, sha binary, packed binary")
    # the row that stays, with its bytes; rows that repeat its id and text are one document, so the smallest bytes serve
    kept = (
        rows.where("packed is not null").join(hits, "digest")
        .where(F.coalesce("doc_id", F.lit(int(NO_ID))) == F.col("keep_id"))
        .groupBy("digest", "keep_id", "group_size")
        .agg(F.min("packed").alias("kept_bytes"))
    )
    found = stored(
        rows.join(kept, "digest", "left").select(
            "doc_id", "digest", F.lower(F.hex("sha")).alias("text_sha256"), "keep_id", "group_size",
            F.when(F.col("keep_id").isNotNull(), F.col("packed") == F.col("kept_bytes")).alias("same"),
        ),
        "exact-found",
    )
    # one row stands for itself; hits whose bytes were the same belong to the row that stays
    alone = found.where("same is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    odd = found.where("not same").select("digest").distinct()
    if odd.isEmpty():
        hit = found.where("same").select("doc_id", F.nullif("keep_id", F.lit(int(NO_ID))).alias("keep_id"), "group_size", "text_sha256")
    else:
        # digests that met by accident: their rows are grouped by the bytes themselves
        own = rows.join(odd, "digest", "left_semi")
        per = own.groupBy("digest", "packed").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        apart = own.join(per, ["digest", "packed"]).select("doc_id", "keep_id", "group_size", F.lower(F.hex("sha")).alias("text_sha256"))
        hit = (
            found.where("same is not null").join(odd, "digest", "left_anti")
            .select("doc_id", F.nullif("keep_id", F.lit(int(NO_ID))).alias("keep_id"), "group_size", "text_sha256").unionByName(apart)
        )
    return alone.unionByName(hit).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    drop = exact_groups(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__gone_sha")).distinct()
    # all columns travel as one, so that none of theirs can meet one of ours
    marked = docs.select(F.col("doc_id").cast("long").alias("__id"), F.sha2(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256).alias("__sha"), F.struct("*").alias("__row"))
    return marked.join(drop, F.col("__id").eqNullSafe(F.col("__gone")) & (F.col("__sha") == F.col("__gone_sha")), "left_anti").select("__row.*")
