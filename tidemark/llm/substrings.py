"""Removal of repeated passages by difference-cover anchors.

A passage is WINDOW words that also start in a document with a smaller doc_id; every word that such a
window covers is removed, judged on the input.

* **Anchors.** In each document, runs of ANCHOR words are hashed only where their position modulo
  PERIOD is in the difference cover {0, 1, 3}: for any two positions there is a shift below PERIOD that
  brings both into the cover, so any two equal windows share an anchor at the same shift within them.
* **Shared anchors.** Chunks of documents send their distinct anchors to hash ranges, each hash once
  for a chunk however often it occurs; an anchor is shared if two documents have it.
* **Extension.** Only windows around shared anchors are extended to full windows and hashed as a whole;
  ranges of these find the smallest document of each, and chunks get back those that beat their own.

Nothing is sent for each occurrence or pair, so a passage in every document costs one entry for each
chunk.  Documents are cut into chunks of CHUNK bytes (or one longer text) that are written once, and
read again for each step.  Windows are told apart by 64 bits of hash and the range, which comes
from other bits.

Words are runs other than ASCII white space, unchanged.  A null or empty text has no words.  Rows with
equal doc_id are one document: none is smaller.  A null doc_id is larger than all others and keeps its
row from being judged: it loses no words.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import WordCache, digest64, mixed, raw, slices, split, stored, sums, windows

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text in a chunk; bytes of text whose windows one hash range is planned for.
CHUNK, RANGE = 2 << 20, 64 << 20
NO_ID = np.iinfo(np.int64).max


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of 8 bytes, byte by byte of all, so that what they share is compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes, kind=np.uint64) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view(kind).ravel()


def _chunked(batches) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    ids: list[int | None] = []
    texts: list[bytes] = []
    size = 0

    def flush():
        nonlocal number, size
        blob = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        known = np.array([NO_ID if i is None else i for i in ids], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([packed(known)]), pa.array([np.packbits([i is None for i in ids]).tobytes()]), pa.array([packed(lengths)]), pa.array([blob], pa.binary()), pa.array([int(lengths.sum())])],
            names=["chunk", "ids", "nulls", "lengths", "texts", "bytes"],
        )
        ids.clear()
        texts.clear()
        number, size = number + 1, 0

    for batch in slices(batches):
        for doc, text in zip(batch.column("doc_id").to_pylist(), raw(batch), strict=True):
            if texts and size + len(text) > CHUNK:
                yield from flush()
            ids.append(doc)
            texts.append(text)
            size += len(text)
    if texts:
        yield from flush()


CHUNKS = "chunk long, ids binary, nulls binary, lengths binary, texts binary, bytes long"


class Chunk:
    """The documents of a chunk, their words and hashes."""

    def __init__(self, row: dict):
        lengths = unpacked(row["lengths"], np.int64)
        self.ids, n = unpacked(row["ids"], np.int64), len(lengths)
        self.nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8))[:n].astype(bool)
        blob = zstandard.ZstdDecompressor().decompress(row["texts"])
        ends = np.cumsum(lengths)
        self.words, self.bounds = split([blob[a:b] for a, b in zip(ends - lengths, ends, strict=True)])
        self.hashes = _hashes(self.words) if self.words else np.zeros(0, np.uint64)
        self.owner = np.repeat(np.arange(n), np.diff(self.bounds))

    def starts(self, width: int, cover: bool = False) -> np.ndarray:
        """Where runs of `width` words start that lie within one document."""
        at = np.arange(max(0, len(self.words) - width + 1))
        at = at[at + width <= self.bounds[1:][self.owner[at]]]
        return at[np.isin((at - self.bounds[:-1][self.owner[at]]) % PERIOD, COVER)] if cover else at


#: One cache for all chunks that a worker reads.
_hashes = WordCache(digest64, 100_000)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The hash range, from bits that differ from those compared within it."""
    return (mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)).astype(np.int64)


class Grouped:
    """Positions grouped by the hash of what starts there, hashes sorted by range."""

    def __init__(self, at: np.ndarray, hashes: np.ndarray, parts: int, second: np.ndarray):
        part = _part(second, parts)
        order = np.lexsort((hashes, part))
        self.at, h, p = at[order], hashes[order], part[order]
        self.first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (p[1:] != p[:-1])])) if len(h) else np.zeros(0, np.int64)
        self.hash, self.part = h[self.first], p[self.first]
        self.count = np.diff(np.append(self.first, len(h)))

    def least(self, values: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(values, self.first) if len(self.first) else values[:0]

    def each(self):
        """(range, slice of the distinct hashes in it)."""
        cuts = np.flatnonzero(np.diff(self.part)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(self.part)], strict=True):
            if b > a:
                yield int(self.part[a]), slice(a, b)


SECOND = 0xBF58476D1CE4E5B9


def _anchors(chunk: Chunk, parts: int) -> Grouped:
    at = chunk.starts(ANCHOR, cover=True)
    return Grouped(at, windows(chunk.hashes, ANCHOR)[at], parts, windows(chunk.hashes, ANCHOR, SECOND)[at])


def _send_anchors(parts: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                g = _anchors(chunk, parts)
                owner = chunk.ids[chunk.owner[g.at]] if len(g.at) else np.zeros(0, np.int64)
                many = g.least(owner) != -g.least(-owner)
                out = [(p, row["chunk"], packed(g.hash[s]), np.packbits(many[s]).tobytes()) for p, s in g.each()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "chunk", "hashes", "many"])

    return run


def _shared(table: pa.Table) -> pa.Table:
    """For each chunk, which of its anchors in this range another document has too."""
    rows = [(r["chunk"], unpacked(r["hashes"]), r["many"]) for r in table.to_pylist()]
    every = np.sort(np.concatenate([h for _, h, _ in rows]))
    twice = every[1:][every[1:] == every[:-1]]
    out = []
    for chunk, h, many in rows:
        found = np.unpackbits(np.frombuffer(many, np.uint8))[: len(h)].astype(bool)
        if len(twice):
            found |= twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
        if found.any():
            out.append((chunk, np.packbits(found).tobytes()))
    return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "part": pa.array([table.column("part")[0].as_py()] * len(out), pa.int32()), "found": pa.array([f for _, f in out], pa.binary())})


def _send_windows(parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        found = dict(zip(right.column("part").to_pylist(), right.column("found").to_pylist(), strict=True))
        for row in left.to_pylist() if found else []:
            chunk = Chunk(row)
            g = _anchors(chunk, parts)
            shared = np.zeros(len(g.hash), bool)
            for p, s in g.each():
                if p in found:
                    shared[s] = np.unpackbits(np.frombuffer(found[p], np.uint8))[: s.stop - s.start]
            anchors = g.at[np.repeat(shared, g.count)]
            near = np.zeros(len(chunk.words), bool)
            for shift in range(PERIOD):
                at = anchors - shift
                near[at[at >= 0]] = True
            at = chunk.starts(WINDOW)
            at = at[near[at]]
            w = Grouped(at, windows(chunk.hashes, WINDOW)[at], parts, windows(chunk.hashes, WINDOW, SECOND)[at])
            least = w.least(chunk.ids[chunk.owner[w.at]]) if len(w.at) else np.zeros(0, np.int64)
            out += [(p, row["chunk"], packed(w.hash[s]), packed(least[s])) for p, s in w.each()]
        return pa.table([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "chunk", "hashes", "ids"])

    return run


def _beaten(table: pa.Table) -> pa.Table:
    """For each chunk, its windows in this range that start in a smaller document of another chunk, and that document."""
    rows = [(r["chunk"], unpacked(r["hashes"]), unpacked(r["ids"], np.int64)) for r in table.to_pylist()]
    every, ids = np.concatenate([h for _, h, _ in rows]), np.concatenate([i for _, _, i in rows])
    order = np.argsort(every, kind="stable")
    every, ids = every[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    hashes, least = every[first], np.minimum.reduceat(ids, first)
    out = []
    for chunk, h, own in rows:
        best = least[np.searchsorted(hashes, h)]
        if (less := best < own).any():
            out.append((chunk, packed(h[less]), packed(best[less])))
    part = table.column("part")[0].as_py()
    return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([part] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["chunk", "part", "hashes", "ids"])


def _judge(parts: int, texts: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in range(5)]
        better = [(p, unpacked(h), unpacked(i, np.int64)) for p, h, i in zip(right.column("part").to_pylist(), right.column("hashes").to_pylist(), right.column("ids").to_pylist(), strict=True)]
        by_part = {p: (h, i) for p, h, i in better}
        for row in left.to_pylist():
            chunk = Chunk(row)
            at = chunk.starts(WINDOW)
            w = Grouped(at, windows(chunk.hashes, WINDOW)[at], parts, windows(chunk.hashes, WINDOW, SECOND)[at])
            own = chunk.ids[chunk.owner[w.at]] if len(w.at) else np.zeros(0, np.int64)
            least = w.least(own).copy()
            for p, s in w.each():
                if p in by_part:
                    h, i = by_part[p]
                    k = np.minimum(np.searchsorted(h, w.hash[s]), len(h) - 1)
                    least[s] = np.where(h[k] == w.hash[s], np.minimum(least[s], i[k]), least[s])
            later = w.at[(np.repeat(least, w.count) < own) & ~chunk.nulls[chunk.owner[w.at]]] if len(w.at) else w.at
            change = np.zeros(len(chunk.words) + 1, np.int64)
            np.add.at(change, later, 1)
            np.add.at(change, later + WINDOW, -1)
            gone = np.cumsum(change)[:-1] > 0
            removed = sums(gone.astype(np.int64), chunk.bounds)
            for k, (a, b) in enumerate(zip(chunk.bounds[:-1], chunk.bounds[1:], strict=True)):
                keep = chunk.words[a:b] if not removed[k] else [x for x, g in zip(chunk.words[a:b], gone[a:b], strict=True) if not g]
                kept = b" ".join(keep)
                for c, v in zip(columns, (None if chunk.nulls[k] else int(chunk.ids[k]), int(b - a), int(removed[k]), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None), strict=True):
                    c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def repeated_passages(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs(doc_id, text); kept_text if asked for."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = stored(docs.mapInArrow(_chunked, CHUNKS), "passage-chunks")
    total = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))

    sent = chunks.mapInArrow(_send_anchors(parts), "part int, chunk long, hashes binary, many binary")
    shared = sent.groupBy("part").applyInArrow(_shared, "chunk long, part int, found binary")
    whole = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_send_windows(parts), "part int, chunk long, hashes binary, ids binary")
    beaten = whole.groupBy("part").applyInArrow(_beaten, "chunk long, part int, hashes binary, ids binary")
    out = chunks.groupBy("chunk").cogroup(beaten.groupBy("chunk")).applyInArrow(_judge(parts, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if texts else out.drop("kept_text")
