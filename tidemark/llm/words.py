"""Whole texts as words, in bounded slices of Arrow batches.

A word is a run of bytes other than the six ASCII white-space characters, which is what
``bytes.split()`` yields.  Everything here is bounded by bytes, never by rows: a slice holds at
most ``limit`` bytes of text (or one text, however long), and caches are emptied when full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are held as Python objects at a time.
SLICE_BYTES = 4 << 20
#: Words that a cache holds before it is emptied.
CACHE_WORDS = 300_000


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most `limit` bytes of `column`, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def split(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts in order, and where each text's words start (one more entry at the end)."""
    words: list[bytes] = []
    bounds = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts, 1):
        words += text.split()
        bounds[i] = len(words)
    return words, bounds


def stretches(text: bytes, size: int) -> Iterator[bytes]:
    """A text in pieces of about `size` bytes, cut at white space only."""
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def digest64(words: Iterable[bytes]) -> np.ndarray:
    """64-bit hashes, the same on every machine."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64)


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        self.fresh.append(word)
        return i


class WordCache:
    """Computes a value for each distinct word once: `measure` gets the new words, in order.

    Values are rows of one numpy array; `look` gives each word's row.  The cache is emptied before
    a slice once it holds more than `limit` words, so memory stays bounded on any input.
    """

    def __init__(self, measure: Callable[[list[bytes]], np.ndarray], limit: int = CACHE_WORDS):
        self.measure, self.limit = measure, limit
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.index.fresh = []
        self.parts: list[np.ndarray] = []
        self.values: np.ndarray | None = None

    def look(self, words: list[bytes]) -> np.ndarray:
        """Rows of `self.values` for the words."""
        if len(self.index) > self.limit:
            self._clear()
        rows = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.fresh or self.values is None:
            new = self.measure(self.index.fresh)
            self.values = new if self.values is None else np.concatenate([self.values, new])
            self.index.fresh = []
        return rows

    def __call__(self, words: list[bytes]) -> np.ndarray:
        rows = self.look(words)
        return self.values[rows]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, width: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash for each run of `width` hashes, across text bounds; the caller masks those."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(seed) + hashes[k : k + n]
    return mixed(out)


def window_texts(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of `width` words that lie within one text, and that text's number."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - np.repeat(first, counts) + np.repeat(bounds[:-1], counts), owner


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values from each bound to the next; of floats each by itself, so that equal texts have equal sums."""
    if values.dtype.kind == "f":
        out, some = np.zeros(len(bounds) - 1), bounds[1:] > bounds[:-1]
        if some.any():
            out[some] = np.add.reduceat(values, bounds[:-1][some])
        return out
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def shelf(spark) -> str:
    """The shared folder for tables between jobs: spark.checkpoint.dir; a local session may do without."""
    where = spark.conf.get("spark.checkpoint.dir", None) or None
    if where is None and (set_dir := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        where = set_dir.get()
    if where is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df, name: str):
    """Writes the frame as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors."""
    import uuid

    spark = df.sparkSession
    path = f"{shelf(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*frames) -> None:
    """Removes the tables of stored() frames that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
