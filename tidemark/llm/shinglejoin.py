"""Join of documents whose word shingles have a Jaccard similarity of 80 % or more, exact.

A document's set is its distinct SHINGLE-word shingles in lower case; equal sets are one node.

* **Global order.** A sketch of fixed size counts all shingles; sets are ordered rare first, so that
  very common shingles come last.  Similar sets share their first shingles in any order.
* **Light sets** (up to the boundary) put each 2-subset of their prefix into a list: such lists hold
  next to nothing but similar sets.
* **Heavy sets** scan the inverted lists of the single shingles of their prefix, in which light sets
  just below the boundary stand as well, since those may be similar to heavy ones.
* **Boundary.** The largest size at which the number of 2-subsets does not exceed the entries that a
  scan of the prefix's lists is expected to touch, by the sketch.
* **Lists.** Texts are hashed once.  Bundles of sets send each key once, however often it occurs, and get back
  which keys another set of a size that may be similar has too; only those become rows (list, set), so no
  list meets in one task.
* **Hubs.** Each list has a hub for each class of sizes: the set that has the largest share of its keys in
  common with others, which in a group of near copies is the one they were made from.  A set is paired
  with the hubs of its lists: as many pairs as rows, however large a group is.
* **Cells.** What a list still holds in different components is compared by bitmaps, in cells of two blocks of
  bounded size, so a long list is many tasks.  A cell gives the nearest pairs that would connect its
  components (a forest); what those leave apart is compared once more, and then every pair whose
  bitmaps allow the similarity is given.  So no link is lost, and copies never give all pairs.
* **Pairs.** A pair needs a list in which both have enough elements left to reach the similarity (positions in
  the order tell that of their first common element), bitmaps that do not differ in more bits than
  similar sets can differ in elements, and is verified by the whole sets.

Set elements are 48-bit hashes, nodes' names 64-bit ones.

Words are runs other than ASCII white space, A-Z in lower case.  With fewer words than SHINGLE, the
whole sequence is the one shingle; without words the set is empty and linked with nothing.  Of a
component the smallest doc_id is its id; null ids are larger than all others.  Rows that repeat a text
are in one component.  An empty table gives an empty result.  Other columns, whatever their names, are
not looked at.  A very long text is split into words a stretch at a time and kept as hashes only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.substrings import Grouped, packed, unpacked
from tidemark.llm.words import WordCache, digest64, dropped, mixed, raw, slices, split, stored, stretches, windows

SHINGLE = 5
#: Similarity in percent.
LEAST = 80
#: Bits of an element.
BITS = 48
#: Counters of the sketch, and how many of them go in one row; rows of one block that are added up at a time.
SKETCH_BITS, BLOCK, FAN = 21, 1 << 15, 16
SKETCH = 1 << SKETCH_BITS
#: The largest set that may be light; members of a block of a long list.
LIGHT, MEMBERS = 100, 512
#: Bytes of a very long text that are split into words at a time, of the prefixes in a bundle; elements that a key range is planned for.
STRETCH, BUNDLE, RANGE = 1 << 20, 1 << 20, 1 << 23
#: Words of 64 bits of the filter that sets pass before they are moved: at most, and for each name.
FILTER_WORDS, FILTER_SHARE = 1 << 20, 6
#: Names whose elements a task remembers to have given.
SEEN = 1_000_000


def needed(n):
    """Elements that a set of n shares with any similar set, at least."""
    return -(-LEAST * n // 100)


def prefix_size(n: int) -> int:
    """Elements of a set of n that its keys are made of, in the global order."""
    return min(n, n - int(needed(n)) + 2)


def six(numbers: np.ndarray) -> bytes:
    """Numbers below 2^48, byte by byte of all."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    return out.view(np.uint64).ravel()


def bits_of(n: int) -> int:
    """Bits of a set's bitmap: a power of two, two for each element or more."""
    return min(1 << 15, max(64, 1 << int(2 * n - 1).bit_length()))


def class_of(sizes: np.ndarray) -> np.ndarray:
    """Classes of sizes: those of similar sets differ by one at most."""
    return np.floor(np.log(np.maximum(sizes, 1)) / np.log(100 / LEAST)).astype(np.uint8)


def bitmap(elements: np.ndarray) -> bytes:
    """For each place, whether an odd number of elements falls on it."""
    size = bits_of(len(elements))
    return np.packbits(np.bincount((elements % np.uint64(size)).astype(np.int64), minlength=size) & 1 == 1, bitorder="little").tobytes()


def folded(maps: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (along the last axis) of a set's elements at fewer bits."""
    while maps.shape[-1] > size:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] ^ maps[..., half:]
    return maps


def differing(one: np.ndarray, two: np.ndarray) -> int:
    """Bits in which two bitmaps differ, the longer one folded: never more than elements that only one set has."""
    size = min(len(one), len(two))
    return int(np.bitwise_count(folded(one, size) ^ folded(two, size)).sum())


def allowed(n, m):
    """Elements that only one of two similar sets of n and m has, at most."""
    return n + m - 2 * (-(-LEAST * (n + m) // (100 + LEAST)))


def _word_hashes(texts: list[bytes], cached: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words start."""
    if len(texts) == 1 and len(texts[0]) > 2 * STRETCH:
        out = np.concatenate([np.zeros(0, np.uint64), *(cached(w) for x in stretches(texts[0], STRETCH) if (w := x.split()))])
        return out, np.array([0, len(out)])
    words, bounds = split(texts)
    return cached(words) if words else np.zeros(0, np.uint64), bounds


def elements_of(texts: list[bytes], cached: WordCache) -> Iterator[np.ndarray]:
    """The set of each text, ascending."""
    hashes, bounds = _word_hashes(texts, cached)
    shingles = windows(hashes, SHINGLE) >> np.uint64(64 - BITS)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = shingles[a : b - SHINGLE + 1] if b - a >= SHINGLE else windows(hashes[a:b], max(b - a, 1)) >> np.uint64(64 - BITS)
        own = np.sort(own)
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def name_of(elements: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mixed(mixed(elements).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(elements))).view(np.int64)[0])


def word_cache() -> WordCache:
    return WordCache(lambda words: digest64(w.lower() for w in words), 100_000)


SETS = "doc_id long, n_shingles long, name long, bitmap binary, elements binary"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())


def _sets(batches):
    """A row for each document, elements once for each name; the task's sketch in rows of n_shingles = -1 - block."""
    counts, seen, cached = np.zeros(SKETCH, np.int64), set(), word_cache()
    for batch in slices(batches):
        sizes, names, maps, given, all_ = [], [], [], [], []
        for own in elements_of(raw(batch), cached):
            name = name_of(own) if len(own) else None
            sizes.append(len(own))
            names.append(name)
            maps.append(bitmap(own) if len(own) and name not in seen else None)
            given.append(six(np.diff(own, prepend=np.uint64(0))) if len(own) and name not in seen else None)
            seen.add(name)
            all_.append(own)
        if len(seen) > SEEN:
            seen.clear()
        counts += np.bincount((np.concatenate(all_) >> np.uint64(BITS - SKETCH_BITS)).astype(np.int64), minlength=SKETCH)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip((sizes, names, maps, given), _KINDS[1:], strict=True))], names=["doc_id", "n_shingles", "name", "bitmap", "elements"])
    if counts.any():
        blocks = counts.reshape(-1, BLOCK)
        none = [None] * len(blocks)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((none, [-1 - k for k in range(len(blocks))], none, [packed(b) for b in blocks], none), _KINDS, strict=True)], names=["doc_id", "n_shingles", "name", "bitmap", "elements"])


def _added(batches):
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, b in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            blocks[k] = blocks.get(k, 0) + unpacked(b, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([packed(b) for b in blocks.values()], pa.binary())], names=["block", "counts"])


def sketch(rows: DataFrame) -> np.ndarray:
    """Counts of all shingles in SKETCH counters, added up in a tree, whatever the number of documents."""
    out = np.zeros((SKETCH // BLOCK, BLOCK), np.int64)
    own = rows.where("n_shingles < 0").select((-1 - F.col("n_shingles")).alias("block"), F.col("bitmap").alias("counts"))
    for keys in (["block", F.pmod(F.xxhash64("counts"), F.lit(FAN))], ["block"]):
        own = own.repartition(*keys).mapInArrow(_added, "block long, counts binary")
    for row in own.toLocalIterator():
        out[row["block"]] += unpacked(row["counts"], np.int64)
    return out.ravel()


def boundary(counts: np.ndarray) -> int:
    """The largest size of a light set: by its 2-subsets against the entries that scanning its prefix touches."""
    total = counts.sum()
    if not total:
        return 0
    # entries in the list of an occurrence: what its counter holds above the counters' median
    length = 1 + float((counts * np.maximum(counts - np.median(counts), 0)).sum() / total)
    sizes = np.arange(2, LIGHT + 1)
    subsets = np.array([math.comb(prefix_size(int(n)), 2) for n in sizes])
    scans = (sizes - needed(sizes) + 1) * (1 + length)
    fits = sizes[subsets <= scans]
    return int(fits.max()) if len(fits) else 0


def _prefixes(order: np.ndarray):
    """The first elements of each set in the global order."""

    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column("elements").to_pylist():
                own = np.cumsum(unsix(data), dtype=np.uint64)
                rank = order[(own >> np.uint64(BITS - SKETCH_BITS)).astype(np.int64)]
                out.append(six(own[np.argsort(rank, kind="stable")[: prefix_size(len(own))]]))
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("n_shingles"), pa.array(out, pa.binary())], names=["name", "size", "prefix"])

    return run


BUNDLES = "chunk long, names binary, sizes binary, prefixes binary"


def _bundled(batches):
    """Many sets in a row."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    names, sizes, prefixes, held = [], [], [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([packed(np.array(x, np.int64))]) for x in (names, sizes)), pa.array([b"".join(prefixes)], pa.binary())], names=["chunk", "names", "sizes", "prefixes"])

    for batch in batches:
        for name, size, prefix in zip(*(batch.column(c).to_pylist() for c in ("name", "size", "prefix")), strict=True):
            names.append(name)
            sizes.append(size)
            prefixes.append(prefix)
            held += len(prefix)
            if held >= BUNDLE:
                yield flush()
                names, sizes, prefixes, held, number = [], [], [], 0, number + 1
    if names:
        yield flush()


class Keys:
    """The keys of a bundle's sets, grouped by range; a set has each key once."""

    def __init__(self, row: dict, light: int, parts: int):
        self.names, self.sizes = unpacked(row["names"], np.int64), unpacked(row["sizes"], np.int64)
        keys, owner, slack = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = 0
        for k, n in enumerate(self.sizes.tolist()):
            length = prefix_size(n)
            own = unsix(row["prefixes"][at : at + 6 * length])
            at += 6 * length
            if n <= light:
                i, j = _corner(length)
                a, b = np.minimum(own[i], own[j]), np.maximum(own[i], own[j])
                with np.errstate(over="ignore"):
                    keys.append(mixed(mixed(a) * np.uint64(3) + b))
                owner.append(np.full(len(i), k))
                slack.append(n - j + 1)
            if n > light or n / LEAST * 100 > light:
                one = own[: n - int(needed(n)) + 1]
                keys.append(mixed(one))
                owner.append(np.full(len(one), k))
                slack.append(n - np.arange(len(one)))
        key, self.owner, self.slack = np.concatenate(keys), np.concatenate(owner), np.concatenate(slack).astype(np.int64)
        self.grouped = Grouped(np.arange(len(key)), key, parts, key)
        self.classes = class_of(self.sizes)


_corners: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _corner(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _corners:
        _corners[n] = np.triu_indices(n, 1)
    return _corners[n]


SENT = "part int, chunk long, hashes binary, many binary, low binary, high binary"


def _send(light: int, parts: int):
    """Each key of a bundle once: whether many sets have it, and the least and largest class of their sizes."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for row in batch.to_pylist():
                k = Keys(row, light, parts)
                g = k.grouped
                own = k.classes[k.owner[g.at]]
                low, high = (f.reduceat(own, g.first) if len(g.first) else own for f in (np.minimum, np.maximum))
                out = [(p, row["chunk"], packed(g.hash[s]), np.packbits(g.count[s] > 1).tobytes(), squeeze(low[s].tobytes()), squeeze(high[s].tobytes())) for p, s in g.each()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["part", "chunk", "hashes", "many", "low", "high"])

    return run


def _shared(table: pa.Table) -> pa.Table:
    """For each chunk, which of its keys in this range another set has too whose class is next to theirs at most, and for which of them a set is of another class."""
    loose = zstandard.ZstdDecompressor().decompress
    rows = [(r["chunk"], unpacked(r["hashes"]), r["many"], *(np.frombuffer(loose(r[c]), np.uint8) for c in ("low", "high"))) for r in table.to_pylist()]
    hashes, low, high = (np.concatenate([r[k] for r in rows]) for k in (1, 3, 4))
    many = np.concatenate([np.unpackbits(np.frombuffer(r[2], np.uint8))[: len(r[1])] for r in rows]).astype(bool)
    key = hashes & ~np.uint64(255)
    # a chunk with sets of several classes under a key may have any between: then all sets of the key count
    wide = np.unique(key[low != high])
    other = wide[np.minimum(np.searchsorted(wide, key), len(wide) - 1)] == key if len(wide) else np.zeros(len(key), bool)
    mark, own, times = np.unique(key | low, return_inverse=True, return_counts=True)
    steps = np.diff(mark) == 1
    other |= (np.append(steps, False) | np.concatenate([[False], steps]))[own]
    found = many | other | (times > 1)[own]
    out, end = [], 0
    for chunk, h, *_ in rows:
        part, end = slice(end, end + len(h)), end + len(h)
        if found[part].any():
            out.append((chunk, np.packbits(found[part]).tobytes(), np.packbits(other[part]).tobytes()))
    return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "part": pa.array([table.column("part")[0].as_py()] * len(out), pa.int32()), **{c: pa.array([x[k] for x in out], pa.binary()) for k, c in ((1, "found"), (2, "other"))}})


ENTRY = "list long, name long, size long, slack long, share int, class int, other boolean"


def _entries(light: int, parts: int):
    """A row for each set and key that another set has too; share: how many of the set's keys are such, in thousandths; other: a set of another class may be similar."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[] for _ in range(7)]
        found = dict(zip(right.column("part").to_pylist(), zip(right.column("found").to_pylist(), right.column("other").to_pylist(), strict=True), strict=True))
        for row in left.to_pylist() if found else []:
            k = Keys(row, light, parts)
            g = k.grouped
            shared, other = np.zeros(len(g.hash), bool), np.zeros(len(g.hash), bool)
            for p, s in g.each():
                if p in found:
                    shared[s], other[s] = (np.unpackbits(np.frombuffer(x, np.uint8))[: s.stop - s.start] for x in found[p])
            each = np.repeat(shared, g.count)
            at, key = g.at[each], np.repeat(g.hash, g.count)[each]
            owner = k.owner[at]
            all_, own = (np.bincount(x, minlength=len(k.names)) for x in (k.owner, owner))
            for c, v in zip(columns, (key.view(np.int64), k.names[owner], k.sizes[owner], k.slack[at], (1000 * own // np.maximum(all_, 1))[owner], k.classes[owner].astype(np.int64), np.repeat(other, g.count)[each].astype(np.int64)), strict=True):
                c.append(v)
        kinds = (*[pa.int64()] * 4, *[pa.int32()] * 2, pa.bool_())
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *c]), pa.int64()).cast(k) for c, k in zip(columns, kinds, strict=True)], names=["list", "name", "size", "slack", "share", "class", "other"])

    return run


def _filtered(words: np.ndarray):
    """Rows whose name may be in the filter."""

    def run(batches):
        for batch in batches:
            word, bits = _places(batch.column("name").to_numpy(zero_copy_only=False), len(words))
            yield batch.filter(pa.array((words[word] & bits) == bits))

    return run


def _places(names: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each name, and its three bits there."""
    h = mixed(names.astype(np.int64).view(np.uint64))
    one = np.uint64(1)
    bits = (one << (h & np.uint64(63))) | (one << (h >> np.uint64(6) & np.uint64(63))) | (one << (h >> np.uint64(12) & np.uint64(63)))
    return ((h >> np.uint64(18)) % np.uint64(words)).astype(np.int64), bits


def _marked(words: int):
    def run(batches):
        for batch in batches:
            word, bits = _places(batch.column("name").to_numpy(zero_copy_only=False), words)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    return run


def among(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The rows whose name is in names (and few others): by a filter of bounded size, so that little is moved for the rest."""
    words = min(FILTER_WORDS, 1 << max(10, (names.count() * FILTER_SHARE // 64).bit_length()))
    table = np.zeros(words, np.int64)
    some = names.mapInArrow(_marked(words), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table[some["word"].to_numpy(np.int64)] = some["bits"].to_numpy(np.int64)
    return rows.mapInArrow(_filtered(table.view(np.uint64)), rows.schema)


def _similar(batches):
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        last, a = None, None
        for k, (x, y) in enumerate(zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True)):
            if x != last:
                last, a = x, np.cumsum(unsix(x), dtype=np.uint64)
            b = np.cumsum(unsix(y), dtype=np.uint64)
            c = np.sort(np.concatenate([a, b]))
            both = int((c[1:] == c[:-1]).sum())
            keep[k] = 100 * both >= LEAST * (len(a) + len(b) - both)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))


def _possible(batches):
    """Pairs whose bitmaps don't rule them out."""
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("one", "two", "n", "m"))
        keep = [differing(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= allowed(n, m) for x, y, n, m in zip(*columns, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def possible(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    side = lambda a, column, n: maps.select(F.col("name").alias(a), F.col("bitmap").alias(column), F.col("n_shingles").alias(n))
    return pairs.join(side("b", "two", "m"), "b").join(side("a", "one", "n"), "a").mapInArrow(_possible, "a long, b long")


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The similar ones of pairs(a, b), by the whole sets, of which only theirs are moved."""
    names = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    whole = stored(among(rows.where("elements IS NOT NULL").select("name", "elements"), names).dropDuplicates(["name"]), "shingle-sets")
    one, two = (whole.select(F.col("name").alias(a), F.col("elements").alias(c)) for a, c in (("a", "one"), ("b", "two")))
    out = stored(pairs.join(two, "b").join(one, "a").mapInArrow(_similar, "a long, b long"), "shingle-links")
    dropped(whole)
    return out


CELL = ("one_label", "two_label", "low", "high")


def _cells(every: bool):
    """Pairs of a cell's members in different components, as many as bitmaps allow, or the nearest that connect them."""

    def pairs(cell: pa.Table) -> Iterator[tuple[int, int]]:
        name, size, cls, slack, root, block = (cell.column(c).to_numpy() for c in ("name", "size", "class", "slack", "root", "block"))
        hub = cell.column("hub").to_numpy(zero_copy_only=False)
        apart = cell.column("low")[0].as_py() != cell.column("high")[0].as_py()
        maps = [np.frombuffer(x, np.uint8) for x in cell.column("bitmap").to_pylist()]
        lengths = np.array([len(x) for x in maps])
        rows = {n: np.stack([maps[i] for i in np.flatnonzero(lengths == n)]) for n in np.unique(lengths).tolist()}
        place = np.zeros(len(maps), np.int64)
        for n in rows:
            place[lengths == n] = np.arange((lengths == n).sum())
        small: dict[tuple[int, int], np.ndarray] = {}
        found: list[tuple[int, int, int]] = []
        for i in range(len(maps) - 1):
            low, high = np.minimum(size[i], size[i + 1 :]), np.maximum(size[i], size[i + 1 :])
            ok = (root[i + 1 :] != root[i]) & (100 * low >= LEAST * high) & ((100 + LEAST) * np.minimum(slack[i], slack[i + 1 :]) >= LEAST * (low + high))
            ok &= ~((cls[i + 1 :] == cls[i]) & (hub[i + 1 :] | hub[i]))
            if apart:
                ok &= block[i + 1 :] != block[i]
            others = i + 1 + np.flatnonzero(ok)
            for n in np.unique(lengths[others]).tolist():
                js = others[lengths[others] == n]
                to = min(n, len(maps[i]))
                if (n, to) not in small:
                    small[n, to] = folded(rows[n], to)
                d = np.bitwise_count(small[n, to][place[js]] ^ folded(maps[i], to)).sum(1, dtype=np.int64)
                near = d <= allowed(size[i], size[js])
                found += [(x, i, j) for x, j in zip(d[near].tolist(), js[near].tolist(), strict=True)]
        if every:
            yield from ((int(name[i]), int(name[j])) for _, i, j in found)
            return
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for _, i, j in sorted(found):
            a, b = top(int(root[i])), top(int(root[j]))
            if a != b:
                parent[a] = b
                yield int(name[i]), int(name[j])

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            out, own = list(pairs(pa.Table.from_batches(held))), key(held[0], 0)
            held.clear()
            columns = [[x] * len(out) for x in own] + [[min(x) for x in out], [max(x) for x in out]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*CELL, "a", "b"])

        key = lambda batch, i: tuple(batch.column(c)[i].as_py() for c in CELL)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy() for c in CELL])
            cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and key(held[0], 0) != key(batch, a):
                    yield flush()
                held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    return run


def _open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of lists that hold more than one component, equal lists once."""
    placed = lists.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name")).repartition("list")
    label = lambda salt: F.bit_xor(F.xxhash64("name", F.lit(salt)))
    every = placed.groupBy("list").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most"), F.min("class").alias("a"), F.max("class").alias("b"), F.min("size").alias("low"), F.max("size").alias("high"), F.min("slack").alias("left"), label(1).alias("one_label"), label(2).alias("two_label"))
    # two of one class are a set and its hub, which are compared already; two others may be too different
    near = (F.col("a") != F.col("b")) & (100 * F.col("low") >= LEAST * F.col("high")) & ((100 + LEAST) * F.col("left") >= LEAST * (F.col("low") + F.col("high")))
    apart = every.where((F.col("least") != F.col("most")) & ((F.col("n") > 2) | near))
    return placed.join(apart.select("list", "n", "one_label", "two_label"), "list").groupBy("one_label", "two_label", "n", "name").agg(F.max("slack").alias("slack"), *(F.first(c).alias(c) for c in ("size", "class", "root")), (F.first("hub") == F.col("name")).alias("hub"))


def _celled(members: DataFrame, maps: DataFrame) -> DataFrame:
    """A row for each member and cell that it stands in."""
    blocks = F.ceil(F.col("n") / MEMBERS).cast("long")
    own = members.withColumn("block", F.pmod(F.xxhash64("name", F.lit(3)), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return own.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("n", "other").join(maps.select("name", "bitmap"), "name")


def _compared(cells: DataFrame, every: bool) -> DataFrame:
    """Pairs that the cells give, each with its cell."""
    return cells.repartition(*CELL).sortWithinPartitions(*CELL, "name").mapInArrow(_cells(every), ", ".join(f"{c} long" for c in (*CELL, "a", "b")))


def _within():
    """Whether a row and its hub may reach the similarity by their sizes and what is left of them."""
    low, high = F.least(F.col("size"), F.col("hub_size")), F.greatest(F.col("size"), F.col("hub_size"))
    return (F.col("name") != F.col("hub")) & (100 * low >= LEAST * high) & ((100 + LEAST) * F.least(F.col("slack"), F.col("hub_slack")) >= LEAST * (low + high))


def listed(rows: DataFrame) -> DataFrame:
    """list, class, name, size, slack, and the class's hub in that list, for each set and key that another set has too.

    open: there may be others than the hub to compare with.
    """
    spark = rows.sparkSession
    counts = sketch(rows)
    light = boundary(counts)
    # 16 steps for each doubling order all that matters
    order = np.round(16 * np.log2(np.maximum(counts, 1))).astype(np.int16)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) // RANGE))
    # alone in its set, an element makes it similar to equal sets only
    firsts = rows.where("elements IS NOT NULL AND n_shingles > 1").select("name", "n_shingles", "elements").mapInArrow(_prefixes(order), "name long, size long, prefix binary").dropDuplicates(["name"])
    bundles = stored(firsts.mapInArrow(_bundled, BUNDLES), "shingle-bundles")
    sent = bundles.mapInArrow(_send(light, parts), SENT)
    shared = sent.groupBy("part").applyInArrow(_shared, "chunk long, part int, found binary, other binary")
    entries = stored(bundles.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_entries(light, parts), ENTRY), "shingle-entries")
    dropped(bundles)
    hubs = entries.groupBy("list", "class").agg(F.max(F.struct("share", "name", "size", "slack")).alias("top"), F.count("*").alias("n"))
    out = stored(entries.join(hubs, ["list", "class"]).select("list", "class", "name", "size", "slack", (F.col("other") | (F.col("n") > 2)).alias("open"), F.col("top.name").alias("hub"), F.col("top.size").alias("hub_size"), F.col("top.slack").alias("hub_slack")), "shingle-lists")
    dropped(entries)
    return out


def links(rows: DataFrame) -> DataFrame:
    """node, root over the names of sets that have a similar, different set; rows as _sets gives them."""
    lists = listed(rows)
    maps = stored(among(rows.where("bitmap IS NOT NULL AND n_shingles > 0").select("name", "n_shingles", "bitmap"), lists.select("name").distinct()).dropDuplicates(["name"]), "shingle-maps")
    star = lists.where(_within()).select(F.least("name", "hub").alias("a"), F.greatest("name", "hub").alias("b")).distinct()
    edges = verified(stored(possible(star, maps), "shingle-pairs"), rows)
    roots = components(edges)
    cells = stored(_celled(_open(lists.where("open").drop("open"), roots), maps), "shingle-cells")
    dropped(lists, maps)
    forest = stored(_compared(cells, False), "shingle-pairs")
    if forest.isEmpty():
        return roots
    edges, roots, found = _joined(edges, roots, forest, rows)
    # where all that was near is similar, or nothing was near, a cell is done
    again = forest.join(found, ["a", "b"], "left_anti").select(*CELL).distinct()
    cells = cells.join(again, list(CELL), "left_semi").drop("root").join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    rest = stored(_compared(cells, True), "shingle-pairs")
    return roots if rest.isEmpty() else _joined(edges, roots, rest, rows)[1]


def _joined(edges: DataFrame, roots: DataFrame, pairs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges and components with the similar ones of pairs, and these."""
    found = verified(pairs.select("a", "b").distinct(), rows)
    if found.isEmpty():
        return edges, roots, found
    edges = edges.unionByName(found)
    return edges, components(edges), found


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    summary = stored(docs.mapInArrow(_sets, SETS), "shingle-rows")
    roots = links(summary)
    rows = summary.where("n_shingles >= 0").select("doc_id", "n_shingles", "name")
    own = rows.where("name is not null").groupBy("name").agg(F.min("doc_id").alias("least"))
    placed = own.join(roots, own["name"] == roots["node"], "left").select("name", "least", F.coalesce("root", "name").alias("root"))
    groups = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("name", "component_id")
    joined = rows.where("name is not null").join(groups, "name").select("doc_id", "n_shingles", "component_id")
    return joined.unionByName(rows.where("name is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; all columns are kept.

    A document is its doc_id and its text: rows that repeat both stay or go together, and rows that share
    only a doc_id, null or not, are judged each by its own text.  Null ids are larger than all others; of
    documents of a group with one id the one with the least hash stays.
    """
    # all columns travel as one, so that none of theirs can meet one of ours
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("__key"), "doc_id", "text", F.struct("*").alias("__row"))
    groups = similar_groups(keyed.select(F.col("__key").alias("doc_id"), "text")).where("n_shingles > 0")
    found = stored(groups.select(F.col("doc_id").alias("__key"), "component_id").distinct(), "shingle-groups")
    own = keyed.select("__key", F.col("doc_id").cast("long").alias("id")).distinct()
    first = found.join(own, "__key").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "__key")).alias("first"))
    # by keys, not by groups, as a group may have any number of rows
    gone = found.select("__key").join(first.select("first.__key"), "__key", "left_anti")
    return keyed.select("__key", "__row").join(gone, "__key", "left_anti").select("__row.*")
