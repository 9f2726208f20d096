"""Content-defined chunks by a rolling fingerprint over GF(2), vectorised.

The fingerprint of a window is linear over GF(2): it is the XOR of one table value for each byte at its
place.  All windows' fingerprints are computed at once, from tables for each place in the window; where
the masked bits are zero a chunk may end.  The few such places are then walked with the size bounds: a
chunk ends at the first that makes it at least MIN long, or at MAX.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format.
WINDOW, MIN, MAX, BITS = 64, 512 << 10, 8 << 20, 20
#: An irreducible polynomial of degree 53.
POLYNOMIAL = 0x3DA3358B4DC173
#: Positions that are looked at together.
BLOCK = 1 << 16
#: Chunks that are given together.
ROWS = 1 << 12


def degree(x: int) -> int:
    return x.bit_length() - 1


def multiply(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = a << 1, b >> 1
    return out


def modulo(a: int, m: int) -> int:
    d = degree(m)
    while a and degree(a) >= d:
        a ^= m << (degree(a) - d)
    return a


def divisor(a: int, b: int) -> int:
    while b:
        a, b = b, modulo(a, b)
    return a


def irreducible(p: int) -> bool:
    """By Ben-Or: p shares no divisor with x^(2^k) - x for k up to half its degree."""
    x = 2
    for _ in range(degree(p) // 2):
        x = modulo(multiply(x, x), p)
        if divisor(p, x ^ 2) != 1:
            return False
    return degree(p) > 0


@cache
def tables(polynomial: int, window: int) -> np.ndarray:
    """(window, 256): what a byte adds to the fingerprint at each place, the last byte of a window first."""
    out = np.zeros((window, 256), np.uint64)
    shift = 1
    for place in range(window):
        for byte in range(256):
            out[place, byte] = modulo(multiply(byte, shift), polynomial)
        shift = modulo(shift << 8, polynomial)
    return out


def candidates(data: bytes | memoryview, polynomial: int, window: int, bits: int) -> np.ndarray:
    """Lengths of beginnings of data after which a chunk may end."""
    raw, table, mask = np.frombuffer(data, np.uint8), tables(polynomial, window), np.uint64((1 << bits) - 1)
    found = [np.zeros(0, np.int64)]
    for start in range(0, max(0, len(raw) - window + 1), BLOCK):
        n = min(BLOCK, len(raw) - window + 1 - start)
        prints = np.zeros(n, np.uint64)
        for place in range(window):
            at = start + window - 1 - place
            prints ^= table[place][raw[at : at + n]]
        found.append(np.flatnonzero((prints & mask) == 0) + start + window)
    return np.concatenate(found)


def chunks(data: bytes | memoryview, polynomial: int = POLYNOMIAL, least: int = MIN, most: int = MAX, bits: int = BITS, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of each chunk; an empty text has none, the last one may be short."""
    ends, out, start = candidates(data, polynomial, window, bits), [], 0
    while start < len(data):
        k = int(np.searchsorted(ends, start + least))
        stop = min(start + most, len(data), int(ends[k]) if k < len(ends) else len(data))
        out.append((start, stop - start))
        start = stop
    return out


def chunk_files(files: DataFrame, polynomial: int = POLYNOMIAL, least: int = MIN, most: int = MAX, bits: int = BITS) -> DataFrame:
    """files(path, content) -> path, start, length, id (hash of the bytes) for each chunk.

    Contents are looked at in place, and chunks are given for ROWS of them or a file at a time, whichever is more.
    """

    def run(batches):
        import hashlib

        names, kinds = ["path", "start", "length", "id"], (pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            rows, paths, contents = [], batch.column("path"), batch.column("content")
            for k in range(batch.num_rows):
                data = contents[k].as_buffer() or b""
                path, view = paths[k].as_py(), memoryview(data)
                rows += [(path, a, n, hashlib.sha256(view[a : a + n]).hexdigest()) for a, n in chunks(view, polynomial, least, most, bits)]
                if rows and (len(rows) >= ROWS or k == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []

    return files.select("path", "content").mapInArrow(run, "path string, start bigint, length bigint, id string")
