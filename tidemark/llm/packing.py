"""Cost-balanced packing of whole documents into sequences of a fixed number of tokens.

A task packs what it reads, window by window, so nothing is shuffled: documents of a window of
WINDOW tokens are taken by descending length; each goes to the sequence of the lowest estimated cost
that still has room for all of it.  The cost of a piece is linear in its tokens plus quadratic, as
attention within it is.  A document is cut only where it fits nowhere: it fills the cheapest sequence
that has room, and the rest goes on; one that is longer than a sequence first fills whole ones.  A
window opens only as many sequences as it can fill, and hands what is left to the next window.  What
is left at the end of a task goes to shorter sequences whose sizes are powers of two, which need no
padding.

Tokens are those of the library for the whole text, then one closing id.  Words between white space
are independent in this vocabulary (white space is dropped before pieces are formed), so each distinct
word is encoded once while the bounded cache lasts.  A null or empty text is the closing id alone.
An empty table gives an empty result; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import WordCache, raw, slices, split, stretches

TOKENIZER = "word_bpe_49k.json"
#: Tokens of a sequence, of a window, and the id that closes a document.
LENGTH, WINDOW, CLOSING = 4096, 1 << 21, 2
#: Cost of a token, and of a pair of tokens that attend to each other.
LINEAR, QUADRATIC = 1.0, 1 / 2048
#: Bytes of a very long text that are split into words at a time.
STRETCH = 1 << 20
#: Words that the cache holds before it is emptied, and runs of letters and the like that outlast it.
CACHE, RUNS = 400_000, 500_000
#: Parts that are encoded in one call.
TOGETHER = 256
#: A word that is one run of letters, perhaps followed by punctuation, all of them whole characters in any normal form.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<")


@cache
def _library(tokenizer: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer if os.sep in tokenizer else public_tokenizers.path(tokenizer))
    ends = np.zeros(t.get_vocab_size() + 1, bool)
    for piece, i in t.get_vocab().items():
        ends[i] = piece.endswith("</w>")
    return t, ends


class Encoder:
    """Ids of words: a word is a run of letters and a tail of punctuation, or stands for itself; each is encoded once until the cache is full."""

    def __init__(self, tokenizer: str = TOKENIZER, limit: int = CACHE):
        self.library, self.ends = _library(tokenizer)
        self.cached = WordCache(self._halves, limit)
        self._clear()

    def _clear(self) -> None:
        self.cached._clear()
        # rows of parts; the first is the empty one
        self.rows: dict[bytes, int] = {b"": 0}
        self.pool, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _each(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in a row, and how many each has."""
        ids = [x.ids for x in self.library.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)

    def _runs(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of letters, in one call: each ends with the one piece that ends a word."""
        ids = np.array(self.library.encode(b" ".join(parts).decode(), add_special_tokens=False).ids, np.int32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(parts) or cuts[-1] != len(ids):
            return self._each(parts)
        return ids, np.diff(cuts, prepend=0)

    def _learn(self, parts: list[bytes], encode) -> None:
        for k in range(0, len(parts), TOGETHER):
            some = parts[k : k + TOGETHER]
            ids, sizes = encode(some)
            self.rows.update(zip(some, range(len(self.rows), len(self.rows) + len(some)), strict=True))
            self.found.append((ids, sizes))

    def _halves(self, words: list[bytes]) -> np.ndarray:
        """Rows of the run and the tail of each word."""
        heads, tails, runs, rest = [], [], {}, {}
        for w in words:
            head = w.rstrip(_MARKS)
            if head.isalpha():  # ASCII letters
                tail, head, kind = w[len(head) :], head.lower(), runs
            elif not w.isascii() and (m := _PLAIN.fullmatch(w.decode())):
                head, tail, kind = m[1].lower().encode(), m[2].encode(), runs
            else:
                head, tail, kind = w, b"", rest
            heads.append(head)
            tails.append(tail)
            if head not in self.rows:
                kind[head] = None
            if tail not in self.rows:
                rest[tail] = None
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self._learn(list(runs), self._runs)
        self._learn(list(rest), self._each)
        if self.found:
            sizes = np.concatenate([s for _, s in self.found])
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.pool = np.concatenate([self.pool, *(i for i, _ in self.found)])
        return np.array([list(map(self.rows.__getitem__, x)) for x in (heads, tails)], np.int64).T

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each text's ids, as the library gives them for the whole text."""
        if len(texts) == 1 and len(texts[0]) > 2 * STRETCH:
            return [np.concatenate([self([x])[0] for x in stretches(texts[0], STRETCH)])]
        if len(self.rows) > RUNS:
            self._clear()
        words, bounds = split(texts)
        if not words:
            return [np.zeros(0, np.int32) for _ in texts]
        rows = self.cached(words).ravel()
        sizes = self.sizes[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.arange(ends[-1]) + np.repeat(self.starts[rows] - ends[:-1], sizes)]
        return [ids[ends[2 * a] : ends[2 * b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def cost(tokens):
    return LINEAR * tokens + QUADRATIC * tokens * tokens


def sizes_of(tokens: int, length: int = LENGTH, last: bool = True) -> list[int]:
    """Sequences that so many tokens fill: full ones, and at the end powers of two."""
    full, left = divmod(tokens, length)
    return [length] * full + ([1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1] if last else [])


def assign(tokens: list[int], rooms: list[int], length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """Pieces (document, start, length, sequence, offset), and what is left: (document, start)."""
    room, spent = np.array(rooms, np.int64), np.zeros(len(rooms))
    size = room.copy()
    pieces: list[tuple[int, int, int, int, int]] = []
    left: list[tuple[int, int]] = []
    units = []

    def put(doc: int, start: int, n: int, k: int) -> None:
        pieces.append((doc, start, n, k, int(size[k] - room[k])))
        room[k] -= n
        spent[k] += cost(n)

    for doc, n in enumerate(tokens):
        start = 0
        while n - start >= length and len(free := np.flatnonzero((room == length) & (size == length))):
            put(doc, start, length, int(free[0]))
            start += length
        if n > start:
            units.append((n - start, doc, start))
    units.sort(key=lambda u: (-u[0], u[1]))
    for n, doc, start in units:
        while n:
            fits = np.where(room >= n, spent, np.inf)
            k = int(fits.argmin()) if len(rooms) else 0
            if not len(rooms) or fits[k] == np.inf:
                some = np.where(room > 0, spent, np.inf)
                k = int(some.argmin()) if len(rooms) else 0
                if not len(rooms) or some[k] == np.inf:
                    left.append((doc, start))
                    break
            part = int(min(n, room[k]))
            put(doc, start, part, k)
            start, n = start + part, n - part
    return pieces, left


RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(tokenizer: str, length: int, window: int):
    def run(batches):
        encoder, task = Encoder(tokenizer), TaskContext.get()
        number = (task.partitionId() if task else 0) << 33
        held: list[tuple[object, np.ndarray, int, int]] = []  # id, ids from some start on, that start, all its ids
        tokens = 0

        def flush(last: bool):
            nonlocal held, tokens, number
            rooms = sizes_of(tokens, length, last)
            pieces, left = assign([len(x[1]) for x in held], rooms, length)
            rows = [
                (held[d][0], held[d][2] + s, n, zlib.crc32(held[d][1][s : s + n].astype("<u4").tobytes()), held[d][3], number + k, o)
                for d, s, n, k, o in pieces
            ]
            number += len(rooms)
            held = [(held[d][0], held[d][1][s:], held[d][2] + s, held[d][3]) for d, s in left]
            tokens = sum(len(x[1]) for x in held)
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in slices(batches):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder(raw(batch)), strict=True):
                ids = np.append(ids, np.int32(CLOSING))
                held.append((doc, ids, 0, len(ids)))
                tokens += len(ids)
                if tokens >= window:
                    yield from flush(False)
        yield from flush(True)

    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """A row for each piece of each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pack(tokenizer, length, window), RESULT)
