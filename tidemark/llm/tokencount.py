"""Token counts by a sentencepiece vocabulary.

Texts go through Arrow batches cut by bytes.  A text is split where no piece can cross: before the
first space of a run of spaces (checked against the vocabulary when it is loaded: no piece has the
space symbol after another symbol).  Parts are encoded in batches, each distinct part once while the
bounded cache lasts, and only their lengths are kept.  Counts equal those of the whole text.

A null text counts as empty: no bytes, no tokens.  Special strings are ordinary text, as the library
has it by default.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import WordCache, raw, slices, sums

SPACE = "▁".encode()
MODEL = "piece_bpe_32k.model"
#: Bytes of a text that are split and encoded at a time.
SPAN = 1 << 20


class UnsafeVocabulary(ValueError):
    """Pieces of this vocabulary cross spaces, so texts can't be split there."""


@cache
def processor(model: str):
    """model: a file, or the name of a public one."""
    import os

    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model if os.sep in model else public_tokenizers.path(model))
    for i in range(sp.vocab_size()):
        piece = sp.id_to_piece(i).encode()
        if SPACE in piece.lstrip(SPACE):
            raise UnsafeVocabulary(piece)
    # the rest of what the split relies on: a space is the symbol, one is put in front, none are taken away
    if [sp.encode(x, out_type=str) for x in ("b", " b", "b  b")] != [[SPACE.decode() + "b"], [SPACE.decode(), SPACE.decode() + "b"], [SPACE.decode() + "b", SPACE.decode(), SPACE.decode() + "b"]]:
        raise UnsafeVocabulary("the model normalises spaces")
    return sp


def parts(text: bytes) -> list[bytes]:
    """Parts whose counts add up to the text's; each drops one space, which its encoding puts in front again."""
    out = text.split(b" ")
    if b"" not in out and SPACE not in text:
        return out
    if not text:
        return []
    whole: list[bytes] = []
    # an empty entry is a further space of a run: it belongs to what follows; so does all after the symbol itself
    for i, x in enumerate(out):
        if i and not (whole[-1] == b"" or whole[-1].endswith((b" ", SPACE))):
            whole.append(x)
        elif i:
            whole[-1] += b" " + x
        else:
            whole.append(x)
    if whole[-1] == b"" and len(whole) > 1:  # one space at the end: nothing stands for it alone
        whole[-2:] = [whole[-2] + b" "]
    return whole


def spans(text: bytes, size: int | None = None) -> list[bytes]:
    """Stretches of a long text of about `size` bytes, whose counts add up to the text's.

    Each but the first drops the space that it starts with, which its encoding puts in front again; cuts are
    made before a space that follows no space.  A run without such a place stays whole.
    """
    size, out, start = size or SPAN, [], 0
    while len(text) - start > size:
        cut = text.find(b" ", start + size)
        while cut >= 0 and (text[cut - 1 : cut] == b" " or text[cut - len(SPACE) : cut] == SPACE or cut + 1 == len(text)):
            cut = text.find(b" ", cut + 1)
        if cut < 0:
            break
        out.append(text[start:cut])
        start = cut + 1
    return [*out, text[start:]]


def _count(model: str, limit: int):
    def run(batches):
        sp = processor(model)
        cached = WordCache(lambda words: np.fromiter(map(len, sp.encode([w.decode() for w in words], num_threads=1)), np.int64, len(words)))
        for batch in slices(batches):
            texts = raw(batch)
            if len(texts) == 1 and len(texts[0]) > SPAN:
                n = np.array([sum(int(cached(parts(x)).sum()) for x in spans(texts[0]))], np.int64)
            else:
                split = [parts(x) for x in texts]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
                n = sums(cached([p for x in split for p in x]), bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_count(model, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
