import random
import zlib
from collections import defaultdict

import numpy as np

from llm.samples import TEXTS, docs
from tidemark.llm import packing


def test_encoder_equals_the_library():
    rnd = random.Random(2)
    alphabet = ["a", "The", "don't", "It's", "é", "É", "x́", "日本", "½", "3", "42", ".", "!!", "<|endoftext|>", "<|ENDOFTEXT|>", "_", "'s", " ", "\n", "\t", " ", " ", "İ", "ß", "%%%", "ing", "́", "_a", "«", "»"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(12))) for _ in range(2500)] + [t or "" for t in TEXTS]
    encoder = packing.Encoder(limit=500)
    for k in range(0, len(texts), 50):
        some = texts[k : k + 50]
        want = [x.ids for x in encoder.library.encode_batch(some, add_special_tokens=False)]
        got = encoder([t.encode() for t in some])
        for t, a, b in zip(some, want, got, strict=True):
            assert a == b.tolist(), repr(t)


def test_stretches_of_a_very_long_text(monkeypatch):
    encoder = packing.Encoder()
    text = ("The quick, brown fox's  tail\n" * 400).encode()
    (want,) = encoder([text])
    monkeypatch.setattr(packing, "STRETCH", 100)
    (got,) = encoder([text])
    assert got.tolist() == want.tolist()


def contract(rows, texts, ids, length):
    library = packing.Encoder().library
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in zip(ids, texts, strict=True):
        tokens = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(tokens) and r.ids_crc32 == zlib.crc32(tokens[at : at + r.length].tobytes())
            at += r.length
        assert at == len(tokens)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or at < length and at & (at - 1) == 0


def test_contract(spark):
    rnd = random.Random(4)
    texts = TEXTS + [" ".join(rnd.choice(["alpha", "beta", "gamma."]) for _ in range(rnd.randrange(900))) for _ in range(40)]
    for length, window in ((64, 500), (4096, 1 << 21)):
        rows = packing.pack(docs(spark, texts), length=length, window=window).collect()
        contract(rows, texts, range(len(texts)), length)


def test_empty_and_null(spark):
    assert packing.pack(docs(spark, [])).count() == 0
    rows = packing.pack(docs(spark, [None, ""], [None, 4])).collect()
    assert sorted((repr(r.doc_id), r.length, r.doc_tokens) for r in rows) == [("4", 1, 1), ("None", 1, 1)]


def test_costs_are_balanced():
    rnd = random.Random(1)
    tokens = [rnd.randrange(20, 3000) for _ in range(2000)]
    rooms = packing.sizes_of(sum(tokens), last=False)
    pieces, _ = packing.assign(tokens, rooms)
    spent = np.zeros(len(rooms))
    for _, _, n, k, _ in pieces:
        spent[k] += packing.cost(n)
    assert spent.max() < 1.6 * spent.mean() and len(pieces) < 1.4 * len(tokens)
