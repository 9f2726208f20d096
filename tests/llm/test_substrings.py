import hashlib
import random

from llm.samples import TEXTS, docs
from tidemark.llm import substrings


def brute(ids, texts, width=substrings.WINDOW):
    words = [(t or "").encode().split() for t in texts]
    least = {}
    for i, w in zip(ids, words, strict=True):
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            least[key] = min(least.get(key, substrings.NO_ID), substrings.NO_ID if i is None else i)
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and least[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_cover_meets_every_pair():
    for a in range(7):
        for b in range(7):
            assert any((a + s) % 7 in substrings.COVER and (b + s) % 7 in substrings.COVER for s in range(7))


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(8)
    passages = [[rnd.choice("abcdefgh") + str(rnd.randrange(30)) for _ in range(rnd.randrange(10, 40))] for _ in range(12)]
    texts = []
    for _ in range(120):
        words = []
        for _ in range(rnd.randrange(5)):
            words += [str(rnd.randrange(10**6)) for _ in range(rnd.randrange(20))]
            p = rnd.choice(passages)
            cut = rnd.randrange(3)
            words += p[cut : len(p) - rnd.randrange(3)]
        texts.append(" ".join(words))
    texts += TEXTS + texts[:5] + ["z " * 40]
    ids = [*range(len(texts) - 8), 3, 3, None, None, 1000, 1001, 1002, 1003][: len(texts)]
    rnd.shuffle(ids)
    monkeypatch.setattr(substrings, "CHUNK", 4000)
    got = rows(substrings.repeated_passages(docs(spark, texts, ids).repartition(3)))
    assert got == brute(ids, texts)
    assert sum(r[2] for r in got) > 1000


def test_empty(spark):
    assert substrings.repeated_passages(docs(spark, [])).count() == 0
    assert rows(substrings.repeated_passages(docs(spark, [None, ""], [1, 2]), texts=True)) == [(i, 0, 0, hashlib.sha256(b"").hexdigest(), "") for i in (1, 2)]
