import random

import numpy as np

from llm.samples import TEXTS, docs
from tidemark.llm import shinglejoin


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)])


def brute(ids, texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(sets[k]), least[find(k)]) for k, i in enumerate(ids))


def rows(df):
    return sorted(map(tuple, df.collect()))


def near(rnd, base, changes):
    words = list(base)
    for _ in range(changes):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


def test_against_brute_force(spark):
    rnd = random.Random(6)
    texts = list(TEXTS) + ["A b C d E", "a B c d e", "one", "ONE"]
    passage = [f"p{k}" for k in range(30)]
    for size in (5, 6, 8, 9, 12, 20, 40, 90, 100, 130, 300):
        for _ in range(3):
            base = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
            texts.append(" ".join(base))
            for changes in (0, 1, 1, 1, 2, 3, 4, 6, 9):
                if changes * 20 < size + 20:
                    texts.append(near(rnd, base, changes))
            texts.append(" ".join(base[: int(size * 0.85)]))
    # long lists whose members are alike to few others, and many texts around one passage
    base = [f"q{k}" for k in range(120)]
    texts += [near(rnd, base, rnd.randrange(1, 6)) for _ in range(40)]
    texts += [" ".join([f"x{rnd.randrange(10**6)}" for _ in range(rnd.randrange(1, 60))] + passage) for _ in range(40)]
    rnd.shuffle(texts)
    ids = list(range(100, 100 + len(texts)))
    got = rows(shinglejoin.similar_groups(docs(spark, texts, ids).repartition(3)))
    want = brute(ids, texts)
    assert got == want
    assert len({r[2] for r in got}) < len(got) - 100


def test_bitmaps_never_rule_out_too_much():
    rnd = np.random.default_rng(2)
    for n, m in ((1, 1), (5, 6), (60, 70), (500, 90), (3000, 2500)):
        both = rnd.integers(0, 1 << 63, min(n, m) // 2).astype(np.uint64)
        one, two = (np.concatenate([both, rnd.integers(0, 1 << 63, k - len(both)).astype(np.uint64)]) for k in (n, m))
        only = n + m - 2 * len(both)
        got = shinglejoin.differing(*(np.frombuffer(shinglejoin.bitmap(x), np.uint8) for x in (one, two)))
        assert got <= only


def test_empty_null_and_near_dedup(spark):
    assert shinglejoin.similar_groups(docs(spark, [])).count() == 0
    df = docs(spark, ["a b c d e f", "A b c d e f", None, "", "z"], [None, 5, 2, 3, 4])
    assert sorted(map(repr, map(tuple, shinglejoin.similar_groups(df).collect()))) == sorted(map(repr, [(None, 2, 5), (5, 2, 5), (2, 0, 2), (3, 0, 3), (4, 1, 4)]))
    assert sorted(r.doc_id for r in shinglejoin.near_dedup(df).collect()) == [2, 3, 4, 5]


def test_near_dedup_with_null_and_repeated_ids(spark):
    words = [f"w{k}" for k in range(60)]
    near_copy = lambda k: " ".join([*words[:59], f"other{k}"])
    clean = ["".join(f"{c}{k} " for k in range(20)) for c in "abcd"]
    rows = [(3, " ".join(words)), (None, near_copy(1)), (None, clean[0]), (None, None), (7, near_copy(2)), (7, clean[1]), (7, clean[1])]
    # a group of null ids, and one of a repeated id: one of each stays
    rows += [(None, clean[2] + "x"), (None, clean[2] + "y"), (9, clean[3] + "x"), (9, clean[3] + "y")]
    got = [(r.doc_id, r.text) for r in shinglejoin.near_dedup(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()]
    assert sorted(map(repr, got[:])) == sorted(map(repr, [rows[k] for k in (0, 2, 3, 5, 6)] + [r for r in got if r in rows[7:]]))
    assert sum(r in rows[7:9] for r in got) == 1 and sum(r in rows[9:] for r in got) == 1


def test_columns_of_any_name_are_carried_along(spark):
    from pyspark.sql import functions as F

    wide = docs(spark, ["a b c d e f", "A b c d e f", None, "z"])
    for c in ("__key", "__row", "name", "n_shingles", "component_id", "bitmap", "size", "list", "class"):
        wide = wide.withColumn(c, F.col("doc_id") + 7)
    rows = shinglejoin.near_dedup(wide).collect()
    assert rows[0].__fields__ == wide.columns and sorted((r.doc_id, r["__key"]) for r in rows) == [(0, 7), (2, 9), (3, 10)]
    assert shinglejoin.similar_groups(wide).count() == 4
