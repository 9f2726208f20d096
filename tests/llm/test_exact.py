import hashlib
import re
from collections import defaultdict

import numpy as np

from llm.samples import TEXTS, docs
from tidemark.llm import exact


def brute(ids, texts):
    groups = defaultdict(list)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, t in zip(ids, norm, strict=True):
        groups[t].append(i)
    keep = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return sorted(((i, keep[t], len(groups[t]), i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(ids, norm, strict=True)), key=repr)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_normalised_like_the_pattern():
    for t in TEXTS:
        assert exact.normalised((t or "").encode()) == re.sub(rb"[\x20\x09-\x0D]+", b" ", (t or "").encode())


def test_groups(spark):
    texts = TEXTS + ["one  two", "one two", "b", "b", "c", None]
    ids = [*range(len(TEXTS)), 70, 60, 5, 5, None, None]
    for memtable in (2, 1000):
        assert rows(exact.exact_groups(docs(spark, texts, ids), memtable)) == brute(ids, texts)


def test_bytes_decide_where_digests_meet(spark):
    texts = [f"text {k % 400}" for k in range(1000)]
    assert rows(exact.exact_groups(docs(spark, texts), 100, digest_bytes=1)) == brute(range(1000), texts)


def test_compaction_keeps_smallest_ids():
    rnd = np.random.default_rng(3)
    runs, want = [], {}
    for _ in range(7):
        keys = np.unique(rnd.integers(0, 60, 30)).astype(np.uint64)
        d = np.stack([keys, keys * 7, keys * 11, keys], 1)
        ids = rnd.integers(0, 10**6, len(keys))
        for k, i in zip(keys, ids, strict=True):
            want[int(k)] = (min(i, want.get(int(k), (10**9,))[0]), want.get(int(k), (0, 0))[1] + 1)
        runs.append((d, ids, np.ones(len(keys), np.int64), exact.Filter(d)))
    d, ids, counts = exact.compacted(runs)
    assert {int(a): (b, c) for a, b, c in zip(d[:, 0], ids, counts, strict=True)} == want


def test_dedup_keeps_columns_and_empty_tables(spark):
    df = docs(spark, ["a  b", "a b", "c"], [2, 1, 3]).selectExpr("*", "'x' AS digest", "1 AS keep_id")
    out = exact.exact_dedup(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]
    assert exact.exact_groups(docs(spark, [])).count() == 0


def test_columns_of_any_name_are_carried_along(spark):
    from pyspark.sql import functions as F

    wide = docs(spark, TEXTS)
    for c in ("__sha", "__gone", "__row", "__id", "kept", "keep_id", "digest", "packed"):
        wide = wide.withColumn(c, F.col("doc_id") + 7)
    rows = exact.exact_dedup(wide).collect()
    assert rows[0].__fields__ == wide.columns and all(r["__sha"] == r.doc_id + 7 for r in rows)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in exact.exact_dedup(docs(spark, TEXTS)).collect())
