import random
import re
from collections import Counter

import numpy as np

from llm.samples import TEXTS, docs
from tidemark.llm import quality
from tidemark.llm.words import digest64, split


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if runs[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def corpus(rnd):
    good = [" ".join(f"w{rnd.randrange(14)}" for _ in range(120)) for _ in range(60)]
    junk = [" ".join(f"w{rnd.randrange(14)}%%%" for _ in range(120)) for _ in range(20)]
    return good + junk + ["a b c d\n" * 40, "x # y | z\nx # y | z\n \nq"] + TEXTS


def test_base_columns_and_verdicts(spark):
    rnd = random.Random(7)
    texts = corpus(rnd)
    labels = spark.createDataFrame([(k, 1) for k in range(0, 60, 2)] + [(k, 0) for k in range(60, 80)] + [(None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(docs(spark, texts), labels).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), repr((t or "")[:60])
    assert all(got[k].kept for k in range(60)) and not any(got[k].kept for k in range(60, 80))
    kept = [r.doc_id for r in quality.quality_filter(docs(spark, texts), labels).collect()]
    assert sorted(kept) == sorted(k for k, r in got.items() if r.kept)


def test_ngrams_by_text():
    words, bounds = split([b"a b c", b"", b"a", b"b c"])
    grams, starts = quality.ngrams(digest64(words), bounds)
    assert starts.tolist() == [0, 5, 5, 6, 9]
    assert grams[4] == grams[8] and grams[0] == grams[5]  # the bigram b c, the word a


def test_ratio_is_a_difference_of_multinomials(spark):
    texts = ["a a b", "a c", "b"]
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    ratio = quality.likelihood_ratio(docs(spark, texts), labels)
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for k, t in enumerate(texts):
        words, bounds = split([t.encode()])
        grams, _ = quality.ngrams(digest64(words), bounds)
        np.add.at(raw, grams, 1)
        if k == 0:
            np.add.at(target, grams, 1)
    target += quality.PRIOR * target.sum() / raw.sum()
    raw += quality.PRIOR
    assert np.allclose(ratio, np.log(target / target.sum()) - np.log(raw / raw.sum()), atol=1e-6)


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    text = " ".join(map(str, range(80)))
    assert [(r.kept, r.score) for r in quality.quality(docs(spark, [text]), none).collect()] == [(True, 0.0)]
    assert quality.quality(docs(spark, []), none).count() == 0
    odd = docs(spark, [text, None], [None, None]).selectExpr("*", "1 AS kept", "2 AS score")
    assert quality.quality(odd, none).count() == 2 and quality.quality_filter(odd, none).columns == odd.columns
