import random
import zlib

import numpy as np

from llm.samples import docs
from tidemark.llm import toxicity
from tidemark.llm.words import WordCache


def test_features_are_distinct_per_text():
    found, starts = toxicity.features([b"A a. b", b"", b"b"], WordCache(toxicity._buckets))
    assert np.diff(starts).tolist() == [2, 0, 1] and found[2] in found[:2]


def test_correction_keeps_the_risk_from_going_below_zero():
    rnd = np.random.default_rng(1)
    side = lambda n, own: (np.concatenate([np.append(rnd.integers(0, 50, 5), own) for _ in range(n)]), np.arange(0, 6 * n + 1, 6))
    positive, unlabelled = side(80, 99), side(400, 98)
    w = toxicity.train(positive, unlabelled, 0.3, steps=120)
    zp, zu = toxicity._margins(w, *positive), toxicity._margins(w, *unlabelled)
    assert np.isfinite(w).all() and zp.mean() > zu.mean()
    assert np.logaddexp(0, zu).mean() - 0.3 * np.logaddexp(0, zp).mean() > -0.2


def test_held_out_and_edges(spark):
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 6 == 0
        text = [rnd.choice(words) for _ in range(40)] + (rnd.sample(["scum", "idiot", "trash"], 2) if toxic else [])
        rows.append(" ".join(text))
        if k % 4 < 2:
            labels.append((k, int(toxic)))
    known = spark.createDataFrame([*labels, (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, [*rows, None, ""]), known).collect()}
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r.score, i % 6 == 0) for i, r in got.items() if r.held_out and i < 600]
    assert sum((s >= 0.5) == t for s, t in held) / len(held) > 0.95
    none = known.where("toxic = 7")
    assert {r.score for r in toxicity.toxicity(docs(spark, rows[:3]), none).collect()} == {0.0}
    assert toxicity.toxicity(docs(spark, []), known).count() == 0


def test_risk_and_slope_equal_brute_force():
    """The estimator by its definition, text by text, and its slope by differences; on both sides of the correction."""
    rnd = np.random.default_rng(4)
    sides = []
    for n in (7, 11):
        each = [np.unique(rnd.integers(0, 12, 5)) for _ in range(n)]
        sides.append((np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])]), each))
    (fp, sp, ep), (fu, su, eu) = sides
    signs = set()
    for prior, shift in ((0.2, 0.0), (0.9, -4.0), (0.9, 3.0)):
        w = np.zeros(toxicity.BUCKETS + 1)
        w[:12], w[-1] = rnd.normal(size=12), shift

        def parts(w, prior=prior):
            z = lambda each: [sum(w[k] for k in x) + w[-1] for x in each]
            minus = lambda each: sum(np.log(1 + np.exp(x)) for x in z(each)) / len(each)
            return prior * sum(np.log(1 + np.exp(-x)) for x in z(ep)) / len(ep), minus(eu) - prior * minus(ep)

        plus, clean, slope = toxicity.risk(w, (fp, sp), (fu, su), prior)
        assert np.allclose((plus, clean), parts(w))
        signs.add(clean >= 0)
        lowered = lambda w: sum(parts(w)) if clean >= 0 else -parts(w)[1]  # noqa: B023, E731
        for k in (*range(12), toxicity.BUCKETS):
            step = np.zeros(len(w))
            step[k] = 1e-5
            assert np.isclose(slope[k], (lowered(w + step) - lowered(w - step)) / 2e-5, atol=1e-6)
    assert signs == {True, False}


def test_scores_equal_brute_force_and_few_labels_still_grade(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice([f"w{k}" for k in range(60)]) for _ in range(20)) + (" scum Idiot!" if k % 5 == 0 else "") for k in range(60)]
    rows = [*texts, texts[3], None, "", "\u00e9 SCUM, scum idiot"]
    df = docs(spark, rows, [*range(60), 3, None, 61, 62])
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(0, 60, 2)] + [(0, 1)], "doc_id long, toxic int")
    fold = toxicity.in_fold(0, 5)
    weights = toxicity.learn(df.select("doc_id", "text"), labels, fold)
    got = toxicity.toxicity(df.withColumn("score", df.text).withColumn("positive", df.text).withColumn("pick", df.text), labels).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        text = rows[r.doc_id] if r.doc_id is not None and r.doc_id < 60 else {None: "", 61: "", 62: rows[-1]}[r.doc_id]
        words = {toxicity._buckets([w])[0] for w in (text or "").encode().split()}
        assert np.isclose(r.score, 1 / (1 + np.exp(-(sum(weights[k] for k in words) + weights[-1])))) and r.predicted == int(r.score >= 0.5)
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_id[3]) == 1 and len({r.score for r in got}) > 50


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(40)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda p, u, prior: seen.append((len(p[0]), len(u[0]))) or np.zeros(toxicity.BUCKETS + 1))
    monkeypatch.setattr(toxicity, "BYTES", 600)
    toxicity.learn(docs(spark, texts).select("doc_id", "text"), labels, toxicity.in_fold(0, 5))
    assert all(60 < n <= 150 for n in seen[0])
