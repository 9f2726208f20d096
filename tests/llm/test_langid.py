import numpy as np

from llm.samples import TEXTS, docs
from tidemark.llm import langid, toxicity


def all_cuts(word, pieces):
    if not word:
        yield []
    for k in range(1, min(len(word), langid.longest(langid.VOCABULARY)) + 1):
        if word[:k] in pieces or k == 1:
            for rest in all_cuts(word[k:], pieces):
                yield [word[:k], *rest]


def test_forward_sums_all_segmentations():
    pieces = langid.vocabulary(langid.VOCABULARY)
    rnd = np.random.default_rng(1)
    logp = np.log(rnd.dirichlet(np.ones(len(pieces))))
    words = ["▁the", "▁tion", "▁a", "▁日x", "▁straße"]
    got = langid.Lattice(words, langid.VOCABULARY).total(langid.probabilities(logp))[:, 0]
    for w, g in zip(words, got, strict=True):
        want = sum(np.exp(sum(logp[pieces[p]] if p in pieces else langid.UNKNOWN for p in cut)) for cut in all_cuts(w, pieces))
        assert np.isclose(g, np.log(want))


def test_expectation_adds_up_and_learning_helps():
    words = {"▁the": 30, "▁tion": 5, "▁other": 4}
    own = list(words)
    pieces = langid.vocabulary(langid.VOCABULARY)
    lattice, weights = langid.Lattice(own, langid.VOCABULARY), np.array([words[w] for w in own], float)
    before = np.full(len(pieces), -np.log(len(pieces)))
    counts = lattice.expected(langid.probabilities(before), weights)
    size = np.array([len(p) for p in pieces])
    assert np.isclose((counts * size).sum(), sum(len(w) * n for w, n in words.items()))
    _, after = langid.train({"x": words})
    assert (lattice.total(langid.probabilities(after[0]))[:, 0] > lattice.total(langid.probabilities(before))[:, 0]).all()


def test_held_out_accuracy_and_edges(spark):
    words = {"en": "the of and that with house water", "de": "der und nicht ein straße wasser haus", "fr": "le et que une maison avec été"}
    rows = [(k, " ".join(words[lang].split()[(k + j) % 7] for j in range(12)), lang) for k, lang in ((k, list(words)[k % 3]) for k in range(240))]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 ?!", "fr"), (None, "the and of that", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = toxicity.in_fold(2, 4)
    got = {r.doc_id: r for r in langid.languages(df, fold).collect()}
    assert len(got) == len(rows)
    held = [(got[k].lang_pred, lang) for k, _, lang in rows[:240] if got[k].held_out]
    assert len(held) > 30 and sum(a == b for a, b in held) / len(held) > 0.95
    assert [(got[k].lang_pred, got[k].score) for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[None].lang_pred == "en" and 0 < got[None].score <= 1
    assert {r.lang_pred for r in langid.languages(docs(spark, ["abc", None]), fold).collect()} == {"und"}
    assert langid.languages(docs(spark, []), fold).count() == 0


def test_long_words_are_summed_in_logarithms():
    rnd = np.random.default_rng(3)
    pieces = langid.vocabulary(langid.VOCABULARY)
    assert "\u2581representations" in pieces
    table = langid.probabilities(np.log(rnd.dirichlet(np.ones(len(pieces)), 2)))
    logs = np.log(np.maximum(table, np.finfo(float).tiny))
    words = ["\u2581representations", "\u2581internationalx\u65e5", "\u2581a"]
    short = langid.Lattice(words, langid.VOCABULARY)
    assert np.allclose(short.total(table), [langid.long_total(w, logs, langid.VOCABULARY) for w in words])
    want = sum(n * langid.long_expected(w, logs[:, :1], langid.VOCABULARY) for w, n in zip(words, (1, 2, 3), strict=True))
    assert np.allclose(short.expected(table[:, :1], np.array([1.0, 2.0, 3.0])), want)
    # a run of rare letters after very many counts stays finite
    rare = langid.probabilities(np.full((1, len(pieces)), np.log(1e-9)))
    assert np.isfinite(langid.likelihoods(["\u2581" + "\u0139" * 40, "\u2581" + "zq" * 3000], rare, langid.VOCABULARY)).all()


def test_predictions_equal_brute_force(spark):
    """The query's rows, by sums over all segmentations of each word with what the same rows teach."""
    words = {"en": ["the", "of", "house"], "de": ["der", "und", "haus"]}
    rows = [(k, " ".join(words[lang][(k * j) % 3] for j in range(1, 5)), lang) for k, lang in ((k, ("en", "de")[k % 2]) for k in range(60))]
    rows += [(900 + k, t, "en") for k, t in enumerate(("the haus, of", "The; UND", "x\u65e5y der", *(t for t in TEXTS if t is None or len(t) < 90)))] + [rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = toxicity.in_fold(2, 4)
    langs, logp = langid.learn(df, fold)
    pieces = langid.vocabulary(langid.VOCABULARY)
    logp = logp.astype(np.float32).astype(float)
    got = langid.languages(df.withColumn("held_out", df.text).withColumn("score", df.text), fold).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for k, t, _ in rows if k == r.doc_id)
        runs = [x for w in (text or "").encode().split() for x in langid.letters(w)]
        if not runs:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = [0.0] * len(langs)
        for w in runs:
            for k in range(len(langs)):
                ps = [np.exp(sum(max(logp[k][pieces[p]], np.log(langid.FLOOR)) if p in pieces else langid.UNKNOWN for p in cut)) for cut in all_cuts(w, pieces)] if len(w) < 12 else None
                total[k] += np.log(sum(ps)) if ps else langid.likelihoods([w], langid.probabilities(logp), langid.VOCABULARY)[0, k]
        graded = np.array(total) / len(runs) * min(len(runs), langid.EVIDENCE)
        assert r.lang_pred == langs[int(np.argmax(total))]
        assert np.isclose(r.score, 1 / np.exp(graded - graded.max()).sum())
