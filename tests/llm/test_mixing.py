import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.samples import docs
from tidemark.llm import mixing


@pytest.fixture(scope="module")
def corpus(spark):
    many = " ".join(map(str, range(60)))
    texts = [(f"fine plain words here {many}") if k % 4 else (f"%%% junk### words&&& here {many}") for k in range(400)]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(0, 400, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    return df, mixing.label_domains(labels)


def test_rates_meet_targets(corpus):
    df, domains = corpus
    rows = mixing.mixing_rates(df, domains, {"clean": 0.9, "low": 0.1}).collect()
    t, p, r = (np.array([x[n] for x in rows]) for n in ("n_tokens", "p_low", "rate"))
    share = (t * p * r).sum() / (t * r).sum()
    assert abs(share - 0.1) < 0.02 and (r >= 0).all() and (r <= 1).all()
    wrong = [x.doc_id for x in rows if (x.p_low > 0.5) != (x.doc_id % 4 == 0)]
    assert not wrong


def test_fit_equals_numpy(spark):
    rnd = np.random.default_rng(1)
    p = rnd.dirichlet([0.3, 0.3, 0.3], 500)
    t = rnd.integers(1, 900, 500)
    known = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p, strict=True)], "n_tokens long, p array<double>")
    goals = {"a": 0.6, "b": 0.3, "c": 0.1}
    history = mixing.fitted(known, ["a", "b", "c"], goals, 1.0)
    r, have = np.ones(500), t @ p
    want = np.minimum([g * have[0] / 0.6 for g in goals.values()], have)
    for push in history:
        assert np.allclose(push, ((t * r) @ p - want) / have)
        r = np.clip(r * (1 - mixing.PULL) + mixing.PULL - p @ push, 0, 1)
    got = [x.r for x in known.select(mixing.rate(F.col("p"), history, 1.0).alias("r")).collect()]
    assert np.allclose(got, r)
    assert abs(((t * r) @ p - want)[1:]).max() < 0.15 * t.sum()


def test_mix_takes_effect_and_keeps_columns(corpus):
    df, domains = corpus
    out = mixing.mix(df.withColumn("p", F.lit(3)), domains, {"clean": 0.95, "low": 0.05})
    assert out.columns == [*df.columns, "p"]
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids))
    junk = sum(i % 4 == 0 for i in ids)
    assert junk < 50 and len(ids) - junk > 280


def test_without_labels_and_empty(spark, corpus):
    df, domains = corpus
    none = domains.where("doc_id < -5")
    assert {(r.rate, r.copies) for r in mixing.mixing_rates(df, none).collect()} == {(1.0, 1)}
    assert mixing.mix(df, none).count() == df.count()
    assert mixing.mix(docs(spark, []), domains).count() == 0
    odd = mixing.mixing_rates(df.unionByName(docs(spark, [None, ""], [None, 5000])), domains).where("n_tokens = 0").collect()
    assert len(odd) == 2 and all(0 <= r.rate <= 1 for r in odd)


def test_shares_are_reached_with_soft_posteriors(spark):
    rnd = np.random.default_rng(7)
    true = rnd.choice(3, 2000, p=[0.7, 0.15, 0.15])
    p = np.array([rnd.dirichlet(np.where(np.arange(3) == k, 3.0, 0.3)) for k in true])
    t = rnd.integers(1, 900, 2000)
    known = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p, strict=True)], "n_tokens long, p array<double>")
    for goals in ({"clean": 0.92, "low": 0.06, "toxic": 0.02}, {"clean": 0.6, "low": 0.35, "toxic": 0.05}):
        history, scarce, misfit = mixing.balanced(known, ["clean", "low", "toxic"], goals)
        r = np.array([x.r for x in known.select(mixing.rate(F.col("p"), history, mixing.limit(F.col("p"), scarce, mixing.MOST)).alias("r")).collect()])
        tokens = (t * r) @ p
        assert abs(tokens / tokens.sum() - list(goals.values())).max() < 2e-4 and misfit < 2e-4
        assert tokens.sum() > 0.3 * t.sum() and scarce == ([1] if goals["low"] > 0.3 else [])
        assert (r >= 0).all() and (r <= 1 + (mixing.MOST - 1) * p[:, scarce].sum(1) + 1e-9).all()


def test_scarce_domains_are_repeated(corpus):
    df, domains = corpus
    goals = {"clean": 0.5, "low": 0.5}
    rows = mixing.mixing_rates(df, domains, goals).collect()
    t, p, r = (np.array([x[n] for x in rows]) for n in ("n_tokens", "p_low", "rate"))
    assert abs((t * p * r).sum() / (t * r).sum() - 0.5) < 1e-3 and r.max() > 1.3
    ids = [x.doc_id for x in mixing.mix(df, domains, goals).collect()]
    assert len(ids) > len(set(ids)) and len(ids) == sum(x.copies for x in rows)


def test_shares_out_of_reach_are_stated(spark):
    known = spark.createDataFrame([(100, [0.8, 0.2])] * 20, "n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="off their targets"):
        history, scarce, misfit = mixing.balanced(known, ["clean", "toxic"], {"clean": 0.98, "toxic": 0.02})
    assert scarce == [] and abs(misfit - 0.18) < 1e-3
    assert known.select(mixing.rate(F.col("p"), history, 1.0).alias("r")).where("r > 0.2").count() == 20


def test_columns_of_any_name_are_carried_along(corpus):
    df, domains = corpus
    odd = ("domain", "pick", "n_tokens", "found", "word", "rate", "copies", "p", "__p", "__n_tokens", "__hits", "__row", "__rate", "__copies", "__copy", "__s0")
    wide = df
    for k, c in enumerate(odd):
        wide = wide.withColumn(c, F.col("doc_id") * 100 + k)
    goals = {"clean": 0.95, "low": 0.05}
    out = mixing.mix(wide, domains, goals)
    assert out.columns == wide.columns
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in mixing.mix(df, domains, goals).collect())
    assert all(r[c] == r.doc_id * 100 + k for r in rows for k, c in enumerate(odd))
    again = mixing.mixing_rates(wide, domains, goals).select("doc_id", "rate").collect()
    assert sorted(again) == sorted(mixing.mixing_rates(df, domains, goals).select("doc_id", "rate").collect())
