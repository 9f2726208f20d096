"""Mixing of documents to target weights of domains, by soft memberships.  DataFrame functions only.

* **Posteriors.** A Poisson naive Bayes classifier is counted from a bounded sample of labelled rows:
  how often for each token the VOCABULARY words and runs of punctuation occur that tell the domains
  apart best.  Each document gets a posterior over the domains from those that it has, and from the
  length over which it lacks the others.
* **Rates.** With tokens t, posteriors p and rates r, the expected tokens of domain d are the sum of
  t * p_d * r.  Of all rates whose expected tokens have the shares of the targets, those nearest to 1 in
  the least squares of tokens are taken; the total follows from them.  They are 1 less a multiple of each
  posterior, cut at 0 and at the limit: ascent by damped Newton steps finds one multiple for each domain.
  A step sums a few numbers over all documents, and the steps end when the shares are reached.
* **Copies.** A document stays floor(rate + u) times, u being a fixed hash of its id between 0 and 1.

Targets are weights of tokens.  A domain that has less than its weight beside the domain of the largest
weight is scarce: its documents may be repeated, up to `most` times; all others have rates up to 1.

Shares that no document comes near can't be reached.  If they would take all but KEEP of what thinning by
true domains leaves, projected gradient descent goes as near to totals as it can that leave the domain of
the largest weight whole, and a warning states the misfit that is left.

A null or empty text has no tokens and the prior as its posterior.  A domain without labelled rows, or
without a target, is not fitted; without any above 0, all rates are 1.  Rows with equal texts have equal rates.
Null ids are never learned from; rows that repeat an id are learned from together, and each is judged by its
own text.  Of words that tell domains apart equally well the first in order is kept.  Other columns, whatever
their names, are carried along by `mix` and not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import stored

#: Labelled rows that are learned from, at most (those with the smallest hashes of their id), and words kept.
LABELLED, VOCABULARY = 8_000, 128
#: Texts of the sample that a word must stand in, the share of all that it may stand in, smoothing in tokens.
SUPPORT, COMMON, PRIOR = 8, 0.5, 5_000
#: Tokens over which lacking a word counts, at most: presence is counted once, however long a text is.
REACH = 200
#: Steps at most, the change of the misfits (share of all tokens) at which they end, and the pull towards rate 1.
STEPS, TOLERANCE, PULL = 20, 1e-3, 1e-4
#: Newton steps at most, the misfit (share of the tokens that stay) at which they end, the share of a thinned
#: corpus that must stay, and how often a document of a scarce domain may stay.
PASSES, MISFIT, KEEP, MOST = 40, 1e-4, 0.25, 4.0
#: Weights of tokens by domain of the labels table.
TARGETS = {"clean": 0.92, "low": 0.06, "toxic": 0.02}
#: ASCII white space, as the words of a text are counted.
_SPACE = r"[\x20\x09-\x0D]+"


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the rows of labels(doc_id, quality, toxic)."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _features() -> Column:
    """The distinct words of a text in lower case, and its runs of other characters."""
    words = F.split(F.lower(_text()), r"[^\p{L}]+")
    marks = F.split(_text(), r"[\p{L}\p{N}\s]+")
    return F.array_distinct(F.concat(words, marks))


def _tokens() -> Column:
    words = F.btrim(_text(), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(words == "", 0).otherwise(F.size(F.split(words, _SPACE))).cast("long")


class Classifier:
    """Log-odds of a bounded vocabulary, as literals of a plan."""

    def __init__(self, docs: DataFrame, domains: DataFrame):
        pick = domains.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(LABELLED).groupBy(F.col("doc_id").alias("pick")).agg(F.min("domain").alias("domain"))
        # at most LABELLED rows, so they may be broadcast
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        sample = stored(own.join(F.broadcast(pick), own["doc_id"] == F.col("pick")).select("domain", _tokens().alias("n_tokens"), _features().alias("found")), "mixing-sample")
        sizes = sample.groupBy("domain").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).collect()
        self.counts, tokens = {r["domain"]: r["n"] for r in sizes}, {r["domain"]: r["tokens"] for r in sizes}
        self.names = sorted(self.counts)
        if not self.names:
            return
        total = sum(self.counts.values())
        per = sample.select("domain", F.explode("found").alias("word")).where("word <> ''").groupBy("word").agg(*(F.sum((F.col("domain") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(self.names)))
        n = reduce(lambda a, b: a + b, (F.col(f"n{k}") for k in range(len(self.names))))
        # how far the share of each domain among the texts with the word is from its share of all texts
        tells = reduce(lambda a, b: a + b, (F.pow(F.col(f"n{k}") - n * self.counts[d] / total, 2) / (n * self.counts[d] / total) for k, d in enumerate(self.names)))
        best = per.where((n >= SUPPORT) & (n <= COMMON * total)).orderBy(tells.desc(), "word").limit(VOCABULARY).collect()
        self.words = [r["word"] for r in best]
        # each domain's rates lean to the rate over all, by as much as PRIOR tokens would weigh
        pooled = [sum(r[f"n{k}"] for k in range(len(self.names))) / max(sum(tokens.values()), 1) for r in best]
        rates = [[(r[f"n{k}"] + PRIOR * q) / (tokens[d] + PRIOR) for k, d in enumerate(self.names)] for r, q in zip(best, pooled, strict=True)]
        self.prior = [self.counts[d] / total for d in self.names]
        self.lacks = [sum(r[k] for r in rates) for k in range(len(self.names))]
        self.steps = [[math.log(r[k]) for k in range(len(self.names))] for r in rates]

    def _seen(self, k: int) -> Column:
        known = F.create_map(*(x for w, s in zip(self.words, self.steps, strict=True) for x in (F.lit(w), F.lit(s[k]))))
        return F.aggregate("__hits", F.lit(0.0), lambda total, w: total + F.element_at(known, w))

    def judged(self, docs: DataFrame) -> DataFrame:
        """docs with __n_tokens, and __p: one posterior for each of self.names.

        What is used more than once is a column of its own, so that it is computed once.
        """
        each = range(len(self.names))
        out = docs.withColumn("__n_tokens", _tokens()).withColumn("__hits", F.array_intersect(_features(), F.array(*map(F.lit, self.words)).cast("array<string>")))
        scores = {}
        for k in each:
            seen = self._seen(k) if self.words else F.lit(0.0)
            scores[f"__s{k}"] = F.lit(math.log(self.prior[k])) - F.least(F.col("__n_tokens"), F.lit(REACH)) * F.lit(self.lacks[k]) + seen
        out = out.withColumns(scores)
        out = out.withColumn("__top", F.greatest(*(f"__s{k}" for k in each)) if len(each) > 1 else F.col("__s0"))
        out = out.withColumns({f"__e{k}": F.exp(F.col(f"__s{k}") - F.col("__top")) for k in each})
        out = out.withColumn("__all", reduce(lambda a, b: a + b, (F.col(f"__e{k}") for k in each)))
        return out.withColumn("__p", F.array(*(F.col(f"__e{k}") / F.col("__all") for k in each))).select(*docs.columns, "__n_tokens", "__p")


def limit(p: Column, scarce: list[int], most: float) -> Column:
    """A document's largest rate: `most` as far as it belongs to scarce domains, 1 otherwise."""
    return reduce(lambda a, b: a + b, (p[k] * F.lit(most - 1) for k in scarce), F.lit(1.0))


def rate(p: Column, history: list[list[float]], most: float | Column) -> Column:
    """A document's rate after all steps, from its posteriors: each step refers to the one before once."""
    r = F.lit(1.0)
    for push in history:
        move = reduce(lambda a, b: a + b, (p[k] * F.lit(x) for k, x in enumerate(push)))
        r = F.least(F.lit(most), F.greatest(F.lit(0.0), r * F.lit(1 - PULL) + F.lit(PULL) - move))
    return r


def balanced(known: DataFrame, names: list[str], targets: dict[str, float], most: float = MOST) -> tuple[list[list[float]], list[int], float]:
    """For known(n_tokens, p): the steps of rate(), the scarce domains of limit(), and the misfit of the shares."""
    each = range(len(names))
    pairs = [(i, j) for i in each for j in each if i <= j]
    p, t = F.col("p"), F.col("n_tokens")

    def summed(history, most):
        """Tokens by domain, those of pairs of domains where rates can move, and squares of changes."""
        at = known.select("n_tokens", "p", rate(p, history, most).alias("r"), F.lit(most).alias("limit"))
        free = (F.col("r") > 0) & (F.col("r") < F.col("limit"))
        row = at.agg(*(F.sum(t * p[k] * F.col("r")) for k in each), *(F.sum(F.when(free, t * p[i] * p[j])) for i, j in pairs), F.sum(t * (F.col("r") - 1) * (F.col("r") - 1))).first()
        row = np.array([x or 0.0 for x in row])
        moves = np.zeros((len(names), len(names)))
        for (i, j), x in zip(pairs, row[len(names) :], strict=False):
            moves[i, j] = moves[j, i] = x
        return row[: len(names)], moves, row[-1] / 2

    # below a limit of 2 all rates of 1 can move, so these are sums over all documents
    have, whole, _ = summed([], 2.0)
    used = [k for k in each if targets.get(names[k], 0) > 0 and have[k] > 0]
    # a target of 0 is one as well, but nothing is measured by it
    fit = [k for k in each if k in used or (targets.get(names[k]) == 0 and have[k] > 0)]
    if not used:
        return [], [], 0.0
    want = np.array([targets[names[k]] if k in used else 0.0 for k in each]) / sum(targets[names[k]] for k in used)
    main = max(used, key=lambda k: want[k])
    scale = have[main] / want[main]
    scarce = [k for k in used if have[k] < want[k] * scale * (1 - MISFIT)] if most > 1 else []
    least = KEEP * sum(min(want[k] * scale, have[k]) for k in used)
    inside = np.array([float(k in fit) for k in each])
    # misfits are a linear map of the tokens by domain: each less its share of all that are fitted
    off = np.diag(inside) - np.outer(want, inside)
    scaled = off @ whole @ off.T
    cap = limit(p, scarce, most)
    at, step, reached, damping = np.zeros(len(names)), np.zeros(len(names)), -math.inf, 1e-3
    for _ in range(PASSES):
        push = (off.T @ (at + step)).tolist()
        now, moves, changes = summed([push], cap)
        misfits = off @ now
        value = changes + (at + step) @ misfits
        if value >= reached - 1e-12 * have.sum():
            at, reached, damping = at + step, value, max(damping / 10, 1e-6)
            ascent, curve = misfits, off @ moves @ off.T
            kept = float(inside @ now)
            if kept >= least and abs(misfits).max() <= MISFIT * kept:
                return [push], scarce, float(abs(misfits).max() / kept)
        else:
            damping *= 10
        # the misfits add up to 0, so one direction is free
        step = np.linalg.lstsq(curve + damping * scaled, ascent, rcond=1e-12)[0]
    history = fitted(known, names, targets, 1.0)
    now = summed(history, 1.0)[0]
    misfit = float(abs(off @ now).max() / max(inside @ now, 1.0))
    warnings.warn(f"mixing: the shares of tokens can't be reached; they are off their targets by up to {misfit:.4f}", stacklevel=2)
    return history, [], misfit


def fitted(known: DataFrame, names: list[str], targets: dict[str, float], most: float) -> list[list[float]]:
    """The steps for known(n_tokens, p) towards totals that leave the largest weight's domain whole: what each domain's posterior takes off a rate, step by step."""
    sums = lambda r: [F.coalesce(F.sum(F.col("n_tokens") * F.col("p")[k] * r), F.lit(0.0)).alias(f"s{k}") for k in range(len(names))]
    have = list(known.agg(*sums(F.lit(1.0))).first())
    total = sum(have)
    goals = [targets.get(d) for d in names]
    used = [k for k, g in enumerate(goals) if g is not None and have[k] > 0]
    if not used or total <= 0:
        return []
    main = max(used, key=lambda k: goals[k])
    scale = have[main] / goals[main] if goals[main] > 0 else 0.0
    want = {k: min(goals[k] * scale, most * have[k]) for k in used}
    history: list[list[float]] = []
    before = {k: math.inf for k in used}
    for _ in range(STEPS):
        now = list(known.agg(*sums(rate(F.col("p"), history, most))).first())
        misfit = {k: now[k] - want[k] for k in used}
        if max(abs(misfit[k] - before[k]) for k in used) <= TOLERANCE * total:
            break
        before = misfit
        history.append([misfit[k] / have[k] if k in used else 0.0 for k in range(len(names))])
    return history


def mixing_rates(docs: DataFrame, domains: DataFrame, targets: dict[str, float] | None = None, most: float = MOST) -> DataFrame:
    """doc_id, n_tokens, a posterior p_<domain> for each domain, rate and copies for each row."""
    classifier = Classifier(docs.select("doc_id", "text"), domains)
    slim = classifier.judged(docs.select("doc_id", "text")).drop("text") if classifier.names else None
    if slim is None:
        return docs.select("doc_id", _tokens().alias("n_tokens"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    known = stored(slim, "mixing-posteriors")
    out = _rated(known, classifier, targets, most)
    return out.select(F.col("doc_id"), F.col("__n_tokens").alias("n_tokens"), *(F.col("__p")[k].alias(f"p_{d}") for k, d in enumerate(classifier.names)), F.col("__rate").alias("rate"), F.col("__copies").alias("copies"))


def _rated(known: DataFrame, classifier: Classifier, targets: dict[str, float] | None, most: float) -> DataFrame:
    history, scarce, _ = balanced(known.select(F.col("__n_tokens").alias("n_tokens"), F.col("__p").alias("p")), classifier.names, TARGETS if targets is None else targets, most)
    u = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.lit("mixing")), F.lit(1 << 24)) / (1 << 24)
    return known.withColumn("__rate", rate(F.col("__p"), history, limit(F.col("__p"), scarce, most))).withColumn("__copies", F.floor(F.col("__rate") + u).cast("int"))


def mix(docs: DataFrame, domains: DataFrame, targets: dict[str, float] | None = None, most: float = MOST) -> DataFrame:
    """The rows of docs, each as often as its copies, with all their columns."""
    classifier = Classifier(docs, domains)
    if not classifier.names:
        return docs
    # all columns travel as one, so that none of theirs can meet one of ours
    whole = docs.select("doc_id", "text", F.struct("*").alias("__row"))
    kept = _rated(stored(classifier.judged(whole).drop("text"), "mixing-posteriors"), classifier, targets, most).where("__copies > 0")
    if most > 1:
        kept = kept.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return kept.select("__row.*")
