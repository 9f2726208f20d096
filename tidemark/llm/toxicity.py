"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over the hashed distinct words of a text, trained in numpy from texts
confirmed as toxic and texts without a label.  Its risk is
``prior * R+(toxic) + max(0, R-(unlabelled) - prior * R-(toxic))``: unlabelled texts count as clean,
corrected by the share of toxic ones among them; where the correction goes below zero (the sign that
the model overfits) the step goes the other way.  The prior is the share of toxic rows among the
labelled rows of the learning fold.

Every word may carry weight.  The squared norm draws a weight to 0 the more, the less the word's share among
toxic texts stands out from chance (see `trust`), so what few texts say is believed little, at every
size of table, and rare words are not learned by heart.

Learning takes a bounded sample (POSITIVE and UNLABELLED rows, those with the smallest hashes of their id,
and of these as many as BYTES of distinct words hold), scoring covers every row.  Rows with a null id
are never learned from.  A score of 0.5 is predicted as toxic.  A null or empty text has no words and
gets the score of the bias alone.  Without any confirmed text all scores are 0.  Rows that repeat a text
have equal scores, whatever their ids; an empty table gives an empty result; other columns, whatever their
names, are not looked at.  Very long texts are no more than their distinct buckets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import WordCache, digest64, raw, slices, split, stored, sums

#: Buckets of hashed words.
BUCKETS = 1 << 18
#: Rows that are learned from, at most.
POSITIVE, UNLABELLED = 8_000, 16_000
#: Bytes of distinct buckets of each side that are learned from, at most, at four a bucket.
BYTES = 64 << 20
#: Steps, their size, the weight of the squared norm, and the size of corrective steps.
STEPS, RATE, DECAY, CORRECTION = 200, 0.05, 3e-5, 1.0
#: The square of a deviation, in standard errors, at which a word is trusted by half.
CHANCE = 36.0
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _buckets(words: list[bytes]) -> np.ndarray:
    return (digest64(w.strip(PUNCTUATION).lower() for w in words) % np.uint64(BUCKETS)).astype(np.int64)


def features(texts: list[bytes], cached: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each text, and where each text's start."""
    words, bounds = split(texts)
    found = cached(words) if words else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    pair = np.unique(owner * BUCKETS + found)
    return pair % BUCKETS, np.searchsorted(pair, np.arange(len(texts) + 1) * BUCKETS)


def _margins(weights: np.ndarray, found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return sums(weights[found], starts) + weights[BUCKETS]


def trust(positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Between 0 and 1 for each bucket, and 1 for the bias: how far its share of toxic texts stands out from chance."""
    (fp, sp), (fu, su) = positive, unlabelled
    n, m = len(sp) - 1, len(su) - 1
    p, u = np.bincount(fp, minlength=BUCKETS) / n, (np.bincount(fu, minlength=BUCKETS) + 1) / (m + 2)
    square = (p - u) ** 2 / (u * (1 - u) * (1 / n + 1 / m))
    return np.append(square / (square + CHANCE), 1.0)


def risk(weights: np.ndarray, positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], prior: float) -> tuple[float, float, np.ndarray]:
    """prior * R+(toxic); R-(unlabelled) - prior * R-(toxic); and the slope of what a step lowers.

    That is the sum of both, or the second one's negative where it is below zero.
    """
    zp, zu = _margins(weights, *positive), _margins(weights, *unlabelled)
    p, u = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))

    def slope(side: tuple[np.ndarray, np.ndarray], each: np.ndarray) -> np.ndarray:
        found, starts = side
        out = np.bincount(found, np.repeat(each, np.diff(starts)), BUCKETS + 1)
        out[BUCKETS] = each.sum()
        return out / max(len(each), 1)

    clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    if clean >= 0:
        g = slope(positive, prior * (p - 1) - prior * p) + slope(unlabelled, u)
    else:
        g = CORRECTION * (slope(positive, prior * p) - slope(unlabelled, u))
    return float(prior * np.logaddexp(0, -zp).mean()), float(clean), g


def train(positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights of the buckets, and the bias behind them.

    A weight is its trust times a free number, whose square is what the norm sums.
    """
    scale = trust(positive, unlabelled)
    free, m, v = (np.zeros(BUCKETS + 1) for _ in range(3))
    free[BUCKETS] = np.log(max(prior, 1e-4) / max(1 - prior, 1e-4))
    decay = np.append(np.full(BUCKETS, DECAY), 0.0)
    for step in range(1, steps + 1):
        g = risk(scale * free, positive, unlabelled, prior)[2] * scale + decay * free
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        free = free - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return scale * free


def _extract(batches):
    cached = WordCache(_buckets)
    for batch in slices(batches):
        found, starts = features(raw(batch), cached)
        data = found.astype(np.int32)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("positive", "unlabelled", "point")), pa.array([data[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary())], names=["positive", "unlabelled", "point", "found"])


def _scored(weights: np.ndarray | None):
    def run(batches):
        cached = WordCache(_buckets)
        for batch in slices(batches):
            score = np.zeros(batch.num_rows) if weights is None else 1 / (1 + np.exp(-np.clip(_margins(weights, *features(raw(batch), cached)), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def learn(docs: DataFrame, labels: DataFrame, held_out) -> np.ndarray | None:
    """held_out: from a column of ids, whether a row is kept from learning."""
    fold = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = fold.agg(F.count("toxic").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("k")).first()
    if not known["k"]:
        return None
    pick = lambda df, n, name: df.select(F.col("doc_id").cast("long").alias("pick")).orderBy(F.xxhash64("pick"), "pick").limit(n).distinct().withColumn(name, F.lit(True))
    sides = [pick(fold.where("toxic = 1"), POSITIVE, "positive"), pick(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), UNLABELLED, "unlabelled")]
    # both samples are bounded by parameters, so they may be broadcast
    chosen = reduce(lambda a, b: a.join(b, "pick", "full"), sides)
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("pick")).select("text", F.coalesce("positive", F.lit(False)).alias("positive"), F.coalesce("unlabelled", F.lit(False)).alias("unlabelled"), F.xxhash64("pick").alias("point"))
    sample = stored(rows.mapInArrow(_extract, "positive boolean, unlabelled boolean, point long, found binary"), "toxicity-sample")

    def side(name: str) -> tuple[np.ndarray, np.ndarray]:
        sizes = sample.where(name).select("point", F.octet_length("found").alias("size")).toPandas().sort_values("point")
        fits = sizes["point"][sizes["size"].cumsum() <= BYTES]
        own = sample.where(name).where(F.col("point") <= int(fits.max())).toPandas().sort_values(["point", "found"]) if len(fits) else sizes.head(0).assign(found=None)
        parts = [np.frombuffer(x, np.int32) for x in own["found"]]
        return np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)

    positive, unlabelled = side("positive"), side("unlabelled")
    return train(positive, unlabelled, known["k"] / known["n"]) if len(positive[1]) > 1 and len(unlabelled[1]) > 1 else None


def in_fold(rest: int, of: int):
    """Whether crc32 of an id, as text, has this remainder; false for null."""
    return lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % of == rest, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, held_out=in_fold(0, 5)) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weights = learn(docs, labels, held_out)
    return docs.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(_scored(weights), "doc_id long, held_out boolean, score double, predicted int")
