"""Quality rules: repetition and symbol counts, and a hashed n-gram likelihood ratio.

Words and their bigrams are hashed to a fixed number of buckets.  Two multinomials are counted over
them: the raw corpus (every word of every document) and the trusted target (the documents of a
bounded sample of rows labelled as of good quality).  A document's score is the mean of
log p_target / p_raw over its n-grams; it is kept if the score reaches a fixed threshold and no base
rule fails.  No sampling, no randomness: equal texts get equal verdicts at every size of corpus.

One pass counts, one pass scores; between them goes a table of as many numbers as there are buckets.
A null or empty text has no words and fails the base rules.  Without labels the ratio is 0 for every
document, so the base rules alone decide.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import WordCache, digest64, mixed, raw, slices, split, stored, sums

#: Buckets of hashed n-grams.
BUCKETS = 1 << 16
#: Labelled rows that the trusted target is counted from, at most: those with the smallest hashes of their id.
TARGET_ROWS = 20_000
#: Smoothing, as counts in each bucket of the raw corpus; the target's is smaller by its share of all n-grams.
PRIOR = 8.0
#: The least mean log-likelihood ratio of a document that is kept.
THRESHOLD = -0.1
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))


def ngrams(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and bigrams of each text, text by text, and where each text's start."""
    counts = np.diff(bounds)
    total = 2 * counts - (counts > 0)
    starts = np.concatenate([[0], np.cumsum(total)])
    out = np.zeros(starts[-1], np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(hashes)) - bounds[:-1][owner]
    one = (mixed(hashes) >> np.uint64(64 - 16)).astype(np.int64) % BUCKETS
    out[starts[:-1][owner] + at] = one
    with np.errstate(over="ignore"):
        two = mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    inner = owner[:-1] == owner[1:]
    place = starts[:-1][owner[:-1]] + counts[owner[:-1]] + at[:-1]
    out[place[inner]] = ((two >> np.uint64(64 - 16)).astype(np.int64) % BUCKETS)[inner]
    return out, starts


def repeated(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many words of each text lie in a run of three words that the text has twice or more; exact."""
    n = len(ids)
    covered = np.zeros(n, bool)
    if n >= 3:
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        inner = np.flatnonzero(owner[:-2] == owner[2:])
        key = pd.factorize(owner[inner])[0].astype(np.int64)
        for k in range(3):  # each step's key is below n * n
            key = pd.factorize(key * (int(ids.max()) + 1) + ids[inner + k])[0].astype(np.int64)
        twice = inner[np.bincount(key, minlength=1)[key] > 1] if len(key) else inner
        for k in range(3):
            covered[twice + k] = True
    return sums(covered.astype(np.int64), bounds)


def duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _characters(words: list[bytes]) -> np.ndarray:
    return np.fromiter((len(w.decode()) for w in words), np.uint64, len(words))


def _measure(words: list[bytes]) -> np.ndarray:
    return np.stack([digest64(words), _characters(words)], 1) if words else np.zeros((0, 2), np.uint64)


def _counts(batches):
    rawc, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    cached = WordCache(_measure)
    for batch in slices(batches):
        words, bounds = split(raw(batch))
        grams, starts = ngrams(cached(words)[:, 0], bounds)
        rawc += np.bincount(grams, minlength=BUCKETS)
        trusted = np.repeat(batch.column("trusted").to_numpy(zero_copy_only=False), np.diff(starts))
        target += np.bincount(grams[trusted], minlength=BUCKETS)
    used = np.flatnonzero(rawc)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(rawc[used]), pa.array(target[used])], names=["bucket", "raw", "target"])


def _score(ratio: np.ndarray | None, threshold: float):
    def run(batches):
        cached = WordCache(_measure)
        for batch in slices(batches):
            texts = raw(batch)
            words, bounds = split(texts)
            rows = cached.look(words)
            values = cached.values[rows] if len(words) else np.zeros((0, 2), np.uint64)
            n = np.diff(bounds)
            repeats = repeated(rows, bounds)
            grams, starts = ngrams(values[:, 0], bounds)
            score = np.zeros(len(n)) if ratio is None else sums(ratio[grams].astype(np.float64), starts) / np.maximum(np.diff(starts), 1)
            failed = (n < 50) | (100 * repeats > 50 * n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n), pa.array(sums(values[:, 1].astype(np.int64), bounds)),
                    pa.array([len(x.translate(None, _NOT_SYMBOLS)) for x in texts], pa.int64()), pa.array([duplicate_lines(x) for x in texts], pa.int64()),
                    pa.array(repeats), pa.array(failed), pa.array(~failed & (np.round(score, 9) >= threshold)), pa.array(score),
                ],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"],
            )

    return run


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def trusted_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """At most `rows` ids labelled as of good quality, the same ones at every run."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("trusted_id")).orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(rows).distinct()


def likelihood_ratio(docs: DataFrame, labels: DataFrame, rows: int = TARGET_ROWS) -> np.ndarray | None:
    """log p_target / p_raw of each bucket; None without any target."""
    # the sample is at most `rows` numbers, so it may be broadcast
    flagged = docs.join(F.broadcast(trusted_ids(labels, rows)), docs["doc_id"] == F.col("trusted_id"), "left").select("text", F.col("trusted_id").isNotNull().alias("trusted"))
    model = flagged.mapInArrow(_counts, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    rawc, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    rawc[model["bucket"]], target[model["bucket"]] = model["raw"], model["target"]
    return ratio_of(rawc, target)


def ratio_of(rawc: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """From counts; where neither has an n-gram, or the target has its share, the ratio is 0 at every size of corpus."""
    if not target.sum():
        return None
    target = target + PRIOR * target.sum() / rawc.sum()
    rawc = rawc + PRIOR
    return (np.log(target / target.sum()) - np.log(rawc / rawc.sum())).astype(np.float32)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TARGET_ROWS) -> DataFrame:
    """The counts, the score and the verdict for each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_score(likelihood_ratio(docs, labels, rows), threshold), RESULT)


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, with all their columns; a row's text decides, not its id."""
    ratio = likelihood_ratio(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels)
    score = _score(ratio, threshold)

    def run(batches):
        for batch in slices(batches):
            (out,) = score([pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text")], names=["doc_id", "text"])])
            yield batch.filter(out.column("kept"))

    return docs.mapInArrow(run, docs.schema)
