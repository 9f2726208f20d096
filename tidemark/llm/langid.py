"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The probability of a
word is the sum over all ways to cut it into pieces, by the forward algorithm; a character that the
vocabulary lacks is a piece of its own with a small fixed probability.  Words (runs of letters in
lower case, with the vocabulary's space symbol in front) are independent, so a text's log-likelihood
is a sum over its words, and a distinct word is scored once while the bounded cache lasts.  Sums of
short words are plain probabilities, many words at a time; longer words, of any length, are summed in
logarithms, a character at a time.  All pieces count, however long.

Pieces are learned by expectation-maximisation (forward and backward sums give the expected counts)
from a bounded number of texts of each language, those with the smallest hashes of their id; their words
are counted on the executors, and each language is learned by a task of its own.  The score is the
posterior of the predicted language with the evidence of the text's words averaged down to at most
EVIDENCE words, so that it stays graded on long texts.  Of languages that are equally likely the first
in the order of names is taken.

A null text, or one without a letter, is `und` with score 0.  Rows with a null lang or id are never
learned from; rows that repeat an id are learned from together.  Without any language to learn, or in an
empty table, there is nothing but `und`.  Equal texts get equal results.  Of other columns, whatever their
names, none is looked at.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.words import CACHE_WORDS, WordCache, raw, slices, split, sums

VOCABULARY = "piece_bpe_32k.model"
#: Texts of each language that are learned from, at most; whole texts are.
TEXTS = 400
#: Rounds of expectation-maximisation; smoothing of the expected counts.
ROUNDS, PRIOR = 3, 0.1
#: Characters of a word whose plain sums stay far from the least double, at most; no piece counts as less likely than FLOOR.
SHORT, FLOOR = 24, 1e-12
#: Log-probability of a character outside the vocabulary.
UNKNOWN = np.log(1e-7)
#: Words whose evidence a score weighs at most.
EVIDENCE = 20.0


@cache
def vocabulary(model: str) -> dict[str, int]:
    import os

    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model if os.sep in model else public_tokenizers.path(model))
    pieces = sorted({sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))})
    return {p: i for i, p in enumerate(pieces)}


@cache
def longest(model: str) -> int:
    return max(map(len, vocabulary(model)))


@cache
def prefixes(model: str) -> frozenset[str]:
    """All beginnings of pieces: where none goes on, the search for longer ones ends."""
    return frozenset(p[:k] for p in vocabulary(model) for k in range(1, len(p) + 1))


#: Rows of a probability table ahead of the pieces: no piece, and a character outside the vocabulary.
NONE, OUTSIDE, FIRST = 0, 1, 2


def probabilities(logp: np.ndarray) -> np.ndarray:
    """(rows, languages) of probabilities, from (languages, pieces) of their logarithms."""
    p = np.maximum(np.exp(np.atleast_2d(np.asarray(logp, np.float64))), FLOOR)
    return np.concatenate([np.zeros((len(p), 1)), np.full((len(p), 1), np.exp(UNKNOWN)), p], 1).T.copy()


class Lattice:
    """All pieces of a batch of words of up to SHORT characters: for each start and length, the piece's row in a probability table."""

    def __init__(self, words: list[str], model: str):
        pieces, begins, most = vocabulary(model), prefixes(model), longest(model)
        self.most = most
        self.n, self.width = len(words), max(map(len, words), default=0)
        self.ends = np.fromiter(map(len, words), np.int64, self.n)
        at, rows = [], []
        for k, w in enumerate(words):
            size = len(w)
            for i in range(size):
                row = pieces.get(w[i])
                at.append((i * (most + 1) + 1) * self.n + k)
                rows.append(OUTSIDE if row is None else row + FIRST)
                for stop in range(i + 2, min(i + most, size) + 1):
                    s = w[i:stop]
                    if s not in begins:
                        break
                    if (row := pieces.get(s)) is not None:
                        at.append((i * (most + 1) + stop - i) * self.n + k)
                        rows.append(row + FIRST)
        flat = np.zeros(self.width * (most + 1) * self.n, np.int32)
        flat[at] = rows
        self.piece = flat.reshape(self.width, most + 1, self.n)
        self.used = self.piece.any(2)

    def forward(self, table: np.ndarray) -> np.ndarray:
        """Sums over all segmentations of each prefix: (width + 1, words, languages)."""
        alpha = np.zeros((self.width + 1, self.n, table.shape[1]))
        alpha[0] = 1
        for j in range(1, self.width + 1):
            for length in range(1, min(self.most, j) + 1):
                if self.used[j - length, length]:
                    alpha[j] += alpha[j - length] * table[self.piece[j - length, length]]
        return alpha

    def backward(self, table: np.ndarray) -> np.ndarray:
        beta = np.zeros((self.width + 1, self.n, table.shape[1]))
        beta[self.ends, np.arange(self.n)] = 1
        for i in range(self.width - 1, -1, -1):
            for length in range(1, min(self.most, self.width - i) + 1):
                if self.used[i, length]:
                    beta[i] += beta[i + length] * table[self.piece[i, length]]
        return beta

    def total(self, table: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word in each language."""
        return np.log(self.forward(table)[self.ends, np.arange(self.n)])

    def expected(self, table: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces of one language over all segmentations of the words."""
        alpha, beta = self.forward(table)[:, :, 0], self.backward(table)[:, :, 0]
        share = weights / alpha[self.ends, np.arange(self.n)]
        out = np.zeros(len(table))
        for i, length in zip(*np.nonzero(self.used), strict=True):
            p = self.piece[i, length]
            out += np.bincount(p, alpha[i] * table[p, 0] * beta[i + length] * share, len(table))
        return out[FIRST:]


def starting(word: str, at: int, model: str):
    """(length, row) of all pieces of a word that start at a character."""
    pieces, begins = vocabulary(model), prefixes(model)
    row = pieces.get(word[at])
    yield 1, OUTSIDE if row is None else row + FIRST
    for stop in range(at + 2, min(at + longest(model), len(word)) + 1):
        if (s := word[at:stop]) not in begins:
            break
        if (row := pieces.get(s)) is not None:
            yield stop - at, row + FIRST


def long_total(word: str, logs: np.ndarray, model: str) -> np.ndarray:
    """Log-likelihood of a word of any length in each language; only the sums that a piece can reach are held."""
    size = longest(model) + 1
    ring = np.full((size, logs.shape[1]), -np.inf)
    ring[0] = 0
    for i in range(len(word)):
        own = ring[i % size].copy()
        ring[i % size] = -np.inf
        for length, row in starting(word, i, model):
            to = (i + length) % size
            ring[to] = np.logaddexp(ring[to], own + logs[row])
    return ring[len(word) % size]


def long_expected(word: str, logs: np.ndarray, model: str) -> np.ndarray:
    """Expected counts of the pieces of one language over all segmentations of a word of any length."""
    steps = [(i, i + length, row) for i in range(len(word)) for length, row in starting(word, i, model)]
    forward, backward = (np.full(len(word) + 1, -np.inf) for _ in range(2))
    forward[0] = backward[-1] = 0
    for i, j, row in steps:
        forward[j] = np.logaddexp(forward[j], forward[i] + logs[row, 0])
    for i, j, row in reversed(steps):
        backward[i] = np.logaddexp(backward[i], backward[j] + logs[row, 0])
    out = np.zeros(len(logs))
    for i, j, row in steps:
        out[row] += np.exp(forward[i] + logs[row, 0] + backward[j] - forward[-1])
    return out[FIRST:]


def likelihoods(words: list[str], table: np.ndarray, model: str) -> np.ndarray:
    """Log-likelihood of each word in each language."""
    out = np.zeros((len(words), table.shape[1]))
    for at in by_length(words):
        out[at] = Lattice([words[i] for i in at], model).total(table)
    long = [i for i, w in enumerate(words) if len(w) > SHORT]
    if long:
        logs = np.log(np.maximum(table, np.finfo(float).tiny))
        for i in long:
            out[i] = long_total(words[i], logs, model)
    return out


def letters(word: bytes) -> list[str]:
    """The runs of letters of a word, lower case, with the space symbol in front of each."""
    text = word.decode().lower()
    runs = [text] if text.isalpha() else "".join(c if c.isalpha() else " " for c in text).split()
    return ["▁" + r for r in runs]


def by_length(words: list[str], size: int = 2048):
    """Numbers of the words of up to SHORT characters in batches of about equal lengths, so that lattices stay narrow."""
    at = sorted((i for i in range(len(words)) if len(words[i]) <= SHORT), key=lambda i: len(words[i]))
    for k in range(0, len(at), size):
        yield np.array(at[k : k + size])


def train(words: dict[str, dict[str, int]], model: str = VOCABULARY, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """words: counts of words by language -> the languages, and their log-probabilities of pieces."""
    pieces = vocabulary(model)
    langs = sorted(words)
    out = np.zeros((len(langs), len(pieces)))
    for k, lang in enumerate(langs):
        own = sorted(words[lang])
        weights = np.array([words[lang][w] for w in own], float)
        lattices = [(Lattice([own[i] for i in at], model), weights[at]) for at in by_length(own)]
        long = [(own[i], weights[i]) for i in range(len(own)) if len(own[i]) > SHORT]
        # longer pieces start likelier, as in a unigram vocabulary's first guess
        logp = np.full(len(pieces), -np.log(len(pieces)))
        for _ in range(rounds):
            table = probabilities(logp)
            counts = PRIOR + sum((x.expected(table, w) for x, w in lattices), np.zeros(len(pieces)))
            logs = np.log(np.maximum(table, np.finfo(float).tiny))
            counts = sum((n * long_expected(w, logs, model) for w, n in long), counts)
            logp = np.log(counts / counts.sum())
        out[k] = logp
    return langs, out


def _measure(langs: list[str], logp: np.ndarray, model: str):
    table = probabilities(logp)

    scored = WordCache(lambda runs: likelihoods([r.decode() for r in runs], table, model))

    def run(words: list[bytes]) -> np.ndarray:
        """For each word: how many runs of letters it has, and their log-likelihood by language."""
        runs = [letters(w) for w in words]
        flat = [r.encode() for x in runs for r in x]
        each = np.ones((len(flat) + 1, len(langs) + 1))
        each[0] = 0
        if flat:
            each[1:, 1:] = scored(flat)
        total = np.cumsum(each, 0)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int64)
        return total[bounds[1:]] - total[bounds[:-1]]

    return run


def _predict(langs: list[str], logp: np.ndarray, model: str):
    def run(batches):
        cached = WordCache(_measure(langs, logp, model))
        for batch in slices(batches):
            words, bounds = split(raw(batch))
            values = cached(words) if words else np.zeros((0, len(langs) + 1))
            n = sums(values[:, 0], bounds)
            likely = np.stack([sums(values[:, 1 + k], bounds) for k in range(len(langs))], 1) if langs else np.zeros((len(n), 0))
            any_ = (n > 0.5) & bool(langs)
            if langs:
                best = np.argmax(likely, 1)
                graded = likely / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None]
                posterior = np.exp(-np.logaddexp.reduce(graded - np.take_along_axis(graded, best[:, None], 1), axis=1))
                names = np.where(any_, np.array(langs, object)[best], "und")
            else:
                posterior, names = np.zeros(len(n)), np.full(len(n), "und", object)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(any_, posterior, 0.0))],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def learn(docs: DataFrame, held_out, model: str = VOCABULARY, texts: int = TEXTS) -> tuple[list[str], np.ndarray]:
    """From docs(doc_id, text, lang); held_out: from a column of ids, whether a row is kept from learning."""
    fold = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    share = F.broadcast(fold.groupBy("lang").agg(F.count("*").alias("all")).where("all > 0"))  # a row for each language
    point = (F.xxhash64("doc_id") % 1_000_000 + 1_000_000) % 1_000_000
    # first by a threshold that leaves a few times the texts asked for, so that no language's rows meet in one task
    some = fold.select("doc_id", "lang").join(share, "lang").where(point < F.greatest(4 * texts / F.col("all"), F.lit(0.0)) * 1_000_000)
    top = some.withColumn("nr", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("nr") <= texts).select("doc_id").distinct()
    words = fold.join(F.broadcast(top), "doc_id", "left_semi").select("lang", "text").mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = {r["lang"]: np.frombuffer(r["logp"]) for r in words.groupBy("lang").applyInArrow(_trained(model), "lang string, logp binary").toLocalIterator()}
    langs = sorted(found)
    return langs, np.stack([found[x] for x in langs]) if langs else np.zeros((0, len(vocabulary(model))))


def _counted(batches):
    """Words of each language; counts are handed on when there are many."""
    held: dict[tuple[str, str], int] = {}

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.string()), pa.array([w for _, w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["lang", "word", "n"])
        held.clear()
        return out

    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), raw(batch), strict=True):
            for w in text.split():
                for r in letters(w):
                    held[lang, r] = held.get((lang, r), 0) + 1
        if len(held) > CACHE_WORDS:
            yield flush()
    yield flush()


def _trained(model: str):
    def run(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        _, logp = train({lang: dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))}, model)
        return pa.table({"lang": [lang], "logp": pa.array([logp[0].tobytes()], pa.binary())})

    return run


def languages(docs: DataFrame, held_out, model: str = VOCABULARY, texts: int = TEXTS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs(doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    langs, logp = learn(docs, held_out, model, texts)
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(_predict(langs, logp.astype(np.float32), model), "doc_id long, held_out boolean, lang_pred string, score double")
