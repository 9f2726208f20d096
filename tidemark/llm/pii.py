"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base patterns (email, ip, card, phone) always count.  A semi-Markov CRF adds spans that they miss:
numbers written without a plus sign, numbers that a pattern swallowed together with a neighbour, and
secrets (keys, tokens, passwords).  It reads zones around seeds - digits, at signs, runs of SHOUT
capitals, a word for a secret with = or : behind it - as atoms: runs of letters and digits, single
other characters.  Whole-span features score every candidate span of up to SPAN atoms that holds a
seed, or follows such a word, as one of the kinds; a dynamic programme over the zone chooses
boundaries and kinds jointly.  What has none of these marks is outside the model, as are spans of more atoms.

Weights are trained here, by the gradient of the log-likelihood (forward and backward sums), from
sentences that a fixed rule generates.  Added spans never overlap base spans.  Of choices that score the
same, the one that leaves its last atoms outside spans is taken, then the one whose last span is longest;
of kinds the first as listed.  Time and memory are linear in a text: candidates come BLOCK starts at a time.  A null or empty text has no spans; equal rows
get equal results, whatever their ids, null ones too; an empty table gives an empty result.  Columns
other than doc_id and text, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import cache, cached_property
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import slices

KINDS = ("email", "ip", "card", "phone", "secret")
#: Atoms of the longest span, words of context around a seed, sentences and passes of the training.
SPAN, CONTEXT, SENTENCES, PASSES, RATE = 16, 2, 300, 12, 0.6
#: Capitals in a row that may be a secret; starts of candidate spans that are scored at a time.
SHOUT, BLOCK = 16, 2048

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NAMED = r"(?i:pass(?:word|wd)?|pwd|token|secret|key)[^A-Za-z0-9\n]{0,2}[=:]"
#: Seeds, one search for each kind, as that is far faster than one for all; = and : count behind a word for a secret.
_SEEDS = re.compile(r"[0-9@=:]"), re.compile(rf"[A-Z]{{{SHOUT}}}")
_NAMES = re.compile(rf"{_NAMED}$")
#: What makes an atom part of an entity by itself, and what ends right before an entity.
_MARK = re.compile(rf"[0-9@]|[A-Z]{{{SHOUT}}}")
_BEHIND = re.compile(rf"{_NAMED}[^A-Za-z0-9\n]{{0,2}}$")
_SPACE = frozenset(" \t\n\x0b\x0c\r")
_WORD = re.compile(r"[^ \t-\r]+")
_ATOM = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]", re.S)
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (twice + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each at sign to the left and right: in time linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, free := m.end()))
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return out


def _byte(digits: str) -> bool:
    """Whether ASCII digits, however many, are a number up to 255."""
    some = digits.lstrip("0")
    return len(some) <= 3 and int(some or "0") <= 255


def base(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(_byte(x) for x in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m.group())) <= 15]
    return out


FEATURES = (
    "always", "at", "at and dot", "four parts to 255", "luhn", "plain number", "plus", "brackets", "phone digits", "few digits", "many digits",
    "grouped", "space", "long mixed", "long hex", "capitals and digits", "cue", "after equals", "quoted", "dots", "odd sign", "letters", "atoms over 10", "open bracket", "one atom", "short parts", "date like", "ends well", "long solid",
)
_CUE = re.compile(r"(?:pass(?:word|wd)?|pwd|token|secret|key)\W{0,4}$", re.I)
_DATE = re.compile(r"(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4})(?:[ T][0-9:.]+)?")


def features(text: str, start: int, end: int) -> np.ndarray:
    """What a whole span looks like, and what stands right before it."""
    s = text[start:end]
    digits = "".join(_DIGITS.findall(s))
    n, letters = len(digits), any(c.isalpha() for c in s)
    parts = s.split(".")
    number = not letters and not set(s) - set("0123456789 -().+")
    solid = s.isalnum()
    before = text[max(0, start - 14) : start]
    has = (
        True,
        "@" in s,
        bool(_DOMAIN.fullmatch(s.rpartition("@")[2])) and 0 < s.find("@") and s.count("@") == 1 and " " not in s,
        len(parts) == 4 and all(p.isascii() and p.isdigit() and _byte(p) for p in parts),
        number and 16 <= n <= 19 and "." not in s and "(" not in s and "+" not in s and luhn(digits),
        number,
        s[0] == "+" and number,
        "(" in s and ")" in s and number,
        number and 8 <= n <= 15,
        n < 8,
        n > 19,
        number and bool(re.search(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$", s)),
        " " in s,
        solid and letters and n >= 3 and len(s) >= 16,
        solid and len(s) >= 16 and not set(s.lower()) - set("0123456789abcdef"),
        solid and s.isupper() and n >= 1 and len(s) >= 16,
        bool(_CUE.search(before)),
        before[-1:] in ("=", ":"),
        before[-1:] == '"' and text[end : end + 1] == '"',
        s.count(".") >= 3,
        bool(set(s) - set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 -().+@_%")),
        letters,
        len(_ATOM.findall(s)) > 10,
        s.count("(") != s.count(")"),
        solid,
        number and n and max(map(len, re.split(r"[^0-9]+", s))) < 3,
        bool(_DATE.fullmatch(s)),
        s[-1].isalnum() and (s[0].isalnum() or s[0] in "+("),
        solid and len(s) >= 12,
    )
    return np.array(has, float)


class Zone:
    """Atoms of a stretch of text, and its candidate spans."""

    def __init__(self, text: str, start: int, end: int):
        self.text = text
        self.bounds = np.fromiter((m.start() for m in _ATOM.finditer(text, start, end)), np.int64)
        self.n = len(self.bounds)
        self.bounds = np.append(self.bounds, end)

    def _edge(self, i: int) -> bool:
        return i == 0 or not (self.text[i - 1].isalnum() and self.text[i : i + 1].isalnum())

    def candidates(self, block: int = BLOCK):
        """(spans, features): rows of (first atom, atom behind), by start and end, of `block` starts at a time."""
        text, bounds = self.text, self.bounds
        spans: list[tuple[int, int]] = []
        rows: list[np.ndarray] = []
        for i in range(self.n):
            if i and i % block == 0 and spans:
                yield np.array(spans, np.int64), np.array(rows)
                spans, rows = [], []
            first = int(bounds[i])
            if text[first].isspace() or text[first] in ".,;:!?)-" or not self._edge(first):
                continue
            seeded = bool(_BEHIND.search(text, max(0, first - 16), first))
            for j in range(i + 1, min(i + SPAN, self.n) + 1):
                a, b = int(bounds[j - 1]), int(bounds[j])
                if text[a] in "\n\r":
                    break
                seeded = seeded or bool(_MARK.search(text, a, b))
                if seeded and not text[a].isspace() and text[b - 1] not in ".,;:!?(+" and self._edge(b):
                    spans.append((i, j))
                    rows.append(features(text, first, b))
        if spans:
            yield np.array(spans, np.int64), np.array(rows)

    def best(self, weights: np.ndarray) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the best joint choice; an atom outside spans scores 0."""
        value, back, kind = np.full(self.n + 1, -np.inf), np.full(self.n + 1, -1, np.int64), np.zeros(self.n + 1, np.int8)
        value[0], done = 0.0, 0
        for spans, rows in self.candidates():
            score = rows @ weights.T
            for (i, j), k, top in zip(spans.tolist(), score.argmax(1).tolist(), score.max(1).tolist(), strict=True):
                while done < i:  # all spans that end there have been seen
                    done += 1
                    if value[done] <= value[done - 1]:
                        value[done], back[done] = value[done - 1], -1
                if value[i] + top > value[j]:
                    value[j], back[j], kind[j] = value[i] + top, i, k
        while done < self.n:
            done += 1
            if value[done] <= value[done - 1]:
                value[done], back[done] = value[done - 1], -1
        out, j = [], self.n
        while j > 0:
            if back[j] < 0:
                j -= 1
            else:
                out.append((int(kind[j]), int(self.bounds[back[j]]), int(self.bounds[j])))
                j = int(back[j])
        return out[::-1]

    @cached_property
    def _all(self):
        """All spans and features of a sentence, and the numbers of the spans into and out of each atom bound."""
        found = list(self.candidates())
        spans = np.concatenate([s for s, _ in found]) if found else np.zeros((0, 2), np.int64)
        rows = np.concatenate([r for _, r in found]) if found else np.zeros((0, len(FEATURES)))
        return spans, rows, *([np.flatnonzero(spans[:, side] == j) for j in range(self.n + 1)] for side in (1, 0))

    def slope(self, weights: np.ndarray, gold: set[tuple[int, int, int]]) -> np.ndarray:
        """Gradient of the log-likelihood of the gold spans: theirs less the expected features."""
        spans, rows, into, out_of = self._all
        if not len(spans):
            return np.zeros_like(weights)
        score = rows @ weights.T
        each = np.logaddexp.reduce(score, axis=1)
        alpha, beta = np.zeros(self.n + 1), np.zeros(self.n + 1)
        for j in range(1, self.n + 1):
            alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[spans[into[j], 0]] + each[into[j]])])
        for i in range(self.n - 1, -1, -1):
            beta[i] = np.logaddexp.reduce([beta[i + 1], *(beta[spans[out_of[i], 1]] + each[out_of[i]])])
        share = np.exp(alpha[spans[:, 0], None] + score + beta[spans[:, 1], None] - alpha[self.n])
        want = np.zeros_like(share)
        for k, (i, j) in enumerate(spans):
            for kind in range(len(KINDS)):
                want[k, kind] = (kind, int(self.bounds[i]), int(self.bounds[j])) in gold
        return (want - share).T @ rows


def sentence(rnd: random.Random) -> tuple[str, set[tuple[int, int, int]]]:
    """A sentence with entities and lookalikes, by rule."""
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rnd.choice("abcdefghilmnoprstuvéü") for _ in range(rnd.randrange(1, 9)))

    def card() -> str:
        body = rnd.choice("3456") + digits(14)
        s = next(body + d for d in "0123456789" if luhn(body + d))
        cut = rnd.choice(["", " ", "-", ""])
        return cut.join(s[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rnd.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {a} {b} {c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}"])

    def secret() -> str:
        mixed = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
        return rnd.choice([lambda: "AKIA" + mixed("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + rnd.choice(["", "234567"]), 16), lambda: mixed("abcdefghijklmnopqrstuvwxyz" + rnd.choice(["", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]), rnd.randrange(12, 28)), lambda: mixed("0123456789abcdef", rnd.choice([16, 18, 32, 40])), lambda: mixed("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 24)])()

    makers = (
        lambda: f"{word()}.{digits(2)}@mail{digits(1)}.example.com".translate({233: "e", 252: "u"}),
        lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)),
        card,
        phone,
        secret,
    )
    others = (
        lambda: digits(rnd.randrange(1, 7)), lambda: f"{rnd.randrange(20)}.{rnd.randrange(20)}", lambda: f"{rnd.randrange(9)}.{rnd.randrange(30)}.{rnd.randrange(30)}", lambda: f"20{digits(2)}-0{rnd.randrange(1, 9)}-1{digits(1)}",
        lambda: f"{rnd.randrange(1, 28)}/{rnd.randrange(1, 12)}/20{digits(2)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{digits(3)},{digits(3)}", lambda: digits(16) if rnd.random() < 0.3 else digits(9), lambda: word() + digits(2), lambda: f"@{word()}", lambda: f"{rnd.randrange(300, 900)}.{digits(3)}.{digits(2)}.{digits(1)}",
        lambda: f"({digits(1)})", lambda: f"{digits(4)}-{digits(4)}", lambda: f"{digits(2)} {digits(2)} {digits(2)}", lambda: f"{digits(1)}.0.", lambda: f"{digits(3)}%", lambda: rnd.choice(["key: ", "token: ", "Secret: ", "the key = "]) + word(), lambda: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rnd.randrange(2, 15))),
    )
    text, gold = "", set()
    for _ in range(rnd.randrange(4, 9)):
        text += (" " if text else "") + word()
        if (x := rnd.random()) < 0.4:
            kind = rnd.randrange(len(KINDS))
            lead = rnd.choice(["password=", 'token = "', "key: ", "secret=", ""]) if kind == 4 else ""
            s = makers[kind]()
            if kind == 4 and not lead and not s.startswith("AKIA"):
                lead = "password="
            start = len(text) + 1 + len(lead)
            text += " " + lead + s + ('"' if '"' in lead else "") + rnd.choice(["", "", ".", ","])
            gold.add((kind, start, start + len(s)))
        elif x < 0.75:
            s = rnd.choice(others)()
            text += " " + (s if not (len(s) == 16 and luhn(s)) else "12")
    return text, gold


@cache
def trained(seed: int = 11) -> np.ndarray:
    """Weights of each kind's features; the same at every run."""
    rnd = random.Random(seed)
    data = []
    for _ in range(SENTENCES):
        text, gold = sentence(rnd)
        data.append((Zone(text, 0, len(text)), gold))
    weights = np.zeros((len(KINDS), len(FEATURES)))
    weights[:, 0] = -3
    square = np.ones_like(weights)
    for _ in range(PASSES):
        rnd.shuffle(data)
        for zone, gold in data:
            g = zone.slope(weights, gold) - 0.002 * weights
            square += g * g
            weights += RATE * g / np.sqrt(square)
    return weights


def _left(text: str, at: int, words: int) -> int:
    """Where the word before `at` starts, or the one `words` further to the left."""
    while at > 0 and text[at - 1] not in _SPACE:
        at -= 1
    for _ in range(words):
        first = at
        while at > 0 and text[at - 1] in _SPACE:
            at -= 1
        if not at:
            return first
        while at > 0 and text[at - 1] not in _SPACE:
            at -= 1
    return at


def _right(text: str, at: int, words: int) -> int:
    """Where the word at `at` ends, or the one `words` further to the right."""
    m = _WORD.match(text, at)
    at = m.end() if m else at
    for _ in range(words):
        if not (m := _WORD.search(text, at)):
            break
        at = m.end()
    return at


def zones(text: str):
    """Stretches around words with a seed, CONTEXT words to either side, apart from each other by more than white space."""
    start = end = at = 0
    for seed in merge(*((m.start() for m in kind.finditer(text)) for kind in _SEEDS)):
        if seed < at or text[seed] in "=:" and not _NAMES.search(text, max(0, seed - 12), seed + 1):
            continue
        at = _right(text, seed, 0)
        a, b = _left(text, seed, CONTEXT), _right(text, seed, CONTEXT)
        if end and (a <= end or text[end:a].isspace()):
            end = b
        else:
            if end:
                yield start, end
            start, end = a, b
    if end:
        yield start, end


def spans(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans; both by kind and start."""
    own = base(text)
    taken = sorted((a, b) for _, a, b in own)
    lefts, reach = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]) if taken else []
    added = []
    for start, end in zones(text):
        for kind, a, b in Zone(text, start, end).best(weights):
            k = int(np.searchsorted(lefts, b)) - 1  # base spans that start before this one's end
            if k < 0 or reach[k] <= a:
                added.append((kind, a, b))
    return own, sorted(own + added)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def _find(weights: np.ndarray):
    def run(batches):
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                own, every = spans(text or "", weights)
                counts = [sum(k == kind for k, _, _ in own) for kind in range(4)]
                out.append((*counts, hashlib.sha256(joined(own).encode()).hexdigest(), joined(every)))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4]), pa.array(columns[5], pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of the base spans, their digest, and all spans for each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_find(trained()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
