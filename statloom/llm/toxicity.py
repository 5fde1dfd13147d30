"""Toxicity of texts after noisy-channel deobfuscation.

Restoring. Stretches of a text that may be written to escape a word list (letters mixed with digits or signs, a letter
three or more times in a row, three or more single letters set apart) become lattices: each sign may stand for itself or for the letters
that it resembles, a run of a letter for one or two of it, a gap for nothing. Viterbi's algorithm finds the path that is
likeliest under a character trigram model of the corpus times the channel's costs. All other words have one path, itself.

Scoring. A logistic regression over which of a bounded set of words and word stems a restored text holds. The words are those that tell
toxic from other labelled texts best (by the likelihood ratio of their document counts). It is fitted on at most `sample`
labelled rows, the first in an order drawn by hash. The character model counts all texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .tables import worker_table

#: Letters that a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
    "*": "abcdefghijklmnopqrstuvwxyz", "#": "abcdefghijklmnopqrstuvwxyz",
}
#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіѕјԁօανοιτ", "aeopcyxisjdoavoit")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
K = len(LETTERS) + 1  # 0: no letter
#: Costs (natural log) of a sign read as a letter, of a sign read as itself, of a wild sign, of a run read as two letters,
#: and of a gap between set-apart letters read as one between words.
SIGN_COST, STAY_COST, WILD_COST, TWICE_COST, GAP_COST = 0.7, 3.0, 3.0, 0.7, 1.5

SPACED = r"(?<![^\W_])(?:[^\W_]|[@$!])(?:[ .\-_*]{1,3}(?:[^\W_]|[@$!])){2,}(?![^\W_])"
#: MIXED and REPEATED begin only where a run of letters does: at a later letter they match no text that they missed before.
MIXED = r"(?:[0-9@$!|+(€£]{1,3}+|(?<![^\W\d_]))[^\W\d_]++(?:[0-9@$!|+€£(*#]{1,2}[^\W\d_]*)+"
REPEATED = r"(?:(?<![^\W_])|(?<![0-9])(?=\d))(?=[^\W_]*?([^\W\d_])\1\1)[^\W_]++"
LED = r"[0-9@$!|€£]{1,2}[^\W\d_]{2,}"
NOISY = re.compile(f"{SPACED}|{MIXED}|{LED}|{REPEATED}")
#: What any noisy stretch holds besides a letter three times: a letter before a sign (MIXED), a sign before two letters (LED),
#: or two set-apart characters, each after separators (SPACED). Both begin with few characters, so they are quick to look for.
BY_SIGN = re.compile(r"[0-9@$!|+€£(*#](?:(?<=[^\W\d_].)|(?<![+(*#])[^\W\d_]{2})")
BY_GAP = re.compile(r"[ .\-_*](?:[^\W_]|[@$!])[ .\-_*]{1,3}(?:[^\W_]|[@$!])(?![^\W_])")
LETTER = re.compile(r"[^\W\d_]")
WORDS = re.compile(r"[^\W\d_]{2,}")
STEM = 5
#: Longest noisy stretch that is kept in a worker's table of restored stretches, and that table's size.
KEPT_LENGTH, KEPT = 80, 100_000


def _table() -> np.ndarray:
    out = np.zeros(0x250, np.uint8)
    for i in range(0x250):
        base = unicodedata.normalize("NFKD", chr(i).lower())[:1]
        if base in LETTERS and base:
            out[i] = 1 + LETTERS.index(base)
    return out


_CODES = _table()
_CODE = _CODES.tolist()


def codes(text: str) -> np.ndarray:
    """0 for other characters, 1 to 26 for letters, without case and accents."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return _CODES[np.minimum(points, len(_CODES) - 1)]


def may_be_noisy(text: str) -> bool:
    """Whether a text may have a noisy stretch; true for every text in which NOISY finds one."""
    if BY_SIGN.search(text) or BY_GAP.search(text):
        return True
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    same = points[1:] == points[:-1]
    return LETTER.search("".join(map(chr, set(points[2:][same[1:] & same[:-1]].tolist())))) is not None


def character_model(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(third | first two) of 27 characters, smoothed, from counts of all trigrams of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(K**3, np.int64)
        for b in batches:
            c = codes(" ".join(t for t in b.column(0).to_pylist() if t)).astype(np.int32)
            if len(c) > 2:
                total += np.bincount(c[:-2] * (K * K) + c[1:-1] * K + c[2:], minlength=K**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["gram", "n"])

    grams = texts.select(text_col).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    table = np.zeros(K**3)
    for gram, n in grams.collect():  # at most 27^3 rows
        table[gram] = n
    table = table.reshape(K, K, K)
    pairs, singles = table.sum(0), table.sum((0, 1)) + 1
    low = (pairs + 5 * singles / singles.sum()) / (pairs.sum(1, keepdims=True) + 5)
    return np.log((table + 5 * low[None]) / (table.sum(2, keepdims=True) + 5))


def lattice(stretch: str) -> list[list[tuple[tuple[int, ...], float]]]:
    """For each run of a noisy stretch, what it may stand for (letters as codes; none for a gap) and at which cost."""
    text = unicodedata.normalize("NFKC", stretch.lower()).translate(LOOKALIKES)
    spaced = re.fullmatch(SPACED, text) is not None
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] == text[i]:
            j += 1
        c, n, options = text[i], j - i, {}
        code = _CODE[min(ord(c), len(_CODE) - 1)]
        if code:
            options[code,] = 0.0
            if n > 1:
                options[code, code] = 0.0 if n == 2 else TWICE_COST
                options[code,] = TWICE_COST if n == 2 else 0.0
        elif spaced and c in " .-_*":
            options[()] = 0.0
            options[0,] = GAP_COST
        else:
            options[0,] = STAY_COST if c in SIGNS else 0.0
            for letter in SIGNS.get(c, ""):
                x = 1 + LETTERS.index(letter)
                options[x,] = WILD_COST if c in "*#" else SIGN_COST
                if n > 1:
                    options[x, x] = 2 * options[x,]
        out.append(list(options.items()))
        i = j
    return out


def restore_stretch(stretch: str, model: np.ndarray | list[list[list[float]]]) -> str:
    """The likeliest reading of a noisy stretch, as lower-case letters and spaces. The model's nested lists are read faster."""
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in [*lattice(stretch), [((0,), 0.0)]]:
        now: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, before) in paths.items():
            for letters, cost in options:
                x, y, s, trail = a, b, score - cost, before
                for z in letters:
                    s += model[x][y][z]
                    x, y, trail = y, z, (z, trail)
                if (x, y) not in now or s > now[x, y][0]:
                    now[x, y] = s, trail
        paths = now
    trail = max(paths.values(), key=lambda p: p[0])[1]
    out = []
    while trail is not None:
        out.append(" " if not trail[0] else LETTERS[trail[0] - 1])
        trail = trail[1]
    return "".join(reversed(out)).strip()


class Restorer:
    """Restores texts; keeps what it has restored, under the model's name."""

    def __init__(self, model: np.ndarray):
        self.name = xxhash.xxh3_64_hexdigest(np.ascontiguousarray(model).tobytes())
        self.model = [[list(map(float, r)) for r in p] for p in model]
        self.array = model

    def __getstate__(self):
        return self.array

    def __setstate__(self, model: np.ndarray):
        self.__init__(model)

    def stretch(self, m: re.Match) -> str:
        known = worker_table("toxicity", self.name)
        got = known.get(m[0])
        if got is None:
            got = restore_stretch(m[0], self.model)
            if len(m[0]) <= KEPT_LENGTH and len(known) < KEPT:
                known[m[0]] = got
        return f" {m[0]} {got} "

    def text(self, text: str) -> str:
        """The text in lower case, with the reading of each noisy stretch set beside it."""
        return (NOISY.sub(self.stretch, text) if may_be_noisy(text) else text).lower()

    def words(self, text: str) -> set[str]:
        """The restored text's words, and the stems (first letters, marked with a star) of those that are longer."""
        words = set(WORDS.findall(self.text(text)))
        return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


@dataclass
class Scorer:
    """Logistic regression over words of restored texts."""

    restorer: Restorer
    weights: dict[str, float]
    bias: float

    def score(self, texts: list[str]) -> list[float]:
        out = []
        known, w = self.weights.keys(), self.weights
        for t in texts:
            z = self.bias + sum(w[x] for x in self.restorer.words(t) & known)
            out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, shrink: float = 0.02, steps: int = 30) -> np.ndarray:
    """Weights and, last, the bias of a ridge-penalized logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), shrink)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, model_docs: DataFrame | None = None, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, words: int = 256, least: int = 8) -> Scorer:
    """A scorer from docs (id, text) and labels (id, 0 or 1; null: none).

    At most `sample` labelled rows are used. With no labelled rows, or of one label only, every text gets a score under 0.5
    or, if all are toxic, the share of toxic ones. model_docs: the texts that the character model counts (default: docs).
    """
    restorer = Restorer(character_model(docs if model_docs is None else model_docs, text_col))
    some = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    some = saved(some.orderBy(F.xxhash64("__id"), "__id").limit(sample))  # at most `sample` rows of 12 bytes
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__text IS NOT NULL").join(F.broadcast(some), "__id")
    rows = saved(rows.select("__y", "__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = (Counter(), Counter())
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[y > 0].update(restorer.words(t))
        yield pa.RecordBatch.from_arrays([pa.array([w for c in n for w in c], pa.string()), pa.array([0] * len(n[0]) + list(n[1].values()), pa.int64()), pa.array(list(n[0].values()) + [0] * len(n[1]), pa.int64())], ["word", "bad", "good"])

    total = {bool(y): n for y, n in rows.groupBy(F.col("__y") > 0).count().collect()}
    n1, n0 = total.get(True, 0), total.get(False, 0)
    prior = math.log((n1 + 0.5) / (n0 + 0.5)) if n1 else -3.0
    if not n1 or not n0:
        return Scorer(restorer, {}, prior)
    both = rows.mapInArrow(count, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    few = min(least, max(2, n1 // 10))
    a, b = F.col("bad") + 0.5, F.col("good") + 0.5
    # how far a word's odds stand over those of all texts, in standard errors
    z = (F.log(a / b) - F.lit(math.log((n1 + 1) / (n0 + 1)))) / F.sqrt(1 / a + 1 / b)
    lift = (F.col("bad") / F.lit(n1 + 1.0)) / ((F.col("good") + 0.5) / F.lit(n0 + 1.0))
    best = both.where((F.col("bad") >= few) & (lift >= 4)).orderBy(F.desc(z * F.sqrt("bad")), "word").limit(words)
    chosen = sorted(r.word for r in best.select("word").collect())
    if not chosen:
        return Scorer(restorer, {}, prior)
    index = {w: i for i, w in enumerate(chosen)}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(index[w] for w in restorer.words(t) & index.keys()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["y", "found"])

    got = rows.mapInArrow(look, "y int, found array<int>").groupBy("y", "found").count().collect()  # at most `sample` short rows
    x, y = np.zeros((sum(r["count"] for r in got), len(chosen))), []
    at = 0
    for r in sorted(got, key=lambda r: (r.y, r.found)):
        x[at : at + r["count"], r.found] = 1
        at += r["count"]
        y += [r.y > 0] * r["count"]
    w = fit_logistic(x, np.array(y, float))
    return Scorer(restorer, dict(zip(chosen, w[:-1].tolist(), strict=True)), float(w[-1]))


def score(text: Column, scorer: Scorer) -> Column:
    """A score from 0 to 1 for each text; null and empty texts get that of a text without known words."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(scorer.score([t or "" for t in p]), dtype="float64")

    return run(text)
