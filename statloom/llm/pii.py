"""Personal data: fixed patterns, and a linear-chain conditional random field for forms that they miss.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers as usually written. The field labels the
words of a line by shape features of the word and its neighbours, and finds veiled or unusual forms: "jo at mail dot org",
"jo [at] mail.org", "10[.]0[.]0[.]7", "4111.1111.1111.1111", "(202) 555-0143". It is trained by gradient ascent on a
small labelled table, hand-written lines (pii_lines.py) and sentences that training_table() writes from a few dozen
templates, and decoded by Viterbi over batches of lines in numpy.

What the field finds is kept if its characters make a valid value of the kind (see _valid) and it meets no pattern's span.
A valid value has four digits, or a sign or veiled "at" with a name and a plain or veiled point after it, so only lines with
these (or the word "dot") are decoded; other lines can hold none.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .pieces import bounded
from .pii_lines import labelled
from .tables import worker_table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("o", *KINDS)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins with its run of digits, as any later digit of the run would match or fail alike.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


class Span(NamedTuple):
    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (2 * d - 9 if d > 4 else 2 * d) if i % 2 else d
    return total % 10 == 0


def _ip_ok(x: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in x.split("."))


def _card_ok(x: str) -> bool:
    d = NOT_DIGIT.sub("", x)
    return 14 <= len(d) <= 19 and luhn(d)


def _phone_ok(x: str) -> bool:
    return 10 <= len(NOT_DIGIT.sub("", x)) <= 15


def pattern_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that don't overlap; those that fail their test are dropped. In order of start, kind."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            out.append(Span(begin, 0, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)  # a match may not hold this sign
        at = text.find("@", done)
    if DIGIT.search(text):
        out += [Span(m.start(), 1, m.end()) for m in IP.finditer(text) if _ip_ok(m[0])]
        out += [Span(m.start(), 2, m.end()) for m in CARD.finditer(text) if _card_ok(m[0])]
        if "+" in text:
            out += [Span(m.start(), 3, m.end()) for m in PHONE.finditer(text) if _phone_ok(m[0])]
    return sorted(out)


# --- the field ---------------------------------------------------------------------------------------------------------

#: Words that matter as such.
AT, DOT = ("at", "[at]", "(at)", "{at}", "<at>"), ("dot", "[dot]", "(dot)", "{dot}", "<dot>")
CUES = (*AT, *DOT, "email", "e-mail", "mail", "reach", "write", "contact", "ip", "host", "server", "address", "card", "visa", "credit", "number", "phone", "tel", "call", "fax", "mobile", "order", "on", "page", "room", "version")


def features(word: str) -> tuple[str, ...]:
    """Shape features of a word."""
    bare = word.rstrip(".,;:!?").lower()
    digits = len(NOT_DIGIT.sub("", word))
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "d", re.sub(r"[^\W\d_]", "x", bare)))
    bucket = next(i for i, most in enumerate((0, 1, 3, 4, 7, 9, 13, 19, 1 << 30)) if digits <= most)
    out = [f"digits{bucket}", f"shape {shape}" if len(shape) <= 8 else "shape long"]
    if bare in CUES:
        out.append("at" if bare in AT else "dot" if bare in DOT else f"cue {bare}")
    if "@" in word:
        out.append("sign")
    if re.search(r"\[\.\]|\(\.\)", word):
        out.append("veiled point")
    return tuple(out)


def training_table(rows: int = 400, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The labelled table: sentences as words and their labels, with values written into templates."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[rng.integers(len(x))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    name = lambda: "".join(pick("abcdefghiklmnoprstuvw") for _ in range(rng.integers(2, 9)))
    part = lambda: str(rng.integers(0, 256))

    def email() -> str:
        i = rng.integers(len(AT)) * rng.integers(2)  # the plain words most often
        end, veil = pick(["com", "org", "net", "edu"]), AT[rng.integers(1, len(AT))]
        return pick([f"{name()} {AT[i]} {name()} {DOT[i]} {end}", f"{name()} {AT[i]} {name()} {DOT[i]} {name()} {DOT[i]} org", f"{name()} {veil} {name()}.{end}", f"{name()}{veil}{name()}.{end}", f"{name()} {AT[i]} {name()}[.]{end}"])

    values = {
        "email": email,
        "ip": lambda: pick(["[.]", "(.)", " . ", " dot "]).join(part() for _ in range(4)),
        "card": lambda: pick([".", " . ", "/", "_"]).join(digits(4) for _ in range(4)),
        "phone": lambda: pick([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}"]),
    }
    before = {"email": ["email me:", "write to", "reach", "contact", "", "the"], "ip": ["host", "from ip", "server address", "", "the"], "card": ["card number", "visa", "credit card", ""], "phone": ["call", "phone", "tel", "fax", "mobile", "", "the"]}
    plain = lambda: pick([name(), name(), name(), "the", "of", "at", "on", "dot", "", digits(pick([1, 2, 4, 6])), f"{digits(2)}.{digits(1)}", "room " + digits(3), "version " + pick(["1.2", "10.4.1"]), f"20{digits(2)}-0{pick('123456789')}-1{digits(1)}", "page " + digits(2), "order " + digits(12), digits(16), "met at " + name(), "more at " + name() + ".com", name() + ".org", "the dot " + name()])
    out = []
    for _ in range(rows):
        words: list[str] = []
        labels: list[str] = []

        def add(text: str, label: str, words=words, labels=labels) -> None:
            got = text.split()
            words += got
            labels += [label] * len(got)

        for _ in range(rng.integers(1, 8)):
            add(plain(), "o")
        if rng.random() < 0.75:
            kind = pick(KINDS)
            add(pick(before[kind]), "o")
            add(values[kind](), kind)
        for _ in range(rng.integers(0, 8)):
            add(plain(), "o")
        if words:
            out.append((words, labels))
    return out


#: Places of the words whose features a word's label looks at, and how often the hand-written lines count in training.
PLACES, HAND = (0, -1, 1, -2, 2), 3


class Field:
    """Weights of a linear-chain field: features of a word and of its neighbours by label, and label pairs."""

    def __init__(self, names: list[str]):
        self.index = {n: i for i, n in enumerate(names)}
        k = len(LABELS)
        self.unary = np.zeros((len(PLACES), len(names) + 1, k))  # by place of the word that has the feature; last: unknown
        self.pair = np.zeros((k, k))

    def ids(self, words: list[str]) -> list[list[int]]:
        return [[self.index[f] for f in features(w) if f in self.index] for w in words]

    def scores(self, ids: list[list[int]]) -> np.ndarray:
        n = len(ids)
        out = np.zeros((n, len(LABELS)))
        for t in range(n):
            for side, at in enumerate(t + p for p in PLACES):
                if 0 <= at < n:
                    out[t] += self.unary[side, ids[at]].sum(0)
        return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Best labels (line, word) of a batch of padded scores (line, word, label)."""
    lines, words, k = scores.shape
    best = scores[:, 0].copy()
    back = np.zeros((lines, words, k), np.int8)
    for t in range(1, words):
        step = best[:, :, None] + pair[None]
        back[:, t] = step.argmax(1)
        now = step.max(1) + scores[:, t]
        live = lengths > t
        best[live] = now[live]
        back[~live, t] = np.arange(k)
    out = np.zeros((lines, words), np.int8)
    label = best.argmax(1)
    for t in range(words - 1, -1, -1):
        out[:, t] = label
        label = back[np.arange(lines), t, label]
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - m).sum(axis, keepdims=True)) + m).squeeze(axis)


@lru_cache(4)
def train(steps: int = 120, rate: float = 0.15, shrink: float = 0.02, without: int | None = None) -> Field:
    """The field that (nearly) maximizes the tables' likelihood with a quadratic penalty, by Adam's gradient steps.

    It learns from the hand-written lines, which count HAND times, and from sentences made of templates. without: lines
    whose number modulo 4 is this are left out, for tests.
    """
    table = training_table() + [x for i, x in enumerate(labelled()) if without is None or i % 4 != without] * HAND
    field = Field(sorted({f for words, _ in table for w in words for f in features(w)}))
    k, n, longest = len(LABELS), len(table), max(len(w) for w, _ in table)
    lengths = np.array([len(w) for w, _ in table])
    own = np.zeros((n, longest, len(field.index) + 1))
    gold = np.zeros((n, longest), int)
    for i, (words, labels) in enumerate(table):
        gold[i, : len(words)] = [LABELS.index(x) for x in labels]
        for t, ids in enumerate(field.ids(words)):
            own[i, t, ids] = 1
    padded = np.pad(own, ((0, 0), (2, 2), (0, 0)))
    sides = [padded[:, 2 + p : 2 + p + longest] for p in PLACES]
    live = np.arange(longest)[None] < lengths[:, None]
    flat = [x[live] for x in sides]
    right = np.eye(k)[gold] * live[:, :, None]
    right_pairs = np.einsum("ita,itb->ab", right[:, :-1], right[:, 1:])
    state = [np.zeros_like(field.unary), np.zeros_like(field.pair)]
    square = [np.zeros_like(x) for x in state]
    for step in range(1, steps + 1):
        scores = np.zeros((n, longest, k))
        scores[live] = sum(x @ w for x, w in zip(flat, field.unary, strict=True))
        fore, aft = np.zeros_like(scores), np.zeros_like(scores)
        fore[:, 0] = scores[:, 0]
        for t in range(1, longest):
            fore[:, t] = np.where(live[:, t, None], _logsum(fore[:, t - 1, :, None] + field.pair[None], 1) + scores[:, t], fore[:, t - 1])
        for t in range(longest - 2, -1, -1):
            aft[:, t] = np.where(live[:, t + 1, None], _logsum(field.pair[None] + (scores[:, t + 1] + aft[:, t + 1])[:, None, :], 2), 0)
        total = _logsum(fore[:, -1], 1)
        p = np.exp(fore + aft - total[:, None, None]) * live[:, :, None]
        pairs = np.exp(fore[:, :-1, :, None] + field.pair[None, None] + (scores[:, 1:] + aft[:, 1:])[:, :, None, :] - total[:, None, None, None])
        pairs = (pairs * live[:, 1:, None, None]).sum((0, 1))
        off = (right - p)[live]
        grads = [np.stack([x.T @ off for x in flat]) - shrink * field.unary, right_pairs - pairs - shrink * field.pair]
        for i, (w, g) in enumerate(zip((field.unary, field.pair), grads, strict=True)):
            state[i] = 0.9 * state[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            w += rate * (state[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return field


_VEILS = ((re.compile(r"\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+", re.I), "@"), (re.compile(r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\s+\.\s+", re.I), "."))
_PLAIN_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD_FORM = re.compile(r"[0-9](?:[\s./_-]{0,3}[0-9])+")
_PHONE_FORM = re.compile(r"\(?[0-9]{2,5}\)?(?:[ .-][0-9]{2,5})+")


def _valid(kind: int, value: str) -> bool:
    if kind == 2:
        return bool(_CARD_FORM.fullmatch(value)) and _card_ok(value)
    if kind == 3:
        return bool(_PHONE_FORM.fullmatch(value)) and _phone_ok(value)
    for veil, plain in _VEILS:
        value = veil.sub(plain, value)
    return bool(EMAIL.fullmatch(value)) if kind == 0 else bool(_PLAIN_IP.fullmatch(value)) and _ip_ok(value)


#: What a line with a valid value has: four digits, or an "at", a name, and a point before another name.
MAY_HOLD = re.compile(
    r"(?:[0-9][^0-9\n]*){4}|\bdot\b|(?:@|[\[({<]\s*at\s*[\])}>]\s*|\sat\s+)[A-Za-z0-9-]+(?:\.|\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+(?:dot|\.)\s+)[A-Za-z0-9-]", re.I
)
LINE = re.compile(r"[^\n]+")
TOKEN = re.compile(r"\S+")
#: Cells (line, word) of a batch that is decoded at once.
CELLS = 200_000

def field_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """The valid spans that the field finds in each text."""
    out: list[list[Span]] = [[] for _ in texts]
    lines = []
    known = bounded(worker_table("pii", "words"), 200_000)
    for i, text in enumerate(texts):
        if MAY_HOLD.search(text):
            for line in LINE.finditer(text):
                if MAY_HOLD.search(line[0]):
                    lines.append((i, [(m.start(), m.end()) for m in TOKEN.finditer(text, line.start(), line.end())]))
    lines.sort(key=lambda x: len(x[1]))
    at = 0
    while at < len(lines):
        stop = at + 1
        while stop < len(lines) and len(lines[stop][1]) * (stop + 1 - at) <= CELLS:
            stop += 1
        batch = lines[at:stop]
        at = stop
        words = len(batch[-1][1])
        if not words:
            continue
        combos: dict[tuple[int, ...], int] = {(): 0}
        cells = np.zeros((len(batch), words + 4), np.int64)  # 0: nothing there
        for row, (i, tokens) in enumerate(batch):
            for t, (a, b) in enumerate(tokens):
                w = texts[i][a:b]
                ids = known.get(w)
                if ids is None:
                    ids = tuple(field.ids([w])[0])
                    if len(w) <= 60:
                        known[w] = ids
                cells[row, t + 2] = combos.setdefault(ids, len(combos))
        each = np.stack([[u[list(ids)].sum(0) for ids in combos] for u in field.unary])
        scores = sum(e[cells[:, 2 + p : 2 + p + words]] for e, p in zip(each, PLACES, strict=True))
        got = viterbi(scores, np.array([len(t) for _, t in batch]), field.pair)
        for row, (i, tokens) in enumerate(batch):
            labels = got[row, : len(tokens)]
            edges = np.flatnonzero(np.diff(labels, prepend=0, append=0))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if labels[a]:
                    begin, end = tokens[a][0], tokens[b - 1][1]
                    value = texts[i][begin:end].rstrip(".,;:!?")
                    if _valid(int(labels[a]) - 1, value):
                        out[i].append(Span(begin, int(labels[a]) - 1, begin + len(value)))
    return out


def find(texts: list[str], field: Field) -> tuple[list[list[Span]], list[list[Span]]]:
    """For each text the patterns' spans, and these with what the field adds; in order of start, then kind."""
    base = [pattern_spans(t) for t in texts]
    both = []
    for b, more in zip(base, field_spans(texts, field), strict=True):
        both.append(sorted(b + [m for m in more if not any(m.start < x.end and x.start < m.end for x in b)]) if more else b)
    return base, both


def personal_data(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_email, n_ip, n_card, n_phone (all spans), n_base_email and so on (the patterns' alone), base_sha256 (of the
    patterns' spans) and spans (all, as kind:start:end). Columns of these names are replaced.

    Starts and ends count code points, the end is exclusive. Null and empty texts have no spans. Repeated rows give
    repeated results, an empty table an empty one.
    """
    field = train()
    names = [*(f"n_{k}" for k in KINDS), *(f"n_base_{k}" for k in KINDS), "base_sha256", "spans"]

    @F.arrow_udf(f"struct<{','.join(f'{n}:bigint' for n in names[:8])},base_sha256:string,spans:string>")
    def run(text: pa.Array) -> pa.Array:
        base, both = find([t or "" for t in text.to_pylist()], field)
        counts = np.zeros((8, len(base)), np.int64)
        for first, found in ((0, both), (4, base)):
            for i, spans in enumerate(found):
                for s in spans:
                    counts[first + s.kind, i] += 1
        hashes = [hashlib.sha256(",".join(map(str, b)).encode()).hexdigest() for b in base]
        arrays = [*map(pa.array, counts), pa.array(hashes, pa.string()), pa.array([",".join(map(str, b)) for b in both], pa.string())]
        return pa.StructArray.from_arrays(arrays, names=names)

    at = fresh(df, "found")
    return df.withColumn(at, run(F.col(text_col))).select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names], f"{at}.*")


def redacted(text: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets, such as <email>; null stays null."""
    field = train()

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        out: list[str | None] = []
        for text, spans in zip(texts, find([t or "" for t in texts], field)[1], strict=True):
            if not spans:
                out.append(text)
                continue
            parts, done = [], 0
            for s in spans:
                if s.start >= done:
                    parts += [text[done : s.start], f"<{KINDS[s.kind]}>"]
                done = max(done, s.end)
            out.append("".join([*parts, text[done:]]))
        return pa.array(out, pa.string())

    return run(text)
