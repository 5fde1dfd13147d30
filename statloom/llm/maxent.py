"""Language-model scores: base counts, and a hashed maximum-entropy model with class-factored softmax.

Tokens are words (A-Z in lower case, between ASCII white space) and an end after each text. A word is its 64-bit hash, whose
low 5 bits are its class: a rule of its last two bytes, one of 31; the end has a class of its own.

Base. Words are counted over all training texts, partially in each task before they are shuffled. The most frequent `common`
words and their counts go to all tasks (at most that many rows); a text's other words are joined with the table of counts by
shuffling, where no word is frequent.

Model. P(token | context) = P(class | context) * P(member | class, context), and for a word that is no member of its own
* (c + 1) / (words of its class that aren't members + their distinct words + 1). The members of a class are its 31 most
frequent words; all its other words are one more. Both factors are softmaxes of summed weights of features of the context.
Class: the classes of the last two words, those of the last and the third last (skip), and, hashed, the word before, the one
before that (skip), and both. Member: the class with the class of the word before, and, hashed, the class with the word
before, with the one before that (skip), and with both. The tables have a row for every 64 distinct training words, from
2^12 to 2^16 rows.

Training. Texts are dealt into `STEPS` by a hash of the text. In each step all tasks compute, at common weights, the gradient
over all positions of the step's texts, in whole numbers, which are summed by slices of the tables over all tasks; then the
driver moves the weights along the sum, scaled by how often each feature was met. Sums of whole numbers don't depend on
their order, so weights and scores are a function of the table, whatever its partitions. Every position of every training
text is used once. A task's sums have a fixed size, and they are added up in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .tables import Table, claim
from .words import mix, word_hashes

CLASSES, END, MEMBERS = 32, 31, 32
#: Rows of the two hashed tables: bounds, and distinct training words for each.
ROWS, WORDS_A_ROW = (1 << 12, 1 << 16), 64
#: Parts of 16 of the texts that each step takes; positions that are worked on at once.
STEPS, BLOCK = (1, 2, 4, 9), 8192
#: Gradients are whole multiples of 1 / UNIT. Rate and damping (positions) of a step.
UNIT, RATE, DAMP = 1 << 12, 2.0, 4.0
#: Words whose counts go to all tasks, and distinct words that a task holds before it hands their counts on.
COMMON, HELD = 200_000, 1 << 20
#: Slices of a table that are summed by themselves, and tasks whose sums one task adds up.
SLICES, FAN = 16, 256
NONE = CLASSES  # the class before a text's first word
PAIRS = (CLASSES + 1) ** 2
#: Features of a position in each factor.
FEATURES = 5, 4

_KIND = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(END)).astype(np.uint64)


def packed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of all words in order: hash and class in one int64; words of each text."""
    h, tails, counts = word_hashes(texts)
    return ((h & ~np.uint64(31)) | _KIND[tails]).view(np.int64), counts


@dataclass
class Positions:
    """All tokens of some texts, ends included."""

    words: np.ndarray  # int64; the ends are END alone
    classes: np.ndarray
    sizes: np.ndarray  # tokens of each text
    class_rows: np.ndarray  # (feature, token)
    member_rows: np.ndarray


def positions(texts: pa.Array, rows: int) -> Positions:
    packed, counts = packed_words(texts)
    sizes = counts + 1
    total, stops = int(sizes.sum()), np.cumsum(sizes)
    words = np.full(total, END, np.int64)
    live = np.ones(total, bool)
    live[stops - 1] = False
    words[live] = packed
    classes = (words & 31).astype(np.int32)
    at = np.arange(total, dtype=np.int32) - np.repeat(stops - sizes, sizes).astype(np.int32)

    def back(x: np.ndarray, k: int, none: int) -> np.ndarray:
        out = np.full(total, none, x.dtype)
        out[k:] = x[:-k] if k < total else x[:0]
        out[at < k] = none
        return out

    c1, c2, c3 = (back(classes, k, NONE) for k in (1, 2, 3))
    w1, w2 = (back(words.view(np.uint64), k, 0) for k in (1, 2))
    w2 = mix(w2 + np.uint64(1))
    both = mix(w1 ^ (w2 << np.uint64(1)))

    def hashed(x: np.ndarray, first: int) -> np.ndarray:
        return first + ((x >> np.uint64(20)) % np.uint64(rows - first)).astype(np.int32)

    near, far = c1 * (CLASSES + 1) + c2, c1 * (CLASSES + 1) + c3
    first = 2 * PAIRS
    class_rows = np.stack([near, PAIRS + far, hashed(w1, first), hashed(w2, first), hashed(both, first)])
    of = mix(classes.astype(np.uint64) + np.uint64(1000))
    member_rows = np.stack([classes * (CLASSES + 1) + c1, *(hashed(mix(of ^ x), PAIRS) for x in (w1, w2, both))])
    return Positions(words, classes, sizes, class_rows, member_rows)


@dataclass
class Model:
    """Weights of both factors, and by word the member's slot, from 1 on."""

    class_weights: np.ndarray
    member_weights: np.ndarray
    members: Table

    @property
    def rows(self) -> int:
        return len(self.class_weights)

    def slot(self, words: np.ndarray) -> np.ndarray:
        """The member that each word is of its class; 0 for all others."""
        return self.members.get(words, 0)


def exponentials(weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of summed weights of each position's feature rows, by (position, outcome), and each position's total.

    Weights move by at most RATE in each step, so nothing overflows.
    """
    z = np.take(weights, rows[0], 0)
    part = np.empty_like(z)
    for r in rows[1:]:
        z += np.take(weights, r, 0, out=part, mode="clip")
    np.exp(z, out=z)
    return z, z.sum(1)


def add_gradient(weights: np.ndarray, rows: np.ndarray, outcome: np.ndarray, sums: np.ndarray, met: np.ndarray) -> None:
    """Add a block's gradient (probability less outcome, in units) by feature row to sums, and how often each was met to met."""
    n = len(outcome)
    p, total = exponentials(weights, rows)
    p *= (np.float32(UNIT) / total)[:, None]
    g = np.rint(p, out=p).astype(np.int32)
    g[np.arange(n), outcome] -= UNIT
    for r in rows:
        r = r.astype(np.uint16)  # which a stable sort orders by radix
        order = np.argsort(r, kind="stable")
        r = r[order]
        starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        count = np.diff(starts, append=n)
        met[r[starts]] += count
        once = count == 1
        at = starts[once]
        sums[r[at]] += g[order[at]]
        if len(at) < len(starts):
            count, at = count[~once], starts[~once]
            of = order[np.repeat(~once, np.diff(starts, append=n))]
            sums[r[at]] += np.add.reduceat(g[of], np.cumsum(count) - count, 0)


class Sums:
    """A task's gradients of both factors, and how often each feature was met."""

    def __init__(self, rows: int):
        self.whole = [np.zeros((rows, x), np.int64) for x in (CLASSES, MEMBERS)]
        self.part = [np.zeros((rows, x), np.int32) for x in (CLASSES, MEMBERS)]
        self.met = [np.zeros(rows, np.int64) for _ in range(2)]
        self.positions = 0

    def add(self, factor: int, weights: np.ndarray, rows: np.ndarray, outcome: np.ndarray) -> None:
        self.positions += len(outcome)
        if self.positions * UNIT >= 1 << 31:
            self.close()
            self.positions = len(outcome)
        add_gradient(weights, rows, outcome, self.part[factor], self.met[factor])

    def close(self) -> None:
        for w, p in zip(self.whole, self.part, strict=True):
            w += p
            p[:] = 0
        self.positions = 0


def gradients(texts: pa.Array, model: Model, sums: Sums) -> None:
    """Add both factors' gradients over all positions of the texts."""
    p = positions(texts, model.rows)
    slots = model.slot(p.words)
    inner = np.flatnonzero(p.classes != END)
    for i in range(0, len(p.words), BLOCK):
        sums.add(0, model.class_weights, p.class_rows[:, i : i + BLOCK], p.classes[i : i + BLOCK])
    for i in range(0, len(inner), BLOCK):
        at = inner[i : i + BLOCK]
        sums.add(1, model.member_weights, p.member_rows[:, at], slots[at])


def moved(weights: np.ndarray, sums: np.ndarray, met: np.ndarray, prior: np.ndarray, features: int) -> np.ndarray:
    """Weights after a step: the gradient over how much a feature's outcomes weigh (at least their share over all texts)."""
    g = sums / UNIT
    n = met[:, None].astype(np.float64)
    scale = features * np.maximum(n * np.maximum(prior, 1e-4), np.abs(g)) + DAMP
    return (weights - RATE * g / scale).astype(np.float32)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], ["word", "n"])

    for b in batches:
        new, k = np.unique(packed_words(b.column(0))[0], return_counts=True)
        both, at = np.unique(np.concatenate([words, new]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, k]), len(both)).astype(np.int64)
        words = both
        if len(words) > HELD:
            yield out()
            words, n = words[:0], n[:0]
    yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word long, c long) of the words of rows (text); exact but for words that share a hash."""
    return texts.mapInArrow(_partial_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows of SUMS that are of one group, factor and slice; a task gets few of these, each of a fixed size."""
    total: dict[tuple[int, int, int], list[np.ndarray]] = {}
    for b in batches:
        for group, factor, k, sums, met in zip(*(c.to_pylist() for c in b.columns), strict=True):
            g, n = _unpacked(sums), np.frombuffer(met, "<i8")
            if (got := total.get((group, factor, k))) is None:
                total[group, factor, k] = [g, n.copy()]
            else:
                got[0] += g
                got[1] += n
    if total:
        yield _packed_slices([(*key, *x) for key, x in total.items()])


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[1:], "<i4" if raw[:1] == b"4" else "<i8").astype(np.int64)


def _packed_slices(slices: list[tuple[int, int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows (group, factor, slice, sums, met); sums in 4 bytes where they fit."""
    group, factor, k, sums, met = zip(*slices, strict=True)
    raw = [b"4" + x.astype("<i4").tobytes() if np.abs(x).max(initial=0) < 1 << 31 else b"8" + x.astype("<i8").tobytes() for x in sums]
    columns = (group, factor, k, raw, [x.astype("<i8").tobytes() for x in met])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["group", "factor", "slice", "sums", "met"])


SUMS = "group int, factor int, slice int, sums binary, met binary"


def gradient(texts: DataFrame, model: Model) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Both factors' gradients over rows (text), and how often each feature was met, summed over all tasks."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("maxent")
        m = shared.value
        mine = Sums(m.rows)
        for b in batches:
            gradients(b.column(0), m, mine)
        mine.close()
        sums, met = mine.whole, mine.met
        if not met[0].any():
            return
        group, step = TaskContext.get().partitionId() // FAN, m.rows // SLICES
        for f in range(2):
            yield _packed_slices([(group, f, k, sums[f][k * step : (k + 1) * step].ravel(), met[f][k * step : (k + 1) * step]) for k in range(SLICES)])

    got, groups = texts.mapInArrow(run, SUMS), -(-max(1, texts.rdd.getNumPartitions()) // FAN)
    while True:
        got = got.repartition(SLICES * groups, "group", "slice").mapInArrow(_sum_slices, SUMS)
        if groups == 1:
            break
        groups = -(-groups // FAN)
        got = got.withColumn("group", F.floor(F.col("group") / FAN).cast("int"))
    sums, met = [np.zeros((SLICES, model.rows // SLICES, x), np.int64) for x in (CLASSES, MEMBERS)], [np.zeros((SLICES, model.rows // SLICES), np.int64) for _ in range(2)]
    for r in got.collect():  # two tables of bounded size
        sums[r.factor][r.slice] += _unpacked(r.sums).reshape(sums[r.factor][r.slice].shape)
        met[r.factor][r.slice] += np.frombuffer(r.met, "<i8")
    return [s.reshape(model.rows, -1) for s in sums], [m.ravel() for m in met]


def train(texts: DataFrame, counts: DataFrame, ends: int) -> tuple[Model, dict[int, tuple[int, int]], dict[int, int]]:
    """The model learnt from rows (text), with their word counts (word, c) and number; by class how many words and distinct
    words are no members; and the members' counts."""
    by_class = {int(r["class"]): (r.n, r.v) for r in counts.groupBy((F.col("word").bitwiseAND(31)).alias("class")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    top = Window.partitionBy(F.col("word").bitwiseAND(31)).orderBy(F.desc("c"), "word")
    best = sorted((r.word, r.slot, r.c) for r in counts.withColumn("slot", F.row_number().over(top)).where(F.col("slot") < MEMBERS).collect())
    rest = dict(by_class)
    shares = np.zeros((CLASSES, MEMBERS))
    for word, slot, c in best:
        k = word & 31
        shares[k, slot] = c
        rest[k] = rest[k][0] - c, rest[k][1] - 1
    for k, (n, _) in rest.items():
        shares[k, 0] = n
    shares[END, 0] = ends
    of_class = shares.sum(1) + 1
    of_class /= of_class.sum()
    shares = (shares + 0.01) / (shares + 0.01).sum(1, keepdims=True)
    distinct = sum(v for _, v in by_class.values())
    rows = int(np.clip(1 << max(0, distinct // WORDS_A_ROW).bit_length(), *ROWS))
    model = Model(np.zeros((rows, CLASSES), np.float32), np.zeros((rows, MEMBERS), np.float32), Table.of(np.array([w for w, _, _ in best], np.int64), np.array([s for _, s, _ in best], np.int32)))
    # where training starts: the outcomes' shares, in the rows of the one feature that each position has without hashing
    model.class_weights[:PAIRS] = np.log(of_class)
    model.member_weights[: CLASSES * (CLASSES + 1)] = np.log(shares).repeat(CLASSES + 1, 0)
    if ends:
        spark = texts.sparkSession
        priors, parts = (of_class, shares.mean(0)), max(1, texts.rdd.getNumPartitions())
        dealt = texts.withColumn("at", F.pmod(F.xxhash64("text"), F.lit(sum(STEPS))))
        done = 0
        for share in STEPS:
            some = dealt.where((F.col("at") >= done) & (F.col("at") < done + share)).select("text")
            done += share
            # as much text to a task as in other passes, so that its sums are as small beside it
            some = some.coalesce(min(parts, max(spark.sparkContext.defaultParallelism, -(-parts * share // sum(STEPS)))))
            sums, met = gradient(some, model)
            model = Model(moved(model.class_weights, sums[0], met[0], priors[0], FEATURES[0]), moved(model.member_weights, sums[1], met[1], priors[1], FEATURES[1]), model.members)
    return model, rest, {w: c for w, _, c in best}


def log10_model(p: Positions, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of P(class) * P(member | class) of each token, its member slot)."""
    slots = model.slot(p.words)
    out = np.zeros(len(p.words))
    inner = np.flatnonzero(p.classes != END)
    for weights, rows, outcome, of in ((model.class_weights, p.class_rows, p.classes, None), (model.member_weights, p.member_rows, slots, inner)):
        for i in range(0, len(out) if of is None else len(of), BLOCK):
            at = slice(i, i + BLOCK) if of is None else of[i : i + BLOCK]
            e, total = exponentials(weights, rows[:, at])
            out[at] += np.log10(e[np.arange(len(e)), outcome[at]] / total)
    return out, slots


def scores(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, n_known, train_tokens, base_score, score) for each row of df, learnt from rows where `training`.

    Null and empty texts hold the end alone. Repeated rows give repeated results and count each time in training; an empty
    table gives an empty one. With no training rows, N and V are 0 and every token is unknown. Ids may be null or repeat.
    Other columns of df are not read. Results don't depend on the table's partitions.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    texts = rows.where("train").select("text")
    counts = saved(word_counts(texts))
    ends = texts.count()
    model, rest, members = train(texts, counts, ends)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (ends > 0)
    leaf = np.log10([float(sum(rest.get(k, (0, 0))) + 1) for k in range(CLASSES)])
    leaf[END] = 0.0
    common = dict(counts.orderBy(F.desc("c"), "word").limit(COMMON).select("word", "c").collect())
    common |= members
    known = Table.of(np.fromiter(common, np.int64, len(common)), np.log10(np.fromiter(common.values(), np.float64, len(common)) + 1), np.float64)
    shared = spark.sparkContext.broadcast((model, leaf, known))  # at most COMMON words and two tables of bounded size
    log_ends = float(np.log10(ends + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("maxent")
        model, leaf, known = shared.value
        for b in batches:
            p = positions(b.column(1), model.rows)
            each, slots = log10_model(p, model)
            end = p.classes == END
            other = (slots == 0) & ~end
            found = known.get(p.words, -1)
            rare = (found < 0) & ~end
            met = ~rare & (~end | (ends > 0))
            found = np.where(end, log_ends, np.maximum(found, 0.0))
            each[other] += found[other] - leaf[p.classes[other]]
            stops = np.cumsum(p.sizes)
            sums = [np.add.reduceat(x, stops - p.sizes) if len(stops) else x for x in (met.astype(np.int64), found, each)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rare)[stops - 1]]) if len(stops) else np.zeros(1), pa.int32()), pa.array(p.words[rare]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sizes), *map(pa.array, sums), lists], ["id", "n_tokens", "known", "found", "model", "rare"])

    kind = rows.schema["id"].dataType.simpleString()
    plain = rows.select("id", "text").mapInArrow(run, f"id {kind}, n_tokens long, known long, found double, model double, rare array<long>")
    # a row's place in the table names it, as ids may repeat: the sketch is written before it is used twice
    plain = saved(plain.withColumn("row", F.monotonically_increasing_id()))
    asked = plain.select("row", F.explode("rare").alias("word"))
    met = asked.join(counts.hint("merge"), "word").groupBy("row").agg(F.count("*").alias("k"), F.sum(F.log10(F.col("c") + 1)).alias("f"))
    out = plain.drop("rare").join(met, "row", "left")
    more = F.coalesce("f", F.lit(0.0))
    base = F.col("found") + more - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return out.select(F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model") + more).alias("score"))
