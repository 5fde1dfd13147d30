"""Mixing sources to target weights by entropy balancing.

Targets. Each source has a weight; targets share a number of words by weight, and none exceeds twice its source's words:
the excess is shared again by weight among the others until none is above. That is min(cap, level * weight) with the one
level at which targets fill the total, found by Newton steps from below; the targets' sum is concave in the level, so the
steps come down to it in at most as many rounds as there are caps.

Rates. A document's rate is exp(lambda of its source). Over all rates with the target words, these lie closest to one copy
of each word in relative entropy, where a document counts by its words. The dual is convex; its gradient for a source is
sum(size * exp(lambda)) - target and its Hessian sum(size * exp(lambda)). Sizes enter by their sums alone, so documents
are summed by source once, and Newton's iterations run over that table, one aggregate each.

Copies. Each document gets the whole part of its rate. The words that the fractions stand for are taken from documents in
an order drawn by hash: each source's documents are chosen as long as their running sum stays within what is missing, and
again from those not chosen that still fit. In a few last rounds each source takes one more copy of the largest document that fits, so that
small sources come near their targets too. Running sums are made in two
steps, within about sqrt(n) groups of a source's n documents and over the groups, so that a source with a third of all
rows is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, saved

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
NEWTON, ROUNDS = 60, (2, 7)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Stretches of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target) of rows (source, size). Sources by code point, null last, take weights in turn."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())  # a row for each source
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = saved(sources.withColumn("weight", turn))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap, goal, level = F.col("source_size") * most, total * share, 0.0
    while total:
        open_ = (cap > F.col("weight") * level) & (cap > 0)
        capped, weight = sources.agg(F.sum(F.when(open_, 0.0).otherwise(cap)), F.sum(F.when(open_, F.col("weight")).otherwise(0.0))).first()
        if not weight or (after := (goal - capped) / weight) <= level * (1 + 1e-15):
            break
        level = after
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(level))
    return sources.withColumn("target", F.when(cap > 0, target).otherwise(0.0)).drop("weight")


def tilts(targets: DataFrame) -> DataFrame:
    """targets with `rate`: exp of each source's dual variable. Newton's iterations stop when no source is off its target."""
    now = targets.withColumn("tilt", F.lit(0.0))
    moved = F.col("source_size") * F.exp("tilt")
    wanted = F.col("target") > 0
    for _ in range(NEWTON):
        off = now.where(wanted).agg(F.max(F.abs(moved - F.col("target")) / F.col("target"))).first()[0]
        if off is None or off < 1e-12:
            break
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("target") - moved) / moved))
        now = saved(now.withColumn("tilt", F.when(wanted, F.col("tilt") + step).otherwise(F.lit(0.0))))
    return now.withColumn("rate", F.when(wanted, F.exp("tilt")).otherwise(F.lit(0.0)))


def _fill(docs: DataFrame, need: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """One round: (documents with `more` copies, what each source still needs) from rows (row, source, size, more)."""
    fits = docs.where("more = 0 AND size > 0").join(F.broadcast(need) if need.count() <= 100_000 else need, F.expr("source <=> of")).where("size <= missing")
    drawn = F.xxhash64("row", F.lit(seed))
    fits = fits.select("row", "of", "size", "missing", "groups", drawn.alias("h"), F.pmod(F.shiftright(drawn, 20), F.col("groups")).alias("g"))
    inside = F.sum("size").over(Window.partitionBy("of", "g").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, 0))
    fits = saved(fits.withColumn("inside", inside))
    sums = fits.groupBy("of", "g").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("of").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = saved(sums.withColumn("before", before).drop("words"))
    chosen = fits.join(sums.hint("merge"), (fits["g"] == sums["g"]) & fits["of"].eqNullSafe(sums["of"])).where("before + inside <= missing").select("row", fits["of"], "size")
    chosen = saved(chosen)
    used = chosen.groupBy(F.col("of").alias("u")).agg(F.sum("size").alias("words"))
    need = saved(need.join(used, F.expr("of <=> u"), "left").select("of", (F.col("missing") - F.coalesce("words", F.lit(0))).alias("missing"), "groups", "whole"))
    docs = docs.join(chosen.select(F.col("row").alias("r"), F.lit(1).alias("add")).hint("merge"), F.expr("row = r"), "left").select("row", "source", "size", (F.col("more") + F.coalesce("add", F.lit(0))).alias("more"))
    return saved(docs), need


def _largest(docs: DataFrame, need: DataFrame, most: float) -> tuple[DataFrame, DataFrame]:
    """As _fill(): each source takes one more copy of its largest document that fits and isn't taken `most` times."""
    fits = docs.where("size > 0").join(F.broadcast(need) if need.count() <= 100_000 else need, F.expr("source <=> of")).where((F.col("size") <= F.col("missing")) & (F.col("whole") + F.col("more") < most))
    best = fits.groupBy("of").agg(F.max(F.struct("size", "row")).alias("b")).select(F.col("of").alias("u"), F.col("b.size").alias("words"), F.col("b.row").alias("r"))
    best = saved(best)
    need = saved(need.join(best, F.expr("of <=> u"), "left").select("of", (F.col("missing") - F.coalesce("words", F.lit(0))).alias("missing"), "groups", "whole"))
    docs = docs.join(best.select("r", F.lit(1).alias("add")), F.expr("row = r"), "left").select("row", "source", "size", (F.col("more") + F.coalesce("add", F.lit(0))).alias("more"))
    return saved(docs), need


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(row, copies, source_size, target) of rows (row, source, size); `row` is unique and not null."""
    targets = saved(tilts(source_targets(docs, weights, share, most)))
    plan = targets.select(
        F.col("source").alias("of"), "source_size", "target", F.floor(F.col("rate") * (1 + 1e-12)).alias("whole"), F.ceil(F.sqrt("n")).alias("groups"))
    missing = F.greatest(F.lit(0.0), F.round(F.col("target") - F.col("whole") * F.col("source_size"), 3))
    need = plan.select("of", missing.alias("missing"), "groups", "whole")
    now = docs.select("row", "source", "size", F.lit(0).alias("more"))
    for i in range(ROUNDS[0]):
        now, need = _fill(now, need, i)
    for _ in range(ROUNDS[1]):
        now, need = _largest(now, need, most)
    out = now.join(plan.select("of", "source_size", "target", "whole"), F.expr("source <=> of"))
    return out.select("row", "size", "source_size", "target", (F.col("whole") + F.col("more")).alias("copies"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (id, size, source_size, target, copies), one for each row of df.

    Null texts have size 0 and, as all documents without words, whole copies only; a null source is a source of its own,
    last in order. Rows that are equal in id, source and text are drawn together, as one document of their common words;
    reruns give the same copies. An empty table gives an empty one; other columns of df are not read.
    """
    sized = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    # rows that are alike can't be told apart: one row stands for them, in which their words count together
    alike = saved(sized.groupBy("id", "source", "t", "size").agg(F.count("*").alias("times")))
    row = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")), "t")
    named = alike.select("id", row.alias("row"), "source", (F.col("size") * F.col("times")).alias("size"), F.col("size").alias("one"), "times")
    got = copies(named.select("row", "source", "size")).withColumnRenamed("size", "together").withColumnRenamed("row", "r")
    out = named.join(got.hint("merge"), F.expr("row = r"))
    repeat = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return out.select(F.col("id").alias(id_col), F.col("one").alias("size"), "source_size", "target", "copies", repeat.alias("__n")).drop("__n")


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """df with each row repeated as often as mix() takes it, none to two times. Keeps df's columns."""
    key = [F.col(id_col), F.col(source_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))]
    sized = df.select(key[0].alias("id"), key[1].alias("source"), key[2].alias("t"), word_count(F.col(text_col)).alias("size"))
    row = lambda i, s, t: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("s"), s), F.lit("-")), t)
    alike = saved(sized.groupBy("id", "source", "t").agg(F.sum("size").alias("size")))
    got = copies(alike.select(row(F.col("id"), F.col("source"), F.col("t")).alias("row"), "source", "size")).select("row", "copies")
    mine, theirs, times, one = (fresh(df, x) for x in ("key", "row", "copies", "one"))
    got = saved(got.where("copies > 0")).toDF(theirs, times)
    out = df.withColumn(mine, row(*key)).join(got.hint("merge"), F.col(mine) == F.col(theirs))
    out = out.withColumn(one, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times).cast("long"))))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
