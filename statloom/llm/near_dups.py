"""Near-duplicate documents by a signature-coordinate inverted join.

A document's set is its distinct five-word shingles. Documents with equal sets form a class, of which one is worked on.
Its signature has 40 coordinates, each made of three MinHash values, so that two documents whose sets have similarity s
agree in a coordinate with probability s^3: at 0.75 they agree in 17 of 40 on average. They are a candidate pair if they
agree in 6 or more, which a pair at 0.75 fails to do about five times in a hundred thousand, and one at 0.8 hardly ever.
A passage that many different documents share makes hardly any coordinate agree. The steps:

Prefix. Pairs that agree in 6 of 40 coordinates agree in one of the first 35. Only these are posted, under coordinate and
value.

Skip. A posting list whose documents are all in one component already needs no more work. First each document meets a few
documents of its lists, hubs drawn by a hash of the document alone, so that lists of the same documents mostly share theirs; what that links, components join. Then the lists that still hold
several components are merged. In short lists, all documents of different components meet. Where one component has half
of a long list, the documents outside it are held against all others there: full sets are compared in blocks, gathered
for each such component over its lists, so that a large group of near copies writes no row for each of its pairs. Other
lists hold many different documents that agree by chance. Up to 4096 documents are compared in blocks too; longer lists are
posted again under the next coordinate on which documents agree (of the first 36, 37, ...) and fall apart. Once 6 coordinates agree, every pair in a list is a candidate,
and all lists are merged. No pair is left out at any size.

Threshold. Agreements of a pair that has met are counted over whole signatures, and pairs at the threshold are confirmed
on their full sets. Sets are made for these documents only, in another pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .links import components
from .tables import claim
from .words import mix, word_hashes

WORDS, COORDINATES, AGREE = 5, 40, 6
#: MinHash values of a coordinate.
VALUES = 3
#: Documents of a list whose pairs are met one by one, and of one whose full sets are compared in blocks.
SHORT, LONG = 32, 4096
#: Hubs of each of its lists that a document meets first; documents of a block of full sets, and their shingles, about.
HUBS, BLOCK, BLOCK_SHINGLES = 3, 256, 1 << 20
#: Ids that are broadcast at most (8 bytes each); beyond that they are joined by shuffling.
BROADCAST_IDS = 200_000
#: Shingles hashed at once for a signature.
STRETCH = 1024

_rng = np.random.default_rng(20240501)
MASKS = _rng.integers(0, 1 << 63, COORDINATES * VALUES, np.uint64)[:, None]
FACTORS = (_rng.integers(0, 1 << 62, COORDINATES * VALUES, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles (lower-cased A-Z, words between ASCII white space).

    With fewer words than a shingle has, the whole sequence is one; without words the set is empty.
    """
    h, _, counts = word_hashes(texts)
    stops = np.cumsum(counts)
    n = max(0, len(h) - words + 1)
    s = np.full(n, words, np.uint64)
    for i in range(words):
        s = s * _ROLL + h[i : i + n]
    s = mix(s)
    out = []
    for size, stop in zip(counts.tolist(), stops.tolist(), strict=True):
        if size >= words:
            out.append(np.unique(s[stop - size : stop - words + 1]))
            continue
        one = np.full(min(size, 1), size, np.uint64)
        for x in h[stop - size : stop]:
            one = one * _ROLL + x
        out.append(mix(one))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """The coordinates of a set that is not empty: each mixes the smallest values of three hashes over the set."""
    least = np.full(COORDINATES * VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), STRETCH):
        np.minimum(least, ((s[None, i : i + STRETCH] ^ MASKS) * FACTORS).min(1), out=least)
    least = least.reshape(COORDINATES, VALUES)
    mixed = least[:, 0]
    for i in range(1, VALUES):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _ROLL + least[:, i]
    return mixed.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct values."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both) > 0


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """(id, n, d1, d2, sig) of rows (id, text); d1 and d2 are a digest of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_dups")
        for b in batches:
            sets = shingle_sets(b.column(1), words)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            sigs = pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), sigs], ["id", "n", "d1", "d2", "sig"])

    return rows.mapInArrow(run, "id long, n long, d1 long, d2 long, sig array<long>")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_dups")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in shingle_sets(b.column(1), words)], pa.binary())], ["id", "set"])

    return rows.mapInArrow(run, "id long, set binary")


def _block_links(percent: int):
    """A function for applyInPandas: links of x rows with y rows (doc, label, asks, set) of other labels, one for each label."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        xs, ys = rows[rows.asks], rows[~rows.asks]
        if not len(xs) or not len(ys):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets = [np.frombuffer(v, np.uint64) for v in ys["set"]]
        sizes = np.array([len(v) for v in sets])
        values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(values)
        values, owners = values[order], owners[order]
        docs, labels = ys.doc.to_numpy(), ys.label.to_numpy()
        out = []
        for doc, label, v in zip(xs.doc.tolist(), xs.label.tolist(), xs["set"], strict=True):
            x = np.frombuffer(v, np.uint64)
            lo, hi = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
            n = hi - lo
            hits = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
            both = np.bincount(owners[hits], minlength=len(sets))
            linked = np.flatnonzero((100 * both >= percent * (len(x) + sizes - both)) & (labels != label))
            _, first = np.unique(labels[linked], return_index=True)
            out += [(doc, y) for y in docs[linked[first]].tolist()]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


class _Linker:
    """Links between class representatives, found in rounds."""

    def __init__(self, rows: DataFrame, sigs: DataFrame, words: int, percent: int):
        self.rows, self.sigs, self.words, self.percent = rows, sigs, words, percent
        self.parts: DataFrame | None = None

    def labelled(self, post: DataFrame) -> DataFrame:
        """Postings (key, at, doc) with their documents' components."""
        if self.parts is None:
            return post.withColumn("label", F.col("doc"))
        parts = self.parts.select(F.col("id").alias("doc"), "component")
        return post.join(parts, "doc", "left").select("key", "at", "doc", F.coalesce("component", "doc").alias("label"))

    def meet_hubs(self, post: DataFrame, hubs: int) -> DataFrame:
        """Link documents of postings with hubs of their lists; the postings of lists that held several components."""
        bound = post.count()
        post = self.labelled(post)
        drawn = [F.min(F.struct(F.xxhash64("doc", F.lit(i)).alias("h"), "doc", "label")) for i in range(hubs)]
        lists = post.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.array(*drawn).alias("hubs"))
        lists = saved(lists.where("lo < hi").select("key", F.transform("hubs", lambda h: F.struct(h["doc"].alias("doc"), h["label"].alias("label"))).alias("hubs")), bound)
        post = saved(post.join(lists.hint("merge"), "key"), bound)
        met = post.select("doc", "label", F.explode(F.array_distinct("hubs")).alias("hub")).where("label <> hub.label")
        self.link(met.select("doc", F.col("hub.doc").alias("hub")).toDF("a", "b"))
        return post.select("key", "at", "doc")

    def merge_lists(self, post: DataFrame, whole: bool) -> DataFrame:
        """Link all documents across components in lists that aren't very long or have a main component (whole: in all lists).

        Returns the postings of the other lists.
        """
        bound = post.count()
        post = self.labelled(post)
        tally = post.groupBy("key", "label").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("z"))
        lists = tally.groupBy("key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), F.bit_xor("x").alias("x"), F.bit_xor("z").alias("z")).where("labels > 1")
        # of lists of the same documents one is worked on, but for those that are posted again under their own key
        once = F.col("key") == F.min("key").over(Window.partitionBy("size", "x", "z"))
        kind = F.when(F.col("size") <= SHORT, "short").when(F.col("main.n") * 2 >= F.col("size"), "main").when(F.lit(whole) | (F.col("size") <= LONG), "whole").otherwise("later")
        lists = lists.select("key", kind.alias("kind"), F.when(kind == "main", F.col("main.label")).otherwise(F.col("key")).alias("of"), F.col("main.label").alias("main"), once.alias("once"))
        lists = saved(lists.where("once OR kind = 'later'").drop("once"), bound)
        post = saved(post.join(lists.hint("merge"), "key"), bound)
        a = post.where("kind = 'short'").select("key", F.col("doc").alias("a"), F.col("label").alias("la"))
        b = a.toDF("key", "b", "lb")
        self.link(a.join(b.hint("merge"), "key").where("a < b AND la <> lb").select("a", "b"))
        asks = (F.col("kind") == "whole") | (F.col("label") != F.col("main"))
        held = post.where("kind IN ('main', 'whole')").groupBy("kind", "of", "doc").agg(F.min("label").alias("label"), F.max(asks).alias("asks"))
        self.link_blocks(saved(held, bound))
        return saved(post.where("kind = 'later'").select("key", "at", "doc"), bound)

    def sets_of(self, docs: DataFrame) -> DataFrame | None:
        """Full sets (id, set) of the documents in docs (id, perhaps repeated); None for none."""
        wanted = docs
        if (n := docs.count()) > BROADCAST_IDS:
            wanted = saved(docs.distinct())
            n = wanted.count()
        if not n:
            return None
        return saved(_sets(self.rows.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, "id", "left_semi"), self.words))

    def join_components(self, found: DataFrame) -> None:
        """Components of what was linked before and of new links (a, b); a component's star stands for its links."""
        if found.isEmpty():
            return
        stars = found if self.parts is None else found.union(self.parts.select(F.col("id").alias("a"), F.col("component").alias("b")))
        self.parts = components(stars)

    def link_blocks(self, held: DataFrame) -> None:
        """Link documents (kind, of, doc, label, asks): in each `of`, those that ask are held against all, in blocks."""
        sets = self.sets_of(held.select(F.col("doc").alias("id")))
        if sets is None:
            return
        long = held.join(self.sigs.select(F.col("id").alias("doc"), "n").hint("merge"), "doc")
        blocks = lambda rows, shingles: F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1))
        asked = F.sum(F.when(F.col("asks"), F.col("n")).otherwise(0))
        sizes = saved(long.groupBy("kind", "of").agg(blocks(F.count("*"), F.sum("n")).alias("ny"), blocks(F.count_if("asks"), asked).alias("nx")), held.count())
        sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes.hint("merge")
        rows = held.join(sets.withColumnRenamed("id", "doc").hint("merge"), "doc").join(sizes, ["kind", "of"])
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        of = lambda n: F.pmod(F.xxhash64("doc"), F.col(n))
        x = rows.where("asks").withColumn("xb", of("nx")).withColumn("yb", upto("ny"))
        y = rows.withColumn("asks", F.lit(False)).withColumn("yb", of("ny")).withColumn("xb", upto("nx"))
        names = ["kind", "of", "xb", "yb", "doc", "label", "asks", "set"]
        found = x.select(names).union(y.select(names)).groupBy("kind", "of", "xb", "yb").applyInPandas(_block_links(self.percent), "a long, b long")
        self.join_components(saved(found))

    def link(self, pairs: DataFrame) -> None:
        """Confirm pairs (a, b) and join components by those that are links."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        side = lambda x: self.sigs.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")).hint("merge")
        met = pairs.join(side("a"), "a").join(side("b"), "b")
        met = met.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent)
        agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
        met = saved(met.where(agree >= AGREE).select("a", "b"))
        sets = self.sets_of(met.select(F.col("a").alias("id")).union(met.select(F.col("b").alias("id"))))
        if sets is None:
            return
        side = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")).hint("merge")
        percent = self.percent

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

        found = saved(met.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(confirm, "a long, b long"), 8 * met.count())
        self.join_components(found)

    def run(self) -> None:
        first = COORDINATES - AGREE + 1
        post = self.sigs.select(F.col("id").alias("doc"), F.posexplode(F.slice("sig", 1, first)).alias("at", "v"))
        post = post.select(F.xxhash64("at", "v").alias("key"), "at", "doc")
        for shared in range(1, AGREE + 1):
            if shared == 1:
                post = self.meet_hubs(post, HUBS)
            post = self.merge_lists(post, shared == AGREE)
            if shared == AGREE or not post.count():
                return
            sigs = self.sigs.select(F.col("id").alias("doc"), "sig").hint("merge")
            last = first + shared  # one more coordinate is posted for each that agrees
            post = post.join(sigs, "doc").select("key", F.col("at").alias("was"), "doc", F.posexplode(F.slice("sig", 1, last)).alias("at", "v")).where("at > was")
            post = post.select(F.xxhash64("key", "at", "v").alias("key"), "at", "doc")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 75) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept), one for each row of df; ids are whole numbers.

    component_id is the smallest id reachable by links, the row's own included; kept marks the rows whose id that is.
    Null and empty texts, and texts without words, have no shingles and no links. Repeated rows are linked with each
    other. Rows with a null id take no part in links, have a null component_id and are kept. An empty table gives an
    empty one; other columns of df are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketches = saved(_sketches(rows, words))
    named = sketches.where("n > 0 AND id IS NOT NULL")
    bound = sketches.count()
    classes = saved(named.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("members")), bound)
    reps = classes.select(F.col("rep").alias("id"), "d1", "d2").hint("merge")
    # one signature for each class, whichever of its rows with the smallest id gives it
    sigs = saved(named.join(reps, ["id", "d1", "d2"], "left_semi").select("id", "n", "sig").dropDuplicates(), 8 * bound)
    linker = _Linker(rows.where("id IS NOT NULL"), sigs, words, percent)
    linker.run()
    parts = linker.parts if linker.parts is not None else classes.limit(0).select(F.col("rep").alias("id"), F.col("rep").alias("component"))
    several = classes.where("members > 1").select("d1", "d2", "rep").hint("merge")
    light = sketches.select("id", "n", "d1", "d2").join(several, ["d1", "d2"], "left").select("id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("rep", "id")).otherwise(F.col("id")).alias("rep"))
    out = light.join(parts.select(F.col("id").alias("rep"), "component").hint("merge"), "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
