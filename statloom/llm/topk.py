"""Exact top-k by inner product: columnar branch and bound.

Candidates are dealt into blocks held column by column (a row for each dimension). A block of queries meets a block of
candidates one dimension block at a time. After each, a query's candidates are bounded: the score so far plus the product
of the norms of what remains of query and candidate (Cauchy-Schwarz). Candidates whose bound is under the k-th best score
already certain (score so far minus that product) can't be among the best and are dropped; those left are compacted
before the next dimensions are read. Scores are integers, so sums are exact.

Each block of queries first meets one block of candidates, which gives each query a score that its k-th best has at least;
with that floor it goes to all blocks. Blocks are joined on the candidate block's number by sorting, where one row, the
candidate block, is held at a time: each block of queries is copied to each candidate block, which is the whole of queries
against all rows, in blocks; no row of a pair is ever written, only k for each query and block. Scores are 64-bit integers:
products of vectors must stay under 2^63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Rows of a block of candidates and of queries; dimensions taken at once.
BLOCK, QUERY_BLOCK, DIMENSIONS = 8192, 256, 16
NO_FLOOR = -(1 << 63)


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Rows (id long, v array<long>) of floor(scale * x), x as double.

    Rows without an id or vector, and vectors with a null, NaN or infinite component, take no part.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    whole = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return whole.where(good).select("id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"))


def block_top(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int, step: int = DIMENSIONS, floors: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's k best among a block, ties to smaller ids, itself left out.

    queries: a row each. columns: a row for each dimension; ids ascending. floors: lower bounds of each query's k-th best
    score among all blocks; candidates that are surely under it may be left out.
    """
    d = len(columns)
    starts = list(range(0, d, step))
    f = columns.astype(np.float64)
    tail = np.zeros((len(starts) + 1, len(ids)))
    for i in range(len(starts) - 1, -1, -1):
        part = f[starts[i] : starts[i] + step]
        tail[i] = tail[i + 1] + np.einsum("ij,ij->j", part, part)
    tail = np.sqrt(tail)
    largest = max(np.abs(columns).max(initial=0), np.abs(queries).max(initial=0))
    exact = np.float64 if d * float(largest) ** 2 < 2**53 else np.int64  # floats hold such sums exactly, and multiply faster
    columns = f if exact is np.float64 else columns
    out = []
    for q, qid, floor in zip(queries, query_ids.tolist(), [NO_FLOOR] * len(queries) if floors is None else floors.tolist(), strict=True):
        alive = np.flatnonzero(ids != qid)
        score = np.zeros(len(alive), exact)
        qf, q = q.astype(np.float64), q.astype(exact)
        for i, s in enumerate(starts):
            part = columns[s : s + step] if len(alive) == columns.shape[1] else columns[s : s + step, alive]
            score = score + q[s : s + step] @ part
            if i + 1 < len(starts) and (len(alive) > k or floor > NO_FLOOR):
                rest = np.sqrt(qf[s + step :] @ qf[s + step :]) * tail[i + 1, alive] * (1 + 1e-9) + 1e-6
                certain = max(np.partition(score - rest, len(alive) - k)[len(alive) - k] if len(alive) > k else floor, floor)
                stay = score + rest >= certain
                alive, score = alive[stay], score[stay]
        if not len(alive):
            continue
        if len(alive) > k:
            stay = score >= np.partition(score, len(alive) - k)[len(alive) - k]
            alive, score = alive[stay], score[stay]
        best = np.lexsort((ids[alive], -score))[:k]
        out += [(qid, int(ids[alive[b]]), int(score[b])) for b in best.tolist()]
    return out


def _packed(rows: DataFrame, block: str) -> DataFrame:
    """A row for each (block, number of dimensions): ids and vectors, packed as long integers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[int, list[int]]]] = {}

        def packed() -> pa.RecordBatch:
            got = []
            for (b, n), x in held.items():
                x.sort()
                got.append((b, n, np.array([r[0] for r in x], "<i8").tobytes(), np.array([r[1] for r in x], "<i8").tobytes()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "n", "ids", "vectors"])

        for batch in batches:
            for b, i, v in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if held and (b, len(v)) not in held:
                    yield packed()
                held.setdefault((b, len(v)), []).append((i, v))
        if held:
            yield packed()

    n = F.size("v")
    dealt = rows.select(F.col(block).alias("block"), "id", "v").repartition(F.col("block")).sortWithinPartitions("block", n, "id")
    return dealt.mapInArrow(pack, "block long, n int, ids binary, vectors binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Rows (query_id, rank int, vec_id, score) from rows (id, v) of either table (see integer_vectors).

    Each query's k highest inner products over all rows but its own (all, if fewer), ties to smaller ids. Vectors are
    compared with those of their own length only; those without components score 0 with each other. Empty tables, or a lone
    vector, give no rows. Ids are unique; a repeated id counts as one vector each time.
    """
    n, m = vectors.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-m // QUERY_BLOCK))
    of = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("long")
    base = saved(_packed(vectors.withColumn("b", of(blocks)), "b"))
    asked = _packed(queries.withColumn("b", of(query_blocks)), "b").select(F.pmod("block", F.lit(blocks)).alias("block"), "n", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))

    def blocks_of(dims: int, ids_: bytes, vectors_: bytes) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(ids_, "<i8")
        return ids, np.frombuffer(vectors_, "<i8").reshape(len(ids), dims)

    def find_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for dims, q_ids, q_vectors, ids_, vectors_ in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                asking, rows = blocks_of(dims, q_ids, q_vectors)
                floors = dict.fromkeys(asking.tolist(), NO_FLOOR)
                if ids_ is not None:
                    ids, x = blocks_of(dims, ids_, vectors_)
                    scores: dict[int, list[int]] = {}
                    for qid, _, score in block_top(rows, asking, np.ascontiguousarray(x.T), ids, k):
                        scores.setdefault(qid, []).append(score)
                    floors |= {q: min(s) for q, s in scores.items() if len(s) >= k}
                out.append(np.array([floors[q] for q in asking.tolist()], "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["n", "q_ids", "q_vectors", "floors"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, ids_, vectors_, q_ids, q_vectors, floors in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                (ids, x), (asking, rows) = blocks_of(dims, ids_, vectors_), blocks_of(dims, q_ids, q_vectors)
                got = block_top(rows, asking, np.ascontiguousarray(x.T), ids, k, floors=np.frombuffer(floors, "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in got], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    first = asked.hint("merge").join(base, ["block", "n"], "left").select("n", "q_ids", "q_vectors", "ids", "vectors")
    asked = first.mapInArrow(find_floors, "n int, q_ids binary, q_vectors binary, floors binary")
    asked = saved(asked).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pairs = asked.hint("merge").join(base, ["block", "n"]).select("n", "ids", "vectors", "q_ids", "q_vectors", "floors")
    best = pairs.mapInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
