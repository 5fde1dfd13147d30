"""Token counts: batch encoding in Arrow functions that returns lengths only.

Texts are cut at safe boundaries (see pieces). Each batch's unseen pieces are encoded by the tokenizer library in
groups of about equal bytes, and only their lengths are kept; a text's count is the sum over its pieces. A very long
text therefore costs no more memory than its list of pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import CACHE_LENGTH, bounded, cut, cut_special
from .tables import worker_table

#: Bytes of pieces given to the library at once.
GROUP_BYTES = 1_000_000


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, [x.content for x in t.get_added_tokens_decoder().values()]


def _by_bytes(pieces: list[str], most: int = GROUP_BYTES) -> Iterator[list[str]]:
    """Groups of pieces of similar length, each of about the same bytes."""
    group, size = [], 0
    for p in sorted(pieces, key=len):
        group.append(p)
        size += len(p) if p.isascii() else len(p.encode())
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def count_batch(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, with special strings as the library's default has them."""
    tokenizer, special = _tokenizer(path)
    known = bounded(worker_table("token_counts", path))
    if len(special) == 1:
        parts = [cut_special(t, special[0]) for t in texts]
    else:
        parts = [[t] if any(s in t for s in special) else cut(t) for t in texts]
    new = set().union(*parts) - known.keys()
    now: dict[str, int] = {}
    for group in _by_bytes(list(new)):
        for piece, e in zip(group, tokenizer.encode_batch_fast(group, add_special_tokens=False), strict=True):
            (known if len(piece) <= CACHE_LENGTH else now)[piece] = len(e)
    if now:
        now |= known
        return [sum(map(now.__getitem__, p)) for p in parts]
    return [sum(map(known.__getitem__, p)) for p in parts]


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one for each row of df.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated results, an empty table an empty one;
    other columns of df are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            n = count_batch(texts, path)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
