"""Token ids in Parquet files: list columns in ascending id order, made for selective reads.

Format. A folder holds `data` and `index`, both Parquet. `data` has a row for each document, in ascending order of its
id over the whole folder: doc_id, part (which of the folder's ranges of ids it is in), offset (ids before it in its
part), n_tokens, and tokens (a list of ints). Token lists are dictionary-encoded, which packs ids of a vocabulary under
65,536 into 16 bits or fewer; the other columns, which only grow or are small, are delta-encoded (page version 2). Row
groups and pages have a set size, and the files carry page indexes, so that a reader of some documents, or of the
lengths alone, fetches those pages only. `index` has a row for each part: its first id and the ids in all parts before
it (base). A document's place in the whole sequence of ids is base + offset.

The data are dealt out once, by ranges of ids, before they are encoded; nothing that is as long as the corpus comes to
one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions
from .pieces import CACHE_LENGTH
from .tables import Table, worker_table
from .words import stretch_hashes, text_bytes

#: Bytes of a row group and of a page.
ROW_GROUP, PAGE = 16 << 20, 64 << 10
#: Parts kept by a worker before it starts anew.
PARTS_KEPT = 600_000
#: Characters that no normalizer joins or splits: printable ASCII and the letters of Latin-1.
SIMPLE = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: Kinds of bytes.
GAP, LETTER, DIGIT, SIGN, HARD = range(5)
#: How a word-level vocabulary cuts a lower-cased word (fixed by the vocabulary's file).
WORD_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"

@lru_cache(2)
def _tokenizer(path: str):
    """The library's tokenizer, its special strings, for each id whether it ends a word, and the tokenizer for words already
    normalized and cut: the same model, which only splits at white space."""
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    vocab = t.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for s, i in vocab.items() if s.endswith(WORD_END)]] = True
    cut_only = Tokenizer(t.model)
    cut_only.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t, [x.content for x in t.get_added_tokens_decoder().values()], ends, cut_only


def _encode_parts(parts: str, n: int, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of n parts that a space ends and that the library would not cut further, and how many each has."""
    tokenizer, _, ends, cut_tokenizer = _tokenizer(path)
    ids = np.array(cut_tokenizer.encode_batch_fast([parts], add_special_tokens=False)[0].ids, np.int32)
    stops = np.flatnonzero(ends[ids]) + 1
    if len(stops) == n:
        return ids, np.diff(stops, prepend=0)
    each = [e.ids for e in tokenizer.encode_batch_fast(parts.split(), add_special_tokens=False)]
    return np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64)


def _encode_words(words: list[str], path: str, plain: bool) -> list[bytes]:
    """Ids of each word (none has white space). Simple words are cut into parts, and all parts encoded in one call.

    plain: no word holds a special string.
    """
    tokenizer, special, _, _ = _tokenizer(path)
    cuts = [WORD_PARTS.findall(w.lower()) if SIMPLE.fullmatch(w) and (plain or not any(s in w for s in special)) else None for w in words]
    parts = list(set().union(*(c for c in cuts if c)))
    ids, n = _encode_parts(" ".join(parts), len(parts), path) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    known = dict(zip(parts, (x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(n)[:-1])), strict=True)) if parts else {}
    other = iter(tokenizer.encode_batch_fast([w for w, c in zip(words, cuts, strict=True) if c is None], add_special_tokens=False))
    return [np.array(next(other).ids, "<u4").tobytes() if c is None else b"".join([known[p] for p in c]) for c in cuts]


def _classes(special: list[str]) -> np.ndarray:
    """Of each byte: a gap between words, a letter, a digit, another sign, or one that only strings can tell about."""
    out = np.full(256, HARD, np.uint8)
    out[0x21:0x7F] = SIGN
    out[0x30:0x3A] = DIGIT
    out[0x41:0x5B] = out[0x61:0x7B] = LETTER
    out[[0x20, 0x0A]] = GAP
    out[[0x27, *(s.encode()[0] for s in special)]] = HARD  # contractions begin with an apostrophe
    return out


class _Store:
    """Ids of parts by hash and of whole words by string, one after the other."""

    def __init__(self) -> None:
        self.places = Table(21)
        self.words: dict[str, int] = {}
        self.starts, self.lengths, self.ids = (np.zeros(n, np.int32) for n in (1, 1, 0))  # the first has no ids

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The places of new entries."""
        first = len(self.starts)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths]).astype(np.int32)
        self.lengths = np.concatenate([self.lengths, lengths]).astype(np.int32)
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        return np.arange(first, len(self.starts), dtype=np.int32)


def encode_arrays(texts: pa.Array, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in order, with end_id after each text, and how many each has.

    For vocabularies that drop white space, lower-case and mark word ends, so that words are encoded one by one, and the
    parts that a word of ASCII characters and letters of Latin-1 is cut into by themselves. Parts are found and hashed in numpy;
    those not met before are made strings and encoded by the library, as are words with other characters.
    """
    tokenizer, special, ends, cut_tokenizer = _tokenizer(path)
    store = worker_table("token_files", path, _Store)
    if len(store.starts) > PARTS_KEPT:
        store.__init__()
    data, bounds = text_bytes(texts)
    plain = not any(pc.any(pc.match_substring(texts, s)).as_py() for s in special)
    kind = _classes([] if plain else special)[data]
    latin = np.flatnonzero(data[1:] >= 0x80) + 1
    latin = latin[(data[latin - 1] == 0xC3) & (data[latin] < 0xC0) & (data[latin] != 0x97) & (data[latin] != 0xB7)]
    kind[latin] = kind[latin - 1] = LETTER  # the letters of Latin-1 have two bytes
    gap = kind == GAP
    fresh = np.empty(len(data), bool)  # where the byte before is of another text, or a gap
    fresh[:1] = True
    fresh[1:] = gap[:-1]
    fresh[bounds[:-1][bounds[:-1] < len(data)]] = True
    word_starts = np.flatnonzero(fresh & ~gap)
    hard = np.add.reduceat(kind == HARD, word_starts, dtype=np.int32) > 0 if len(word_starts) else np.zeros(0, bool)
    part = fresh | (kind == DIGIT)
    part[1:] |= kind[1:] != kind[:-1]
    part &= ~gap
    if hard.any():  # their words are one part each
        inside = np.zeros(len(data) + 1, np.int8)
        stops = np.append(word_starts[1:], len(data))
        np.add.at(inside, word_starts[hard], 1)
        np.add.at(inside, stops[hard], -1)
        part &= (np.cumsum(inside[:-1]) == 0) | fresh
    starts = np.flatnonzero(part)
    after = np.concatenate([part[1:] | gap[1:] | fresh[1:], [True]]) if len(data) else part
    stops = np.flatnonzero(after & ~gap) + 1
    if len(stops) != len(starts):  # a word of one part may hold ends of parts
        stops = stops[np.append(np.searchsorted(stops, starts[1:], "right") - 1, len(stops) - 1)]
    whole = np.zeros(len(starts), bool)
    whole[np.searchsorted(starts, word_starts[hard])] = True
    places = np.empty(len(starts), np.int32)
    easy = np.flatnonzero(~whole)
    hashes = stretch_hashes(data, starts, stops).view(np.int64)[easy]
    got = store.places.get(hashes)
    new = np.flatnonzero(got < 0)
    if len(new):
        distinct, first = np.unique(hashes[new], return_index=True)
        at = easy[new[first]]
        n = stops[at] - starts[at] + 1  # each with the space after it
        to = np.cumsum(n)
        joined = data[np.minimum(np.repeat(starts[at] - (to - n), n) + np.arange(int(to[-1])), len(data) - 1)]
        joined[to - 1] = 0x20
        put = store.add(*_encode_parts(joined.tobytes().decode().lower(), len(at), path))
        store.places.put(distinct, put)
        got[new] = put[np.searchsorted(distinct, hashes[new])]
    places[easy] = got
    if hard.any():
        at = np.flatnonzero(whole)
        strings = [data[a:b].tobytes().decode() for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]
        missing = [w for w in dict.fromkeys(strings) if w not in store.words]
        pieces = _encode_words(missing, path, plain)
        put = store.add(np.frombuffer(b"".join(pieces), "<i4"), np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4)
        now = dict(zip(missing, put.tolist(), strict=True))
        store.words |= {w: i for w, i in now.items() if len(w) <= CACHE_LENGTH}
        places[at] = [now[w] if w in now else store.words[w] for w in strings]
    counts = np.searchsorted(starts, bounds)
    end = store.add(np.array([end_id]), np.ones(1, np.int64)) if end_id is not None else np.zeros(1, np.int32)
    order = np.insert(places, counts[1:], end[0])
    each = store.lengths[order].astype(np.int64)
    stops = np.cumsum(each)
    total = int(stops[-1]) if len(stops) else 0
    wide = np.int32 if total < 1 << 31 else np.int64
    at = np.repeat((store.starts[order] - (stops - each)).astype(wide), each)
    at += np.arange(total, dtype=wide)
    last = stops[counts[1:] + np.arange(len(texts))] if len(texts) else stops
    return store.ids[at].view("<u4"), np.diff(last, prepend=0)


def encode_batch(texts: list[str], path: str, end_id: int | None) -> list[bytes]:
    """The same for each text by itself, as little-endian unsigned 32-bit integers."""
    ids, n = encode_arrays(pa.array(texts, pa.string()), path, end_id)
    return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []


def write_tokens(df: DataFrame, out: str, path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the texts of df and write them to the folder `out`.

    Null and empty texts hold end_id alone. Rows with a null id come first; rows with the same id stand together. An
    empty table gives a folder of empty tables. Other columns of df are not read.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, offset = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, n = encode_arrays(b.column(1), path, end_id)
            stops = np.cumsum(n)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(offset + stops - n), pa.array(n), tokens], ["doc_id", "part", "offset", "n_tokens", "tokens"]
            )
            offset += int(stops[-1]) if len(stops) else 0

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id")
    form = {"parquet.writer.version": "v2", "parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE), "compression": "zstd"}
    form |= {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "offset", "n_tokens")}
    rows.mapInArrow(run, f"doc_id {kind}, part int, offset long, n_tokens long, tokens array<int>").write.options(**form).parquet(f"{out}/data")
    # a row for each part: as many as there are partitions of the write
    parts = spark.read.parquet(f"{out}/data").groupBy("part").agg(F.min("doc_id").alias("first_id"), F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.select("part", "first_id", "part_tokens", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("base")).coalesce(1).write.parquet(f"{out}/index")


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, tokens); start counts the ids of all documents before. Unused columns are not fetched."""
    data, index = spark.read.parquet(f"{out}/data"), spark.read.parquet(f"{out}/index")
    return data.join(index.select("part", "base"), "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "tokens")


def checksums(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """df with ids_crc32 instead of its token lists: unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def crc(lists: pa.Array) -> pa.Array:
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        stops = lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
        return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)], pa.int64())

    return df.withColumn("ids_crc32", crc(F.col(tokens_col))).drop(tokens_col)
