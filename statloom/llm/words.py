"""Words of many texts at once as 64-bit hashes, in numpy.

A word is a stretch of bytes other than ASCII white space, with A-Z in lower case. Its hash is a polynomial of random values
of its bytes, mixed: differences of one running sum over a whole stretch of text, so no word is ever made an object.
Different words share a hash with a probability of about 2^-60 for each pair.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer word makes a longer stretch.
STRETCH = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, np.uint64)[_LOWER]
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's texts, and where each begins and the last ends; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets is not None and len(texts) else np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def stretch_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of data[start:stop], of none of which another begins before the end; A-Z count as a-z."""
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + STRETCH)))
        a, b = int(starts[i]), int(stops[j - 1])
        up, down = _powers(STRETCH) if b - a <= STRETCH else _powers(1 << (b - a).bit_length())
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_VALUES[data[a:b]] * up[: b - a], out=sums[1:])
        at, to = starts[i:j] - a, stops[i:j] - a
        hashes[i:j] = (sums[to] - sums[at]) * down[at] + (to - at).astype(np.uint64)
        i = j
    return mix(hashes)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in order: hashes (uint64) and last two bytes (uint16, lower case, 0 before a word of one); words of each text."""
    data, bounds = text_bytes(texts)
    space = _SPACE[data]
    first = np.empty(len(data), bool)
    first[:1] = True
    first[1:] = space[:-1]
    first[bounds[:-1][bounds[:-1] < len(data)]] = True
    starts = np.flatnonzero(first & ~space)
    del first
    last = np.empty(len(data), bool)
    last[-1:] = True
    last[:-1] = space[1:]
    last[bounds[1:-1][bounds[1:-1] > 0] - 1] = True
    stops = np.flatnonzero(last & ~space) + 1
    del last, space
    counts = np.diff(np.searchsorted(starts, bounds))
    hashes = stretch_hashes(data, starts, stops)
    tails = _LOWER[data[stops - 1]].astype(np.uint16)
    more = stops - starts > 1
    tails[more] |= _LOWER[data[stops[more] - 2]].astype(np.uint16) << 8
    return hashes, tails, counts
