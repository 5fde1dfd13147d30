"""Byte payloads as greyscale PNG images in binary columns, and hashes of their low frequencies.

write_pngs() gives signature, IHDR, IDAT (zlib) and IEND chunks, each with its checksum; rows are 64 samples wide, each
under the one of the five filters whose bytes take the fewest bits. read_pngs() tests every chunk's checksum, inflates,
and undoes the filters with numpy, along diagonals of many images at once. feature() averages the image down to 32 x 32, takes its 8 x 8 lowest cosine-transform coefficients and gives a bit
for each that exceeds their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

WIDTH = 64
LEVEL = 3
#: Rows of the images whose filters are undone together, about.
GROUP_ROWS = 1 << 14
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8

_k = np.arange(LOW)[:, None]
COSINES = np.cos(np.pi * (2 * np.arange(SIDE)[None, :] + 1) * _k / (2 * SIDE)) * np.where(_k == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _paeth(left: np.ndarray, above: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of left, above and corner (int16), the nearest to left + above - corner; ties go to the first."""
    a, b = above - corner, left - corner
    c = np.abs(a + b)
    np.abs(a, out=a)
    np.abs(b, out=b)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))


def coded_bits(rows: np.ndarray) -> np.ndarray:
    """How many bits each row's bytes take if coded by how often they occur in it."""
    n = rows.shape[1]
    steps = np.arange(n + 1) * np.log2(np.maximum(np.arange(n + 1), 1))
    gain = np.diff(steps).astype(np.float32)  # what the k-th of equal bytes saves; the sum over c of them is c log c
    ordered = np.sort(rows, axis=1)
    at = np.arange(n, dtype=np.int32)
    starts = np.zeros(rows.shape, np.int32)
    starts[:, 1:] = np.where(ordered[:, 1:] != ordered[:, :-1], at[1:], 0)
    return n * np.log2(n) - gain[at - np.maximum.accumulate(starts, axis=1)].sum(1)


def filtered(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of samples the filter whose bytes take the fewest bits, and those bytes; ties go to the simpler filter.

    rows are those of many images, one after the other; first marks where one begins.
    """
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    above[first] = 0
    left, corner = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], corner[:, 1:] = rows[:, :-1], above[:, :-1]
    wide = [x.astype(np.int16) for x in (left, above, corner)]
    best, kinds, least = rows.copy(), np.zeros(len(rows), np.uint8), coded_bits(rows)
    for kind, guess in enumerate((left, above, (wide[0] + wide[1]) >> 1, _paeth(*wide)), 1):
        out = rows - guess.astype(np.uint8)
        bits = coded_bits(out)
        better = bits < least - 1e-3
        best[better], kinds[better], least[better] = out[better], kind, bits[better]
    return kinds, best


def write_pngs(payloads: list[bytes]) -> list[bytes]:
    """Greyscale images of 64 samples a row. Each payload's length is a positive multiple of 64."""
    heights = np.array([len(p) // WIDTH for p in payloads], np.int64)
    stops = np.cumsum(heights)
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH)
    first = np.zeros(len(rows), bool)
    first[stops - heights] = True
    body = np.empty((len(rows), WIDTH + 1), np.uint8)
    body[:, 0], body[:, 1:] = filtered(rows, first)
    out = []
    for h, stop in zip(heights.tolist(), stops.tolist(), strict=True):
        head = struct.pack(">IIBBBBB", WIDTH, h, 8, 0, 0, 0, 0)
        out.append(SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body[stop - h : stop].tobytes(), LEVEL)) + _chunk(b"IEND", b""))
    return out


def write_png(payload: bytes) -> bytes:
    return write_pngs([payload])[0]


def unfilter(images: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Samples of images with one byte a pixel and one width, from each row's filter kind and filtered bytes.

    A sample depends on those to its left, above, and between, so all samples on a rising diagonal, of all images of a
    group, are undone together. Images of like height make a group.
    """
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(images)
    order = sorted(range(len(images)), key=lambda i: len(images[i][0]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and len(images[order[stop]][0]) <= max(16, 5 * len(images[order[at]][0]) // 4) and (stop - at) * len(images[order[stop]][0]) < GROUP_ROWS:
            stop += 1
        group = order[at:stop]
        for i, x in zip(group, _unfilter_group([images[i] for i in group]), strict=True):
            out[i] = x
        at = stop
    return out


def _unfilter_group(images: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    if any(k.max(initial=0) > 4 for k, _ in images):
        raise ValueError("a row's filter is not defined")
    if not any(k.any() for k, _ in images):
        return [rows for _, rows in images]
    width, tall = images[0][1].shape[1], max(len(k) for k, _ in images)
    steps = tall + width - 1
    # diagonal t holds sample (t - x, x) at x; beyond an image all is 0 and unfiltered
    values, kinds = np.zeros((steps, len(images), width), np.int16), np.zeros((steps, len(images), width), np.int8)
    t, x = np.arange(tall)[:, None] + np.arange(width)[None, :], np.broadcast_to(np.arange(width), (tall, width))
    for i, (k, rows) in enumerate(images):
        h = len(k)
        values[t[:h], i, x[:h]], kinds[t[:h], i, x[:h]] = rows, k[:, None]
    left, corner = (np.zeros(values.shape[1:], np.int16) for _ in range(2))
    above = np.zeros_like(left)
    for d in range(steps):
        kind, now = kinds[d], values[d]
        guess = np.where(kind == 1, left, np.where(kind == 2, above, 0)) if (kind < 3).all() else np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) >> 1, _paeth(left, above, corner)], 0)
        now += guess.astype(np.int16)
        now &= 255
        # what lies above the next diagonal is this one; to its left, this one moved by a column
        corner = left
        above, left = now, np.zeros_like(now)
        left[:, 1:] = now[:, :-1]
        corner = np.where(np.arange(width) > 0, corner, 0)
    out = []
    for i, (k, _) in enumerate(images):
        h = len(k)
        out.append(values[t[:h], i, x[:h]].astype(np.uint8))
    return out


def parse_png(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each row's filter kind and filtered bytes of an 8-bit greyscale image; ValueError if it is damaged or of another kind."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, size, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        (n,) = struct.unpack_from(">I", data, at)
        kind, content = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(content) < n or at + 12 + n > len(data):
            raise ValueError("a chunk is cut off")
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(content, zlib.crc32(kind)):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        ended = kind == b"IEND"
        at += 12 + n
    if size is None or not ended:
        raise ValueError("IHDR or IEND is missing")
    if size[2:] != (8, 0, 0, 0, 0) or not size[0] * size[1]:
        raise ValueError("not an 8-bit greyscale image without interlace")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(rows) != size[1] * (size[0] + 1):
        raise ValueError("the image data do not fill the image")
    rows = rows.reshape(size[1], size[0] + 1)
    if rows[:, 0].max() > 4:
        raise ValueError("a row's filter is not defined")
    return rows[:, 0], rows[:, 1:]


def read_pngs(data: list[bytes | None]) -> list[np.ndarray | None]:
    """The samples of images; None where one is null, damaged or of another kind than 8-bit greyscale."""
    parsed: dict[int, list[tuple[int, tuple[np.ndarray, np.ndarray]]]] = {}
    for i, d in enumerate(data):
        try:
            got = parse_png(d) if d is not None else None
        except (ValueError, zlib.error, struct.error):
            got = None
        if got is not None:
            parsed.setdefault(got[1].shape[1], []).append((i, got))
    out: list[np.ndarray | None] = [None] * len(data)
    for images in parsed.values():  # of one width
        for (i, _), image in zip(images, unfilter([x for _, x in images]), strict=True):
            out[i] = image
    return out


def read_png(data: bytes) -> np.ndarray:
    return unfilter([parse_png(data)])[0]


def _shrink(image: np.ndarray, axis: int) -> np.ndarray:
    """Means of SIDE equal stretches along an axis; an image shorter than that repeats its samples."""
    n = image.shape[axis]
    if n < SIDE:
        return np.take(image, np.arange(SIDE) * n // SIDE, axis)
    edges = np.arange(SIDE + 1) * n // SIDE
    shape = [1, 1]
    shape[axis] = SIDE
    return np.add.reduceat(image, edges[:-1], axis, dtype=np.float64) / np.diff(edges).reshape(shape)


def feature(image: np.ndarray) -> bytes:
    """Eight bytes: which of the 64 lowest cosine coefficients exceed the median of all but the first."""
    low = COSINES @ _shrink(_shrink(image, 0), 1).astype(np.float64) @ COSINES.T
    flat = np.round(low.ravel(), 6)
    return np.packbits(flat > np.median(flat[1:])).tobytes()


def payload_of(text: str) -> bytes:
    """UTF-8 bytes with zeros up to a positive multiple of 64."""
    raw = text.encode()
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def text_images(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, media binary): each text as a PNG. Null and empty texts give one row of zeros.

    Repeated rows give repeated results, an empty table an empty one; other columns of df are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(write_pngs([payload_of(t) for t in texts]), pa.binary())], ["id", "n_bytes", "media"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def image_features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and hash (binary), read from its images.

    Where an image is null or damaged, or isn't 8-bit greyscale, these are null. Columns of these names are replaced.
    """
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash")
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    @F.arrow_udf("struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,hash:binary>")
    def read(media: pa.Array) -> pa.Array:
        out = []
        stored = media.to_pylist()
        for data, image in zip(stored, read_pngs(stored), strict=True):
            if image is None:
                out.append(None)
                continue
            payload = image.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(image)))
        arrays = [pa.array([None if r is None else r[i] for r in out], t) for i, t in enumerate(types)]
        return pa.StructArray.from_arrays(arrays, names=list(names))

    at = fresh(df, "read")
    got = df.withColumn(at, read(F.col(media_col)))
    return got.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names], f"{at}.*")
