"""Media columns: texts as PNG images in binary columns, read back, and hashed by appearance.

A payload is the text's UTF-8 bytes, padded with spaces to a positive multiple of 192, seen as
rows of 64 RGB pixels with 8-bit samples.  ``store_png`` writes them losslessly; ``read_png``
parses the stored bytes chunk by chunk, tests each chunk's checksum, inflates, undoes the
scanline filters with numpy and gives the samples back; ``appearance`` is a 64-bit hash from
the low frequencies of a cosine transform.  Reading understands all five filter types;
writing chooses for each row among none, sub and up.

Null text is empty text: one row of spaces.  Equal texts give equal values.  A stored image
whose checksum or layout is wrong raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, map_arrow, table

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 16


def pad(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % ROW if raw else ROW)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """PNG of a payload of whole rows; each row takes the filter with the smallest residual."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    sub, up = rows.copy(), rows.copy()
    sub[:, CHANNELS:] -= rows[:, :-CHANNELS]
    up[1:] -= rows[:-1]
    tried = np.stack([rows, sub, up])
    choice = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0)
    lines = np.empty((len(rows), ROW + 1), np.uint8)
    lines[:, 0] = choice
    lines[:, 1:] = tried[choice, np.arange(len(rows))]
    data = zlib.compress(lines.tobytes(), 1)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """Samples (height, width, channels) of an 8-bit grey, RGB or RGBA image that isn't interlaced."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("cut short")
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(body) != n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended, at = kind == b"IEND", at + 12 + n
    if head is None or not ended:
        raise ValueError("no header or no end")
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlaced:
        raise ValueError("kind of PNG isn't handled")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(lines) != height * (width * channels + 1):
        raise ValueError("size of the samples")
    return unfilter(lines.reshape(height, -1), channels).reshape(height, width, channels)


def unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the scanline filters; runs of rows with one filter go together where it allows that."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(kinds)], strict=True):
        kind, block = kinds[a], out[a:b]
        above = out[a - 1] if a else np.zeros(out.shape[1], np.uint8)
        if kind == 1:
            pixels = block.reshape(b - a, -1, bpp)
            out[a:b] = np.cumsum(pixels, axis=1, dtype=np.uint8).reshape(b - a, -1)
        elif kind == 2:
            out[a:b] = np.cumsum(block, axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for i in range(a, b):
                _unfilter_row(out[i], out[i - 1] if i else np.zeros(out.shape[1], np.uint8), bpp, kind)
        elif kind:
            raise ValueError("filter")
    return out


def _unfilter_row(row: np.ndarray, above: np.ndarray, bpp: int, kind: int) -> None:
    """Average and Paeth depend on the pixel to the left: pixel by pixel, channels together."""
    left = corner = np.zeros(bpp, np.int16)
    for i in range(0, len(row), bpp):
        up = above[i : i + bpp].astype(np.int16)
        if kind == 3:
            guess = (left + up) // 2
        else:
            base = left + up - corner
            far = np.abs(np.stack([base - left, base - up, base - corner]))
            guess = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
        row[i : i + bpp] = (row[i : i + bpp] + guess).astype(np.uint8)
        left, corner = row[i : i + bpp].astype(np.int16), up


SIDE, LOW = 32, 8
#: Rows of the cosine transform's matrix for the lowest frequencies.
COSINES = np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) / (2 * SIDE))


def _shrink(x: np.ndarray, n: int) -> np.ndarray:
    """Rows to n rows: means of n stretches, or repeats if there are fewer rows."""
    if len(x) < n:
        return x[np.arange(n) * len(x) // n]
    edges = np.arange(n + 1) * len(x) // n
    return np.add.reduceat(x, edges[:-1], axis=0) / np.diff(edges)[:, None]


def appearance(samples: np.ndarray) -> bytes:
    """8 bytes: which low-frequency coefficients are above their median."""
    grey = samples.sum(axis=2, dtype=np.int64)
    small = _shrink(_shrink(grey, SIDE).T, SIDE).T
    low = (COSINES @ small @ COSINES.T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def store_png(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): each text as a PNG."""
    docs = documents(df, id_column, text_column)

    def store(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([encode_png(pad(r)) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(docs, store, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read_png(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32, phash binary) from stored images."""
    names = ["doc_id", "n_bytes", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "phash"]

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for media in batch.column(2).to_pylist():
            samples = decode_png(media)
            payload = samples.tobytes()
            out.append((len(media), hashlib.sha256(media).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), appearance(samples)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=names)

    docs = media.select("doc_id", "n_bytes", F.col("media").alias("text"))
    return map_arrow(docs, read, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, phash binary")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_png(store_png(table(spark, sf_dir, "documents")))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("phash")).alias("feature"))
