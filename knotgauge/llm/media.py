"""Media columns: payloads as PNG images in binary columns, read back and hashed.

The payload's bytes are RGB samples of an image 64 pixels wide. Writing picks a filter per
row by the least sum of absolute differences; reading tests each chunk's checksum, inflates
and unfilters with numpy, and hashes the signs of the image's lowest cosine frequencies.
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

from .common import sliced


#: Fixed values of the PNG format: its signature, and channels by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
WIDTH, PIXEL = 64, 3
CHUNK = 1 << 16


class BrokenPng(ValueError):
    """Not a PNG that this reader takes, or damaged."""


def padded(raw: bytes, unit: int = WIDTH * PIXEL) -> bytes:
    return raw + b" " * (-len(raw) % unit if raw else unit)


def encode_png(payload: bytes, level: int = 4) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH * PIXEL)
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, PIXEL:] = rows[:, :-PIXEL]
    up[1:] = rows[:-1]
    tried = np.stack([rows, rows - left, rows - up])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(2)
    best = cost.argmin(0)
    lines = np.empty((len(rows), 1 + WIDTH * PIXEL), np.uint8)
    lines[:, 0], lines[:, 1:] = best, tried[best, np.arange(len(rows))]
    packed = zlib.compress(lines.tobytes(), level)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))
    data = b"".join(chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)) + data + chunk(b"IEND", b"")


def unfilter(lines: np.ndarray, pixel: int) -> np.ndarray:
    """Rows with their filter byte first -> samples. Runs of rows with one filter are undone at once where the filter allows."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise BrokenPng("unknown filter")
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    width = out.shape[1]
    for a, b in zip(edges, edges[1:]):
        if a == b or kinds[a] == 0:
            continue
        above = out[a - 1] if a else np.zeros(width, np.uint8)
        if kinds[a] == 1:
            out[a:b] = np.cumsum(out[a:b].reshape(b - a, -1, pixel), axis=1, dtype=np.uint8).reshape(b - a, width)
        elif kinds[a] == 2:
            out[a:b] = np.cumsum(np.vstack([above[None], out[a:b]]), axis=0, dtype=np.uint8)[1:]
        else:
            for r in range(a, b):
                row, up = out[r].astype(int), (out[r - 1] if r else np.zeros(width, np.uint8)).astype(int)
                for i in range(width):
                    x, y, z = (row[i - pixel] if i >= pixel else 0), up[i], (up[i - pixel] if i >= pixel else 0)
                    if kinds[r] == 3:
                        guess = (x + y) // 2
                    else:
                        guess = min((abs(y - z), 0, x), (abs(x - z), 1, y), (abs(x + y - 2 * z), 2, z))[2]
                    row[i] = (row[i] + guess) & 255
                out[r] = row
    return out


def decode_png(png: bytes) -> np.ndarray:
    """Samples as (rows, pixels, channels); BrokenPng if a checksum, a length or the form is wrong."""
    if png[:8] != SIGNATURE:
        raise BrokenPng("no signature")
    at, head, data, ended = 8, None, [], False
    while at < len(png) and not ended:
        if at + 12 > len(png) or at + 12 + (n := struct.unpack_from(">I", png, at)[0]) > len(png):
            raise BrokenPng("cut short")
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise BrokenPng(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended, at = kind == b"IEND", at + 12 + n
    if not head or not ended:
        raise BrokenPng("no header or end")
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in CHANNELS or interlaced:
        raise BrokenPng("only plain 8-bit samples are read")
    pixel = CHANNELS[colour]
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as e:
        raise BrokenPng(str(e)) from e
    if len(lines) != height * (1 + width * pixel):
        raise BrokenPng("wrong number of samples")
    return unfilter(lines.reshape(height, 1 + width * pixel), pixel).reshape(height, width, pixel)


def cosine_rows(size: int = 32, lowest: int = 8) -> np.ndarray:
    k, x = np.arange(lowest)[:, None], np.arange(size)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * size))


COSINES = cosine_rows()


def cosine_hash(image: np.ndarray, size: int = 32) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients of the 32 x 32 grey image exceed their median."""
    grey = image.sum(2, dtype=np.float64)
    for axis in (0, 1):
        n = grey.shape[axis]
        if n >= size:
            edges = np.arange(size + 1) * n // size
            grey = np.add.reduceat(grey, edges[:-1], axis) / np.expand_dims(np.diff(edges), 1 - axis)
        else:
            grey = np.take(grey, np.arange(size) * n // size, axis)
    low = (COSINES @ grey @ COSINES.T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def media_columns(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Each text as a PNG in a binary column, with what is read back from it.

    doc_id, n_bytes (of the text), payload_bytes, payload_sha256 and tail_crc32 (of the payload read
    back), media_bytes, media_sha256, feature (hex), hash (the same as binary), and `media` if kept. Null text counts as empty
    and makes one row of spaces. Equal texts give equal values. A payload read back that is not the
    one stored raises BrokenPng. Empty table: no rows.
    """
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("hash", pa.binary()), ("media", pa.binary())][: None if keep_media else -1]

    def one(doc_id: int | None, raw: bytes) -> tuple:
        payload = padded(raw)
        png = encode_png(payload)
        image = decode_png(png)
        if (back := image.tobytes()) != payload:
            raise BrokenPng("the payload read back differs")
        return doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(png), hashlib.sha256(png).hexdigest(), (bits := cosine_hash(image)).hex(), bits, png

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            rows = [one(*x) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, hash binary" + ", media binary" * keep_media
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")).mapInArrow(run, schema)
