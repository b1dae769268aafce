"""Media columns: bytes as PNG images and back, and low-frequency cosine-transform hashes.

Method: a payload becomes an 8-bit greyscale image WIDTH samples wide. Each row takes the filter (none, sub, up, average, Paeth are all
decoded; none, sub and up are written) with the smallest sum of absolute residuals; the rows are deflated into IDAT chunks, and every chunk
carries its CRC-32. Reading parses the chunks, tests each checksum, inflates and undoes the filters with numpy. The hash resamples the image to
32 x 32 block means, takes its two-dimensional cosine transform and sets one bit for each of the 64 lowest frequencies above their median.
PNG and hash are binary columns.

Cases: a null text counts as empty; an empty payload is one row of 255s (payloads are padded with 255 to a positive multiple of WIDTH).
Equal bytes give equal values. Very long texts are images of more rows. Extra columns are not read; an empty table gives an empty result.
A chunk whose checksum is wrong raises ValueError.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, released, text_or_empty

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT = 1 << 16


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def padded(data: bytes, width: int = WIDTH) -> bytes:
    return data + b"\xff" * ((-len(data)) % width or (0 if data else width))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """An 8-bit greyscale PNG of a payload whose length is a positive multiple of width."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left = np.zeros_like(image)
    left[:, 1:] = image[:, :-1]
    above = np.zeros_like(image)
    above[1:] = image[:-1]
    ways = np.stack([image, image - left, image - above])
    cost = np.minimum(ways, 256 - ways.astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    lines = np.empty((len(image), width + 1), np.uint8)
    lines[:, 0] = best  # 0 none, 1 sub, 2 up
    lines[:, 1:] = ways[best, np.arange(len(image))]
    packed = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", packed[i : i + IDAT]) for i in range(0, len(packed), IDAT)) + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray, width: int) -> np.ndarray:
    """Undoes the row filters of one byte a sample."""
    kinds, image = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    sub = kinds == 1
    image[sub] = np.cumsum(image[sub], axis=1, dtype=np.uint8)
    y = 0
    while y < len(image):
        kind = kinds[y]
        if kind < 2:
            y += 1
        elif kind == 2:  # a run of rows that lean on the row above
            z = y
            while z < len(image) and kinds[z] == 2:
                z += 1
            if y:
                image[y] += image[y - 1]
            image[y:z] = np.cumsum(image[y:z], axis=0, dtype=np.uint8)
            y = z
        else:
            above = image[y - 1].tolist() if y else [0] * width
            row, left, corner = image[y].tolist(), 0, 0
            for x in range(width):
                up = above[x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = left if a <= b and a <= c else up if b <= c else corner
                left = row[x] = (row[x] + guess) & 255
                corner = up
            image[y] = row
            y += 1
    return image


def decode_png(data: bytes) -> np.ndarray:
    """The image of an 8-bit greyscale PNG; every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, packed, head, kind = 8, [], None, b""
    while kind != b"IEND":
        if at + 12 > len(data):
            raise ValueError("the PNG ends within a chunk")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))) != data[at + 8 + size : at + 12 + size]:
            raise ValueError(f"wrong checksum of a {kind!r} chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit greyscale without interlacing is read")
    width, height = head[:2]
    return unfilter(np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1), width)


_N, _LOW = 32, 8
_DCT = np.cos(np.pi / _N * np.outer(np.arange(_LOW), np.arange(_N) + 0.5))


def _edges(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_N ranges over n samples, of one sample at least."""
    begin = np.arange(_N) * n // _N
    return begin, np.maximum((np.arange(_N) + 1) * n // _N, begin + 1)


def dct_hash(image: np.ndarray) -> bytes:
    """64 bits, as 8 bytes."""
    (y0, y1), (x0, x1) = _edges(image.shape[0]), _edges(image.shape[1])
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.int64), axis=1, out=sums[1:, 1:])
    small = (sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]) / np.outer(y1 - y0, x1 - x0)
    low = np.round(_DCT @ small @ _DCT.T, 6).ravel()
    return np.packbits(low > np.median(low)).tobytes()


def encode(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """id, n_bytes (unpadded) and png, the stored form."""

    def run(batches):
        for part in cut(batches, 128):
            data = [x.as_py() for x in part.column(1)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(list(map(len, data)), pa.int64()), pa.array([encode_png(padded(x, width), width) for x in data], pa.binary())], names=[id, "n_bytes", "png"]
            )

    kind = dict(df.dtypes)[id]
    return df.select(F.col(id), F.encode(text_or_empty(text), "UTF-8").alias("_bytes")).mapInArrow(released(run), f"`{id}` {kind}, n_bytes long, png binary")


def decode(df: DataFrame, png: str = "png") -> DataFrame:
    """df with payload (the stored samples, read back) and dct_hash."""
    fields = df.schema.fields

    def run(batches):
        for part in cut(batches, 128):
            images = [decode_png(x.as_py()) for x in part.column(png)]
            arrays = [*part.columns, pa.array([x.tobytes() for x in images], pa.binary()), pa.array([dct_hash(x) for x in images], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, "payload", "dct_hash"])

    return df.mapInArrow(released(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "payload binary", "dct_hash binary"]))
