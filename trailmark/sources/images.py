"""Pictures as rows of pixels.  PNG files (8 bits, gray or RGB, with or without alpha, not interlaced) are decoded with zlib and NumPy."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by the format's colour types that are read.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


def _parts(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG file")
    at = 8
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def decode(data: bytes) -> np.ndarray:
    """Array (height, width, samples) of bytes."""
    head, body = None, []
    for kind, part in _parts(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in SAMPLES or interlaced:
        raise ValueError("only plain pictures of 8 bits a sample are read")
    step = SAMPLES[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height + 1, width + 1, step), np.uint8)  # a row and a column of zeros before the first
    for y, row in enumerate(rows, 1):
        how, line, above = row[0], row[1:].reshape(width, step), out[y - 1, 1:]
        if how == 0:
            out[y, 1:] = line
        elif how == 1:
            out[y, 1:] = np.cumsum(line, axis=0, dtype=np.uint8)
        elif how == 2:
            out[y, 1:] = line + above
        else:
            for x in range(1, width + 1):
                a, b, c = out[y, x - 1].astype(int), out[y - 1, x].astype(int), out[y - 1, x - 1].astype(int)
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                out[y, x] = (line[x - 1] + guess) % 256
    return out[1:, 1:]


def encode(pixels: np.ndarray, how: int = 0) -> bytes:
    """A PNG file of an array (height, width) of bytes; ``how``: 0 as they are, 1 differences to the left, 2 to the row above."""
    height, width = pixels.shape
    rows = pixels.copy()
    if how == 1:
        rows[:, 1:] -= pixels[:, :-1]
    elif how == 2:
        rows[1:] -= pixels[:-1]
    raw = np.concatenate([np.full((height, 1), how, np.uint8), rows], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def gray(picture: np.ndarray) -> np.ndarray:
    """Mean over the colours; a last sample beyond them is transparency and left out."""
    return picture[:, :, : 3 if picture.shape[2] > 2 else 1].mean(axis=2).astype(np.int32)


def gray_pixels(content: Column) -> Column:
    """array<int> of a picture's samples, mean over the colours of a pixel, row by row."""

    @F.pandas_udf("array<int>")
    def pixels(files: pd.Series) -> pd.Series:
        return files.map(lambda data: gray(decode(data)).ravel())

    return pixels(content)


def pictures(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """Rows (path, px array<int>) of the pictures below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", gray_pixels(F.col("content")).alias("px"))
