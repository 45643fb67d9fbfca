"""Elevation tiles stored as PNG images, decoded where they are read."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 256
#: Fixed values of the image format: samples of a pixel by colour type, at eight bits each.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def pixels(image: bytes) -> np.ndarray:
    """Rows, columns and samples of a PNG image of eight bits a sample, not interlaced; a ValueError for any other."""
    if image[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, data, palette = 8, b"", None
    while at + 8 <= len(image):
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        body, at = image[at + 8 : at + 8 + n], at + n + 12
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlaced or colour not in SAMPLES:
                raise ValueError("an image of another depth, colour type or order")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        elif kind == b"IEND":
            break
    k = SAMPLES[colour]
    try:
        lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * k)
    except (zlib.error, UnboundLocalError) as e:
        raise ValueError("a damaged image") from e
    out = np.zeros((height, width * k), np.uint8)
    above = np.zeros(width * k, np.uint8)
    for i, line in enumerate(lines):
        out[i] = above = unfiltered(int(line[0]), line[1:], above, k)
    found = out.reshape(height, width, k)
    return palette[found[..., 0]] if colour == 3 else found


def unfiltered(kind: int, line: np.ndarray, above: np.ndarray, k: int) -> np.ndarray:
    """A line of samples from its differences to the left, above, their mean, or the likeliest of three neighbours."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, k), axis=0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise ValueError("an unknown filter")
    out, up = line.tolist(), above.tolist()
    for i, x in enumerate(out):
        a, b, c = (out[i - k], up[i], up[i - k]) if i >= k else (0, up[i], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
        out[i] = (x + guess) & 255
    return np.array(out, np.uint8)


def elevations(image: bytes | None) -> np.ndarray | None:
    """Metres of a tile, row by row; None if it can't be read or has another size, which makes it sea level."""
    try:
        p = pixels(image or b"").astype(np.float64)
    except (ValueError, struct.error):
        return None
    if p.shape[:2] != (SIZE, SIZE):
        return None
    r, g, b = (p[..., i] for i in range(3)) if p.shape[2] >= 3 else (p[..., 0],) * 3
    return (r * 256 + g + b / 256 - 32768).astype(np.float32).reshape(-1)


def png_tiles(spark: SparkSession, path: str) -> DataFrame:
    """z, x, y, elev of the tiles under z/x/y.png; a tile that can't be read isn't there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path)
    place = lambda i: F.regexp_extract("path", r"/(\d+)/(\d+)/(\d+)\.png$", i).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(len(whole)):  # a decoded tile at a time
                b = whole.slice(i, 1)
                metres = elevations(b.column(3)[0].as_py())
                if metres is not None:
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(3)), pa.array([metres], pa.list_(pa.float32()))], names=["z", "x", "y", "elev"])

    rows = files.select(place(1).alias("z"), place(2).alias("x"), place(3).alias("y"), "content").where("z IS NOT NULL")
    return rows.mapInArrow(run, "z int, x int, y int, elev array<float>")
