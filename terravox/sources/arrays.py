"""Array files: reconstruction arrays with a ``W&H&D&`` head, NumPy arrays, PNG images. Each file is one task's work."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "path string, row int, col int, ch int, v double"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _pixels(files: DataFrame, decode) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for at in batches:
            for path, content in zip(at.path, at.content):
                image = decode(content)
                image = image[:, :, None] if image.ndim == 2 else image
                for r in range(0, image.shape[0], 256):  # some rows at a time
                    part = image[r : r + 256]
                    row, col, ch = np.indices(part.shape, np.int32)
                    yield pd.DataFrame({"path": path, "row": row.ravel() + r, "col": col.ravel(), "ch": ch.ravel(), "v": part.ravel().astype(float)})

    return files.mapInPandas(run, PIXELS)


def decode_reconstruction(data: bytes) -> np.ndarray:
    """(rows, columns, channels) of an array stored column-major with width first."""
    parts = data.split(b"&", 3)
    w, h, d = (int(p) for p in parts[:3])
    if len(parts) < 4 or len(parts[3]) < 4 * w * h * d:
        raise ValueError("the body is too short")
    return np.frombuffer(parts[3][: 4 * w * h * d], "<f4").reshape(d, h, w).transpose(1, 2, 0)


def read_reconstruction(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, ch, v) of depth or normal maps."""
    return _pixels(_files(spark, path, "*.bin"), decode_reconstruction)


def decode_png(data: bytes) -> np.ndarray:
    """8-bit images without interlacing as values from 0 to 1: grey, RGB, and either with alpha."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", chunk) if kind == b"IHDR" else head
        body += chunk if kind == b"IDAT" else b""
        at += 12 + size
    width, height, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlace or channels is None:
        raise ValueError("only plain 8-bit PNG files are read")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.int64)
    for y in range(height):
        kind, line, up = raw[y, 0], raw[y, 1:].astype(np.int64), out[y - 1] if y else np.zeros(width * channels, np.int64)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            for x in range(width * channels):
                left, corner = (out[y, x - channels], up[x - channels]) if x >= channels else (0, 0)
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    guess = min((left, up[x], corner), key=lambda v, p=left + up[x] - corner: abs(p - v))
                out[y, x] = (line[x] + guess) & 255
    image = out.reshape(height, width, channels) / 255.0
    return image[:, :, 0] if channels == 1 else image


def encode_png(image: np.ndarray) -> bytes:
    """Values from 0 to 1 of (rows, columns[, 1 to 4 channels]) as an 8-bit PNG."""
    image = image[:, :, None] if image.ndim == 2 else image
    levels = np.round(np.clip(image, 0, 1) * 255).astype(np.uint8)
    h, w, c = levels.shape
    raw = b"".join(b"\0" + r.tobytes() for r in levels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def read_png(spark: SparkSession, path: str) -> DataFrame:
    return _pixels(_files(spark, path, "*.png"), decode_png)


def write_png(pixels: DataFrame, folder: str, *, img: str = "img") -> DataFrame:
    """One file ``IMG.png`` an image of (img, row, col, ch, v); returns (img, path). Images are written by the tasks."""
    from .headers import write_whole

    def run(at: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((at.row.max() + 1, at.col.max() + 1, at.ch.max() + 1))
        image[at.row, at.col, at.ch] = at.v
        path = f"{folder.rstrip('/')}/{at.img.iloc[0]}.png"
        write_whole(path, encode_png(image))
        return pd.DataFrame({"img": at.img.iloc[:1].astype(str), "path": [path]})

    rows = pixels.select(F.col(img).alias("img"), "row", "col", "ch", "v")
    return rows.groupBy("img").applyInPandas(run, "img string, path string")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, v): elements of NumPy arrays in row-major order with their place. Pickled objects are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for at in batches:
            for path, content in zip(at.path, at.content):
                flat = np.load(io.BytesIO(content), allow_pickle=False).ravel()
                for a in range(0, len(flat), 65_536):
                    part = flat[a : a + 65_536]
                    yield pd.DataFrame({"path": path, "i": np.arange(a, a + len(part)), "v": part.astype(float)})

    return _files(spark, path, "*.npy").mapInPandas(run, "path string, i long, v double")


def find_paths(spark: SparkSession, root: str, condition=None) -> DataFrame:
    """(path, is_dir) of everything below root (itself included) for which condition(path column) holds, in order."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(conf)
    found, todo = [(root.rstrip("/"), True)], [path]
    while todo:  # a name-node call a folder
        for s in store.listStatus(todo.pop()):
            found.append((jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(s.getPath()).toString(), s.isDirectory()))
            if s.isDirectory():
                todo.append(s.getPath())
    df = spark.createDataFrame(found, "path string, is_dir boolean")
    return (df.where(condition(F.col("path"))) if condition else df).orderBy("path")
