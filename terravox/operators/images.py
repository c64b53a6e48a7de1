"""Pixel tables (img, row, col[, ch], v): blending, crops, shifts, inpainting, colour, hull and triangle fills."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks import require
from ..functions import scalar as S

PIXEL = ["img", "row", "col"]


def overlay_image(image: DataFrame, layer: DataFrame, *, ratio: float = 0.5, mask: DataFrame | None = None, on: Sequence[str] = PIXEL, value: str = "v") -> DataFrame:
    """Blend of two images by pixel, where ``mask`` (pixel keys, ``masked``) holds; clamped everywhere."""
    joined = image.join(layer.select(*on, F.col(value).alias("__layer")), list(on))
    if mask is None:
        return joined.withColumn(value, S.overlay(F.col(value), F.col("__layer"), ratio)).drop("__layer")
    keys = [k for k in PIXEL if k in mask.columns]
    joined = joined.join(mask.select(*keys, "masked"), keys, "left")
    hit = F.coalesce(F.col("masked"), F.lit(False))
    return joined.withColumn(value, S.overlay(F.col(value), F.col("__layer"), ratio, hit)).drop("__layer", "masked")


def clamp_image(image: DataFrame, value: str = "v") -> DataFrame:
    return image.withColumn(value, S.clamp(F.col(value)))


def center_crop(image: DataFrame, shape: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """The middle of the image, rows and columns counted from 0 again."""
    require(target[0] <= shape[0] and target[1] <= shape[1], "the crop is larger than the image")
    top, left = shape[0] // 2 - target[0] // 2, shape[1] // 2 - target[1] // 2
    inside = image.where(F.col("row").between(top, top + target[0] - 1) & F.col("col").between(left, left + target[1] - 1))
    return inside.withColumns({"row": F.col("row") - top, "col": F.col("col") - left})


def translate(image: DataFrame, tx: int, ty: int, shape: tuple[int, int], value: str = "v") -> DataFrame:
    """Rows move by tx and columns by ty, cut to the image's size; what comes in is 0.

    The image must have all its pixels. No join: a pixel whose source lies outside is the shifted copy, emptied, of one
    that leaves.
    """
    h, w = shape
    tx, ty = max(-h, min(h, tx)), max(-w, min(w, ty))
    row, col = F.col("row") + tx, F.col("col") + ty
    stays = (row >= 0) & (row < h) & (col >= 0) & (col < w)
    return image.withColumns({"row": F.pmod(row, F.lit(h)), "col": F.pmod(col, F.lit(w)), value: F.when(stays, F.col(value)).otherwise(F.lit(0.0))})


def inpaint(image: DataFrame, *, kernel: int = 3, value: str = "v", missing: Column | None = None, by: Sequence[str] = ("img",)) -> DataFrame:
    """Missing pixels (-1, or where ``missing`` holds) become the mean of the valid ones in the kernel around them;
    one without any stays.

    The box sum is taken along rows, then along columns, by two range windows; channels go into ``by``.
    """
    require(kernel % 2 == 1 and kernel > 0, "kernel must be odd")
    half = kernel // 2
    gone = F.coalesce(F.col(value) == -1 if missing is None else missing, F.lit(True))
    marked = image.withColumn("__gone", gone).withColumns({"__s": F.when(F.col("__gone"), 0.0).otherwise(F.col(value)), "__n": F.when(F.col("__gone"), 0).otherwise(1)})
    along = Window.partitionBy(*by, "row").orderBy("col").rangeBetween(-half, half)
    down = Window.partitionBy(*by, "col").orderBy("row").rangeBetween(-half, half)
    summed = marked.withColumns({"__s": F.sum("__s").over(along), "__n": F.sum("__n").over(along)})
    summed = summed.withColumns({"__s": F.sum("__s").over(down), "__n": F.sum("__n").over(down)})
    return summed.withColumn(value, F.when(F.col("__gone") & (F.col("__n") > 0), F.col("__s") / F.greatest("__n", F.lit(1))).otherwise(F.col(value))).drop("__gone", "__s", "__n")


def _half(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> int:
    return int((a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0]))


def hull_of(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of integer points, in turn; collinear points give their two ends."""
    points = points[np.lexsort((points[:, 1], points[:, 0]))]

    def chain(ps) -> list:
        out: list = []
        for p in ps:
            while len(out) > 1 and _half(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def hull_pixels(points: np.ndarray) -> np.ndarray:
    """(row, col) of all pixels in the hull of some pixels, border included; none for under three."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return np.zeros((0, 2), np.int64)
    corners = hull_of(points)
    out = []
    for row in range(int(points[:, 0].min()), int(points[:, 0].max()) + 1):
        low, high = np.inf, -np.inf
        for (r0, c0), (r1, c1) in zip(corners, np.roll(corners, -1, axis=0)):
            if min(r0, r1) <= row <= max(r0, r1):
                ends = [c0, c1] if r0 == r1 else [c0 + (c1 - c0) * (row - r0) / (r1 - r0)]
                low, high = min(low, *ends), max(high, *ends)
        cols = np.arange(int(np.ceil(low - 1e-9)), int(np.floor(high + 1e-9)) + 1)
        out.append(np.stack([np.full(len(cols), row), cols], axis=1))
    return np.concatenate(out)


def triangulate(points: np.ndarray) -> np.ndarray:
    """Triangles (indices) of the Delaunay triangulation of distinct points, by inserting one after another."""
    n = len(points)
    if n < 3 or not any(_half(points[0], points[1], p) for p in points[2:]):
        return np.zeros((0, 3), np.int64)
    span = int(np.abs(points).max()) + 1
    far = [[-3 * span * 1000, -3 * span * 1000], [3 * span * 1000, 0], [0, 3 * span * 1000]]
    at = [tuple(map(int, p)) for p in [*points.tolist(), *far]]

    def turned(a: int, b: int, c: int) -> tuple[int, int, int]:
        return (a, b, c) if _half(at[a], at[b], at[c]) > 0 else (a, c, b)

    def in_circle(t: tuple[int, int, int], p: int) -> bool:
        m = [(at[i][0] - at[p][0], at[i][1] - at[p][1]) for i in t]
        q = [x * x + y * y for x, y in m]
        return m[0][0] * (m[1][1] * q[2] - m[2][1] * q[1]) - m[0][1] * (m[1][0] * q[2] - m[2][0] * q[1]) + q[0] * (m[1][0] * m[2][1] - m[2][0] * m[1][1]) > 0

    triangles = {turned(n, n + 1, n + 2)}
    for p in range(n):
        bad = {t for t in triangles if in_circle(t, p)}
        edges: dict[frozenset, int] = {}
        for a, b, c in bad:
            for e in ((a, b), (b, c), (c, a)):
                edges[frozenset(e)] = edges.get(frozenset(e), 0) + 1
        triangles -= bad
        triangles |= {turned(*e, p) for e, k in ((tuple(x), k) for x, k in edges.items()) if k == 1 and _half(at[e[0]], at[e[1]], at[p])}
    return np.array(sorted(sorted(t) for t in triangles if max(t) < n), np.int64).reshape(-1, 3)


def _fill(masks: DataFrame, pixels) -> DataFrame:
    def fill(at: pd.DataFrame) -> pd.DataFrame:
        found = pixels(at[["row", "col"]].to_numpy(np.int64))
        return pd.DataFrame({"img": at.img.iloc[0], "row": found[:, 0].astype("int32"), "col": found[:, 1].astype("int32")})

    return masks.select("img", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).groupBy("img").applyInPandas(fill, "img long, row int, col int")


def fill_convex_hull(masks: DataFrame) -> DataFrame:
    """(img, row, col) of the pixels in the hull of each image's true pixels; an image fits one task."""
    return _fill(masks, hull_pixels)


def fill_delaunay(masks: DataFrame) -> DataFrame:
    """The same by the union of Delaunay triangles; collinear pixels have none."""

    def pixels(points: np.ndarray) -> np.ndarray:
        points = np.unique(points, axis=0)
        parts = [hull_pixels(points[list(t)]) for t in triangulate(points)]
        return np.unique(np.concatenate(parts), axis=0) if parts else np.zeros((0, 2), np.int64)

    return _fill(masks, pixels)


def delaunay_triangles(masks: DataFrame) -> DataFrame:
    """(img, a, b, c): corners of each triangle as places in the row-major order of the image's true pixels."""

    def run(at: pd.DataFrame) -> pd.DataFrame:
        found = triangulate(np.unique(at[["row", "col"]].to_numpy(np.int64), axis=0))
        return pd.DataFrame({"img": at.img.iloc[0], "a": found[:, 0], "b": found[:, 1], "c": found[:, 2]})

    return masks.select("img", "row", "col").groupBy("img").applyInPandas(run, "img long, a long, b long, c long")
