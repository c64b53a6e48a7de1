"""Voxel grids as group-bys on computed keys; first-per-voxel; subtraction by voxel."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks import require
from ..plans.physical import floor_div

XYZ = ("x", "y", "z")
KEYS = ["vx", "vy", "vz"]


def sizes_of(size: float | Sequence[float]) -> list[float]:
    found = [abs(float(s)) for s in (size if isinstance(size, Sequence) else [size] * 3)]
    require(len(found) == 3 and all(s > 0 for s in found), "voxel size must be one or three positive numbers")
    return found


def voxel_keys(size: float | Sequence[float], xyz: Sequence[str] = XYZ) -> list[Column]:
    """floor(p / size) on each axis; an infinite size makes the axis one cell."""
    return [(F.lit(0) if math.isinf(s) else F.floor(F.col(c) / s)).cast("bigint").alias(k) for c, s, k in zip(xyz, sizes_of(size), KEYS)]


def with_voxels(points: DataFrame, size: float | Sequence[float], xyz: Sequence[str] = XYZ) -> DataFrame:
    return points.select("*", *voxel_keys(size, xyz))


def voxel_grid(points: DataFrame, size: float | Sequence[float], *, xyz: Sequence[str] = XYZ, attributes: Sequence[str] = (), vectors: dict[str, int] | None = None) -> DataFrame:
    """One row a voxel: key, count, centroid (cx, cy, cz), centre (mx, my, mz), mean of each attribute.

    ``vectors`` names array attributes with their length; their mean is an array.  One partial aggregate and one
    exchange; nothing is sorted.
    """
    aggregates = [F.count(F.lit(1)).alias("count"), *[F.avg(c).alias(f"c{a}") for a, c in zip("xyz", xyz)], *[F.avg(a).alias(a) for a in attributes]]
    for name, length in (vectors or {}).items():
        aggregates.append(F.array(*[F.avg(F.col(name)[i]) for i in range(length)]).alias(name))
    centre = [(F.lit(0.0) if math.isinf(s) else F.col(k) * s + s / 2).alias(f"m{a}") for a, k, s in zip("xyz", KEYS, sizes_of(size))]
    grid = with_voxels(points, size, xyz).groupBy(*KEYS).agg(*aggregates)
    return grid.select(*KEYS, "count", "cx", "cy", "cz", *centre, *attributes, *(vectors or {}))


def voxel_indices(points: DataFrame, size, xyz: Sequence[str] = XYZ) -> DataFrame:
    return points.select(*voxel_keys(size, xyz)).distinct()


def voxel_number(points: DataFrame, size, xyz: Sequence[str] = XYZ) -> DataFrame:
    return voxel_indices(points, size, xyz).agg(F.count(F.lit(1)).alias("voxels"))


def voxel_order(points: DataFrame, size, *, idx: str = "idx", xyz: Sequence[str] = XYZ) -> DataFrame:
    """(idx, position): the rank of each point in the order of voxels, then idx.

    Positions are prefix sums of counts, axis by axis: slabs of one vx are added up over the whole table, columns of one
    vy within their slab, voxels within their column, points within their voxel; so no task orders more than one of these.
    """
    keyed = with_voxels(points, size, xyz)
    counts, base = keyed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("__n")), None
    for n in range(len(KEYS)):
        above, own = KEYS[:n], KEYS[: n + 1]
        here = counts.groupBy(*own).agg(F.sum("__n").alias("__n"))
        upto = F.sum("__n").over(Window.partitionBy(*above).orderBy(KEYS[n])) - F.col("__n")
        here = here.select(*own, upto.alias("__here"))
        base = here.withColumnRenamed("__here", "__base") if base is None else here.join(base, above).select(*own, (F.col("__base") + F.col("__here")).alias("__base"))
    within = F.row_number().over(Window.partitionBy(*KEYS).orderBy(idx)) - 1
    return keyed.withColumn("__within", within).join(base, KEYS).select(idx, (F.col("__base") + F.col("__within")).alias("position"))


def floor_keys(size, xyz: Sequence[str] = XYZ) -> list[Column]:
    return [floor_div(F.col(c).cast("double"), s).alias(k) for c, s, k in zip(xyz, sizes_of(size), KEYS)]


def unique_points(points: DataFrame, size=0.2, *, idx: str = "idx", xyz: Sequence[str] = XYZ) -> DataFrame:
    """The row with the smallest idx of each voxel, by floor division. Pre-aggregates before the exchange."""
    rest = [c for c in points.columns if c != idx]
    first = F.min_by(F.struct(*rest), idx) if rest else F.lit(None)
    picked = points.select("*", *floor_keys(size, xyz)).groupBy(*KEYS).agg(F.min(idx).alias(idx), first.alias("__row"))
    return picked.select(*[F.col(idx) if c == idx else F.col(f"__row.{c}") for c in points.columns])


def subtract_points(a: DataFrame, b: DataFrame, size=0.2, *, xyz: Sequence[str] = XYZ) -> DataFrame:
    """Rows of ``a`` in voxels that ``b`` does not touch."""
    return a.select("*", *floor_keys(size, xyz)).join(b.select(*floor_keys(size, xyz)).distinct(), KEYS, "left_anti").drop(*KEYS)


def subtraction_mask(a: DataFrame, b: DataFrame, size=0.2, *, xyz: Sequence[str] = XYZ) -> DataFrame:
    """Every row of ``a`` with ``kept``."""
    hit = b.select(*floor_keys(size, xyz)).distinct().withColumn("__hit", F.lit(True))
    return a.select("*", *floor_keys(size, xyz)).join(hit, KEYS, "left").withColumn("kept", F.col("__hit").isNull()).drop(*KEYS, "__hit")
