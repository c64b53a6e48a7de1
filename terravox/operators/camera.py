"""Projection of points into a pinhole camera: field of view, closest point a pixel, dense maps, back-projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..plans.physical import dense_grid

IDENTITY = ((1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0))


@dataclass(frozen=True)
class Camera:
    """A 3 x 3 intrinsic, a 4 x 4 camera-to-world extrinsic, and the image's size."""

    intrinsic: Sequence[Sequence[float]]
    height: int
    width: int
    extrinsic: Sequence[Sequence[float]] = IDENTITY

    def pose(self) -> tuple[G.Mat, G.Vec]:
        return G.lit_mat([r[:3] for r in self.extrinsic[:3]]), G.lit_vec([r[3] for r in self.extrinsic[:3]])

    def to_camera(self, point: G.Vec) -> G.Vec:
        return G.world_to_camera(point, *self.pose())

    def pixel(self, point: G.Vec) -> tuple[Column, Column]:
        """(u, v) of a point in camera coordinates; null unless z is positive."""
        z = F.when(point[2] > 0, point[2])
        u, v, _ = G.apply(G.lit_mat(self.intrinsic), [point[0] / z, point[1] / z, F.lit(1.0)])
        return u, v


def project(points: DataFrame, camera: Camera, *, xyz: Sequence[str] = ("x", "y", "z"), in_camera: bool = False) -> DataFrame:
    """Adds cam_x, cam_y, depth, u, v, row and col; pixel columns are null behind the camera."""
    p = [F.col(c).cast("double") for c in xyz]
    p = p if in_camera else camera.to_camera(p)
    out = points.withColumns({"cam_x": p[0], "cam_y": p[1], "depth": p[2]})
    u, v = camera.pixel([F.col("cam_x"), F.col("cam_y"), F.col("depth")])
    return out.withColumns({"u": u, "v": v}).withColumns({"row": F.floor("v").cast("int"), "col": F.floor("u").cast("int")})


def field_of_view(points: DataFrame, camera: Camera, *, min_distance: float | None = None, max_distance: float | None = None, closest_only: bool = False, idx: str = "idx", xyz: Sequence[str] = ("x", "y", "z"), in_camera: bool = False) -> DataFrame:
    """Projected points that fall into the image, in front of the camera; limits are on depth, strict."""
    seen = project(points, camera, xyz=xyz, in_camera=in_camera)
    ok = (F.col("depth") > 0) & (F.col("u") >= 0) & (F.col("u") < camera.width) & (F.col("v") >= 0) & (F.col("v") < camera.height)
    if max_distance is not None:
        ok = ok & (F.col("depth") < max_distance)
    if min_distance is not None:
        ok = ok & (F.col("depth") > min_distance)
    seen = seen.where(ok)
    return closest_per_pixel(seen, idx=idx) if closest_only else seen


def closest_per_pixel(projected: DataFrame, *, idx: str = "idx", by: Sequence[str] = ()) -> DataFrame:
    """The nearest point of each pixel, ties to the smallest idx: a partial aggregate, no sort by pixel."""
    keys = [*by, "row", "col"]
    rest = [c for c in projected.columns if c not in (*keys, "depth", idx)]
    best = F.min(F.struct("depth", idx, *rest)).alias("__best")
    return projected.groupBy(*keys).agg(best).select(*keys, "__best.*").select(projected.columns)


def dense_map(points: DataFrame, camera: Camera, values: dict[str, Column], *, invalid: float = -1, idx: str = "idx", **limits) -> DataFrame:
    """(row, col, values) of every pixel: columns of its nearest point, ``invalid`` where there is none."""
    near = field_of_view(points, camera, closest_only=True, idx=idx, **limits).select("row", "col", *[c.alias(n) for n, c in values.items()])
    grid = dense_grid(points.sparkSession, camera.height, camera.width)
    return grid.join(near, ["row", "col"], "left").select("row", "col", *[F.coalesce(F.col(n), F.lit(invalid)).alias(n) for n in values])


def index_map(points: DataFrame, camera: Camera, *, idx: str = "idx", **limits) -> DataFrame:
    return dense_map(points, camera, {"index": F.col(idx)}, invalid=-1, idx=idx, **limits)


def depth_image(points: DataFrame, camera: Camera, *, invalid: float = -1, **limits) -> DataFrame:
    return dense_map(points, camera, {"depth": F.col("depth")}, invalid=invalid, **limits)


def point_map(points: DataFrame, camera: Camera, *, xyz: Sequence[str] = ("x", "y", "z"), attributes: Sequence[str] = (), details: bool = False, invalid: float = -1, **limits) -> DataFrame:
    """World coordinates of each pixel's point, with further attributes; ``details`` adds u, v and whether there is one."""
    values = {c: F.col(c) for c in (*xyz, *attributes)} | ({"u": F.col("u"), "v": F.col("v"), "filled": F.lit(1)} if details else {})
    out = dense_map(points, camera, values, invalid=invalid, xyz=xyz, **limits)
    return out.withColumn("filled", F.col("filled") == 1) if details else out


def depth_to_points(depth: DataFrame, camera: Camera, *, value: str = "depth", offset: float = 0.5, scale: float = 1.0, valid_only: bool = False) -> DataFrame:
    """World coordinates x, y, z of each pixel's depth; pixels without a depth are projected too unless ``valid_only``."""
    (a, b, c), (d, e, f), (g, h, i) = [[float(v) for v in r] for r in camera.intrinsic]
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    inverse = [[(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det], [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det], [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det]]
    z = F.col(value) * float(scale)
    ray = G.apply(G.lit_mat(inverse), [F.col("col") + offset, F.col("row") + offset, F.lit(1.0)])
    world = G.camera_to_world([r * z for r in ray], *camera.pose())
    rows = depth.where(F.col(value) > 0) if valid_only else depth
    return rows.withColumns(dict(zip("xyz", world)))


def lookup_pixels(points: DataFrame, camera: Camera, image: DataFrame, *, xyz: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Each point with the image's columns at its pixel; a point outside the image fails the query."""
    seen = project(points, camera, xyz=xyz)
    ok = (F.col("depth") > 0) & (F.col("u") >= 0) & (F.col("u") < camera.width) & (F.col("v") >= 0) & (F.col("v") < camera.height)
    row = F.when(F.coalesce(ok, F.lit(False)), F.col("row")).otherwise(F.raise_error(F.lit("a point lies outside the image")))
    return seen.withColumn("row", row).join(image, ["row", "col"])
