"""Queries of voxels, geometry, cameras and images."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalar as S
from ..operators import camera, images, voxels
from .common import P, points, r6, sql6, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return wrap


_KEYED = f"WITH p AS ({P}), k AS (SELECT *, CAST(floor(x / 0.1) AS BIGINT) AS vx, CAST(floor(y / 0.1) AS BIGINT) AS vy, CAST(floor(z / 0.1) AS BIGINT) AS vz FROM p) "


@query("voxel_downsample", _KEYED + "SELECT vx, vy, vz, count(*) AS count, round(avg(x), 6) + 0.0 AS cx, round(avg(y), 6) + 0.0 AS cy, round(avg(z), 6) + 0.0 AS cz FROM k GROUP BY vx, vy, vz")
def voxel_downsample(spark, d):
    return voxels.voxel_grid(points(spark, d), 0.1).select("vx", "vy", "vz", "count", *r6("cx", "cy", "cz"))


@query("voxel_counts", _KEYED + "SELECT vx, vy, vz, count(*) AS count FROM k GROUP BY vx, vy, vz")
def _(spark, d):
    return voxels.voxel_grid(points(spark, d), 0.1).select("vx", "vy", "vz", "count")


@query("voxel_centers", _KEYED + "SELECT DISTINCT vx, vy, vz, round(CAST(vx * 0.1 + 0.05 AS DOUBLE), 6) + 0.0 AS mx, round(CAST(vy * 0.1 + 0.05 AS DOUBLE), 6) + 0.0 AS my, round(CAST(vz * 0.1 + 0.05 AS DOUBLE), 6) + 0.0 AS mz FROM k")
def _(spark, d):
    return voxels.voxel_grid(points(spark, d), 0.1).select("vx", "vy", "vz", *r6("mx", "my", "mz"))


@query("voxel_attributes", _KEYED + "SELECT vx, vy, vz, round(avg(label), 6) + 0.0 AS label, round(avg(embedding[5]), 6) + 0.0 AS a0, round(avg(embedding[6]), 6) + 0.0 AS a1 FROM k GROUP BY vx, vy, vz")
def _(spark, d):
    cloud = points(spark, d, "label", F.array(F.col("embedding")[4], F.col("embedding")[5]).alias("pair"))
    grid = voxels.voxel_grid(cloud, [0.1, 0.1, 0.1], attributes=["label"], vectors={"pair": 2})
    return grid.select("vx", "vy", "vz", "label", F.col("pair")[0].alias("a0"), F.col("pair")[1].alias("a1")).select("vx", "vy", "vz", *r6("label", "a0", "a1"))


@query("voxel_flat_axis", f"WITH p AS ({P}) SELECT CAST(floor(x / 0.1) AS BIGINT) AS vx, CAST(floor(y / 0.1) AS BIGINT) AS vy, CAST(0 AS BIGINT) AS vz, count(*) AS count, CAST(0 AS DOUBLE) AS mz FROM p GROUP BY 1, 2")
def _(spark, d):
    return voxels.voxel_grid(points(spark, d), [0.1, -0.1, math.inf]).select("vx", "vy", "vz", "count", *r6("mz"))


@query("voxel_permutation", _KEYED + "SELECT idx, row_number() OVER (ORDER BY vx, vy, vz, idx) - 1 AS position FROM k")
def _(spark, d):
    return voxels.voxel_order(points(spark, d), 0.1)


@query("voxel_number", _KEYED + "SELECT count(*) AS voxels FROM (SELECT DISTINCT vx, vy, vz FROM k)")
def _(spark, d):
    return voxels.voxel_number(points(spark, d), 0.1)


def _floor(c: str) -> str:
    return f"CAST(round(({c} - {c} % 0.2) / 0.2 - CASE WHEN {c} % 0.2 < 0 THEN 1 ELSE 0 END) AS BIGINT)"


_FLOORED = f"WITH p AS ({P}), k AS (SELECT *, {_floor('x')} AS vx, {_floor('y')} AS vy, {_floor('z')} AS vz FROM p) "


@query("unique_points", _FLOORED + f"SELECT idx, {sql6('x', 'y', 'z')} FROM (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY idx) AS n FROM k) WHERE n = 1")
def _(spark, d):
    return voxels.unique_points(points(spark, d), 0.2).select("idx", *r6("x", "y", "z"))


@query("subtract_points", _FLOORED + "SELECT idx FROM k a WHERE label < 5 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.label >= 5 AND a.vx = b.vx AND a.vy = b.vy AND a.vz = b.vz)")
def _(spark, d):
    cloud = points(spark, d, "label")
    return voxels.subtract_points(cloud.where("label < 5"), cloud.where("label >= 5")).select("idx")


@query("subtraction_mask", _FLOORED + "SELECT idx, NOT EXISTS (SELECT 1 FROM k b WHERE b.label >= 5 AND a.vx = b.vx AND a.vy = b.vy AND a.vz = b.vz) AS kept FROM k a WHERE label < 5")
def _(spark, d):
    cloud = points(spark, d, "label")
    return voxels.subtraction_mask(cloud.where("label < 5"), cloud.where("label >= 5")).select("idx", "kept")


def _slots(first: int, n: int):
    return [F.col("embedding")[first + i].cast("double") for i in range(n)]


def _flat(matrix, prefix: str = "r"):
    return [c.alias(f"{prefix}{i}{j}") for i, row in enumerate(matrix) for j, c in enumerate(row)]


_NINE = [f"r{i}{j}" for i in range(3) for j in range(3)]
_Q = "SELECT vec_id, CAST(embedding[{0}] AS DOUBLE) / l AS x, CAST(embedding[{0}+1] AS DOUBLE) / l AS y, CAST(embedding[{0}+2] AS DOUBLE) / l AS z, CAST(embedding[{0}+3] AS DOUBLE) / l AS w FROM (SELECT *, sqrt(CAST(embedding[{0}] AS DOUBLE)**2 + CAST(embedding[{0}+1] AS DOUBLE)**2 + CAST(embedding[{0}+2] AS DOUBLE)**2 + CAST(embedding[{0}+3] AS DOUBLE)**2) AS l FROM embeddings)"
_R = "SELECT vec_id, 1-2*(y*y+z*z) AS r00, 2*(x*y-z*w) AS r01, 2*(x*z+y*w) AS r02, 2*(x*y+z*w) AS r10, 1-2*(x*x+z*z) AS r11, 2*(y*z-x*w) AS r12, 2*(x*z-y*w) AS r20, 2*(y*z+x*w) AS r21, 1-2*(x*x+y*y) AS r22 FROM ({0})"


@query("quaternion_to_matrix", f"SELECT vec_id, {sql6(*_NINE)} FROM ({_R.format(_Q.format(4))})")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", *_flat(G.quaternion_to_matrix(_slots(3, 4)))).select("vec_id", *r6(*_NINE))


@query(
    "euler_to_matrix",
    f"""SELECT vec_id, {sql6(*_NINE)} FROM (SELECT vec_id, cos(p)*cos(y) AS r00, cos(p)*sin(y) AS r01, -sin(p) AS r02,
 sin(r)*sin(p)*cos(y)-cos(r)*sin(y) AS r10, sin(r)*sin(p)*sin(y)+cos(r)*cos(y) AS r11, sin(r)*cos(p) AS r12,
 cos(r)*sin(p)*cos(y)+sin(r)*sin(y) AS r20, cos(r)*sin(p)*sin(y)-sin(r)*cos(y) AS r21, cos(r)*cos(p) AS r22
 FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS r, CAST(embedding[2] AS DOUBLE) AS p, CAST(embedding[3] AS DOUBLE) AS y FROM embeddings))""",
)
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", *_flat(G.euler_to_matrix(_slots(0, 3)))).select("vec_id", *r6(*_NINE))


@query("matrix_to_euler", f"SELECT vec_id, round(atan2(r21, r22), 6) + 0.0 AS roll, round(atan2(-r20, sqrt(r00*r00 + r10*r10)), 6) + 0.0 AS pitch, round(atan2(r10, r00), 6) + 0.0 AS yaw FROM ({_R.format(_Q.format(4))})")
def _(spark, d):
    angles = G.matrix_to_euler(G.quaternion_to_matrix(_slots(3, 4)))
    return table(spark, d, "embeddings").select("vec_id", *[a.alias(n) for a, n in zip(angles, ("roll", "pitch", "yaw"))]).select("vec_id", *r6("roll", "pitch", "yaw"))


@query("matrix_to_quaternion", f"SELECT vec_id, round(x*s, 6) + 0.0 AS qx, round(y*s, 6) + 0.0 AS qy, round(z*s, 6) + 0.0 AS qz, round(w*s, 6) + 0.0 AS qw FROM (SELECT *, CASE WHEN w < 0 THEN -1 ELSE 1 END AS s FROM ({_Q.format(4)}))")
def _(spark, d):
    q = G.matrix_to_quaternion(G.quaternion_to_matrix(_slots(3, 4)))
    named = table(spark, d, "embeddings").select("vec_id", *[c.alias(n) for c, n in zip(q, ("qx", "qy", "qz", "qw"))])
    sign = F.when(F.col("qw") < 0, -1.0).otherwise(1.0)  # q and -q are one rotation
    return named.select("vec_id", *[(F.col(c) * sign).alias(c) for c in ("qx", "qy", "qz", "qw")]).select("vec_id", *r6("qx", "qy", "qz", "qw"))


_T = "CAST(embedding[1] AS DOUBLE) AS tx, CAST(embedding[2] AS DOUBLE) AS ty, CAST(embedding[3] AS DOUBLE) AS tz"


@query("pose_inverse", f"SELECT m.vec_id, {sql6('r01', 'r12', 'r20')}, round(-(r00*tx+r10*ty+r20*tz), 6) + 0.0 AS t0, round(-(r01*tx+r11*ty+r21*tz), 6) + 0.0 AS t1, round(-(r02*tx+r12*ty+r22*tz), 6) + 0.0 AS t2 FROM ({_R.format(_Q.format(4))}) m JOIN (SELECT vec_id, {_T} FROM embeddings) t ON m.vec_id = t.vec_id")
def _(spark, d):
    r, t = G.invert_pose(G.quaternion_to_matrix(_slots(3, 4)), _slots(0, 3))
    out = table(spark, d, "embeddings").select("vec_id", *_flat(G.transpose(r)), *[c.alias(f"t{i}") for i, c in enumerate(t)])
    return out.select("vec_id", *r6("r01", "r12", "r20", "t0", "t1", "t2"))


@query(
    "pose_compose",
    f"""SELECT a.vec_id, round(b.r00*a.r00+b.r01*a.r10+b.r02*a.r20, 6) + 0.0 AS r00, round(b.r10*a.r02+b.r11*a.r12+b.r12*a.r22, 6) + 0.0 AS r12,
 round(b.r00*tx+b.r01*ty+b.r02*tz+ux, 6) + 0.0 AS t0, round(b.r10*tx+b.r11*ty+b.r12*tz+uy, 6) + 0.0 AS t1, round(b.r20*tx+b.r21*ty+b.r22*tz+uz, 6) + 0.0 AS t2
 FROM ({_R.format(_Q.format(4))}) a JOIN ({_R.format(_Q.format(8))}) b ON a.vec_id = b.vec_id
 JOIN (SELECT vec_id, {_T}, CAST(embedding[12] AS DOUBLE) AS ux, CAST(embedding[13] AS DOUBLE) AS uy, CAST(embedding[14] AS DOUBLE) AS uz FROM embeddings) t ON t.vec_id = a.vec_id""",
)
def _(spark, d):
    r, t = G.compose_poses(G.quaternion_to_matrix(_slots(3, 4)), _slots(0, 3), G.quaternion_to_matrix(_slots(7, 4)), _slots(11, 3))
    out = table(spark, d, "embeddings").select("vec_id", r[0][0].alias("r00"), r[1][2].alias("r12"), *[c.alias(f"t{i}") for i, c in enumerate(t)])
    return out.select("vec_id", *r6("r00", "r12", "t0", "t1", "t2"))


@query("transform_points", f"SELECT m.vec_id, round(r00*px+r01*py+r02*pz+tx, 6) + 0.0 AS x, round(r10*px+r11*py+r12*pz+ty, 6) + 0.0 AS y, round(r20*px+r21*py+r22*pz+tz, 6) + 0.0 AS z FROM ({_R.format(_Q.format(4))}) m JOIN (SELECT vec_id, {_T}, CAST(embedding[8] AS DOUBLE) AS px, CAST(embedding[9] AS DOUBLE) AS py, CAST(embedding[10] AS DOUBLE) AS pz FROM embeddings) t ON m.vec_id = t.vec_id")
def _(spark, d):
    p = G.camera_to_world(_slots(7, 3), G.quaternion_to_matrix(_slots(3, 4)), _slots(0, 3))
    return table(spark, d, "embeddings").select("vec_id", *[c.alias(n) for c, n in zip(p, "xyz")]).select("vec_id", *r6("x", "y", "z"))


#: Corners in the order that ``inside_box`` takes: a box turned by 30 degrees about z, sides 0.4, 0.3, 0.5.
_C, _S_ = math.cos(math.pi / 6), math.sin(math.pi / 6)
_SIGNS = [(1, 1, 1), (1, 1, -1), (1, -1, -1), (1, -1, 1), (-1, 1, 1), (-1, 1, -1), (-1, -1, -1), (-1, -1, 1)]
_BOX = [(0.2 * a * _C - 0.15 * b * _S_, 0.2 * a * _S_ + 0.15 * b * _C, 0.25 * c) for a, b, c in _SIGNS]


@query("box_filter", f"WITH p AS ({P}) SELECT idx FROM p WHERE abs(x * {_C!r} + y * {_S_!r}) <= 0.2 AND abs(-x * {_S_!r} + y * {_C!r}) <= 0.15 AND abs(z) <= 0.25")
def _(spark, d):
    return points(spark, d).where(G.inside_box([F.col(c) for c in "xyz"], _BOX)).select("idx")


CAMERA = camera.Camera(((200.0, 0.0, 32.0), (0.0, 200.0, 24.0), (0.0, 0.0, 1.0)), 48, 64)


def _seen(spark, d):
    return points(spark, d).withColumn("z", F.col("z") + 2)


_FOV = f"""WITH p AS (SELECT idx, x, y, z + 2 AS z FROM ({P})),
 c AS (SELECT *, 200 * (x / z) + 32 AS u, 200 * (y / z) + 24 AS v FROM p WHERE z > 0),
 f AS (SELECT *, CAST(floor(v) AS INTEGER) AS row, CAST(floor(u) AS INTEGER) AS col FROM c WHERE u >= 0 AND u < 64 AND v >= 0 AND v < 48),
 n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY z, idx) AS k FROM f) WHERE k = 1),
 g AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM range(48) a(r), range(64) b(c)) """


@query("camera_fov", _FOV + f"SELECT idx, {sql6('u', 'v')} FROM f WHERE z < 2.2 AND z > 1.8")
def _(spark, d):
    return camera.field_of_view(_seen(spark, d), CAMERA, min_distance=1.8, max_distance=2.2).select("idx", *r6("u", "v"))


@query("closest_per_pixel", _FOV + "SELECT row, col, idx FROM n")
def _(spark, d):
    return camera.field_of_view(_seen(spark, d), CAMERA, closest_only=True).select("row", "col", "idx")


@query("index_map", _FOV + "SELECT g.row, g.col, coalesce(n.idx, -1) AS index FROM g LEFT JOIN n ON g.row = n.row AND g.col = n.col")
def _(spark, d):
    return camera.index_map(_seen(spark, d), CAMERA).select("row", "col", F.col("index").cast("bigint").alias("index"))


@query("depth_map", _FOV + "SELECT g.row, g.col, round(coalesce(n.z, -1), 6) + 0.0 AS depth FROM g LEFT JOIN n ON g.row = n.row AND g.col = n.col")
def _(spark, d):
    return camera.depth_image(_seen(spark, d), CAMERA).select("row", "col", *r6("depth"))


@query("point_map", _FOV + f"SELECT g.row, g.col, {', '.join(f'round(coalesce(n.{c}, -1), 6) + 0.0 AS {c}' for c in 'xyz')}, n.idx IS NOT NULL AS filled FROM g LEFT JOIN n ON g.row = n.row AND g.col = n.col")
def _(spark, d):
    return camera.point_map(_seen(spark, d), CAMERA, details=True).select("row", "col", *r6("x", "y", "z"), F.coalesce("filled", F.lit(False)).alias("filled"))


@query("depth_to_points", _FOV + ", q AS (SELECT g.row, g.col, coalesce(n.z, -1) AS d FROM g LEFT JOIN n ON g.row = n.row AND g.col = n.col) SELECT row, col, round((col + 0.5 - 32) / 200 * d, 6) + 0.0 AS x, round((row + 0.5 - 24) / 200 * d, 6) + 0.0 AS y, round(d, 6) + 0.0 AS z FROM q")
def _(spark, d):
    return camera.depth_to_points(camera.depth_image(_seen(spark, d), CAMERA), CAMERA).select("row", "col", *r6("x", "y", "z"))


@query("pixel_lookup", _FOV + "SELECT f.idx, CAST(f.row * 1000 + f.col AS BIGINT) AS code FROM f")
def _(spark, d):
    inside = camera.field_of_view(_seen(spark, d), CAMERA).select("idx", "x", "y", "z")
    image = camera.dense_grid(spark, 48, 64).withColumn("code", (F.col("row") * 1000 + F.col("col")).cast("bigint"))
    return camera.lookup_pixels(inside, CAMERA, image).select("idx", "code")


@query("viewer_angles", f"SELECT vec_id, round(atan2(-r12, -r02), 6) + 0.0 AS phi, round(atan2(-r22, sqrt(r02*r02 + r12*r12)), 6) + 0.0 AS theta, CAST(1 AS DOUBLE) AS r FROM ({_R.format(_Q.format(4))})")
def _(spark, d):
    at = G.viewer_angles(G.quaternion_to_matrix(_slots(3, 4)), _slots(0, 3), CAMERA.intrinsic, 48, 64)
    return table(spark, d, "embeddings").select("vec_id", at["phi"].alias("phi"), at["theta"].alias("theta"), at["r"].alias("r")).select("vec_id", *r6("phi", "theta", "r"))


@query("intrinsics", "SELECT n_nationkey, CAST(200 AS DOUBLE) AS fx, CAST(180 AS DOUBLE) AS fy, CAST(n_nationkey AS DOUBLE) - 16 AS cx, CAST(n_nationkey AS DOUBLE) * 2 - 12 AS cy FROM nation")
def _(spark, d):
    k = F.col("n_nationkey").cast("double")
    fx, fy, _, _ = G.scale_intrinsics(F.lit(100.0), F.lit(120.0), k, k * 2, (48, 64), (72, 128))
    _, _, cx, cy = G.center_crop_intrinsics(F.lit(100.0), F.lit(120.0), k, k * 2, (48, 64), (24, 32))
    return table(spark, d, "nation").select("n_nationkey", *[c.alias(n) for c, n in zip((fx, fy, cx, cy), ("fx", "fy", "cx", "cy"))]).select("n_nationkey", *r6("fx", "fy", "cx", "cy"))


def _image(spark, d):
    """One image: a row for each vector, a column for each slot."""
    pixels = table(spark, d, "embeddings").select(F.lit(0).alias("img"), F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "v"))
    return pixels.withColumn("v", F.col("v").cast("double"))


_IMAGE = "WITH i AS (SELECT CAST(vec_id AS INTEGER) AS row, unnest(range(0, 64)) AS col, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) "


@query(
    "image_inpaint",
    _IMAGE
    + """, a AS (SELECT row, col, v, sum(CASE WHEN v < 0 THEN 0 ELSE v END) OVER w AS s, sum(CASE WHEN v < 0 THEN 0 ELSE 1 END) OVER w AS n FROM i WINDOW w AS (PARTITION BY row ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
 b AS (SELECT row, col, v, sum(s) OVER w AS s, sum(n) OVER w AS n FROM a WINDOW w AS (PARTITION BY col ORDER BY row ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
 SELECT row, CAST(col AS INTEGER) AS col, round(CASE WHEN v < 0 AND n > 0 THEN s / n ELSE v END, 6) + 0.0 AS v FROM b""",
)
def _(spark, d):
    return images.inpaint(_image(spark, d), missing=F.col("v") < 0).select("row", "col", *r6("v"))


@query("image_blend", _IMAGE + "SELECT row, CAST(col AS INTEGER) AS col, round(greatest(least(CASE WHEN col % 2 = 0 THEN 0.3 * v + 0.7 * (v * v) ELSE v END, 1), 0), 6) + 0.0 AS v FROM i")
def _(spark, d):
    image = _image(spark, d)
    layer, mask = image.withColumn("v", F.col("v") * F.col("v")), image.select("img", "row", "col", (F.col("col") % 2 == 0).alias("masked"))
    return images.overlay_image(image, layer, ratio=0.3, mask=mask).select("row", "col", *r6("v"))


@query(
    "image_crop",
    _IMAGE
    + """, n AS (SELECT count(*) AS h, count(*) // 2 AS t FROM embeddings)
 SELECT CAST(row - (h // 2 - t // 2) AS INTEGER) AS row, CAST(col - 17 AS INTEGER) AS col, round(v, 6) + 0.0 AS v FROM i, n
 WHERE row >= h // 2 - t // 2 AND row < h // 2 - t // 2 + t AND col BETWEEN 17 AND 46""",
)
def _(spark, d):
    height = table(spark, d, "embeddings").count()
    return images.center_crop(_image(spark, d), (height, 64), (height // 2, 30)).select("row", "col", *r6("v"))


@query("image_translate", _IMAGE + "SELECT i.row, CAST(i.col AS INTEGER) AS col, round(coalesce(o.v, 0), 6) + 0.0 AS v FROM i LEFT JOIN i o ON o.row = i.row - 5 AND o.col = i.col + 9")
def _(spark, d):
    height = table(spark, d, "embeddings").count()
    return images.translate(_image(spark, d), 5, -9, (height, 64)).select("row", "col", *r6("v"))


@query(
    "hsv_to_rgb",
    f"""WITH p AS (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) AS h, abs(CAST(embedding[2] AS DOUBLE)) AS s, abs(CAST(embedding[3] AS DOUBLE)) AS v FROM embeddings),
 c AS (SELECT *, CAST(floor(h * 6) AS INTEGER) AS i, h * 6 - floor(h * 6) AS f FROM p), q AS (SELECT *, v*(1-s) AS a, v*(1-s*f) AS b, v*(1-s*(1-f)) AS t FROM c)
 SELECT vec_id, round([v, b, a, a, t, v][i % 6 + 1], 6) + 0.0 AS r, round([t, v, v, b, a, a][i % 6 + 1], 6) + 0.0 AS g, round([a, a, t, v, v, b][i % 6 + 1], 6) + 0.0 AS b FROM q""",
)
def _(spark, d):
    rgb = S.hsv_to_rgb(*[F.abs(c) for c in _slots(0, 3)])
    return table(spark, d, "embeddings").select("vec_id", *[c.alias(n) for c, n in zip(rgb, "rgb")]).select("vec_id", *r6("r", "g", "b"))


@query(
    "colour_map",
    """WITH p AS (SELECT event_id, greatest(least((value - 50) / 350, 1), 0) * 4 AS t FROM events)
 SELECT event_id, round(CASE WHEN t <= 2 THEN 0 WHEN t <= 3 THEN t - 2 ELSE 1 END, 6) + 0.0 AS r,
 round(CASE WHEN t <= 1 THEN t WHEN t <= 3 THEN 1 ELSE 4 - t END, 6) + 0.0 AS g, round(CASE WHEN t <= 1 THEN 1 WHEN t <= 2 THEN 2 - t ELSE 0 END, 6) + 0.0 AS b FROM p""",
)
def _(spark, d):
    rgb = S.color_of(F.col("value"), 50, 400)
    return table(spark, d, "events").select("event_id", *[c.alias(n) for c, n in zip(rgb, "rgb")]).select("event_id", *r6("r", "g", "b"))


def _blocks(spark, d):
    """Masks of 40 rows each: pixels over 0.25."""
    return _image(spark, d).where("v > 0.25").select(F.floor(F.col("row") / 40).alias("img"), (F.col("row") % 40).cast("int").alias("row"), "col")


@query("hull_fill")
def _(spark, d):
    return images.fill_convex_hull(_blocks(spark, d))


@query("delaunay_fill")
def _(spark, d):
    return images.fill_delaunay(_blocks(spark, d))


@query("delaunay_triangles")
def _(spark, d):
    return images.delaunay_triangles(_blocks(spark, d))
