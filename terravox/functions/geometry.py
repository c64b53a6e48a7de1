"""Rotations, rigid transforms and boxes as column expressions.

Vectors and matrices are lists of Columns while a plan is built (``vec``, ``mat``) and arrays in tables
(``as_vector``, ``as_matrix``).  Quaternions are (x, y, z, w).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..checks import require

Vec = list[Column]
Mat = list[Vec]


def vec(column: Column, n: int = 3) -> Vec:
    return [column[i] for i in range(n)]


def mat(column: Column, n: int = 3, m: int = 3) -> Mat:
    return [[column[i][j] for j in range(m)] for i in range(n)]


def lit_vec(values: Sequence[float]) -> Vec:
    return [F.lit(float(v)) for v in values]


def lit_mat(values: Sequence[Sequence[float]]) -> Mat:
    return [lit_vec(r) for r in values]


def as_vector(v: Vec) -> Column:
    return F.array(*v)


def as_matrix(m: Mat) -> Column:
    return F.array(*[F.array(*r) for r in m])


def dot(a: Vec, b: Vec) -> Column:
    require(len(a) == len(b), "vectors differ in length")
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Vec, b: Vec) -> Vec:
    return [x + y for x, y in zip(a, b)]


def sub(a: Vec, b: Vec) -> Vec:
    return [x - y for x, y in zip(a, b)]


def transpose(m: Mat) -> Mat:
    return [list(r) for r in zip(*m)]


def apply(m: Mat, v: Vec) -> Vec:
    return [dot(r, v) for r in m]


def multiply(a: Mat, b: Mat) -> Mat:
    return [[dot(r, c) for c in transpose(b)] for r in a]


def quaternion_to_matrix(q: Vec) -> Mat:
    """The rotation of a quaternion, normalised first; NaN for a zero quaternion."""
    require(len(q) == 4, "a quaternion has four components")
    length = norm(q)
    x, y, z, w = [F.when(length > 0, c / length).otherwise(F.lit(float("nan"))) for c in q]
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def _about(axis: int, angle: Column) -> Mat:
    c, s, one, zero = F.cos(angle), F.sin(angle), F.lit(1.0), F.lit(0.0)
    return {0: [[one, zero, zero], [zero, c, -s], [zero, s, c]], 1: [[c, zero, s], [zero, one, zero], [-s, zero, c]], 2: [[c, -s, zero], [s, c, zero], [zero, zero, one]]}[axis]


def euler_to_matrix(euler: Vec) -> Mat:
    """(roll, pitch, yaw) to the transpose of Rz(yaw) Ry(pitch) Rx(roll).

    ``matrix_to_euler`` inverts the product itself, so it is not the inverse of this function.
    """
    require(len(euler) == 3, "roll, pitch and yaw are needed")
    roll, pitch, yaw = euler
    return transpose(multiply(multiply(_about(2, yaw), _about(1, pitch)), _about(0, roll)))


def matrix_to_euler(r: Mat) -> Vec:
    """(roll, pitch, yaw) of Rz Ry Rx; yaw is 0 where the pitch is within 1e-6 of a right angle."""
    flat = F.sqrt(r[0][0] * r[0][0] + r[1][0] * r[1][0])
    singular = flat < 1e-6
    roll = F.when(singular, F.atan2(-r[1][2], r[1][1])).otherwise(F.atan2(r[2][1], r[2][2]))
    yaw = F.when(singular, F.lit(0.0)).otherwise(F.atan2(r[1][0], r[0][0]))
    return [roll, F.atan2(-r[2][0], flat), yaw]


def matrix_to_quaternion(r: Mat) -> Vec:
    """From the largest of the diagonal and the trace, normalised; the sign is left as it comes."""
    trace = r[0][0] + r[1][1] + r[2][2]
    by_w = [r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1], 1 + trace]
    options = []
    for i in range(3):
        j, k = (i + 1) % 3, (i + 2) % 3
        q: list = [None] * 4
        q[i], q[j], q[k], q[3] = 1 - trace + 2 * r[i][i], r[j][i] + r[i][j], r[k][i] + r[i][k], r[k][j] - r[j][k]
        options.append(q)
    d = [r[0][0], r[1][1], r[2][2]]
    top = F.greatest(*d, trace)
    raw = [F.when(d[0] == top, options[0][c]).when(d[1] == top, options[1][c]).when(d[2] == top, options[2][c]).otherwise(by_w[c]) for c in range(4)]
    length = norm(raw)
    return [c / length for c in raw]


def rotation_angle(a: Vec, b: Vec) -> Column:
    """The angle between two orientations given as quaternions, from 0 to pi; 0 if either is null."""
    share = F.abs(dot(a, b)) / (norm(a) * norm(b))
    return 2 * F.acos(F.least(F.lit(1.0), share))


def invert_pose(r: Mat, t: Vec) -> tuple[Mat, Vec]:
    rt = transpose(r)
    return rt, [-x for x in apply(rt, t)]


def compose_poses(r1: Mat, t1: Vec, r2: Mat, t2: Vec) -> tuple[Mat, Vec]:
    """The second after the first."""
    return multiply(r2, r1), add(t2, apply(r2, t1))


def homogeneous(r: Mat, t: Vec) -> Mat:
    return [*[[*row, x] for row, x in zip(r, t)], lit_vec([0, 0, 0, 1])]


def world_to_camera(p: Vec, r: Mat, t: Vec) -> Vec:
    return apply(transpose(r), sub(p, t))


def camera_to_world(p: Vec, r: Mat, t: Vec) -> Vec:
    return add(apply(r, p), t)


def inside_box(p: Vec, corners: Sequence[Sequence[float]] | Column) -> Column:
    """Whether a point lies in the box of eight corners (borders included): along the edges from corner 0 to corners
    3, 4 and 1.  A box with an edge of no length holds nothing."""
    at = (lambda i: vec(corners[i])) if isinstance(corners, Column) else (lambda i: lit_vec(corners[i]))
    origin, ok = at(0), F.lit(True)
    offset = sub(p, origin)
    for i in (3, 4, 1):
        edge = sub(at(i), origin)
        length = norm(edge)
        along = F.when(length > 0, dot(offset, edge) / length)
        ok = ok & F.coalesce((along >= 0) & (along <= length), F.lit(False))
    return ok


def scale_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, shape: tuple[int, int], resized: tuple[int, int]) -> Vec:
    """(fx, fy, cx, cy) after an image of (height, width) is resized."""
    sy, sx = resized[0] / shape[0], resized[1] / shape[1]
    return [fx * sx, fy * sy, cx * sx, cy * sy]


def crop_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, top: int, left: int) -> Vec:
    return [fx, fy, cx - left, cy - top]


def center_crop_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, shape: tuple[int, int], cropped: tuple[int, int]) -> Vec:
    require(cropped[0] <= shape[0] and cropped[1] <= shape[1], "the crop is larger than the image")
    return crop_intrinsics(fx, fy, cx, cy, (shape[0] - cropped[0]) // 2, (shape[1] - cropped[1]) // 2)


def viewer_angles(r: Mat, t: Vec, intrinsic: Sequence[Sequence[float]], height: int, width: int, distance: float = 1.0) -> dict[str, Column]:
    """phi, theta, r and lookat of a viewer that sees what the camera sees at ``distance`` in its image's middle."""
    (fx, _, cx), (_, fy, cy), _ = intrinsic
    middle = lit_vec([(width / 2 - cx) * distance / fx, (height / 2 - cy) * distance / fy, distance])
    look = camera_to_world(middle, r, t)
    back = sub(t, look)
    return {"phi": F.atan2(back[1], back[0]), "theta": F.atan2(back[2], F.sqrt(back[0] * back[0] + back[1] * back[1])), "r": norm(back), "lookat": as_vector(look)}
