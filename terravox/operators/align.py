"""Alignment of matched point sets: similarity transforms, RANSAC, nearest neighbours, iterative closest point.

The cluster computes moments, hypotheses' inliers and neighbours; the driver sees sums of fixed size and does the
3 x 3 algebra.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checks import positive, require
from ..functions import geometry as G
from ..plans.physical import cell_join, halving_cell_join, halvings, literal_rows

SRC, DST = ("sx", "sy", "sz"), ("dx", "dy", "dz")

#: Unlimited nearest-neighbour search compares all pairs with destinations of this many rows at most; beyond
#: that it widens a cell search instead.
ALL_PAIRS_ROWS = 20_000


@dataclass(frozen=True)
class Similarity:
    """dst ~ scale * rotation @ src + translation."""

    scale: float
    rotation: np.ndarray
    translation: np.ndarray

    def apply(self, p: list[Column]) -> list[Column]:
        return G.add(G.apply(G.lit_mat((self.scale * self.rotation).tolist()), p), G.lit_vec(self.translation.tolist()))


def moments(pairs: DataFrame, *more: Column) -> dict[str, float]:
    """Means, variances and covariances of the pairs, and further aggregates: one row."""
    aggregates = [F.count(F.lit(1)).alias("n"), *more, *[F.avg(c).alias(c) for c in (*SRC, *DST)], *[F.var_pop(c).alias(f"v_{c}") for c in SRC]]
    aggregates += [F.covar_pop(d, s).alias(f"{d}_{s}") for d in DST for s in SRC]
    return pairs.agg(*aggregates).first().asDict()


def solve(m: dict[str, float], with_scale: bool) -> Similarity:
    cov = np.array([[m[f"{d}_{s}"] for s in SRC] for d in DST])
    u, sing, vt = np.linalg.svd(cov)
    if np.linalg.det(u) * np.linalg.det(vt) < 0:
        vt[-1] *= -1
    rotation = u @ vt
    var = sum(m[f"v_{c}"] for c in SRC)
    scale = float(sing.sum() / var) if with_scale and var > 0 else 1.0  # the sum is unsigned, also after a flip
    mean_s, mean_d = np.array([m[c] for c in SRC]), np.array([m[c] for c in DST])
    return Similarity(scale, rotation, mean_d - scale * rotation @ mean_s)


def umeyama(pairs: DataFrame, *, with_scale: bool = True) -> Similarity:
    """The least-squares similarity of matched rows (sx, sy, sz, dx, dy, dz): one aggregate."""
    m = moments(pairs)
    require(m["n"] > 0, "there are no pairs")
    return solve(m, with_scale)


def residual2(t: Similarity) -> Column:
    off = G.sub(t.apply([F.col(c) for c in SRC]), [F.col(c) for c in DST])
    return G.dot(off, off)


def ransac(pairs: DataFrame, *, idx: str = "idx", with_scale: bool = True, max_iterations: int = 1000, inlier_threshold: float = 0.05, min_samples: int = 4, seed: int | None = None) -> tuple[Similarity, DataFrame]:
    """(transform, pairs with ``inlier``).

    The rows to sample from are those with the smallest seeded hashes, as many as all samples together hold, found
    by a distributed top-n; samples are drawn from them on the driver.  All hypotheses are counted in a few passes as
    joins with constants, so the data are read a fixed number of times.  The first of the best wins; with enough
    inliers it is fitted again to them, else it stays (the identity, if no hypothesis has an inlier).
    """
    positive("max_iterations", max_iterations)
    draw = np.random.default_rng(seed)
    by_hash = F.xxhash64(F.lit(int(draw.integers(2**31))), F.col(idx))
    rows = [list(r) for r in pairs.orderBy(by_hash, idx).select(*SRC, *DST).limit(max_iterations * min_samples).collect()]
    require(len(rows) >= min_samples, "there are fewer pairs than a sample needs")
    samples = [draw.choice(len(rows), min_samples, replace=False) for _ in range(max_iterations)]
    hypotheses = [_fit([rows[int(i)] for i in s], with_scale) for s in samples]
    limit = inlier_threshold**2
    best, most = Similarity(1.0, np.eye(3), np.zeros(3)), 0
    for a in range(0, len(hypotheses), 200):
        part = hypotheses[a : a + 200]
        table = literal_rows(pairs.sparkSession, [(k, *(h.scale * h.rotation).ravel().tolist(), *h.translation.tolist()) for k, h in enumerate(part)], "h int, " + ", ".join(f"r{i} double" for i in range(9)) + ", t0 double, t1 double, t2 double")
        moved = [sum((F.col(f"r{3 * i + j}") * F.col(SRC[j]) for j in range(3)), F.col(f"t{i}")) for i in range(3)]
        off = [m - F.col(d) for m, d in zip(moved, DST)]
        counts = pairs.join(F.broadcast(table)).where(G.dot(off, off) < limit).groupBy("h").agg(F.count(F.lit(1)).alias("inliers"))
        top = counts.orderBy(F.desc("inliers"), "h").first()
        if top is not None and top["inliers"] > most:
            best, most = part[top["h"]], top["inliers"]
    if most >= min_samples:
        best = umeyama(pairs.where(residual2(best) < limit), with_scale=with_scale)
        return best, pairs.withColumn("inlier", residual2(best) < limit)
    return best, pairs.withColumn("inlier", residual2(best) < limit if most else F.lit(False))


def _fit(rows: list[list[float]], with_scale: bool) -> Similarity:
    at = np.array(rows, float)
    s, d = at[:, :3] - at[:, :3].mean(axis=0), at[:, 3:] - at[:, 3:].mean(axis=0)
    m = {f"v_{c}": float((s[:, i] ** 2).mean()) for i, c in enumerate(SRC)} | {f"{y}_{x}": float((d[:, j] * s[:, i]).mean()) for i, x in enumerate(SRC) for j, y in enumerate(DST)}
    return solve(m | dict(zip((*SRC, *DST), at.mean(axis=0))), with_scale)


def _finite(df: DataFrame, xyz: tuple[str, str, str]) -> DataFrame:
    inside = F.lit(True)
    for c in xyz:
        inside &= F.coalesce(F.abs(F.col(c)) < math.inf, F.lit(False))  # NaN is larger than infinity
    return df.where(inside)


def crowding(dst: DataFrame, radius: float, *, xyz: tuple[str, str, str] = ("x", "y", "z")) -> int:
    """How often cells of size ``radius`` are to be halved until a place shares its cell with few others: one pass."""
    return halvings(_finite(dst, xyz), radius=radius, xyz=xyz)


def nearest_neighbors(src: DataFrame, dst: DataFrame, *, radius: float = math.inf, src_id: str = "i", dst_id: str = "j", xyz: tuple[str, str, str] = ("x", "y", "z"), levels: int | None = None) -> DataFrame:
    """(i, j, d2): the nearest destination of each source within ``radius``, ties to the smallest j; sources without
    one are left out.  Rows with a null, NaN or infinite coordinate take no part.

    A finite radius is an equi-join on cells, halved ``levels`` times where destinations are crowded (if not given,
    as often as ``crowding`` finds).  Without one, cells grow from the mean spacing, doubling for the
    sources that have found nothing yet, until all have; a small destination table is compared in full.
    """
    src, dst = _finite(src, xyz), _finite(dst, xyz)
    best = lambda pairs: pairs.groupBy(src_id).agg(F.min(F.struct("d2", dst_id)).alias("b")).select(src_id, F.col(f"b.{dst_id}").alias(dst_id), F.col("b.d2").alias("d2"))
    if math.isfinite(radius):
        levels = crowding(dst, radius, xyz=xyz) if levels is None else levels
        return best(halving_cell_join(src, dst, radius=radius, levels=levels, xyz=xyz, src_id=src_id, dst_id=dst_id))
    s = src.select(src_id, *[F.col(c).alias(f"__s{k}") for k, c in enumerate(xyz)])
    d = dst.select(dst_id, *[F.col(c).alias(f"__d{k}") for k, c in enumerate(xyz)])
    if dst.limit(ALL_PAIRS_ROWS + 1).count() <= ALL_PAIRS_ROWS:
        off = [F.col(f"__s{k}") - F.col(f"__d{k}") for k in range(3)]
        return best(s.join(F.broadcast(d)).select(src_id, dst_id, G.dot(off, off).alias("d2")))
    if src.isEmpty():
        return best(cell_join(src, dst, radius=1.0, xyz=xyz, src_id=src_id, dst_id=dst_id))
    bounds = dst.agg(F.count(F.lit(1)).alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in xyz]).first()
    far = src.select(*[F.max(F.abs(c)).alias(c) for c in xyz]).first()
    reach = sum(bounds[c] for c in xyz) + 2 * sum((v or 0.0) for v in far)
    step, found, left = max(max(bounds[c] for c in xyz), 1e-9) / max(1.0, bounds["n"] ** (1 / 3)) * 2, None, src
    while True:
        got = best(cell_join(left, dst, radius=step, xyz=xyz, src_id=src_id, dst_id=dst_id))
        found = got if found is None else found.union(got)
        found = _kept(found)
        left = src.join(found.select(src_id), src_id, "left_anti")
        if left.isEmpty() or step > 4 * reach:
            return found
        step *= 2


def _kept(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder, if the session has one, and reread; else checkpointed in memory."""
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not base:
        return df.cache()
    path = f"{base.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile leaves no shuffle files: rounds would heap them up until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@dataclass(frozen=True)
class Alignment:
    rotation: np.ndarray
    translation: np.ndarray
    iterations: int
    mean_distances: tuple[float, ...]
    matches: DataFrame | None

    def matrix(self) -> np.ndarray:
        out = np.eye(4)
        out[:3, :3], out[:3, 3] = self.rotation, self.translation
        return out


def iterative_closest_point(src: DataFrame, dst: DataFrame, *, initial: np.ndarray | None = None, max_iterations: int = 20, max_distance: float = math.inf, min_delta: float = 1e-6, min_mean_distance: float = 1e-6, src_id: str = "i", dst_id: str = "j", xyz: tuple[str, str, str] = ("x", "y", "z")) -> Alignment:
    """Rigid alignment of src to dst; stops with fewer than three matches, at a small mean distance, or when that
    hardly changes.

    Each round is one neighbour join and one aggregate.  The pose is a constant in the plan, so the plan does not
    grow with the rounds.  How crowded the destinations are is found once, as they stay where they are.
    """
    pose = np.eye(4) if initial is None else np.asarray(initial, float)
    rotation, translation = pose[:3, :3].copy(), pose[:3, 3].copy()
    last, means, matches, n = math.inf, [], None, 0
    target = dst.select(dst_id, *[F.col(c).alias(d) for c, d in zip(xyz, DST)])
    levels = crowding(dst, max_distance, xyz=xyz) if math.isfinite(max_distance) else None
    for n in range(1, max_iterations + 1):
        here = Similarity(1.0, rotation, translation)
        moved = here.apply([F.col(c) for c in xyz])
        now = src.select(src_id, *[m.alias(c) for m, c in zip(moved, xyz)])
        matches = nearest_neighbors(now, dst, radius=max_distance, src_id=src_id, dst_id=dst_id, xyz=xyz, levels=levels)
        pairs = matches.join(now.select(src_id, *[F.col(c).alias(s) for c, s in zip(xyz, SRC)]), src_id).join(target, dst_id)
        with _shuffles_dropped(src.sparkSession):
            m = moments(pairs, F.avg(F.sqrt("d2")).alias("distance"))
        if m["n"] < 3:
            break
        means.append(m["distance"])
        if m["distance"] < min_mean_distance or abs(last - m["distance"]) < min_delta:
            break
        last = m["distance"]
        step = solve(m, False)
        rotation, translation = step.rotation @ rotation, step.rotation @ translation + step.translation
    return Alignment(rotation, translation, n, tuple(means), matches)
