"""Sparse voxel tensors (batch, x, y, z, f): neighbourhood joins, set operations, element-wise statistics."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import require

COORD = ["batch", "x", "y", "z"]


def cube_offsets(size: int, *, stride: int = 1, dilation: int = 1, dimension: int = 3) -> list[tuple[int, ...]]:
    """Offsets of a cube kernel of odd size."""
    require(size % 2 == 1 and size > 0, "kernel size must be odd")
    reach = [o * dilation * stride for o in range(-(size // 2), size // 2 + 1)]
    return list(product(reach, repeat=dimension))


def cross_offsets(size: int, *, stride: int = 1, dilation: int = 1, dimension: int = 3) -> list[tuple[int, ...]]:
    return [o for o in cube_offsets(size, stride=stride, dilation=dilation, dimension=dimension) if sum(v != 0 for v in o) <= 1]


def tensor(df: DataFrame, coords: list[str], features: list[str]) -> DataFrame:
    """(idx is kept if there) batch, x, y, z and f from plain columns; without a batch column the batch is 0."""
    require(len(coords) in (3, 4), "coordinates are (x, y, z) or (batch, x, y, z)")
    batch = [F.lit(0)] if len(coords) == 3 else []
    keys = [c.cast("int").alias(n) for c, n in zip([*batch, *[F.col(c) for c in coords]], COORD)]
    extra = ["idx"] if "idx" in df.columns and "idx" not in coords else []
    return df.select(*extra, *keys, F.array(*[F.col(f).cast("float") for f in features]).alias("f"))


def neighbor_join(a: DataFrame, b: DataFrame, offsets: list[tuple[int, ...]], *, a_id: str = "idx", b_id: str = "idx") -> DataFrame:
    """(a_idx, b_idx, offset number) where a's coordinate plus an offset is b's: one equi-join.

    The smaller side should be ``a``: its rows are repeated for each offset, in a projection.
    """
    kinds = F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(v).alias(f"o{k}") for k, v in enumerate(o)]) for n, o in enumerate(offsets)])
    left = a.select(F.col(a_id).alias("a_idx"), *[F.col(c).alias(f"__{c}") for c in COORD], F.explode(kinds).alias("__o"))
    left = left.select("a_idx", F.col("__o.n").alias("offset"), F.col("__batch").alias("batch"), *[(F.col(f"__{c}") + F.col(f"__o.o{k}")).alias(c) for k, c in enumerate("xyz")])
    return left.join(b.select(F.col(b_id).alias("b_idx"), *COORD), COORD).select("a_idx", "b_idx", "offset")


def occupied(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of ``a`` with ``occupied``: whether ``b`` has its coordinate."""
    hit = b.select(*COORD).distinct().withColumn("__hit", F.lit(True))
    return a.join(hit, COORD, "left").withColumn("occupied", F.col("__hit").isNotNull()).drop("__hit")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*COORD).distinct(), COORD, "left_anti")


def disjoint_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def append_unique(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, and what b has beyond it; a's features win."""
    return a.unionByName(difference(b, a))


def _every(tensors: tuple[DataFrame, ...]) -> DataFrame:
    require(len(tensors) > 0, "at least one tensor is needed")
    return reduce(lambda x, y: x.union(y), [t.select(*COORD, "f") for t in tensors])


def _by_slot(tensors: tuple[DataFrame, ...], width: int, aggregate) -> DataFrame:
    return _every(tensors).groupBy(*COORD).agg(F.array(*[aggregate(F.col("f")[i].cast("double")) for i in range(width)]).alias("f"))


def sparse_sum(*tensors: DataFrame, width: int) -> DataFrame:
    """Features of ``width`` slots added up by coordinate."""
    return _by_slot(tensors, width, F.sum)


def sparse_mean(*tensors: DataFrame, width: int) -> DataFrame:
    return _by_slot(tensors, width, F.avg)


def sparse_count(*tensors: DataFrame) -> DataFrame:
    """By coordinate the number of tensors' rows that hold it."""
    return _every(tensors).groupBy(*COORD).agg(F.count(F.lit(1)).alias("count"))


def batch_indices(t: DataFrame, batches: int, idx: str = "idx") -> DataFrame:
    """(batch, indices): ordered row ids of each batch, empty where there are none. For batches that fit a row."""
    every = t.sparkSession.range(batches).select(F.col("id").cast("int").alias("batch"))
    own = t.groupBy("batch").agg(F.sort_array(F.collect_list(idx)).alias("indices"))
    return every.join(own, "batch", "left").select("batch", F.coalesce("indices", F.array().cast("array<bigint>")).alias("indices"))


def unbatch(t: DataFrame, batches: int) -> list[DataFrame]:
    return [t.where(F.col("batch") == b) for b in range(batches)]


def normalise(t: DataFrame, width: int, *, eps: float = 1e-5, running: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """Features minus their mean, by the root of their population variance plus eps; at most one row: by the running
    statistics given (else unchanged)."""
    stats = t.agg(F.count(F.lit(1)).alias("__n"), *[f(F.col("f")[i].cast("double")).alias(f"__{k}{i}") for i in range(width) for k, f in (("m", F.avg), ("v", F.var_pop))])
    mean, var = running or ([0.0] * width, [1.0 - eps] * width)

    def slot(i: int) -> Column:
        few = F.col("__n") <= 1
        m, v = F.when(few, F.lit(float(mean[i]))).otherwise(F.col(f"__m{i}")), F.when(few, F.lit(float(var[i]))).otherwise(F.col(f"__v{i}"))
        return (F.col("f")[i] - m) / F.sqrt(v + eps)

    return t.join(F.broadcast(stats)).withColumn("f", F.array(*[slot(i) for i in range(width)])).select(t.columns)


def to_numpy(t: DataFrame | None):
    """(coordinates, features) as arrays, for tensors that fit the driver; (None, None) for no tensor."""
    if t is None:
        return None, None
    rows = t.select(*COORD, "f").toPandas()
    return rows[COORD].to_numpy("int32"), np.array(rows.f.tolist(), "float32")
