"""Edge-list attention, and attention layers with given weights (inference only)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import require
from .sparse import cube_offsets, neighbor_join

Matrix = Sequence[Sequence[float]]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def edge_attention(queries: DataFrame, keys: DataFrame, edges: DataFrame, *, heads: int, width: int) -> DataFrame:
    """(q, out): for each query the softmax-weighted sum of its keys' values, head by head, as one array.

    ``queries`` (q, vq), ``keys`` (k, vk, vv) hold arrays of heads * width doubles; ``edges`` (q, k).  Logits are
    scaled by the root of ``width``; the softmax's denominator has 1e-12 added.  A query without edges gets zeros.
    The softmax needs a query's maximum and sum only, which are aggregated, so a query with many edges is no hot group.
    """
    part = lambda c, h: F.slice(F.col(c), h * width + 1, width)
    rows = edges.select("q", "k").join(queries.select("q", "vq"), "q").join(keys.select("k", "vk"), "k")
    logits = F.array(*[_dot(part("vq", h), part("vk", h)) / math.sqrt(width) for h in range(heads)])
    rows = rows.select("q", "k", logits.alias("logits"))  # narrow: this is what the maximum and its join exchange
    top = rows.groupBy("q").agg(*[F.max(F.col("logits")[h]).alias(f"m{h}") for h in range(heads)])
    rows = rows.join(top, "q").join(keys.select("k", "vv"), "k").select("q", "vv", *[F.exp(F.col("logits")[h] - F.col(f"m{h}")).alias(f"e{h}") for h in range(heads)])
    sums = [F.sum(f"e{h}").alias(f"s{h}") for h in range(heads)]
    sums += [F.sum(F.col(f"e{h}") * F.col("vv")[h * width + i]).alias(f"o{h}_{i}") for h in range(heads) for i in range(width)]
    got = rows.groupBy("q").agg(*sums)
    out = F.array(*[F.coalesce(F.col(f"o{h}_{i}") / (F.col(f"s{h}") + F.lit(1e-12)), F.lit(0.0)) for h in range(heads) for i in range(width)])
    return queries.select("q").join(got, "q", "left").select("q", out.alias("out"))


def linear(x: Column, weight: Matrix, bias: Sequence[float] | None = None) -> Column:
    """weight (out x in) times x, plus bias."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in weight])
    out = F.transform(rows, lambda r: _dot(r, x))
    return out if bias is None else F.zip_with(out, F.array(*[F.lit(float(b)) for b in bias]), lambda a, b: a + b)


def layer_norm(x: Column, weight: Sequence[float], bias: Sequence[float], eps: float = 1e-5) -> Column:
    n = len(weight)
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    var = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n
    scaled = F.transform(x, lambda v: (v - mean) / F.sqrt(var + eps))
    lit = lambda vs: F.array(*[F.lit(float(v)) for v in vs])
    return F.zip_with(F.zip_with(scaled, lit(weight), lambda a, b: a * b), lit(bias), lambda a, b: a + b)


@dataclass(frozen=True)
class AttentionWeights:
    """Matrices (out x in) without bias; queries come from a's features, keys and values from b's."""

    query: Matrix
    key: Matrix
    value: Matrix
    out: Matrix
    heads: int = 1

    def width(self) -> int:
        require(len(self.query) % self.heads == 0, "the width must be a multiple of the number of heads")
        return len(self.query) // self.heads


def multi_head_attention(a: DataFrame, b: DataFrame, edges: DataFrame, weights: AttentionWeights) -> DataFrame:
    """(idx, out) for every row (idx, f) of ``a``; edges are (a_idx, b_idx)."""
    doubles = lambda c: F.transform(F.col(c), lambda v: v.cast("double"))
    queries = a.select(F.col("idx").alias("q"), linear(doubles("f"), weights.query).alias("vq"))
    keys = b.select(F.col("idx").alias("k"), linear(doubles("f"), weights.key).alias("vk"), linear(doubles("f"), weights.value).alias("vv"))
    mixed = edge_attention(queries, keys, edges.select(F.col("a_idx").alias("q"), F.col("b_idx").alias("k")), heads=weights.heads, width=weights.width())
    return mixed.select(F.col("q").alias("idx"), linear(F.col("out"), weights.out).alias("out"))


@dataclass(frozen=True)
class BlockWeights:
    attention: AttentionWeights
    norm_1: tuple[Sequence[float], Sequence[float]]
    up: tuple[Matrix, Sequence[float]]
    down: tuple[Matrix, Sequence[float]]
    norm_2: tuple[Sequence[float], Sequence[float]]
    kernel: int = 3


def neighborhood_attention(a: DataFrame, b: DataFrame, weights: BlockWeights) -> DataFrame:
    """a (idx, batch, x, y, z, f) with f replaced: attention over b's rows in the kernel around each coordinate, added
    and normalised, then a two-layer network with a rectifier, added and normalised. Dropout is off."""
    edges = neighbor_join(a, b, cube_offsets(weights.kernel))
    got = multi_head_attention(a, b, edges, weights.attention)
    plus = lambda x, y: F.zip_with(x, y, lambda p, q: p + q)
    rows = a.join(got, "idx").withColumn("__1", layer_norm(plus(F.transform("f", lambda v: v.cast("double")), F.col("out")), *weights.norm_1))
    hidden = F.transform(linear(F.col("__1"), *weights.up), lambda v: F.greatest(v, F.lit(0.0)))
    return rows.withColumn("f", layer_norm(plus(F.col("__1"), linear(hidden, *weights.down)), *weights.norm_2)).select(a.columns)
