"""Sliding and hopping windows of rows, group sizes, grouped softmax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checks import no_nan, one_of, positive, require

METHODS = ("sum", "count", "mean", "max", "min", "argmax", "argmin")


def window_indices(spark: SparkSession, n: int, size: int, *, full_only: bool = True) -> DataFrame:
    """(w, s, e): centred windows over 0 .. n - 1. Odd sizes have one a row, even sizes one a gap (n + 1)."""
    positive("size", size)
    half = size // 2
    s, e = F.col("w") - half, F.col("w") + half + (size % 2)
    windows = spark.range(n + 1 - size % 2).select(F.col("id").alias("w")).select("w", F.greatest(s, F.lit(0)).alias("s"), F.least(e, F.lit(n)).alias("e"))
    return windows.where(F.col("e") - F.col("s") == size) if full_only else windows


def hop_length(size: int, overlap: float) -> int:
    stride = size - round(size * overlap)
    require(stride > 0, "the overlap leaves no stride")
    return stride


def overlapping_windows(spark: SparkSession, n: int, size: int, overlap: float = 0.33) -> DataFrame:
    """(s, e) of full windows at a fixed stride, and the last full one; none if n is smaller than the size."""
    positive("size", size)
    stride = hop_length(size, overlap)
    if n < size:
        return spark.range(0).select(F.col("id").alias("s"), F.col("id").alias("e"))
    count = (n - size) // stride + 1
    starts = spark.range(count).select((F.col("id") * stride).alias("s"))
    if (count - 1) * stride != n - size:
        starts = starts.union(spark.range(1).select(F.lit(n - size).cast("bigint")))
    return starts.select("s", (F.col("s") + size).alias("e"))


def _over(value: Column, order: Column, w, method: str) -> Column:
    plain = {"sum": F.sum, "count": F.count, "mean": F.avg, "max": F.max, "min": F.min}
    if method in plain:
        return plain[method](value if method in ("sum", "count", "mean") else no_nan(value)).over(w)
    if method == "argmax":
        return -F.max(F.struct(no_nan(value).alias("v"), (-order).alias("n"))).over(w)["n"]
    return F.min(F.struct(no_nan(value).alias("v"), order.alias("n"))).over(w)["n"]


def sliding_window(df: DataFrame, value: str, *, by: list[str], order: list[str], at: str, size: int = 3, methods: list[str] = ("mean",), full_only: bool = False) -> DataFrame:
    """Adds one column a method, over the ``size`` rows centred on each row within ``by``.

    ``at`` is the numeric place that argmax and argmin return.  One exchange on ``by`` serves all methods.
    ``full_only`` keeps rows whose window is whole.
    """
    require(size % 2 == 1 and size > 0, "size must be odd")
    for m in methods:
        one_of("method", m, METHODS)
    require(len(by) > 0, "a partition key is needed; use chunked_sliding_window for one long series")
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(size // 2), size // 2)
    out = df.withColumns({m: _over(F.col(value), F.col(at), w, m) for m in methods} | {"__rows": F.count(F.lit(1)).over(w)})
    return (out.where(F.col("__rows") == size) if full_only else out).drop("__rows")


def chunked_sliding_window(df: DataFrame, value: str, *, at: str, size: int, methods: list[str], chunk: int = 1_000_000, full_only: bool = False) -> DataFrame:
    """The same for one series with places 0, 1, .. in ``at``: chunks with a halo of half a window on either side, so
    that no task holds the whole series."""
    half = size // 2
    own = F.floor(F.col(at) / chunk)
    chunks = F.array_distinct(F.array(F.floor((F.col(at) - half) / chunk), own, F.floor((F.col(at) + half) / chunk)))
    halo = df.withColumn("__chunk", F.explode(chunks))
    out = sliding_window(halo, value, by=["__chunk"], order=[at], at=at, size=size, methods=methods)
    out = out.where(F.col("__chunk") == own).drop("__chunk")
    return out.where((F.col(at) >= half) & (F.col(at) < df.count() - half)) if full_only else out


def group_sizes(df: DataFrame, label: str, name: str = "group_size") -> DataFrame:
    """Each row with the size of its label's group: a partial aggregate joined back, so a frequent label is no hot window."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias(name)).withColumnRenamed(label, "__label")
    return df.join(sizes, F.col(label).eqNullSafe(F.col("__label"))).drop("__label")


def grouped_softmax(df: DataFrame, logit: str, by: list[str], name: str = "softmax") -> DataFrame:
    """exp(x - max) by the sum of that in the group plus 1e-12.

    Maximum and sum are aggregated by group and joined back, so that a large group is never held together.
    """
    x, names = F.col(logit), {c: f"__k{n}" for n, c in enumerate(by)}

    def joined(rows: DataFrame, found: DataFrame) -> DataFrame:
        same = F.lit(True)
        for c, k in names.items():
            same &= rows[c].eqNullSafe(found[k])
        return rows.join(found, same).drop(*names.values())

    keys = [F.col(c).alias(k) for c, k in names.items()]
    shifted = joined(df, df.groupBy(*keys).agg(F.max(x).alias("__max"))).withColumn("__e", F.exp(x - F.col("__max"))).drop("__max")
    sums = shifted.groupBy(*keys).agg(F.sum("__e").alias("__sum"))
    return joined(shifted, sums).withColumn(name, F.col("__e") / (F.col("__sum") + F.lit(1e-12))).drop("__e", "__sum")
