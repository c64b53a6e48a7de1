"""Mergeable (n, mean, var) states; population variance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment_state(value: str) -> list[Column]:
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var")]


def merge_moments(states: DataFrame, by: list[str] = (), *, n: str = "n", mean: str = "mean", var: str = "var") -> DataFrame:
    """(by, n, mean, var) of the union that the states describe; no rows give zeros, as do zero counts.

    Two sums suffice: sum of n * mean, and of n * (var + mean squared) about a common origin; the states' means are
    shifted by their unweighted mean first, so that large offsets don't cancel.
    """
    keys = list(by)
    origin = states.groupBy(*keys).agg(F.coalesce(F.avg(mean), F.lit(0.0)).alias("__o"))
    rows = states.join(origin, keys) if keys else states.join(F.broadcast(origin))
    d = F.col(mean) - F.col("__o")
    out = rows.groupBy(*keys).agg(F.coalesce(F.sum(n), F.lit(0)).alias("__n"), F.sum(F.col(n) * d).alias("__1"), F.sum(F.col(n) * (F.col(var) + d * d)).alias("__2"), F.max("__o").alias("__o"))
    some = F.col("__n") > 0
    shift = F.col("__1") / F.nullif(F.col("__n"), F.lit(0))
    return out.select(
        *keys,
        F.col("__n").cast("bigint").alias("n"),
        F.when(some, F.col("__o") + shift).otherwise(F.lit(0.0)).alias("mean"),
        F.when(some, F.greatest(F.col("__2") / F.nullif(F.col("__n"), F.lit(0)) - shift * shift, F.lit(0.0))).otherwise(F.lit(0.0)).alias("var"),
    )
