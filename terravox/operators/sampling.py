"""Key frames of trajectories; random relabelling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checks import require


def keyframes(df: DataFrame, *, by: list[str], order: list[str], idx: str, xyz: tuple[str, ...] = ("x", "y", "z"), quaternion: tuple[str, ...] | None = None, min_distance: float = 1.5, min_angle: float = math.radians(2)) -> DataFrame:
    """(by, idx) of the rows kept by one sweep: the first of each trajectory, every row that lies ``min_distance`` or
    ``min_angle`` from the last one kept, and the last.

    A row's fate hangs on the last kept one, so a trajectory is one sequential pass; rows are sorted by (by, order)
    and streamed batch by batch, so memory is bounded whatever the trajectory's length.
    """
    require(len(by) > 0, "a trajectory key is needed")
    q = list(quaternion or ())
    dist = ["__x%d" % i for i in range(len(xyz))]
    quat = ["__q%d" % i for i in range(len(q))]
    rows = df.select(*by, idx, *order, *[F.col(c).cast("double").alias(n) for c, n in zip((*xyz, *q), dist + quat)])
    rows = rows.repartition(*by).sortWithinPartitions(*by, *order).select(*by, idx, *dist, *quat)
    half = math.cos(min_angle / 2)
    key_schema = rows.select(*by, idx).schema

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept, last, last_q, pending = None, [], None, None, None
        for at in batches:
            keys = list(zip(*[at[c] for c in by]))
            places, ids = at[dist].to_numpy(float), at[idx].tolist()
            turns = at[quat].to_numpy(float) if q else None
            for n, k in enumerate(keys):
                if k != key:
                    if pending is not None:
                        kept.append((*key, pending))
                    key, pending, far = k, None, True
                else:
                    step = places[n] - last
                    far = math.sqrt(float(step @ step)) >= min_distance
                    if q and not far:
                        a, b = last_q, turns[n]
                        length = math.sqrt(float(a @ a) * float(b @ b))
                        far = length > 0 and abs(float(a @ b)) / length <= half
                if far:
                    kept.append((*k, ids[n]))
                    last, pending = places[n], None
                    last_q = turns[n] if q else None
                else:
                    pending = ids[n]
            if kept:
                yield pd.DataFrame(kept, columns=[*by, idx])
                kept = []
        if pending is not None:
            yield pd.DataFrame([(*key, pending)], columns=[*by, idx])

    return rows.mapInPandas(sweep, key_schema)


def randomize_labels(df: DataFrame, label: str, *, seed: int = 0, name: str = "random_label") -> DataFrame:
    """A random one-to-one map of labels onto 0 .. k - 1: labels in the order of a seeded hash.

    Hashes are cut into 65,536 ranges; a label's place is the number of labels in the ranges before, and its place in its own.
    """
    drawn = F.xxhash64(F.lit(seed), F.col("__label"))
    labels = df.select(F.col(label).alias("__label")).distinct().withColumn("__range", F.shiftright(drawn, 48))
    ranges = labels.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = ranges.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__range").orderBy(drawn, "__label")) - 1
    numbered = labels.join(before, "__range").select("__label", place.cast("int").alias(name))
    return df.join(numbered, F.col(label).eqNullSafe(F.col("__label"))).drop("__label")
