"""Row containers, timestamps and poses: typed tables keyed by ``idx``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geometry as G
from ..functions.scalar import micros_of_nanos
from ..plans.physical import nearest_asof


def allocate(spark: SparkSession, n: int, schema: StructType) -> DataFrame:
    """n rows with idx 0 .. n - 1 and nulls of the schema's types."""
    return spark.range(n).select(*[(F.col("id") if f.name == "idx" else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def length(df: DataFrame) -> int:
    return df.count()


def index(df: DataFrame, idx: str = "idx") -> DataFrame:
    return df.select(idx)


def slice_rows(df: DataFrame, start: int | None, stop: int | None, *, n: int | None = None, step: int = 1, idx: str = "idx") -> DataFrame:
    """Rows start <= idx < stop; negative ends count from the end, which needs n."""
    start, stop, step = slice(start, stop, step).indices(n if n is not None else (stop or 2**62))
    out = df.where((F.col(idx) >= start) & (F.col(idx) < stop))
    return out if step == 1 else out.where((F.col(idx) - start) % step == 0)


def mask_rows(df: DataFrame, mask: Column) -> DataFrame:
    return df.where(F.coalesce(mask, F.lit(False)))


def take_rows(df: DataFrame, keys: DataFrame | Sequence[int], *, n: int | None = None, idx: str = "idx") -> DataFrame:
    """Rows of the given places; repeated places count once, as the table has no order to repeat them in."""
    if not isinstance(keys, DataFrame):
        found = sorted({k + n if k < 0 and n is not None else k for k in keys})
        return df.where(F.col(idx).isin(found))
    return df.join(keys.select(F.col(keys.columns[0]).alias(idx)).distinct(), idx, "left_semi")


def datetime_of(df: DataFrame, ts: str = "ts_ns", name: str = "datetime") -> DataFrame:
    return df.withColumn(name, micros_of_nanos(F.col(ts)))


def set_timestamps(df: DataFrame, value: Column, ts: str = "ts_ns") -> DataFrame:
    return df.withColumn(ts, value.cast("bigint"))


def align_timestamps(base: DataFrame, probes: DataFrame, *, ts: str = "ts_ns", by: list[str], idx: str = "idx", probe_id: str = "probe", span: float | None = None) -> DataFrame:
    """(by, probe, ts, matched idx, matched ts): for each probe the base row nearest in time, the later of two equals.

    ``span``: time that one task sweeps at once of an entity; give it where an entity may have very many rows.
    """
    matched = base.withColumn("__mts", F.col(ts))
    found = nearest_asof(probes, matched, time=ts, by=by, tie=idx, probe_id=probe_id, base_columns=[idx, "__mts"], span=span)
    return found.withColumnRenamed("__mts", f"matched_{ts}")


def aligned_rows(base: DataFrame, probes: DataFrame, **how) -> DataFrame:
    """The base rows that some probe matches, each once."""
    idx = how.get("idx", "idx")
    matches = align_timestamps(base, probes, **how).select(idx).where(F.col(idx).isNotNull()).distinct()
    return base.join(matches, idx, "left_semi")


XYZ, QUATERNION = ("x", "y", "z"), ("qx", "qy", "qz", "qw")


def xyz(df: DataFrame, name: str = "xyz") -> DataFrame:
    return df.withColumn(name, F.array(*XYZ))


def quaternion(df: DataFrame, name: str = "quaternion") -> DataFrame:
    return df.withColumn(name, F.array(*QUATERNION))


def set_xyz(df: DataFrame, value: Column) -> DataFrame:
    return df.withColumns({c: value[i].cast("double") for i, c in enumerate(XYZ)})


def set_quaternion(df: DataFrame, value: Column) -> DataFrame:
    return df.withColumns({c: value[i].cast("double") for i, c in enumerate(QUATERNION)})


def rotation(df: DataFrame, name: str = "R") -> DataFrame:
    return df.withColumn(name, G.as_matrix(G.quaternion_to_matrix([F.col(c) for c in QUATERNION])))


def transformation(df: DataFrame, name: str = "transformation") -> DataFrame:
    r = G.quaternion_to_matrix([F.col(c) for c in QUATERNION])
    return df.withColumn(name, G.as_matrix(G.homogeneous(r, [F.col(c) for c in XYZ])))
