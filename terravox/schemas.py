"""Row types of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

ARRAY = T.StructType([T.StructField("idx", T.LongType(), False)])
TIMESTAMPS = T.StructType([*ARRAY, T.StructField("ts_ns", T.LongType())])
POSE_FIELDS = [T.StructField(n, T.DoubleType()) for n in ("x", "y", "z", "qx", "qy", "qz", "qw")]
POSES = T.StructType([*ARRAY, *POSE_FIELDS])
TIME_POSES = T.StructType([*TIMESTAMPS, *POSE_FIELDS])
POINTS = T.StructType([*ARRAY, *POSE_FIELDS[:3]])
SEGMENTS = T.StructType([T.StructField(n, T.LongType(), False) for n in ("seg", "s", "e")])
PIXELS = T.StructType([T.StructField("img", T.LongType()), *[T.StructField(n, T.IntegerType()) for n in ("row", "col", "ch")], T.StructField("v", T.DoubleType())])
SPARSE = T.StructType([*[T.StructField(n, T.IntegerType()) for n in ("batch", "x", "y", "z")], T.StructField("f", T.ArrayType(T.FloatType()))])
EDGES = T.StructType([T.StructField("q", T.LongType()), T.StructField("k", T.LongType())])
MOMENTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("var", T.DoubleType())])
PARAMETERS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("requires_grad", T.BooleanType()),
        T.StructField("numel", T.LongType()),
        T.StructField("value", T.ArrayType(T.FloatType())),
    ]
)
