"""Aggregates over segments [s, e) of an ordered series; segments may overlap.

``series`` has an order column ``i`` (0, 1, ..) and values; ``segments`` has (seg, s, e).  A segment with s = e takes
the row at s, and counts 1.  Segments outside the series, or that end before they start, are an error: every operator
checks them against the series' length (its largest place and one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks import checked, no_nan
from ..plans.physical import bucketed_range_join, first_max, first_min

BUCKET = 64
#: Numbers of segments that one task orders.
STARTS_A_BLOCK = 1 << 16


def length_of(series: DataFrame) -> Column:
    """The largest place and one, as a scalar subquery that reads the place alone."""
    return series.select("i").agg(F.coalesce(F.max("i") + 1, F.lit(0))).scalar()


def check_segments(segments: DataFrame, n: int | Column) -> DataFrame:
    """Fails the query where not 0 <= s < n, or not s <= e <= n."""
    s, e = F.col("s"), F.col("e")
    return segments.withColumn("s", checked(s, (s >= 0) & (s < n) & (s <= e) & (e <= n), "a segment leaves the series or ends before it starts"))


def _rows(series: DataFrame, segments: DataFrame, bucket: int, *more: str) -> DataFrame:
    inside = check_segments(segments.select("seg", "s", "e", *more), length_of(series))
    return bucketed_range_join(inside, series, bucket=bucket)


def segmented(series: DataFrame, segments: DataFrame, aggregates: dict[str, Column], *, bucket: int = BUCKET) -> DataFrame:
    """Any aggregates of a segment's rows, in one pass: (seg, aggregates)."""
    return _rows(series, segments, bucket).groupBy("seg").agg(*[a.alias(n) for n, a in aggregates.items()])


def segmented_sum(series: DataFrame, segments: DataFrame, value: str = "x", *, bucket: int = BUCKET) -> DataFrame:
    return segmented(series, segments, {"sum": F.sum(value)}, bucket=bucket)


def segmented_count(segments: DataFrame, n: int | DataFrame) -> DataFrame:
    """e - s, and 1 for an empty segment; ``n`` is the series or its length."""
    inside = check_segments(segments, length_of(n) if isinstance(n, DataFrame) else n)
    return inside.select("seg", F.greatest(F.col("e") - F.col("s"), F.lit(1)).cast("bigint").alias("count"))


def segmented_mean(series: DataFrame, segments: DataFrame, value: str = "x", *, bucket: int = BUCKET) -> DataFrame:
    return segmented(series, segments, {"mean": F.avg(value)}, bucket=bucket)


def _arg(series: DataFrame, segments: DataFrame, value: str, largest: bool, bucket: int) -> DataFrame:
    picked = (first_max if largest else first_min)(no_nan(F.col(value)), F.col("i"))
    found = segmented(series, segments, {"__p": picked}, bucket=bucket)
    return found.select("seg", F.col("__p.value").alias("value"), (-F.col("__p.neg") if largest else F.col("__p.at")).alias("at"))


def segmented_max(series: DataFrame, segments: DataFrame, value: str = "x", *, bucket: int = BUCKET) -> DataFrame:
    """(seg, value, at): the largest value and the first place that has it. NaN is an error."""
    return _arg(series, segments, value, True, bucket)


def segmented_min(series: DataFrame, segments: DataFrame, value: str = "x", *, bucket: int = BUCKET) -> DataFrame:
    return _arg(series, segments, value, False, bucket)


def segmented_argmax(series: DataFrame, segments: DataFrame, value: str = "x", *, bucket: int = BUCKET) -> DataFrame:
    return segmented_max(series, segments, value, bucket=bucket).select("seg", "at")


def segmented_argmin(series: DataFrame, segments: DataFrame, value: str = "x", *, bucket: int = BUCKET) -> DataFrame:
    return segmented_min(series, segments, value, bucket=bucket).select("seg", "at")


def segmented_where(series: DataFrame, segments: DataFrame, wanted: str = "want", value: str = "x", *, bucket: int = BUCKET) -> DataFrame:
    """(seg, places): ordered places where the value equals the segment's ``wanted``; an empty array for none."""
    rows = _rows(series, segments, bucket, wanted)
    hits = rows.where(F.col(value) == F.col(wanted)).groupBy("seg").agg(F.sort_array(F.collect_list("i")).alias("places"))
    return segments.select("seg").join(hits, "seg", "left").select("seg", F.coalesce("places", F.array().cast("array<bigint>")).alias("places"))


def reduceat(series: DataFrame, starts: DataFrame, value: str = "x", *, largest: bool = True, bucket: int = BUCKET) -> DataFrame:
    """Arg-extreme of consecutive segments given by their starts (seg, s): each ends where the next begins, the last at
    the series' end; one that ends before it begins takes its start."""
    block = F.floor(F.col("seg") / STARTS_A_BLOCK)
    own = Window.partitionBy("__block").orderBy("seg")
    blocks = starts.groupBy(block.alias("__block")).agg(F.min_by("s", "seg").alias("__s"))  # one row for so many starts
    following = blocks.select("__block", F.lead("__s").over(Window.orderBy("__block")).alias("__next"))
    rows = starts.withColumn("__block", block).join(following, "__block")
    n = length_of(series)
    ends = F.coalesce(F.lead("s").over(own), "__next", n)
    segments = rows.withColumn("e", F.greatest(ends, F.col("s"))).select("seg", "s", "e")
    return (segmented_argmax if largest else segmented_argmin)(series, segments, value, bucket=bucket)
