import pytest
from pyspark.errors import PySparkException

from terravox.operators import moments, segments, windows


def series(spark, xs):
    return spark.createDataFrame(list(enumerate(xs)), "i long, x long")


def cut(spark, s, e):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(s, e))], "seg long, s long, e long")


def column(df, name, by="seg"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_disjoint(spark):
    x, g = series(spark, [1, 2, 3, 4, 5]), cut(spark, [0, 3], [3, 5])
    assert column(segments.segmented_sum(x, g), "sum") == [6, 9]
    assert column(segments.segmented_count(g, x), "count") == [3, 2]
    assert column(segments.segmented_mean(x, g), "mean") == [2, 4.5]


def test_touching_and_nested(spark):
    x, g = series(spark, [2, 3, 5, 1, 4, 7]), cut(spark, [0, 2, 3, 5], [2, 3, 6, 6])
    top, low = segments.segmented_max(x, g, bucket=2), segments.segmented_min(x, g, bucket=2)
    assert column(top, "value") == [3, 5, 7, 7] and column(top, "at") == [1, 2, 5, 5]
    assert column(low, "value") == [2, 5, 1, 7] and column(low, "at") == [0, 2, 3, 5]
    wanted = g.withColumn("want", segments.F.element_at(segments.F.array(*[segments.F.lit(v) for v in (3, 5, 7, 7)]), (segments.F.col("seg") + 1).cast("int")))
    assert column(segments.segmented_where(x, wanted), "places") == [[1], [2], [5], [5]]


def test_overlapping_with_ties(spark):
    x, g = series(spark, [2, 3, 3, 5, 1, 1, 4, 7]), cut(spark, [0, 0, 1, 3, 3, 7], [2, 3, 3, 7, 8, 8])
    assert column(segments.segmented_argmax(x, g), "at") == [1, 1, 1, 3, 7, 7]
    assert column(segments.segmented_argmin(x, g), "at") == [0, 0, 1, 4, 4, 7]


def test_empty_segment_takes_its_start(spark):
    x, g = series(spark, [1, 2, 4, 8]), cut(spark, [0, 1, 2], [1, 1, 4])
    assert column(segments.segmented_count(g, 4), "count") == [1, 1, 2]
    assert column(segments.segmented_sum(x, g), "sum") == [1, 2, 12]


@pytest.mark.parametrize(("start", "end"), [(0, 4), (3, 3), (-1, 2), (2, 1), (5, 9)])
def test_segments_outside_are_an_error(spark, start, end):
    x, g = series(spark, [1, 2, 3]), cut(spark, [0, start], [2, end])
    wanted = g.withColumn("want", segments.F.lit(1))
    for f in (segments.segmented_sum, segments.segmented_mean, segments.segmented_max, segments.segmented_min, segments.segmented_argmax, segments.segmented_argmin):
        with pytest.raises(PySparkException):
            f(x, g).collect()
    with pytest.raises(PySparkException):
        segments.segmented_where(x, wanted).collect()
    for n in (x, 3):
        with pytest.raises(PySparkException):
            segments.segmented_count(g, n).collect()


def test_reduceat_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(segments, "STARTS_A_BLOCK", 3)
    x = series(spark, [(7 * i) % 11 for i in range(40)])
    places = [0, 3, 3, 10, 9, 20, 21, 39]
    starts = spark.createDataFrame([(2 * k, s) for k, s in enumerate(places)], "seg long, s long")
    want = []
    for s, e in zip(places, [*places[1:], 40]):
        own = range(s, max(e, s + 1))
        want.append(max(own, key=lambda i: ((7 * i) % 11, -i)))
    assert column(segments.reduceat(x, starts), "at") == want


def test_reduceat(spark):
    x = series(spark, [2, 3, 3, 5, 1, 1, 4, 7, 7])
    starts = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (3, 3)], "seg long, s long")
    assert column(segments.reduceat(x, starts), "at") == [1, 2, 2, 7]
    assert column(segments.reduceat(x, starts, largest=False), "at") == [0, 2, 2, 4]


def test_nan_is_refused(spark):
    x = spark.createDataFrame([(0, 1.0), (1, float("nan"))], "i long, x double")
    with pytest.raises(PySparkException):
        segments.segmented_max(x, cut(spark, [0], [2])).collect()


@pytest.mark.parametrize("size", [3, 4, 6])
def test_window_indices(spark, size):
    n, half = 5, size // 2
    places = range(n) if size % 2 else range(n + 1)
    want = [(max(0, w - half), min(n, w + half + size % 2)) for w in places]
    got = [(r["s"], r["e"]) for r in windows.window_indices(spark, n, size, full_only=False).orderBy("w").collect()]
    assert got == want
    full = [(r["s"], r["e"]) for r in windows.window_indices(spark, n, size).orderBy("w").collect()]
    assert full == [(s, e) for s, e in want if e - s == size]


def test_overlapping_windows(spark):
    assert windows.overlapping_windows(spark, 3, 5).count() == 0
    assert [r["s"] for r in windows.overlapping_windows(spark, 11, 4, 0.5).orderBy("s").collect()] == [0, 2, 4, 6, 7]
    with pytest.raises(ValueError):
        windows.overlapping_windows(spark, 10, 4, 1.0)


def test_sliding_arguments(spark):
    x = series(spark, [1, 2, 3])
    for bad in ({"size": 4}, {"methods": ["median"]}):
        with pytest.raises(ValueError):
            windows.sliding_window(x, "x", by=["i"], order=["i"], at="i", **bad)


def test_merge_moments(spark):
    states = spark.createDataFrame([(0, 0.0, 0.0), (15, 3.5, 1.75)], "n long, mean double, var double")
    assert tuple(moments.merge_moments(states).first()) == (15, 3.5, 1.75)
    assert tuple(moments.merge_moments(states.where("false")).first()) == (0, 0.0, 0.0)
    assert tuple(moments.merge_moments(states.where("n = 0")).first()) == (0, 0.0, 0.0)
