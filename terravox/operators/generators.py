"""Tables made from parameters or a few points: encodings, axes, lines, boxes, stacked clouds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalar as S
from ..plans.physical import literal_rows


def positional_encoding(spark: SparkSession, seq: int, d: int, n: float = 10000) -> DataFrame:
    """(pos, slot, v) of a seq x d table."""
    pairs = spark.range(seq * d)
    pos, slot = F.floor(F.col("id") / max(d, 1)).cast("int"), (F.col("id") % max(d, 1)).cast("int")
    return pairs.select(pos.alias("pos"), slot.alias("slot")).withColumn("v", S.positional_value(F.col("pos"), F.col("slot"), max(d, 1), n))


def pose_axes(poses: DataFrame, rotation: Column, *, xyz: tuple[str, str, str] = ("x", "y", "z"), keys: list[str], length: float = 1.0, number: int = 20) -> DataFrame:
    """(keys, axis, step, x, y, z, r, g, b): points along each pose's three axes, red, green and blue."""
    at = poses.select(*keys, *[F.col(c).alias(f"__{c}") for c in "xyz"], rotation.alias("__r")) if xyz == ("x", "y", "z") else poses.select(*keys, *[F.col(c).alias(f"__{n}") for c, n in zip(xyz, "xyz")], rotation.alias("__r"))
    axes = at.withColumn("axis", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    along = F.col("step") * (length / (number - 1) if number > 1 else 0.0)
    point = [(F.col(f"__{c}") + F.get(F.col("__r")[i], F.col("axis")) * along).alias(c) for i, c in enumerate("xyz")]
    color = [F.when(F.col("axis") == i, 1.0).otherwise(0.0).alias(c) for i, c in enumerate("rgb")]
    return axes.select(*keys, "axis", "step", *point, *color)


def lines(segments: DataFrame, *, keys: list[str], src: tuple[str, ...] = ("sx", "sy", "sz"), dst: tuple[str, ...] = ("dx", "dy", "dz"), start: bool = True, end: bool = True, eps: float = 0.005) -> DataFrame:
    """(keys, step, x, y, z): max(2, floor(length / eps)) + 1 evenly spaced points a segment, ends left out on request."""
    way = G.sub([F.col(c) for c in dst], [F.col(c) for c in src])
    last = F.greatest(F.lit(2), F.floor(G.norm(way) / eps)).cast("int")
    steps = segments.withColumn("__last", last).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("__last"))))
    steps = steps.where(((F.col("step") > 0) if not start else F.lit(True)) & ((F.col("step") < F.col("__last")) if not end else F.lit(True)))
    return steps.select(*keys, "step", *[(F.col(s) + w * F.col("step") / F.col("__last")).alias(c) for s, w, c in zip(src, way, "xyz")])


def _chained(points: DataFrame, by: str, order: str, closed: bool) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) if closed else F.lead(c).over(w)
    return points.select(by, order, *[F.col(c).alias(f"s{c}") for c in "xyz"], *[following(c).alias(f"d{c}") for c in "xyz"])


def polygon(points: DataFrame, *, by: str, order: str, eps: float = 0.005) -> DataFrame:
    """Points of the closed ring through each group's corners; each corner once."""
    return lines(_chained(points, by, order, True), keys=[by, order], end=False, eps=eps)


def polyline(points: DataFrame, *, by: str, order: str, eps: float = 0.005) -> DataFrame:
    """Points of the open chain, the last corner included."""
    chain = _chained(points, by, order, False)
    last = chain.where(F.col("dx").isNull()).select(by, order, F.lit(0).alias("step"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"))
    return lines(chain.where(F.col("dx").isNotNull()), keys=[by, order], end=False, eps=eps).union(last)


#: The sign of x, y, z at corners 0 to 7.
CORNERS = [(1, 1, 1), (1, 1, -1), (1, -1, -1), (1, -1, 1), (-1, 1, 1), (-1, 1, -1), (-1, -1, -1), (-1, -1, 1)]
#: Corners of the two faces that are drawn as rings; struts join them in this order.
FACE_A, FACE_B = (0, 1, 5, 4), (3, 2, 6, 7)


def box_corners(boxes: DataFrame, *, box: str = "box", sizes: tuple[str, str, str] = ("lx", "ly", "lz")) -> DataFrame:
    """(box, vertex, x, y, z): the eight corners of centred boxes of the given side lengths."""
    corners = F.array(*[F.struct(F.lit(v).alias("vertex"), *[(F.col(s) * (0.5 * sign)).alias(c) for s, sign, c in zip(sizes, signs, "xyz")]) for v, signs in enumerate(CORNERS)])
    return boxes.select(box, F.explode(corners).alias("c")).select(box, "c.*")


def box_lines(corners: DataFrame, *, box: str = "box", eps: float = 0.005) -> DataFrame:
    """(box, part, x, y, z): points on the edges of boxes given by their corners (box, vertex, x, y, z).

    A box's corners are gathered by one exchange and its edges made from them in place: nothing is joined, so no table
    that grows with the boxes is broadcast.  Rings go through the corners that are there; struts need both of theirs.
    """
    boxes = corners.groupBy(box).agg(F.array_sort(F.collect_list(F.struct("vertex", "x", "y", "z"))).alias("__c"))
    edges = [_ring(part, face) for part, face in enumerate((FACE_A, FACE_B))] + [_strut(v, other) for v, other in zip(FACE_A, FACE_B)]
    every = boxes.select(box, F.explode(F.concat(*edges)).alias("e")).select(box, "e.*")
    out = lines(every, keys=[box, "part"], end=False, eps=eps)
    return out.where((F.col("part") < 2) | (F.col("step") > 0)).select(box, "part", "x", "y", "z")  # struts lack both ends


def _at_vertex(v: int) -> Column:
    return F.filter("__c", lambda c: c["vertex"] == v)


def _edge(part: int, a: Column, b: Column) -> Column:
    return F.struct(F.lit(part).alias("part"), *[a[c].alias(f"s{c}") for c in "xyz"], *[b[c].alias(f"d{c}") for c in "xyz"])


def _ring(part: int, face: tuple[int, ...]) -> Column:
    """Edges from each corner to the next, from the last to the first."""
    corners = F.flatten(F.array(*[_at_vertex(v) for v in face]))
    following = F.concat(F.slice(corners, 2, F.greatest(F.size(corners), F.lit(1))), F.slice(corners, 1, 1))
    return F.zip_with(corners, following, lambda a, b: _edge(part, a, b))


def _strut(v: int, other: int) -> Column:
    return F.flatten(F.transform(_at_vertex(v), lambda a: F.transform(_at_vertex(other), lambda b: _edge(2, a, b))))


def stack_clouds(clouds: list[tuple[DataFrame, list[str]]], *, scale: tuple[float, float] = (0, 100), color_map=None) -> DataFrame:
    """(cloud, shown, x, y, z, r, g, b, a): all clouds together, once for each cloud with the others' alpha 0.

    Each cloud is (rows with x, y, z, attribute columns): none is white, else see ``rgba_of``.
    """
    parts = []
    for k, (rows, attributes) in enumerate(clouds):
        rgba = S.rgba_of([F.col(a) for a in attributes] or [F.lit(1.0)] * 3, scale, color_map)
        parts.append(rows.select(F.lit(k).alias("cloud"), *[F.col(c).cast("double").alias(c) for c in "xyz"], *[c.alias(n) for c, n in zip(rgba, "rgba")]))
    every = reduce(DataFrame.union, parts)
    shown = every.withColumn("shown", F.explode(F.sequence(F.lit(0), F.lit(len(clouds) - 1))))
    return shown.withColumn("a", F.when(F.col("shown") == F.col("cloud"), F.col("a")).otherwise(0.0)).select("cloud", "shown", *"xyz", *"rgba")


def match_lines(before: DataFrame, after: DataFrame, matches: DataFrame, *, eps: float = 0.005) -> DataFrame:
    """Lines between matched rows (i, j) of two clouds keyed by i and j."""
    a = before.select("i", *[F.col(c).alias(f"s{c}") for c in "xyz"])
    b = after.select("j", *[F.col(c).alias(f"d{c}") for c in "xyz"])
    return lines(matches.select("i", "j").join(a, "i").join(b, "j"), keys=["i", "j"], eps=eps)


def markdown_table(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row ``markdown``: header lines and the rows in order. For tables that are meant to be read."""
    text = rows.select(F.col(order).alias("__o"), S.markdown_row([F.col(c) for c in columns]).alias("line"))
    lines_ = text.agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", "line"))), lambda s: s["line"]).alias("lines"))
    return lines_.select(F.concat_ws("\n", F.lit(S.markdown_header(len(columns))), F.array_join("lines", "\n")).alias("markdown"))
