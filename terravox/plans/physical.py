"""Plan shapes: bucketed range join, nearest as-of join, cell join, dense grids, floor division, first-wins extremes."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checks import positive


def first_max(value: Column, order: Column) -> Column:
    """Aggregate: struct(value, at) of the largest value, the smallest order among ties. Order must be numeric."""
    return F.max(F.struct(value.alias("value"), (-order).alias("neg")))


def first_min(value: Column, order: Column) -> Column:
    return F.min(F.struct(value.alias("value"), order.alias("at")))


def floor_div(value: Column, size: float) -> Column:
    """Floor of a quotient as floating-point floor division gives it: from the exact remainder, not the rounded quotient."""
    positive("size", size)
    k = F.lit(float(size))
    rest = value % k
    quotient = (value - rest) / k - F.when(rest < 0, 1.0).otherwise(0.0)
    return F.round(quotient).cast("bigint")


def bucketed_range_join(segments: DataFrame, rows: DataFrame, *, bucket: int, start: str = "s", end: str = "e", at: str = "i", keys: list[str] | None = None) -> DataFrame:
    """Rows with ``start <= at < end`` beside each segment, by an equi-join on blocks of ``bucket`` places.

    A segment is repeated for each block that it touches, so rows are shuffled once by (keys, block) and a segment's
    cost follows its length.  A segment without places matches the row at its start.
    """
    positive("bucket", bucket)
    on = [*(keys or []), "__block"]
    last = F.greatest(F.col(end), F.col(start) + 1)
    blocks = F.sequence(F.floor(F.col(start) / bucket), F.floor((last - 1) / bucket))
    left = segments.withColumn("__last", last).withColumn("__block", F.explode(blocks))
    right = rows.withColumn("__block", F.floor(F.col(at) / bucket))
    joined = left.join(right, on).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col("__last")))
    return joined.drop("__block", "__last")


def nearest_asof(probes: DataFrame, base: DataFrame, *, time: str, by: list[str], tie: str, probe_id: str, base_columns: list[str], span: float | None = None) -> DataFrame:
    """Each probe with the base row nearest in time within ``by``; the later row wins a tie.

    Both sides are unioned and swept once per entity by two running windows, one in each direction: the last base row
    before a probe and the first one at or after it; the cost is linear in an entity's rows.  With ``span`` an entity is
    cut into ranges of so much time, each swept on its own; what lies nearest before and after a range is carried over
    from one row a range, so that a frequent entity is no single task.  Output: by, probe_id, time, then base_columns
    (null without a base row).
    """
    payload = F.struct(F.col(time).alias("__t"), *[F.col(c).alias(c) for c in base_columns])
    none = F.lit(None)
    b = base.select(*by, F.col(time).alias("__time"), F.col(tie).cast("long").alias("__tie"), F.lit(1).alias("__kind"), none.cast("long").alias("__probe"), payload.alias("__row"))
    p = probes.select(*by, F.col(time).alias("__time"), F.col(probe_id).cast("long").alias("__tie"), F.lit(0).alias("__kind"), F.col(probe_id).cast("long").alias("__probe"))
    both = b.unionByName(p, allowMissingColumns=True)
    keys = [*by, "__range"] if span is not None else by
    if span is not None:
        both = both.withColumn("__range", F.floor(F.col("__time") / positive("span", span)))
    order = ["__time", "__kind", "__tie"]
    so_far = (Window.unboundedPreceding, -1)
    up = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*so_far)
    down = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(*so_far)
    latest = F.last("__row", ignorenulls=True)
    swept = both.select("*", latest.over(up).alias("__before"), latest.over(down).alias("__after")).where("__kind = 0")
    if span is not None:
        at = F.when(F.col("__kind") == 1, F.struct("__time", "__tie"))
        edges = both.groupBy(*keys).agg(F.max_by("__row", at).alias("__last"), F.min_by("__row", at).alias("__first"))
        ranges = lambda by_range: Window.partitionBy(*by).orderBy(by_range).rowsBetween(*so_far)
        carried = edges.select(
            *[F.col(c).alias(f"__k{n}") for n, c in enumerate(keys)],
            F.last("__last", ignorenulls=True).over(ranges("__range")).alias("__earlier"),
            F.last("__first", ignorenulls=True).over(ranges(F.desc("__range"))).alias("__later"),
        )
        same = F.lit(True)
        for n, c in enumerate(keys):
            same &= swept[c].eqNullSafe(carried[f"__k{n}"])
        swept = swept.join(carried, same).withColumns({"__before": F.coalesce("__before", "__earlier"), "__after": F.coalesce("__after", "__later")})
    earlier = F.col("__after").isNull() | (F.col("__before").isNotNull() & ((F.col("__time") - F.col("__before.__t")) < (F.col("__after.__t") - F.col("__time"))))
    chosen = F.when(earlier, F.col("__before")).otherwise(F.col("__after"))
    out = swept.withColumn("__chosen", chosen)
    return out.select(*by, F.col("__probe").alias(probe_id), F.col("__time").alias(time), *[F.col(f"__chosen.{c}").alias(c) for c in base_columns])


def cell_join(src: DataFrame, dst: DataFrame, *, radius: float, xyz: tuple[str, str, str] = ("x", "y", "z"), src_id: str = "i", dst_id: str = "j") -> DataFrame:
    """(src_id, dst_id, d2) of all pairs within ``radius``: an equi-join on cubic cells of that size.

    Each source row is repeated for its 27 neighbouring cells; destinations are shuffled once.
    """
    positive("radius", radius)
    cell = [F.floor(F.col(c) / radius) for c in xyz]
    around = F.array(*[F.struct(*[F.lit(o).alias(f"o{a}") for a, o in enumerate(off)]) for off in product((-1, 0, 1), repeat=3)])
    s = src.select(F.col(src_id).alias("__i"), *[F.col(c).alias(f"__s{a}") for a, c in enumerate(xyz)], *[c.alias(f"__b{a}") for a, c in enumerate(cell)], F.explode(around).alias("__o"))
    s = s.select("__i", "__s0", "__s1", "__s2", *[(F.col(f"__b{a}") + F.col(f"__o.o{a}")).alias(f"__c{a}") for a in range(3)])
    d = dst.select(F.col(dst_id).alias("__j"), *[F.col(c).alias(f"__d{a}") for a, c in enumerate(xyz)], *[c.alias(f"__c{a}") for a, c in enumerate(cell)])
    d2 = sum(((F.col(f"__s{a}") - F.col(f"__d{a}")) * (F.col(f"__s{a}") - F.col(f"__d{a}")) for a in range(1, 3)), (F.col("__s0") - F.col("__d0")) * (F.col("__s0") - F.col("__d0")))
    pairs = s.join(d, ["__c0", "__c1", "__c2"]).select(F.col("__i").alias(src_id), F.col("__j").alias(dst_id), d2.alias("d2"))
    return pairs.where(F.col("d2") <= radius * radius)


#: Cells are halved until a place shares its own with this many on average, itself included, at most so often.
CROWD, MOST_HALVINGS = 4, 24


def halvings(dst: DataFrame, *, radius: float, xyz: tuple[str, str, str] = ("x", "y", "z")) -> int:
    """How often cells of size ``radius`` have to be halved to hold few different places each."""
    positive("radius", radius)
    places = dst.select(*[F.col(c).alias(f"__p{a}") for a, c in enumerate(xyz)]).distinct()
    cells = _in_cells(places, radius, MOST_HALVINGS).groupBy("__k", "__cell").agg(F.count(F.lit(1)).cast("double").alias("n"))
    crowd = {r["__k"]: r["crowd"] for r in cells.groupBy("__k").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd")).collect()}
    return min((k for k, n in crowd.items() if n <= CROWD), default=MOST_HALVINGS if crowd else 0)


def _size(radius: float, levels: int) -> Column:
    return F.get(F.array(*[F.lit(radius / 2**k) for k in range(levels + 1)]), F.col("__k"))


def _in_cells(df: DataFrame, radius: float, levels: int) -> DataFrame:
    """Each row once a level, with its cell there as ``__cell``: a hash, so seldom are two cells taken for one."""
    every = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    return every.withColumn("__cell", F.xxhash64("__k", *[F.floor(F.col(f"__p{a}") / _size(radius, levels)) for a in range(3)]))


def halving_cell_join(src: DataFrame, dst: DataFrame, *, radius: float, levels: int, xyz: tuple[str, str, str] = ("x", "y", "z"), src_id: str = "i", dst_id: str = "j") -> DataFrame:
    """(src_id, dst_id, d2) of pairs within ``radius``, the nearest pairs of each source among them: of destinations at
    the same place only the smallest, and none beyond what a source is known to have.

    Cells have size ``radius`` and its halves.  A source first meets one destination of each cell it lies in; within the
    distance to the nearest of these it then looks through the cells of the smallest size not below twice that distance,
    eight at most (27 of the largest size).  So what a source is compared with follows how dense destinations are around
    it, not the radius; only where many sources lie far from a dense clump do all of them meet all of it.  Cells that
    share a hash are looked through together, which changes no distance.
    """
    positive("radius", radius)
    squares = [(F.col(f"__s{a}") - F.col(f"__p{a}")) * (F.col(f"__s{a}") - F.col(f"__p{a}")) for a in range(3)]
    d2 = squares[0] + squares[1] + squares[2]
    places = dst.groupBy(*[F.col(c).alias(f"__p{a}") for a, c in enumerate(xyz)]).agg(F.min(dst_id).alias("__j"))
    cells = _in_cells(places, radius, levels).drop("__k")
    one = cells.groupBy("__cell").agg(F.min(F.struct("__j", "__p0", "__p1", "__p2")).alias("__one")).select("__cell", "__one.*")

    s = src.select(F.col(src_id).alias("__i"), *[F.col(c).alias(f"__p{a}") for a, c in enumerate(xyz)])
    own = _in_cells(s, radius, levels).drop("__k").withColumnsRenamed({f"__p{a}": f"__s{a}" for a in range(3)})
    # many sources may lie in one of the largest cells: as both sides are shuffled for this join, Spark can split it
    own, one = (side.withColumn("__cell", F.xxhash64("__cell")) for side in (own, one))
    met = own.join(one, "__cell", "left").groupBy("__i", "__s0", "__s1", "__s2").agg(F.min(d2).alias("__met"))
    ball = met.withColumn("__limit", F.least("__met", F.lit(radius * radius)))  # passes over null
    ball = ball.withColumn("__u", F.sqrt("__limit") * (1 + 1e-9) + 1e-150)  # for rounding
    ball = ball.withColumn("__k", sum(((2 * F.col("__u") <= radius / 2**k).cast("int") for k in range(1, levels + 1)), F.lit(0)))
    for a in range(3):
        first, last = (F.floor((F.col(f"__s{a}") + way * F.col("__u")) / _size(radius, levels)) for way in (-1, 1))
        ball = ball.withColumn(f"__c{a}", F.explode(F.sequence(first, last)))
    ball = ball.select("__i", "__s0", "__s1", "__s2", "__limit", F.xxhash64("__k", "__c0", "__c1", "__c2").alias("__cell"))
    pairs = ball.join(cells, "__cell").withColumn("d2", d2).where(F.col("d2") <= F.col("__limit"))
    return pairs.select(F.col("__i").alias(src_id), F.col("__j").alias(dst_id), "d2")


def dense_grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """(row, col) of every pixel."""
    n = spark.range(height * width)
    return n.select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant table, made from literals so that no Python is run."""
    names = [p.strip().split(" ")[0] for p in schema.split(",")]
    kinds = [p.strip().split(" ", 1)[1] for p in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(k).alias(n) for v, n, k in zip(r, names, kinds)]) for r in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")
