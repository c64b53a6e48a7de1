"""Queries of file formats, the repository, table generators and text."""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.vectorized import array_function
from ..operators import generators as gen
from ..sources import arrays, lzf, pcd, ply, repository
from ..sources.headers import write_whole
from ..streaming import running
from .common import P, big, points, r6, scratch, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return wrap


_FLOATS = f"SELECT CAST(idx AS INTEGER) AS idx, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 6) + 0.0 AS x, round(CAST(CAST(y AS FLOAT) AS DOUBLE), 6) + 0.0 AS y, round(CAST(CAST(z AS FLOAT) AS DOUBLE), 6) + 0.0 AS z FROM ({P})"


def _floats(spark, d):
    return points(spark, d).select(F.col("idx").cast("int").alias("idx"), *[F.col(c).cast("float").alias(c) for c in "xyz"])


@query("pcd_roundtrip", _FLOATS)
def _(spark, d):
    spark.dataSource.register(pcd.PcdSource)
    path = scratch(spark, "pcd")
    _floats(spark, d).write.format("pcd").mode("append").save(path)
    return spark.read.format("pcd").load(path).select("idx", *r6("x", "y", "z"))


@query("ply_roundtrip", _FLOATS)
def _(spark, d):
    spark.dataSource.register(ply.PlySource)
    path = scratch(spark, "ply") + ".ply"
    ply.write_ply(path, _floats(spark, d), comment="points")
    return spark.read.format("ply").load(path).select("idx", *r6("x", "y", "z"))


@query("pcd_append", "SELECT CAST(vec_id AS INTEGER) AS idx, label FROM embeddings")
def _(spark, d):
    """Two writes under one path add up; a third one overwrites another path's first."""
    spark.dataSource.register(pcd.PcdSource)
    rows, path, other = table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("idx"), "label"), scratch(spark, "pcd"), scratch(spark, "pcd")
    for k in (0, 1):
        rows.where(F.col("idx") % 2 == k).write.format("pcd").mode("append").save(path)
    rows.limit(3).write.format("pcd").mode("append").save(other)
    read = spark.read.format("pcd").load(path)
    read.write.format("pcd").mode("overwrite").save(other)
    return spark.read.format("pcd").load(other)


_NATIONS = "SELECT CAST(n_nationkey AS INTEGER) AS a, CAST(n_regionkey AS INTEGER) AS b, n_nationkey / 4.0 AS x FROM nation"


def _nations(spark, d) -> list[tuple[int, int, float]]:
    """The nations, which are a fixed few, as (key, region, quarter of the key)."""
    return sorted((r[0], r[1], r[0] / 4) for r in table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect())


def _pcd_head(n: int, data: str) -> str:
    return f"VERSION .7\nFIELDS a b x\nSIZE 4 4 4\nTYPE I I F\nCOUNT 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA {data}\n"


@query("pcd_ascii", _NATIONS)
def _(spark, d):
    spark.dataSource.register(pcd.PcdSource)
    rows, path = _nations(spark, d), scratch(spark, "ascii") + ".pcd"
    write_whole(path, (_pcd_head(len(rows), "ascii") + "".join(f"{a} {b} {x}\n" for a, b, x in rows)).encode())
    return spark.read.format("pcd").load(path).select("a", "b", *r6("x"))


@query("pcd_compressed", _NATIONS)
def _(spark, d):
    spark.dataSource.register(pcd.PcdSource)
    rows, path = _nations(spark, d), scratch(spark, "packed") + ".pcd"
    raw = b"".join(np.array(column, kind).tobytes() for column, kind in zip(zip(*rows), ("<i4", "<i4", "<f4")))
    packed = lzf.compress(raw)
    write_whole(path, _pcd_head(len(rows), "binary_compressed").encode() + struct.pack("<II", len(packed), len(raw)) + packed)
    return spark.read.format("pcd").load(path).select("a", "b", *r6("x"))


@query("ply_ascii", _NATIONS)
def _(spark, d):
    spark.dataSource.register(ply.PlySource)
    rows, path = _nations(spark, d), scratch(spark, "ascii") + ".ply"
    head = f"ply\nformat ascii 1.0\nelement vertex {len(rows)}\nproperty int a\nproperty int b\nproperty float x\nend_header\n"
    write_whole(path, (head + "".join(f"{a} {b} {x}\n" for a, b, x in rows)).encode())
    return spark.read.format("ply").load(path).select("a", "b", *r6("x"))


def _mesh(spark, d) -> str:
    """A mesh file: the points, coloured by label, a polygon of r + 3 corners from 10 r on for each region r, and an edge from
    each nation to its region."""
    spark.dataSource.register(ply.PlySource)
    path = scratch(spark, "mesh") + ".ply"
    vertex = points(spark, d, "label").select("idx", *[F.col(c).cast("float").alias(c) for c in "xyz"], (F.col("label") * 25).cast("int").alias("red"))
    corners = F.sequence(F.col("r_regionkey") * 10, F.col("r_regionkey") * 11 + 2).cast("array<int>")
    face = table(spark, d, "region").select(F.col("r_regionkey").alias("idx"), corners.alias("corners"))
    edge = table(spark, d, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_nationkey").cast("int").alias("a"), F.col("n_regionkey").cast("int").alias("b"))
    ply.write_ply(path, vertex, face, edge, comment="a mesh", order="idx", types={"red": "uchar"})
    return path


@query("ply_faces", "SELECT CAST(r_regionkey * 10 AS INTEGER) AS a, CAST(r_regionkey * 10 + t + 1 AS INTEGER) AS b, CAST(r_regionkey * 10 + t + 2 AS INTEGER) AS c FROM region, range(0, r_regionkey + 1) x(t)")
def _(spark, d):
    tri = spark.read.format("ply").option("element", "face").load(_mesh(spark, d))
    return tri.select(*[F.col("tri")[i].cast("int").alias(c) for i, c in enumerate("abc")])


@query("ply_edges", "SELECT CAST(n_nationkey AS INTEGER) AS a, CAST(n_regionkey AS INTEGER) AS b FROM nation")
def _(spark, d):
    return spark.read.format("ply").option("element", "edge").load(_mesh(spark, d))


@query("ply_colours", f"SELECT round(CAST(CAST(x AS FLOAT) AS DOUBLE), 6) + 0.0 AS x, CAST(label * 25 AS INTEGER) AS red FROM ({P})")
def _(spark, d):
    return spark.read.format("ply").load(_mesh(spark, d)).select(*r6("x"), F.col("red").cast("int").alias("red"))


@query("triangle_fan", "WITH l AS (SELECT n_regionkey AS f, list(n_nationkey ORDER BY n_nationkey) AS p FROM nation GROUP BY n_regionkey), t AS (SELECT f, p, unnest(range(2, len(p))) AS i FROM l) SELECT f, p[1] AS a, p[i] AS b, p[i + 1] AS c FROM t")
def _(spark, d):
    faces = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("f")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("p"))
    return faces.select("f", F.explode(S.triangle_fan(F.col("p"))).alias("t")).select("f", *[F.col("t")[i].alias(c) for i, c in enumerate("abc")])


# the colour of label / 9 between five stops, its bytes below 255 in one whole number
_RGB = """SELECT *, CASE WHEN t <= 2 THEN 0 WHEN t <= 3 THEN t - 2 ELSE 1 END AS r, CASE WHEN t <= 1 THEN t WHEN t <= 3 THEN 1 ELSE 1 - (t - 3) END AS g, CASE WHEN t <= 1 THEN 1 WHEN t <= 2 THEN 1 - (t - 1) ELSE 0 END AS b
 FROM (SELECT *, (label - (SELECT min(label) FROM embeddings)) / ((SELECT max(label) FROM embeddings) - (SELECT min(label) FROM embeddings)) * 4 AS t FROM embeddings)"""


@query("cloud_compare", f"SELECT round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS x, round(CAST(embedding[2] AS DOUBLE), 6) + 0.0 AS y, round(CAST(embedding[3] AS DOUBLE), 6) + 0.0 AS z, CAST(4278190080 + floor(r * 255) * 65536 + floor(g * 255) * 256 + floor(b * 255) AS BIGINT) AS rgb FROM ({_RGB})")
def _(spark, d):
    """Written to a file and read again; the float rgb is taken as the four bytes that it holds."""
    spark.dataSource.register(pcd.PcdSource)
    path = scratch(spark, "compare")
    pcd.cloud_compare(points(spark, d, "label"), "label").write.format("pcd").mode("append").save(path)

    def bits(batches):
        for at in batches:
            whole = at["rgb"].to_numpy(zero_copy_only=False).view("<u4").astype("int64")
            yield pa.RecordBatch.from_arrays([*at.columns[:3], pa.array(whole)], ["x", "y", "z", "rgb"])

    found = spark.read.format("pcd").load(path).mapInArrow(bits, "x float, y float, z float, rgb long")
    return found.select(*r6("x", "y", "z"), "rgb")


@query("reconstruction_files", "SELECT CAST(n_regionkey AS INTEGER) AS row, CAST(n_nationkey % 5 AS INTEGER) AS col, CAST(0 AS INTEGER) AS ch, CAST(n_nationkey AS DOUBLE) AS v FROM (SELECT (row_number() OVER (ORDER BY n_nationkey) - 1) // 5 AS n_regionkey, n_nationkey FROM nation)")
def _(spark, d):
    """A map of 5 x 5 nation keys in the reconstruction format: width first."""
    folder, keys = scratch(spark, "maps"), np.array([a for a, _, _ in _nations(spark, d)], "<f4")
    write_whole(f"{folder}/a.bin", b"5&5&1&" + keys.tobytes())
    return arrays.read_reconstruction(spark, folder).select("row", "col", "ch", "v")


@query("npy_files", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS i, CAST(n_nationkey AS DOUBLE) AS v FROM nation")
def _(spark, d):
    folder, out = scratch(spark, "npy"), io.BytesIO()
    np.save(out, np.array([a for a, _, _ in _nations(spark, d)]).reshape(5, -1))
    write_whole(f"{folder}/a.npy", out.getvalue())
    return arrays.read_npy(spark, folder).select("i", "v")


@query("find_paths", "SELECT 'r' || r_regionkey AS name FROM region")
def _(spark, d):
    folder = scratch(spark, "tree")
    for r in table(spark, d, "region").collect():  # a fixed few
        write_whole(f"{folder}/r{r['r_regionkey']}/deep/file.txt", b"x")
    found = arrays.find_paths(spark, folder, lambda p: p.rlike(r"/r\d+$"))
    return found.where("is_dir").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))


@query("clear_cache", "SELECT count(*) > 0 AS first, false AS second FROM region")
def _(spark, d):
    path = scratch(spark, "cache")
    repository.save_cache(table(spark, d, "region"), path)
    found = [repository.clear_cache(spark, path) for _ in range(2)]
    return table(spark, d, "region").limit(1).select(F.lit(found[0]).alias("first"), F.lit(found[1]).alias("second"))


@query("repository_attribute", "SELECT 'part' AS name, CAST(count(*) AS VARCHAR) AS rows FROM part")
def _(spark, d):
    repo = repository.Repository(spark, scratch(spark, "repository"))
    name = repo.add_item("part", table(spark, d, "part").limit(5), rows=str(table(spark, d, "part").count()))
    return spark.range(1).select(F.lit("part").alias("name"), F.lit(repo.get_attribute(name)["rows"]).alias("rows"))


@query("array_function", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 2, 6) + 0.0 AS a, round(CAST(embedding[33] AS DOUBLE) * 2, 6) + 0.0 AS b FROM embeddings")
def _(spark, d):
    """A function of stacked arrays: rows of 2 x 32, transposed and doubled."""
    twice = array_function(shape=(2, 32), permute=(1, 0))(lambda stacked: stacked * 2)
    out = twice(F.transform("embedding", lambda v: v.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", out.alias("o")).select("vec_id", (F.round(F.col("o")[0], 6) + 0.0).alias("a"), (F.round(F.col("o")[1], 6) + 0.0).alias("b"))


@query("utc_time", "SELECT true AS now")
def _(spark, d):
    apart = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.to_timestamp(S.utc_now("yyyy-MM-dd HH:mm:ss")))
    return spark.range(1).select((F.abs(apart) < 5).alias("now"))


@query("array_files", "SELECT CAST(vec_id // 64 AS INTEGER) AS img, CAST(vec_id % 64 AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST(round(abs(CAST(v AS DOUBLE)) * 255) AS INTEGER) AS level FROM (SELECT vec_id, unnest(range(0, 64)) AS c, unnest(embedding) AS v FROM embeddings)")
def _(spark, d):
    """Images of 64 vectors each, written as PNG files and read again: values as 8-bit levels."""
    pixels = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("col", "v"))
    tiles = pixels.select(F.floor(F.col("vec_id") / 64).alias("img"), (F.col("vec_id") % 64).cast("int").alias("row"), "col", F.lit(0).alias("ch"), F.abs(F.col("v").cast("double")).alias("v"))
    folder = scratch(spark, "png")
    arrays.write_png(tiles, folder).count()
    found = arrays.read_png(spark, folder)
    return found.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("int").alias("img"), "row", "col", F.round(F.col("v") * 255).cast("int").alias("level"))


@query("repository_list", "SELECT 'nation.parquet' AS name, 'small' AS kind UNION ALL SELECT 'region.parquet', 'small'")
def _(spark, d):
    repo = repository.Repository(spark, scratch(spark, "repository"))
    for name, kind in (("nation", "small"), ("region", "small"), ("part", "large")):
        repo.add_item(name, table(spark, d, name), kind=kind)
    return repo.list_items(F.col("attributes")["kind"] == "small").select("name", F.col("attributes")["kind"].alias("kind"))


@query("repository_item", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    repo = repository.Repository(spark, scratch(spark, "repository"))
    repo.add_item("region", table(spark, d, "region"))
    repo.add_item("nation", table(spark, d, "nation"))
    repo.del_item("nation.parquet")
    assert "nation.parquet" not in repo
    return repo.get_item("region.parquet").select("r_regionkey", "r_name")


@query("materialized", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def _(spark, d):
    path = scratch(spark, "kept")
    make = lambda: table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    repository.materialize(spark, path, make)
    return repository.materialize(spark, path, lambda: 1 / 0)


@query("positional_encoding", "SELECT CAST(p AS INTEGER) AS pos, CAST(s AS INTEGER) AS slot, round(CASE WHEN s % 2 = 0 THEN sin(p / pow(10000, 2 * (s // 2) / 7.0)) ELSE cos(p / pow(10000, 2 * (s // 2) / 7.0)) END, 6) + 0.0 AS v FROM range(50) a(p), range(7) b(s)")
def _(spark, d):
    return gen.positional_encoding(spark, 50, 7).select("pos", "slot", *r6("v"))


@query("lr_schedule", "SELECT CAST(e AS BIGINT) AS epoch, round(CASE WHEN e < 10 THEN 0.1 + (0.05 + 0.95 * (cos(10 / 90.0 * pi()) + 1) / 2 - 0.1) * e / 10 ELSE 0.05 + 0.95 * (cos(e / 90.0 * pi()) + 1) / 2 END * 0.3, 6) + 0.0 AS lr FROM range(90) t(e)")
def _(spark, d):
    lr = S.learning_rate(F.lit(0.3), F.col("id"), start_scale=0.1, warmup_epoch=10, final_scale=0.05, total_epoch=90, mode="cosine")
    return spark.range(90).select(F.col("id").alias("epoch"), lr.alias("lr")).select("epoch", *r6("lr"))


@query("lr_decay", "SELECT CAST(e AS BIGINT) AS epoch, round(exp(ln(0.05 + 1e-7) * e / 40.0), 6) + 0.0 AS exponential, round(1 - 0.95 * e / 40.0, 6) + 0.0 AS straight FROM range(41) t(e)")
def _(spark, d):
    kinds = {"exponential": "exp", "straight": "linear"}
    return spark.range(41).select(F.col("id").alias("epoch"), *[S.decay(F.col("id"), mode=m, final_scale=0.05, total_epoch=40).alias(n) for n, m in kinds.items()]).select("epoch", *r6(*kinds))


@query("bbox_vertices", "SELECT p_partkey AS box, CAST(v AS INTEGER) AS vertex, CASE WHEN v < 4 THEN 1 ELSE -1 END * p_size / 2.0 AS x, CASE WHEN v IN (0, 1, 4, 5) THEN 1 ELSE -1 END * p_size / 2.0 * 2 AS y, CASE WHEN v IN (0, 3, 4, 7) THEN 1 ELSE -1 END * p_size / 2.0 * 3 AS z FROM part, range(8) t(v)")
def _(spark, d):
    boxes = table(spark, d, "part").select(F.col("p_partkey").alias("box"), *[(F.col("p_size") * (i + 1)).alias(c) for i, c in enumerate(("lx", "ly", "lz"))])
    return gen.box_corners(boxes).select("box", "vertex", *r6("x", "y", "z"))


_EDGES = "(VALUES (0, 0, 1, true), (0, 1, 5, true), (0, 5, 4, true), (0, 4, 0, true), (1, 3, 2, true), (1, 2, 6, true), (1, 6, 7, true), (1, 7, 3, true), (2, 0, 3, false), (2, 1, 2, false), (2, 5, 6, false), (2, 4, 7, false)) e(part, a, b, ring)"


@query("bbox_lines", f"SELECT p_partkey AS box, CAST(part AS INTEGER) AS part, CAST(sum(greatest(2, CAST(floor(p_size * CASE WHEN a // 4 <> b // 4 THEN 1 WHEN (a % 4 IN (0, 1)) <> (b % 4 IN (0, 1)) THEN 2 ELSE 3 END / 0.5) AS BIGINT)) - CASE WHEN ring THEN 0 ELSE 1 END) AS BIGINT) AS points FROM part, {_EDGES} GROUP BY 1, 2")
def _(spark, d):
    """How many points each box's two rings and its struts have; where corners lie is what bbox_vertices compares."""
    boxes = table(spark, d, "part").select(F.col("p_partkey").alias("box"), *[(F.col("p_size") * (i + 1)).cast("double").alias(c) for i, c in enumerate(("lx", "ly", "lz"))])
    return gen.box_lines(gen.box_corners(boxes), eps=0.5).groupBy("box", "part").agg(F.count("*").alias("points"))


_CHAIN = f"WITH p AS (SELECT idx % 7 AS g, idx, x, y, z FROM ({P})), c AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM p WINDOW w AS (PARTITION BY g ORDER BY idx)), n AS (SELECT *, greatest(2, CAST(floor(sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)+(nz-z)*(nz-z)) / 0.05) AS INTEGER)) AS m FROM c WHERE nx IS NOT NULL), s AS (SELECT *, unnest(range(0, m)) AS step FROM n) "


@query("polyline_points", _CHAIN + "SELECT idx, CAST(step AS INTEGER) AS step, round(x + (nx - x) * step / m, 6) + 0.0 AS x, round(y + (ny - y) * step / m, 6) + 0.0 AS y, round(z + (nz - z) * step / m, 6) + 0.0 AS z FROM s UNION ALL SELECT idx, 0, round(x, 6) + 0.0, round(y, 6) + 0.0, round(z, 6) + 0.0 FROM c WHERE nx IS NULL")
def _(spark, d):
    chain = points(spark, d).withColumn("by", F.col("idx") % 7)
    return gen.polyline(chain, by="by", order="idx", eps=0.05).select("idx", "step", *r6("x", "y", "z"))


@query("polygon_points", _CHAIN.replace("lead(x) OVER w", "coalesce(lead(x) OVER w, first_value(x) OVER w)").replace("lead(y) OVER w", "coalesce(lead(y) OVER w, first_value(y) OVER w)").replace("lead(z) OVER w", "coalesce(lead(z) OVER w, first_value(z) OVER w)") + "SELECT idx, CAST(step AS INTEGER) AS step, round(x + (nx - x) * step / m, 6) + 0.0 AS x, round(y + (ny - y) * step / m, 6) + 0.0 AS y, round(z + (nz - z) * step / m, 6) + 0.0 AS z FROM s")
def _(spark, d):
    ring = points(spark, d).withColumn("by", F.col("idx") % 7)
    return gen.polygon(ring, by="by", order="idx", eps=0.05).select("idx", "step", *r6("x", "y", "z"))


@query("pose_axes", f"SELECT idx, CAST(a AS INTEGER) AS axis, CAST(s AS INTEGER) AS step, round(x + CASE WHEN a = 0 THEN s * 0.25 ELSE 0 END, 6) + 0.0 AS x, round(y + CASE WHEN a = 1 THEN s * 0.25 ELSE 0 END, 6) + 0.0 AS y, round(z + CASE WHEN a = 2 THEN s * 0.25 ELSE 0 END, 6) + 0.0 AS z FROM ({P}), range(3) t(a), range(5) u(s)")
def _(spark, d):
    unit = F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(3)]) for i in range(3)])
    return gen.pose_axes(points(spark, d), unit, keys=["idx"], length=1.0, number=5).select("idx", "axis", "step", *r6("x", "y", "z"))


@query("stacked_clouds", f"SELECT CAST(cloud AS INTEGER) AS cloud, CAST(s AS INTEGER) AS shown, count(*) AS n, CAST(sum(CASE WHEN s = cloud THEN 1 ELSE 0 END) AS DOUBLE) AS alpha FROM (SELECT CASE WHEN label < 5 THEN 0 ELSE 1 END AS cloud FROM ({P})), range(2) t(s) GROUP BY cloud, s")
def _(spark, d):
    p = points(spark, d, "label")
    both = gen.stack_clouds([(p.where("label < 5"), []), (p.where("label >= 5"), ["label"])], scale=(0, 10))
    return both.groupBy("cloud", "shown").agg(F.count("*").alias("n"), F.sum("a").alias("alpha"))


@query("markdown_rows", "SELECT '|   |   |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation")
def _(spark, d):
    return gen.markdown_table(table(spark, d, "nation"), ["n_nationkey", "n_name"], "n_nationkey")


@query("pixels_to_inches", "SELECT p_partkey, round(p_size / 91.79, 6) + 0.0 AS inches FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.pixels_to_inches(F.col("p_size")).alias("inches")).select("p_partkey", *r6("inches"))


@query("windowed_moments", "SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(var_pop(value), 6) + 0.0 AS var FROM events GROUP BY 1, 2")
def _(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = running.windowed_moments(events, time="ts", value="value", by=["event_type"])
    return out.select(F.unix_micros("start").alias("start"), "event_type", *big("n"), *r6("mean", "var"))
