"""Queries of sparse tensors, attention, alignment and neighbours."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import align, attention, parameters, sparse
from ..plans.physical import literal_rows
from .common import P, points, r6, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return wrap


def _voxels(spark, d):
    """Every embedding as a row of a sparse tensor: cells of 0.1, features slots 3 and 4; idx and label kept."""
    cells = [F.floor(F.col(c) / 0.1).cast("int").alias(c) for c in "xyz"]
    cloud = points(spark, d, "label", *[F.col("embedding")[i].alias(f"f{i}") for i in (3, 4)])
    return cloud.select("idx", "label", F.lit(0).alias("batch"), *cells, F.array("f3", "f4").alias("f"))


def _sides(spark, d):
    v = _voxels(spark, d)
    return v.where("label < 5").drop("label"), v.where("label >= 5").drop("label")


_V = f"WITH p AS ({P}), v AS (SELECT idx, label, CAST(floor(x / 0.1) AS INTEGER) AS x, CAST(floor(y / 0.1) AS INTEGER) AS y, CAST(floor(z / 0.1) AS INTEGER) AS z, embedding FROM p), a AS (SELECT * FROM v WHERE label < 5), b AS (SELECT * FROM v WHERE label >= 5) "
_SAME = "a.x = b.x AND a.y = b.y AND a.z = b.z"
_NEAR = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1"


@query("neighbor_join", _V + f"SELECT a.idx AS a_idx, b.idx AS b_idx FROM a JOIN b ON {_NEAR}")
def _(spark, d):
    return sparse.neighbor_join(*_sides(spark, d), sparse.cube_offsets(3)).select("a_idx", "b_idx")


@query("neighbor_join_cross", _V + f"SELECT a.idx AS a_idx, b.idx AS b_idx FROM a JOIN b ON {_NEAR} AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) <= 1")
def _(spark, d):
    return sparse.neighbor_join(*_sides(spark, d), sparse.cross_offsets(3)).select("a_idx", "b_idx")


@query("occupancy_mask", _V + f"SELECT idx, EXISTS (SELECT 1 FROM b WHERE {_SAME}) AS occupied FROM a")
def _(spark, d):
    return sparse.occupied(*_sides(spark, d)).select("idx", "occupied")


@query("coord_difference", _V + f"SELECT idx FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_SAME})")
def _(spark, d):
    return sparse.difference(*_sides(spark, d)).select("idx")


@query("coord_union", _V + "SELECT idx, x, y, z FROM a UNION ALL SELECT idx, x, y, z FROM b")
def _(spark, d):
    return sparse.disjoint_union(*_sides(spark, d)).select("idx", "x", "y", "z")


@query("coord_append", _V + f"SELECT idx FROM a UNION ALL SELECT idx FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {_SAME})")
def _(spark, d):
    return sparse.append_unique(*_sides(spark, d)).select("idx")


def _three(spark, d):
    v = _voxels(spark, d)
    return [v.where(F.col("label") % 3 == k) for k in range(3)]


def _slots_sql(f: str) -> str:
    return _V + f"SELECT x, y, z, round({f}(CAST(embedding[4] AS DOUBLE)), 6) + 0.0 AS f0, round({f}(CAST(embedding[5] AS DOUBLE)), 6) + 0.0 AS f1 FROM v GROUP BY x, y, z"


@query("sparse_sum", _slots_sql("sum"))
def _(spark, d):
    out = sparse.sparse_sum(*_three(spark, d), width=2)
    return out.select("x", "y", "z", F.col("f")[0].alias("f0"), F.col("f")[1].alias("f1")).select("x", "y", "z", *r6("f0", "f1"))


@query("sparse_mean", _slots_sql("avg"))
def _(spark, d):
    out = sparse.sparse_mean(*_three(spark, d), width=2)
    return out.select("x", "y", "z", F.col("f")[0].alias("f0"), F.col("f")[1].alias("f1")).select("x", "y", "z", *r6("f0", "f1"))


@query("sparse_count", _V + "SELECT x, y, z, count(*) AS count FROM v GROUP BY x, y, z")
def _(spark, d):
    return sparse.sparse_count(*_three(spark, d)).select("x", "y", "z", "count")


@query("sparse_normalise", _V + "SELECT idx, round((f0 - avg(f0) OVER ()) / sqrt(var_pop(f0) OVER () + 1e-5), 6) + 0.0 AS f0, round((f1 - avg(f1) OVER ()) / sqrt(var_pop(f1) OVER () + 1e-5), 6) + 0.0 AS f1 FROM (SELECT idx, CAST(embedding[4] AS DOUBLE) AS f0, CAST(embedding[5] AS DOUBLE) AS f1 FROM v)")
def _(spark, d):
    out = sparse.normalise(_voxels(spark, d), 2)
    return out.select("idx", F.col("f")[0].alias("f0"), F.col("f")[1].alias("f1")).select("idx", *r6("f0", "f1"))


@query("batch_indices", "SELECT CAST(label AS INTEGER) AS batch, vec_id AS idx FROM embeddings")
def _(spark, d):
    t = table(spark, d, "embeddings").select(F.col("label").alias("batch"), F.col("vec_id").alias("idx"))
    return sparse.batch_indices(t, 12).select("batch", F.explode("indices").alias("idx"))


@query(
    "neighbor_attention",
    _V
    + f""", e AS (SELECT a.idx AS q, b.idx AS k,
   list_dot_product(CAST(a.embedding[5:8] AS DOUBLE[]), CAST(b.embedding[5:8] AS DOUBLE[])) / 2 AS l0,
   list_dot_product(CAST(a.embedding[9:12] AS DOUBLE[]), CAST(b.embedding[9:12] AS DOUBLE[])) / 2 AS l1,
   CAST(b.embedding[13] AS DOUBLE) AS v0, CAST(b.embedding[17] AS DOUBLE) AS v1 FROM a JOIN b ON {_NEAR}),
 m AS (SELECT *, max(l0) OVER (PARTITION BY q) AS m0, max(l1) OVER (PARTITION BY q) AS m1 FROM e),
 o AS (SELECT q, sum(exp(l0 - m0) * v0) / (sum(exp(l0 - m0)) + 1e-12) AS o0, sum(exp(l1 - m1) * v1) / (sum(exp(l1 - m1)) + 1e-12) AS o4 FROM m GROUP BY q)
 SELECT a.idx AS q, round(coalesce(o0, 0), 6) + 0.0 AS o0, round(coalesce(o4, 0), 6) + 0.0 AS o4 FROM a LEFT JOIN o ON o.q = a.idx""",
)
def _(spark, d):
    edges = sparse.neighbor_join(*_sides(spark, d), sparse.cube_offsets(3)).select(F.col("a_idx").alias("q"), F.col("b_idx").alias("k"))
    e = table(spark, d, "embeddings")
    part = lambda a, n: F.transform(F.slice("embedding", a, n), lambda v: v.cast("double"))
    queries = e.where("label < 5").select(F.col("vec_id").alias("q"), part(5, 8).alias("vq"))
    keys = e.where("label >= 5").select(F.col("vec_id").alias("k"), part(5, 8).alias("vk"), part(13, 8).alias("vv"))
    out = attention.edge_attention(queries, keys, edges, heads=2, width=4)
    return out.select("q", F.col("out")[0].alias("o0"), F.col("out")[4].alias("o4")).select("q", *r6("o0", "o4"))


def _weights(rows: int, columns: int, seed: int) -> list[list[float]]:
    return np.round(np.random.default_rng(seed).normal(size=(rows, columns)) / math.sqrt(columns), 3).tolist()


@query("neighborhood_block")
def _(spark, d):
    a, b = _sides(spark, d)
    w = attention.BlockWeights(
        attention.AttentionWeights(_weights(4, 2, 1), _weights(4, 2, 2), _weights(4, 2, 3), _weights(2, 4, 4), heads=2),
        ([1.0, 1.0], [0.0, 0.0]), (_weights(8, 2, 5), [0.1] * 8), (_weights(2, 8, 6), [0.0, 0.1]), ([1.0, 1.0], [0.0, 0.0]),
    )
    out = attention.neighborhood_attention(a, b, w)
    return out.select("idx", F.col("f")[0].alias("f0"), F.col("f")[1].alias("f1")).select("idx", *r6("f0", "f1"))


_D2 = "((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"


def _nearest_sql(limit: str) -> str:
    return f"WITH p AS ({P}), a AS (SELECT * FROM p WHERE label < 5), b AS (SELECT * FROM p WHERE label >= 5), c AS (SELECT a.idx AS i, b.idx AS j, {_D2} AS d2, row_number() OVER (PARTITION BY a.idx ORDER BY {_D2}, b.idx) AS n FROM a JOIN b ON {limit}) SELECT i, j, round(d2, 6) + 0.0 AS d2 FROM c WHERE n = 1"


def _clouds(spark, d):
    p = points(spark, d, "label")
    return p.where("label < 5").select(F.col("idx").alias("i"), *"xyz"), p.where("label >= 5").select(F.col("idx").alias("j"), *"xyz")


@query("nearest_neighbor", _nearest_sql(f"{_D2} <= 0.2 * 0.2"))
def _(spark, d):
    return align.nearest_neighbors(*_clouds(spark, d), radius=0.2).select("i", "j", *r6("d2"))


@query("nearest_neighbor_unlimited", _nearest_sql("true"))
def _(spark, d):
    return align.nearest_neighbors(*_clouds(spark, d)).select("i", "j", *r6("d2"))


#: A known similarity: scale 2, a turn of 0.3 about z, a shift.
_TURN = np.array([[math.cos(0.3), -math.sin(0.3), 0.0], [math.sin(0.3), math.cos(0.3), 0.0], [0.0, 0.0, 1.0]])
_SHIFT = np.array([0.5, -0.25, 1.0])


def _pairs(spark, d, scale: float):
    moved = align.Similarity(scale, _TURN, _SHIFT).apply([F.col(c) for c in "xyz"])
    return points(spark, d).select("idx", *[F.col(c).alias(f"s{c}") for c in "xyz"], *[m.alias(f"d{c}") for m, c in zip(moved, "xyz")])


def _moved(rows, t: align.Similarity, *more):
    """Where a found transform takes every point."""
    return rows.select("idx", *[(F.round(m, 4) + 0.0).alias(c) for m, c in zip(t.apply([F.col(f"s{c}") for c in "xyz"]), "xyz")], *more)


def _expected(scale: float, turn: float, shift, more: str = "") -> str:
    """The same from the known transform."""
    c, s = f"cos({turn})", f"sin({turn})"
    x, y, z = (f"round({scale} * ({v}) + ({t}), 4) + 0.0 AS {n}" for v, t, n in zip((f"{c} * x - {s} * y", f"{s} * x + {c} * y", "z"), shift, "xyz"))
    return f"SELECT idx, {x}, {y}, {z}{more} FROM ({P})"


@query("umeyama", _expected(2.0, 0.3, _SHIFT.tolist()))
def _(spark, d):
    pairs = _pairs(spark, d, 2.0)
    return _moved(pairs, align.umeyama(pairs))


@query("ransac", _expected(2.0, 0.3, _SHIFT.tolist(), ", idx % 4 <> 0 AS inlier"))
def _(spark, d):
    wrong = F.when(F.col("idx") % 4 == 0, 3.0).otherwise(0.0)  # a quarter of the pairs is far off
    found, rows = align.ransac(_pairs(spark, d, 2.0).withColumn("dx", F.col("dx") + wrong), max_iterations=60, seed=1)
    return _moved(rows, found, "inlier")


@query("icp", _expected(1.0, 0.02, (0.01, -0.01, 0.005)))
def _(spark, d):
    turn = np.array([[math.cos(0.02), -math.sin(0.02), 0.0], [math.sin(0.02), math.cos(0.02), 0.0], [0.0, 0.0, 1.0]])
    truth = align.Similarity(1.0, turn, np.array([0.01, -0.01, 0.005]))
    src = points(spark, d).select(F.col("idx").alias("i"), *"xyz")
    dst = points(spark, d).select(F.col("idx").alias("j"), *[m.alias(c) for m, c in zip(truth.apply([F.col(c) for c in "xyz"]), "xyz")])
    found = align.iterative_closest_point(src, dst, max_distance=0.3, max_iterations=30, min_delta=1e-12)
    return _moved(points(spark, d).select("idx", *[F.col(c).alias(f"s{c}") for c in "xyz"]), align.Similarity(1.0, found.rotation, found.translation))


@query("tensor_of_columns", "SELECT vec_id AS idx, 0 AS batch, CAST(floor(CAST(embedding[1] AS DOUBLE) / 0.1) AS INTEGER) AS x, round(CAST(embedding[4] AS DOUBLE), 6) + 0.0 AS f0, round(CAST(embedding[5] AS DOUBLE), 6) + 0.0 AS f1 FROM embeddings")
def _(spark, d):
    cloud = points(spark, d, *[F.col("embedding")[i].alias(f"f{i}") for i in (3, 4)]).withColumns({c: F.floor(F.col(c) / 0.1) for c in "xyz"})
    t = sparse.tensor(cloud, ["x", "y", "z"], ["f3", "f4"])
    return t.select("idx", "batch", "x", F.col("f")[0].alias("f0"), F.col("f")[1].alias("f1")).select("idx", "batch", "x", *r6("f0", "f1"))


@query("unbatched", "SELECT vec_id AS idx, CAST(label AS INTEGER) AS batch FROM embeddings WHERE label IN (1, 3)")
def _(spark, d):
    parts = sparse.unbatch(_voxels(spark, d).withColumn("batch", F.col("label").cast("int")), 4)
    return parts[1].union(parts[3]).select("idx", "batch")


@query("tensor_arrays", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(x) AS BIGINT) AS x, round(sum(CAST(embedding[4] AS DOUBLE)), 3) + 0.0 AS f FROM (SELECT embedding, floor(CAST(embedding[1] AS DOUBLE) / 0.1) AS x FROM embeddings WHERE label = 1)")
def _(spark, d):
    coords, features = sparse.to_numpy(_voxels(spark, d).where("label = 1"))
    return literal_rows(spark, [(len(coords), int(coords[:, 1].sum()), round(float(features[:, 0].astype(float).sum()), 3) + 0.0)], "n bigint, x bigint, f double")


def _parameters(spark, d):
    """A parameter table made of part keys: blocks, layers and weights; block0 and every third layer of block1 are frozen."""
    k = F.col("p_partkey").cast("long")
    path = F.concat(F.lit("block"), k % 3, F.lit(".layer"), k % 7, F.lit(".w"), k)
    kind = F.when(k % 11 == 0, "buffer").otherwise("parameter")
    grad = (kind == "parameter") & (k % 3 != 0) & ~((k % 3 == 1) & (k % 7 % 3 == 0))
    return table(spark, d, "part").select(path.alias("path"), k.cast("int").alias("ordinal"), kind.alias("kind"), grad.alias("requires_grad"), F.col("p_size").cast("long").alias("numel"), F.array(F.col("p_retailprice").cast("float")).alias("value"))


_PAR = """WITH k AS (SELECT p_partkey AS k, p_size AS numel FROM part), p AS (SELECT k, numel, 'block' || k % 3 AS block, 'block' || k % 3 || '.layer' || k % 7 AS layer,
 'block' || k % 3 || '.layer' || k % 7 || '.w' || k AS path, k % 11 <> 0 AS par, k % 11 <> 0 AND k % 3 <> 0 AND NOT (k % 3 = 1 AND k % 7 % 3 = 0) AS grad FROM k) """


@query("parameter_count", _PAR + "SELECT CAST(sum(numel) AS BIGINT) AS parameters, CAST(sum(numel) FILTER (WHERE grad) AS BIGINT) AS trainable FROM p WHERE par")
def _(spark, d):
    t = _parameters(spark, d)
    return parameters.count_parameters(t).join(parameters.count_parameters(t, trainable_only=True).select(F.col("parameters").alias("trainable")))


@query("frozen_layers", _PAR + ", l AS (SELECT block, layer, NOT bool_or(grad) AS frozen FROM p GROUP BY block, layer), b AS (SELECT block, bool_and(frozen) AS frozen FROM l GROUP BY block), x AS (SELECT layer, bool_or(grad) AND bool_or(par AND NOT grad) AS mixed FROM p GROUP BY layer) SELECT block AS name FROM b WHERE frozen UNION SELECT l.layer FROM l JOIN b ON l.block = b.block WHERE l.frozen AND NOT b.frozen UNION SELECT path FROM p JOIN x ON x.layer = p.layer WHERE mixed AND NOT grad")
def _(spark, d):
    return parameters.frozen_layers(_parameters(spark, d))


@query("unfrozen_layers", _PAR + ", l AS (SELECT block, layer, bool_or(grad) AND NOT bool_or(par AND NOT grad) AS open, bool_or(grad) AND bool_or(par AND NOT grad) AS mixed FROM p GROUP BY block, layer), b AS (SELECT block, bool_and(open) AS open FROM l GROUP BY block) SELECT block AS name FROM b WHERE open UNION SELECT l.layer FROM l JOIN b ON l.block = b.block WHERE l.open AND NOT b.open UNION SELECT path FROM p JOIN l ON l.layer = p.layer WHERE mixed AND grad")
def _(spark, d):
    return parameters.unfrozen_layers(_parameters(spark, d))


@query("partial_state", _PAR + ", l AS (SELECT layer, bool_or(grad) AND NOT bool_or(par AND NOT grad) AS open FROM p GROUP BY layer) SELECT path FROM p JOIN l ON l.layer = p.layer WHERE open OR grad")
def _(spark, d):
    return parameters.grad_state(_parameters(spark, d)).select("path")


@query("same_state", "SELECT count(*) = 0 AS same, count(*) < 0 AS same_changed FROM part WHERE p_partkey IS NULL")
def _(spark, d):
    t = _parameters(spark, d)
    changed = t.withColumn("value", F.when(F.col("ordinal") == 5, F.array(F.lit(0.5).cast("float"))).otherwise(F.col("value")))
    return parameters.same_state(t, t.select("*")).join(parameters.same_state(t, changed).select(F.col("same").alias("same_changed")))


@query("frozen_flags", _PAR + "SELECT NOT bool_or(par AND grad) AS all_before, bool_or(par AND NOT grad) AS any_before, count(*) FILTER (WHERE par) > 0 AS all_frozen, count(*) FILTER (WHERE par) = 0 AS any_unfrozen FROM p")
def _(spark, d):
    t = _parameters(spark, d)
    found = [parameters.all_frozen(t).toDF("all_before"), parameters.any_frozen(t).toDF("any_before"), parameters.all_frozen(parameters.freeze(t)), parameters.any_frozen(parameters.unfreeze(t)).toDF("any_unfrozen")]
    out = found[0]
    for f in found[1:]:
        out = out.join(f)
    return out


@query("train_flags", _PAR + ", l AS (SELECT layer, par, grad FROM p UNION ALL SELECT block, par, grad FROM p UNION ALL SELECT '', par, grad FROM p) SELECT layer, bool_or(par AND grad) AS train FROM l GROUP BY layer")
def _(spark, d):
    return parameters.train_flags(_parameters(spark, d))


@query("loaded_state", _PAR + "SELECT path, CASE WHEN k % 2 = 0 THEN CAST(-1 AS DOUBLE) ELSE round(CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE), 3) + 0.0 END AS value FROM p JOIN part ON p_partkey = k")
def _(spark, d):
    t = _parameters(spark, d)
    state = t.where("ordinal % 2 = 0").select("path", F.array(F.lit(-1.0).cast("float")).alias("value"))
    loaded, lacking = parameters.load_grad_state(t, state.union(state.limit(1).select(F.lit("nowhere"), "value")))
    assert lacking.count() == 1
    return loaded.select("path", (F.round(F.col("value")[0].cast("double"), 3) + 0.0).alias("value"))
