"""Queries of segments, windows, row containers and moments."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import scalar as S
from ..operators import moments, sampling, segments, tables, windows
from .common import ROWS_OF, big, r6, series, table
from .common import segments as made
from .common import segments_sql as made_sql

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return wrap


@query("segmented_sum", f"WITH g AS ({made_sql()}) SELECT g.seg, round(sum(r.x), 6) + 0.0 AS sum FROM g {ROWS_OF} GROUP BY g.seg")
def _(spark, d):
    return segments.segmented_sum(series(spark, d), made(spark, d)).select("seg", *r6("sum"))


@query("segmented_mean", f"WITH g AS ({made_sql()}) SELECT g.seg, round(avg(r.x), 9) + 0.0 AS mean FROM g {ROWS_OF} GROUP BY g.seg")
def _(spark, d):
    return segments.segmented_mean(series(spark, d), made(spark, d)).select("seg", F.round("mean", 9).alias("mean"))


@query("segmented_count", f"WITH g AS ({made_sql(7)}) SELECT seg, CAST(greatest(e - s, 1) AS BIGINT) AS count FROM g")
def _(spark, d):
    return segments.segmented_count(made(spark, d, 7), series(spark, d))


def _extreme(largest: bool, columns: str) -> str:
    order = "r.x DESC, r.i" if largest else "r.x, r.i"
    return f"WITH g AS ({made_sql()}), o AS (SELECT g.seg, r.x AS value, r.i AS \"at\", row_number() OVER (PARTITION BY g.seg ORDER BY {order}) AS n FROM g {ROWS_OF}) SELECT seg, {columns} FROM o WHERE n = 1"


for _name, _largest in (("max", True), ("min", False)):
    QUERIES[f"segmented_{_name}"] = lambda spark, d, f=getattr(segments, f"segmented_{_name}"): f(series(spark, d), made(spark, d)).select("seg", *r6("value"), "at")
    SQL[f"segmented_{_name}"] = _extreme(_largest, 'round(value, 6) + 0.0 AS value, "at"')
    QUERIES[f"segmented_arg{_name}"] = lambda spark, d, f=getattr(segments, f"segmented_arg{_name}"): f(series(spark, d), made(spark, d))
    SQL[f"segmented_arg{_name}"] = _extreme(_largest, '"at"')


@query("segmented_empty", f"WITH g AS ({made_sql(7)}) SELECT g.seg, round(sum(r.x), 6) + 0.0 AS sum, count(*) AS count FROM g {ROWS_OF} GROUP BY g.seg")
def _(spark, d):
    return segments.segmented(series(spark, d), made(spark, d, 7), {"sum": F.sum("x"), "count": F.count("x")}).select("seg", *r6("sum"), "count")


@query("segmented_where", f"WITH g AS ({made_sql()}) SELECT g.seg, r.i AS \"at\" FROM g {ROWS_OF} WHERE r.event_type = 'error'")
def _(spark, d):
    found = segments.segmented_where(series(spark, d), made(spark, d).withColumn("want", F.lit("error")), value="event_type")
    return found.select("seg", F.explode("places").alias("at"))


def _reduceat(order: str) -> str:
    return "WITH s AS (SELECT p_partkey AS seg, (p_partkey * 37) % n AS s, n FROM part, (SELECT count(*) AS n FROM events)), g AS (SELECT seg, s, greatest(coalesce(lead(s) OVER (ORDER BY seg), n), s) AS e FROM s), o AS (SELECT g.seg, r.i AS \"at\", row_number() OVER (PARTITION BY g.seg ORDER BY " + order + ") AS n FROM g " + ROWS_OF + ") SELECT seg, \"at\" FROM o WHERE n = 1"


@query("reduceat_argmax", _reduceat("r.x DESC, r.i"))
def _(spark, d):
    return segments.reduceat(series(spark, d), made(spark, d).select("seg", "s"))


@query("reduceat_argmin", _reduceat("r.x, r.i"))
def _(spark, d):
    return segments.reduceat(series(spark, d), made(spark, d).select("seg", "s"), largest=False)


_BY_USER = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
_SLIDING = {"sum": "sum(value)", "count": "count(value)", "mean": "avg(value)", "max": "max(value)", "min": "min(value)"}
for _name in windows.METHODS:

    def _sliding(spark, d, m=_name):
        out = windows.sliding_window(series(spark, d), "x", by=["user_id"], order=["ts", "i"], at="i", size=5, methods=[m])
        return out.select(F.col("i").alias("event_id"), *(big(m) if m in ("count", "argmax", "argmin") else r6(m)))

    QUERIES[f"sliding_{_name}"] = _sliding
    if _name in _SLIDING:
        SQL[f"sliding_{_name}"] = f"SELECT event_id, {f'{_SLIDING[_name]} {_BY_USER}' if _name == 'count' else f'round({_SLIDING[_name]} {_BY_USER}, 6) + 0.0'} AS {_name} FROM events"
    else:
        _order = "n.value DESC, n.event_id" if _name == "argmax" else "n.value, n.event_id"
        SQL[f"sliding_{_name}"] = f"""
WITH e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
c AS (SELECT e.event_id, n.event_id AS {_name}, row_number() OVER (PARTITION BY e.event_id ORDER BY {_order}) AS k
      FROM e JOIN e n ON n.user_id = e.user_id AND n.p BETWEEN e.p - 2 AND e.p + 2)
SELECT event_id, {_name} FROM c WHERE k = 1"""


@query("sliding_full_only", f"SELECT event_id, m AS mean FROM (SELECT event_id, round(avg(value) {_BY_USER}, 6) + 0.0 AS m, count(*) {_BY_USER} AS c FROM events) WHERE c = 5")
def _(spark, d):
    out = windows.sliding_window(series(spark, d), "x", by=["user_id"], order=["ts", "i"], at="i", size=5, full_only=True)
    return out.select(F.col("i").alias("event_id"), *r6("mean"))


@query("sliding_one_series", "SELECT event_id, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) + 0.0 AS mean, max(value) OVER (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS max FROM events")
def _(spark, d):
    out = windows.chunked_sliding_window(series(spark, d), "x", at="i", size=7, methods=["mean", "max"], chunk=997)
    return out.select(F.col("i").alias("event_id"), *r6("mean"), "max")


@query("window_indices_odd", "SELECT CAST(w AS BIGINT) AS w, CAST(w - 2 AS BIGINT) AS s, CAST(w + 3 AS BIGINT) AS e FROM range(1000) t(w) WHERE w - 2 >= 0 AND w + 3 <= 1000")
def _(spark, d):
    return windows.window_indices(spark, 1000, 5).select(*big("w", "s", "e"))


@query("window_indices_even", "SELECT CAST(w AS BIGINT) AS w, CAST(greatest(w - 2, 0) AS BIGINT) AS s, CAST(least(w + 2, 1000) AS BIGINT) AS e FROM range(1001) t(w)")
def _(spark, d):
    return windows.window_indices(spark, 1000, 4, full_only=False).select(*big("w", "s", "e"))


@query("hopping_overlap", "SELECT DISTINCT CAST(s AS BIGINT) AS s, CAST(s + 50 AS BIGINT) AS e FROM (SELECT unnest(generate_series(0, 950, 34)) AS s UNION ALL SELECT 950)")
def _(spark, d):
    return windows.overlapping_windows(spark, 1000, 50, 0.33).select(*big("s", "e"))


@query("group_sizes", "SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment) AS group_size FROM customer")
def _(spark, d):
    return windows.group_sizes(table(spark, d, "customer"), "c_mktsegment").select("c_custkey", "group_size")


@query("grouped_softmax", "SELECT event_id, round(exp(v - m) / (sum(exp(v - m)) OVER (PARTITION BY user_id) + 1e-12), 6) + 0.0 AS softmax FROM (SELECT event_id, user_id, value / 100 AS v, max(value / 100) OVER (PARTITION BY user_id) AS m FROM events)")
def _(spark, d):
    logits = series(spark, d).withColumn("v", F.col("x") / 100)
    return windows.grouped_softmax(logits, "v", ["user_id"]).select(F.col("i").alias("event_id"), *r6("softmax"))


def _timed(spark, d):
    return table(spark, d, "events").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))


_NEAREST = """
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events),
c AS (SELECT p.event_id AS probe, b.event_id AS matched, b.t AS bt,
             row_number() OVER (PARTITION BY p.event_id ORDER BY abs(b.t - p.t), b.t DESC, b.event_id) AS n
      FROM e p JOIN e b ON b.user_id = p.user_id AND p.event_type = 'error' AND b.event_type = 'view')
"""


def _sides(spark, d):
    e = _timed(spark, d)
    base = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("idx"), "t")
    return base, e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("probe"), "t")


@query("align_nearest", _NEAREST + "SELECT probe, matched, bt AS matched_t FROM c WHERE n = 1")
def _(spark, d):
    found = tables.align_timestamps(*_sides(spark, d), ts="t", by=["user_id"])
    return found.where("idx is not null").select("probe", F.col("idx").alias("matched"), "matched_t")


@query("align_distinct_rows", _NEAREST + "SELECT DISTINCT matched AS idx FROM c WHERE n = 1")
def _(spark, d):
    return tables.aligned_rows(*_sides(spark, d), ts="t", by=["user_id"]).select("idx")


@query("slice_index", "SELECT event_id, value FROM events WHERE event_id >= 100 AND event_id < 2000 AND (event_id - 100) % 3 = 0")
def _(spark, d):
    return tables.slice_rows(table(spark, d, "events"), 100, 2000, step=3, idx="event_id").select("event_id", "value")


@query("slice_mask", "SELECT event_id, value FROM events WHERE event_type = 'error'")
def _(spark, d):
    return tables.mask_rows(table(spark, d, "events"), F.col("event_type") == "error").select("event_id", "value")


@query("slice_list", "SELECT event_id, value FROM events WHERE event_id IN (SELECT p_size FROM part)")
def _(spark, d):
    keys = table(spark, d, "part").select(F.col("p_size").cast("bigint").alias("k"))
    return tables.take_rows(table(spark, d, "events"), keys, idx="event_id").select("event_id", "value")


@query("timestamps_datetime", "SELECT event_id, epoch_us(ts) AS us FROM events")
def _(spark, d):
    stamped = table(spark, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + 7).alias("ts_ns"))
    return tables.datetime_of(stamped).select("event_id", F.unix_micros("datetime").alias("us"))


@query(
    "trajectory_keyframes",
    """
WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT user_id, p, n, event_id, value AS last, true AS kept FROM e WHERE p = 1
      UNION ALL
      SELECT e.user_id, e.p, e.n, e.event_id, CASE WHEN abs(e.value - k.last) >= 100 THEN e.value ELSE k.last END, abs(e.value - k.last) >= 100
      FROM k JOIN e ON e.user_id = k.user_id AND e.p = k.p + 1)
SELECT user_id, event_id FROM k WHERE kept OR p = n""",
)
def _(spark, d):
    return sampling.keyframes(table(spark, d, "events"), by=["user_id"], order=["ts", "event_id"], idx="event_id", xyz=("value",), min_distance=100)


@query("random_labels", "WITH k AS (SELECT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS place, count(*) AS n FROM customer GROUP BY c_mktsegment) SELECT c_mktsegment, n, CAST(1 AS BIGINT) AS codes, (SELECT count(*) FROM k) AS labels, (SELECT sum(place) FROM k)::BIGINT AS total FROM k")
def _(spark, d):
    """Which label gets which number is random; that the numbers are 0 .. k - 1 and one a label is not."""
    got = sampling.randomize_labels(table(spark, d, "customer"), "c_mktsegment", seed=5)
    each = got.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("random_label").alias("codes"))
    whole = got.select("random_label").distinct().agg(F.count(F.lit(1)).alias("labels"), F.sum("random_label").cast("bigint").alias("total"))
    return each.join(F.broadcast(whole))


@query("allocated_rows", "SELECT CAST(i AS BIGINT) AS idx, CAST(NULL AS DOUBLE) AS x FROM range((SELECT count(*) FROM region)) t(i)")
def _(spark, d):
    n = tables.length(table(spark, d, "region"))
    return tables.allocate(spark, n, StructType([StructField("idx", LongType()), StructField("x", DoubleType())]))


@query("row_index", "SELECT event_id FROM events")
def _(spark, d):
    return tables.index(table(spark, d, "events"), "event_id")


@query("timestamps_set", "SELECT event_id, epoch_us(ts) * 1000 + event_id AS ts_ns FROM events")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.lit(0).cast("bigint").alias("ts_ns"))
    return tables.set_timestamps(rows, F.col("us") * 1000 + F.col("event_id")).select("event_id", "ts_ns")


def _poses(spark, d):
    """Poses with places from the first three slots of the embeddings, and unit quaternions from the next four."""
    e = lambda i: F.col("embedding")[i].cast("double")
    norm = F.sqrt(sum((e(i) * e(i) for i in range(4, 7)), e(3) * e(3)))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), *[e(i).alias(c) for i, c in enumerate("xyz")], *[(e(i + 3) / norm).alias(c) for i, c in enumerate(tables.QUATERNION)])


_POSES = "SELECT vec_id AS idx, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) / n AS qx, CAST(embedding[5] AS DOUBLE) / n AS qy, CAST(embedding[6] AS DOUBLE) / n AS qz, CAST(embedding[7] AS DOUBLE) / n AS qw FROM (SELECT *, sqrt(list_sum([CAST(v AS DOUBLE) * CAST(v AS DOUBLE) FOR v IN embedding[4:7]])) AS n FROM embeddings)"


@query("pose_parts", f"SELECT idx, round(x, 6) + 0.0 AS x, round(z, 6) + 0.0 AS z, round(qx, 6) + 0.0 AS qx, round(qw, 6) + 0.0 AS qw FROM ({_POSES})")
def _(spark, d):
    p = tables.quaternion(tables.xyz(_poses(spark, d)))
    return p.select("idx", F.col("xyz")[0].alias("x"), F.col("xyz")[2].alias("z"), F.col("quaternion")[0].alias("qx"), F.col("quaternion")[3].alias("qw")).select("idx", *r6("x", "z", "qx", "qw"))


@query("pose_set", f"SELECT idx, round(z, 6) + 0.0 AS x, round(x, 6) + 0.0 AS z, round(qw, 6) + 0.0 AS qx, round(qx, 6) + 0.0 AS qw FROM ({_POSES})")
def _(spark, d):
    turned = tables.set_xyz(_poses(spark, d), F.array("z", "y", "x"))
    return tables.set_quaternion(turned, F.array("qw", "qz", "qy", "qx")).select("idx", *r6("x", "z", "qx", "qw"))


@query("pose_transformation", f"SELECT idx, round(1 - 2 * (qy * qy + qz * qz), 6) + 0.0 AS m00, round(2 * (qx * qy - qz * qw), 6) + 0.0 AS m01, round(x, 6) + 0.0 AS m03, round(2 * (qy * qz - qx * qw), 6) + 0.0 AS m12, round(z, 6) + 0.0 AS m23, CAST(1 AS DOUBLE) AS m33 FROM ({_POSES})")
def _(spark, d):
    at = tables.transformation(_poses(spark, d))
    cells = [(0, 0), (0, 1), (0, 3), (1, 2), (2, 3), (3, 3)]
    return at.select("idx", *[F.col("transformation")[i][j].alias(f"m{i}{j}") for i, j in cells]).select("idx", *r6(*[f"m{i}{j}" for i, j in cells]))


@query("mean_var_merge", "SELECT event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(var_pop(value), 6) + 0.0 AS var FROM events GROUP BY event_type")
def _(spark, d):
    parts = table(spark, d, "events").groupBy("event_type", "user_id").agg(*moments.moment_state("value"))
    return moments.merge_moments(parts, ["event_type"]).select("event_type", "n", *r6("mean", "var"))


@query("mean_var_total", "SELECT count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(var_pop(value), 6) + 0.0 AS var FROM events")
def _(spark, d):
    parts = table(spark, d, "events").groupBy("user_id").agg(*moments.moment_state("value"))
    return moments.merge_moments(parts).select("n", *r6("mean", "var"))


@query(
    "stable_merge",
    """
WITH l AS (SELECT o_custkey AS k, list(o_orderpriority ORDER BY o_orderkey)[1:3] AS a, list(o_orderpriority ORDER BY o_orderkey)[2:6] AS b FROM orders GROUP BY o_custkey),
u AS (SELECT k, a, unnest(b) AS x, generate_subscripts(b, 1) AS p FROM l),
f AS (SELECT k, x, min(p) AS p FROM u WHERE NOT list_contains(a, x) GROUP BY k, x),
m AS (SELECT k, list(x ORDER BY p) AS more FROM f GROUP BY k)
SELECT l.k, array_to_string(l.a || coalesce(m.more, []), '>') AS merged FROM l LEFT JOIN m ON l.k = m.k""",
)
def _(spark, d):
    ordered = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda s: s["o_orderpriority"]).alias("p"))
    return ordered.select("k", F.array_join(S.stable_merge(F.array(F.slice("p", 1, 3), F.slice("p", 2, 5))), ">").alias("merged"))
