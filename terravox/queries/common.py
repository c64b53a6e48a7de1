"""What the queries share: test tables in the shapes that operators take."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checks import one_machine, require


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder; on one machine without that setting, in the temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    require(base or one_machine(spark), "spark.checkpoint.dir must name a folder that all executors share")
    base = base or "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/terravox-{name}-{uuid.uuid4().hex}"


def points(spark: SparkSession, sf_dir: str, *extra) -> DataFrame:
    """(idx, x, y, z) from the first three slots of the embeddings."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")], *extra)


P = "SELECT vec_id AS idx, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label, CAST(embedding[4] AS DOUBLE) AS w, embedding FROM embeddings"


def r6(*names: str):
    """Columns rounded to six digits, without a negative zero."""
    return [(F.round(F.col(n).cast("double"), 6) + 0.0).alias(n) for n in names]


def big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def sql6(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) + 0.0 AS {n}" for n in names)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.col("value").alias("x"), "event_type", "user_id", "ts")


def segments(spark: SparkSession, sf_dir: str, empty_every: int | None = None) -> DataFrame:
    """Segments over the events' places: from each part's key and size."""
    n = table(spark, sf_dir, "events").count()
    s = F.pmod(F.col("p_partkey") * 37, F.lit(n))
    e = F.least(s + F.col("p_size"), F.lit(n))
    if empty_every:
        e = F.when(F.col("p_size") % empty_every == 0, s).otherwise(e)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("seg"), s.cast("bigint").alias("s"), e.cast("bigint").alias("e"))


def segments_sql(empty_every: int | None = None) -> str:
    e = "least((p_partkey * 37) % n + p_size, n)"
    if empty_every:
        e = f"CASE WHEN p_size % {empty_every} = 0 THEN (p_partkey * 37) % n ELSE {e} END"
    return f"SELECT p_partkey AS seg, (p_partkey * 37) % n AS s, {e} AS e FROM part, (SELECT count(*) AS n FROM events)"


ROWS_OF = "JOIN (SELECT event_id AS i, value AS x, event_type FROM events) r ON r.i >= g.s AND r.i < greatest(g.e, g.s + 1)"
