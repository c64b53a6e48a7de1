"""Connected components of a link table by alternating large and small stars, on the cluster alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a long, b long); the component is its smallest node.

    Each round links a node's neighbours to the smallest of them; neighbours are only aggregated and joined
    back, never gathered, so a node with many links is no burden.  Rounds end when nothing changes, after
    about the logarithm of the longest path.  Nulls and links of a node to itself are dropped, repeated links
    count once, an empty table gives none.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    scratch, mark = Scratch(edges.sparkSession), None
    links = scratch.write(links, "links")
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        links = scratch.write(small.where("u <> v").distinct(), "links")
        scratch.clear(but=1)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = written(links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")
    scratch.clear()
    return out
