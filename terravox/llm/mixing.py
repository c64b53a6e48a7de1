"""Mixing sources to target weights by hash-threshold histograms, with DataFrame operations alone.

Every document has a 60-bit hash of its key and text.  Words are summed by source and by the top 12 bits of the
hash; a source's budget falls into one bucket of its histogram, and only the documents of that bucket are
summed again by the next 12 bits, and so on, until the budget's document is found.  The outcome is one threshold
a source; a document is taken if its hash lies below.  Thresholds are nested: a larger budget takes the same
documents and more.  Nothing is sorted but the buckets of a source.

Budgets: sources in code-point order, null last, weigh 5, 2, 1, 5, ..; they share ``budget`` times all words by
weight; no source gets over ``most`` times its own words, and the excess goes to the others by weight.  A
source with a target beyond its size is taken whole once, and the threshold says what is taken again.

The document at the threshold is taken if that comes nearer to the target.  Where rows of equal key and text stand at
the threshold, they are told apart by a second hash, of a number that is written with each of them, and a second
threshold, found in the same way, takes as many of them as come nearest to the target.

Nulls: a null text has no words, so nothing is taken of it; null sources are one source; a null key is hashed as
such.  Rows of equal key and text share a hash; they are told apart only at the threshold.  Equal keys with other texts
differ.  Very long texts are counted whole, and one may be the document at the threshold.  An empty table gives an empty
result.  Other columns stay as they are in ``mix_rows``, whatever their names; ``mix_table`` leaves them behind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Scratch, fresh, written

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2.0
LEVEL_BITS, HASH_BITS = 12, 60

#: Threshold tables of so many sources at most are broadcast (under 10 MB); larger ones are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def hash_of(key: str, text: str) -> Column:
    """60 bits of md5 over key and text."""
    whole = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(whole, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_of(source: str) -> Column:
    """A key that is never null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1"))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source_key, source_size, target) from (source_key, source_size): one row a source.

    Resharing what capped sources can't take ends at a common level: a source gets level * weight or its cap.
    With sources in order of cap / weight, the level is what the caps before leave, by the weights from here on,
    at the first source whose cap it does not reach.
    """
    order = F.row_number().over(Window.orderBy("source_key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    s = sources.select("source_key", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("weight").over(after)).withColumn("nth", F.row_number().over(by_room))
    open_here = F.col("level") * F.col("weight") <= F.col("cap")
    s = s.withColumn("common", F.min(F.when(open_here, F.struct("nth", "level"))).over(whole)["level"])
    return s.select("source_key", "source_size", F.coalesce(F.least("cap", F.col("common") * F.col("weight")), F.col("cap")).alias("target"))


def join_small(rows: DataFrame, small: DataFrame, on: str | list[str]) -> DataFrame:
    """Broadcast ``small`` if it is of a bounded size, else leave the join to a shuffle."""
    return rows.join(F.broadcast(small) if small.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else small, on)


def second_hash(number: Column) -> Column:
    """60 bits of a row's number."""
    return F.shiftrightunsigned(F.xxhash64(number, F.lit(11)), 64 - HASH_BITS)


def refined(sized: DataFrame, budgets: DataFrame, scratch: Scratch) -> DataFrame:
    """(source_key, threshold, tie, tie_rest): where the budgets (source_key, rest) fall among (source_key, hash, size).

    Hashes below the threshold are within the budget.  If several rows share the hash at the budget's end, ``tie`` is that
    hash, the threshold leaves it out, and ``tie_rest`` is what is left for these rows.  Sources whose rows are all within
    their budget have no row.
    """
    found, state, bits = None, None, 0
    while True:
        bits += LEVEL_BITS
        rows = sized
        if state is not None:
            rows = join_small(rows.withColumn("prefix", F.shiftright("hash", HASH_BITS - bits + LEVEL_BITS)), state.select("source_key", "prefix"), ["source_key", "prefix"])
        bucket = F.shiftright("hash", HASH_BITS - bits).alias("bucket")
        sums = rows.groupBy("source_key", bucket).agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("n"), F.min("hash").alias("first"), (F.min("hash") == F.max("hash")).alias("single"))
        open_ = budgets.select("source_key", "rest", F.lit(0).cast("decimal(38,0)").alias("base")) if state is None else state.select("source_key", "rest", "base")
        up_to = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.join(open_, "source_key").withColumn("upto", F.col("base") + F.sum(F.col("sum").cast("decimal(38,0)")).over(up_to))
        edge = sums.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("sum") <= F.col("rest")) & (F.col("sum") > 0))
        edge = edge.select("source_key", "rest", F.col("bucket").alias("prefix"), "sum", "n", "first", "single", (F.col("upto") - F.col("sum")).cast("decimal(38,0)").alias("base"))
        edge = scratch.write(edge, "edges")
        last = bits >= HASH_BITS
        nearer = (F.col("n") == 1) & (F.col("base") + F.col("sum") - F.col("rest") < F.col("rest") - F.col("base"))
        at = F.shiftleft(F.col("prefix") + F.when(nearer, 1).otherwise(0), HASH_BITS - bits)
        done = edge.where(F.lit(last) | F.col("single"))
        done = done.select("source_key", at.alias("threshold"), F.when(F.col("n") > 1, F.col("first")).alias("tie"), (F.col("rest") - F.col("base")).alias("tie_rest"))
        found = done if found is None else found.union(done)
        state = edge.where(~F.col("single"))
        if last or state.isEmpty():
            return found


def thresholds(sized: DataFrame, **shares) -> DataFrame:
    """(source_key, source_size, target, whole, threshold, tie, tie_rest) from (source_key, hash, size).

    whole: times that every document is taken; those with a hash below the threshold are taken once more, and of those
    whose hash is ``tie`` as many as come nearest to ``tie_rest``.
    """
    scratch = Scratch(sized.sparkSession)
    plan = targets(sized.groupBy("source_key").agg(F.sum("size").alias("source_size")), **shares)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = scratch.write(plan, "targets")
    every = F.lit(1 << HASH_BITS)  # no bucket holds the budget: all are taken
    out = plan.join(refined(sized, plan, scratch), "source_key", "left").withColumn("threshold", F.coalesce("threshold", F.when(F.col("rest") <= 0, F.lit(0)).otherwise(every)))
    out = written(out.select("source_key", "source_size", "target", "whole", "threshold", "tie", "tie_rest"), "thresholds")
    scratch.clear()
    return out


def second_thresholds(tied: DataFrame, plan: DataFrame) -> DataFrame:
    """(source_key, tie, second) for the rows (source_key, second_hash, size) at ties: those below ``second`` are taken."""
    scratch = Scratch(plan.sparkSession)
    budgets = plan.where("tie is not null").select("source_key", "tie", F.col("tie_rest").cast("double").alias("rest"))
    found = refined(tied.select("source_key", F.col("second_hash").alias("hash"), "size"), budgets, scratch)
    out = budgets.join(found.select("source_key", F.col("threshold").alias("second")), "source_key", "left")
    out = written(out.select("source_key", F.coalesce("second", F.lit(1 << HASH_BITS)).alias("second")), "seconds")
    scratch.clear()
    return out


def sized_rows(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return df.select(F.col(key).alias("doc_id"), source_of(source).alias("source_key"), hash_of(key, text).alias("hash"), words_in(text).alias("size"))


def mix_table(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", **shares) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row; taken is size times copies."""
    sized = written(sized_rows(df, key, text, source).withColumn("number", F.monotonically_increasing_id()), "sizes")
    plan = thresholds(sized.select("source_key", "hash", "size"), **shares)
    mixed = join_small(sized, plan, "source_key")
    again = F.col("hash") < F.col("threshold")
    if not plan.where("tie is not null").isEmpty():
        mixed = mixed.withColumn("second_hash", second_hash(F.col("number")))
        tied = mixed.where("hash = tie").select("source_key", "second_hash", "size")
        mixed = mixed.join(second_thresholds(tied, plan), "source_key", "left")
        again |= F.coalesce((F.col("hash") == F.col("tie")) & (F.col("second_hash") < F.col("second")), F.lit(False))
    copies = F.col("whole") + again.cast("long")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mix_rows(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", **shares) -> DataFrame:
    """The rows of the mix, as often as they are taken, with the columns of ``df``."""
    sized = written(sized_rows(df, key, text, source).select("source_key", "hash", "size"), "sizes")
    plan = thresholds(sized, **shares)
    own = {c: fresh(df, c) for c in ("source_key", "hash", "whole", "threshold", "tie", "copy", "second_hash", "second")}
    rows = df.withColumn(own["source_key"], source_of(source)).withColumn(own["hash"], hash_of(key, text)).where(words_in(text) > 0)
    named = plan.select(*[F.col(c).alias(own[c]) for c in ("source_key", "whole", "threshold", "tie")])
    rows = join_small(rows, named, own["source_key"])

    def taken(some: DataFrame, again: Column) -> DataFrame:
        times = (F.col(own["whole"]) + again.cast("long")).cast("int")
        return some.where(times > 0).withColumn(own["copy"], F.explode(F.sequence(F.lit(1), times))).select(df.columns)

    at_tie = F.coalesce(F.col(own["hash"]) == F.col(own["tie"]), F.lit(False))
    out = taken(rows.where(~at_tie), F.col(own["hash"]) < F.col(own["threshold"]))
    if plan.where("tie is not null").isEmpty():
        return out
    tied = written(rows.where(at_tie).withColumn(own["second_hash"], second_hash(F.monotonically_increasing_id())), "tied")
    sizes = tied.select(F.col(own["source_key"]).alias("source_key"), F.col(own["second_hash"]).alias("second_hash"), words_in(text).alias("size"))
    seconds = second_thresholds(sizes, plan).select(F.col("source_key").alias(own["source_key"]), F.col("second").alias(own["second"]))
    return out.union(taken(tied.join(seconds, own["source_key"]), F.col(own["second_hash"]) < F.col(own["second"])))


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for ``mix_table``: the same budgets, and thresholds by a sort of the hashes."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM {table}),
s AS (SELECT k, CAST(sum(size) AS DOUBLE) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY k) - 1) % 3 + 1] AS w FROM d GROUP BY k),
-- shares in rounds: what capped sources leave is shared again
r AS (
  SELECT 0 AS n, k, source_size, w, 1.5 * sum(source_size) OVER () * w / sum(w) OVER () AS target FROM s
  UNION ALL
  SELECT n + 1, k, source_size, w,
         CASE WHEN target >= 2 * source_size THEN 2 * source_size
              ELSE target + coalesce(sum(greatest(target - 2 * source_size, 0)) OVER () * w / nullif(sum(CASE WHEN target >= 2 * source_size THEN 0 ELSE w END) OVER (), 0), 0) END
  FROM r WHERE n < 60),
t AS (SELECT k, source_size, target, CASE WHEN source_size > 0 THEN floor(round(target / source_size, 9)) ELSE 0 END AS whole FROM r WHERE n = 60),
g AS (SELECT k, h, sum(size) AS size, max(size) AS one, count(*) AS n FROM d GROUP BY k, h),
c AS (SELECT g.k, h, size, one, n, target - whole * source_size AS rest, sum(size) OVER (PARTITION BY g.k ORDER BY h) AS upto FROM g JOIN t ON g.k = t.k),
-- how many rows of this hash are taken again: all, or as many as come nearest
x AS (SELECT k, h, CASE WHEN upto <= rest THEN n WHEN upto - size <= rest AND size > 0 THEN ceil((rest - (upto - size)) / one - 0.5) ELSE 0 END AS again FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY k, h) AS nth FROM d)
SELECT doc_id, CAST(d.size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(target, 3) AS target,
       CAST(d.size * (whole + CASE WHEN nth <= again THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e d JOIN t ON d.k = t.k JOIN x ON d.k = x.k AND d.h = x.h"""
