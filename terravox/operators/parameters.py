"""Parameter tables (path, ordinal, kind, requires_grad, numel, value): counting, freezing, comparing, partial state.

Paths are dotted; kind is ``parameter`` or ``buffer``.  A layer is any proper prefix of a path; the root is ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is_parameter() -> Column:
    return F.col("kind") == "parameter"


def count_parameters(table: DataFrame, *, trainable_only: bool = False) -> DataFrame:
    rows = table.where(_is_parameter() & F.col("requires_grad")) if trainable_only else table.where(_is_parameter())
    return rows.agg(F.coalesce(F.sum("numel"), F.lit(0)).cast("bigint").alias("parameters"))


def set_frozen(table: DataFrame, frozen: bool) -> DataFrame:
    return table.withColumn("requires_grad", F.when(_is_parameter(), F.lit(not frozen)).otherwise(F.col("requires_grad")))


def freeze(table: DataFrame) -> DataFrame:
    return set_frozen(table, True)


def unfreeze(table: DataFrame) -> DataFrame:
    return set_frozen(table, False)


def all_frozen(table: DataFrame) -> DataFrame:
    """True without any trainable parameter, also if there are none."""
    return table.agg((~F.coalesce(F.bool_or(_is_parameter() & F.col("requires_grad")), F.lit(False))).alias("all_frozen"))


def any_frozen(table: DataFrame) -> DataFrame:
    return table.agg(F.coalesce(F.bool_or(_is_parameter() & ~F.col("requires_grad")), F.lit(False)).alias("any_frozen"))


def same_state(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether both tables hold the same values in the same order; a row that one lacks makes them differ."""
    left = a.select("ordinal", F.col("value").alias("__a"), F.lit(True).alias("__in_a"))
    right = b.select("ordinal", F.col("value").alias("__b"), F.lit(True).alias("__in_b"))
    same = F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull() & F.col("__a").eqNullSafe(F.col("__b"))
    return left.join(right, "ordinal", "full").agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("same"))


def layers(table: DataFrame) -> DataFrame:
    """(path, layer, depth): every layer above each row, the root at depth 0."""
    parts = F.split("path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), ".").alias("layer"), n.alias("depth")))
    return table.select("*", F.explode(prefixes).alias("__l")).select(*table.columns, "__l.layer", "__l.depth")


def layer_state(table: DataFrame) -> DataFrame:
    """(layer, depth, frozen, mixed): frozen has no trainable parameter; mixed has some frozen parameter as well as a
    trainable one."""
    trainable, fixed = _is_parameter() & F.col("requires_grad"), _is_parameter() & ~F.col("requires_grad")
    state = layers(table).groupBy("layer", "depth").agg(F.bool_or(trainable).alias("t"), F.bool_or(fixed).alias("f"))
    return state.select("layer", "depth", (~F.col("t")).alias("frozen"), (F.col("t") & F.col("f")).alias("mixed"), (F.col("t") & ~F.col("f")).alias("open"))


def _maximal(table: DataFrame, flag: str, full_path: bool, leaf: Column) -> DataFrame:
    state = layer_state(table)
    above = layers(table).join(state.select("layer", flag, "mixed"), "layer")
    # the topmost layer of the wanted kind under mixed layers only; leaves of mixed layers stand for themselves
    top = above.groupBy(*[c for c in table.columns if c != "value"]).agg(F.min(F.when(F.col(flag), F.struct("depth", "layer"))).alias("top"), F.bool_and("mixed").alias("in_mixed"))
    whole = top.where(F.col("top").isNotNull())
    names = whole.select((F.col("path") if full_path else F.col("top.layer")).alias("name"))
    return names.union(top.where(F.col("in_mixed") & leaf).select(F.col("path").alias("name"))).distinct()


def frozen_layers(table: DataFrame, *, full_path: bool = False) -> DataFrame:
    """Names of the topmost frozen layers (or of all rows in them), and of frozen leaves in mixed layers; a buffer counts
    as frozen there."""
    return _maximal(table, "frozen", full_path, ~_is_parameter() | ~F.col("requires_grad"))


def unfrozen_layers(table: DataFrame, *, full_path: bool = False) -> DataFrame:
    return _maximal(table, "open", full_path, _is_parameter() & F.col("requires_grad"))


def grad_state(table: DataFrame) -> DataFrame:
    """What a partial save keeps: all rows of layers without a frozen parameter, and trainable parameters elsewhere."""
    open_ = layer_state(table).where("open").select("layer")
    whole = layers(table).join(open_, "layer", "left_semi").select("path").distinct().withColumn("__open", F.lit(True))
    kept = table.join(whole, "path", "left").where(F.col("__open").isNotNull() | (_is_parameter() & F.col("requires_grad")))
    return kept.select(table.columns)


def load_grad_state(table: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table with the state's values, names of the state that the table lacks)."""
    loaded = table.join(state.select("path", F.col("value").alias("__v"), F.lit(True).alias("__hit")), "path", "left")
    loaded = loaded.withColumn("value", F.when(F.col("__hit"), F.col("__v")).otherwise(F.col("value"))).select(table.columns)
    return loaded, state.join(table.select("path"), "path", "left_anti").select("path")


def train_flags(table: DataFrame) -> DataFrame:
    """(layer, train): every layer but those without a trainable parameter."""
    return layer_state(table).select("layer", (~F.col("frozen")).alias("train"))
