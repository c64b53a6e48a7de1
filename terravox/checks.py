"""Argument checks made while a plan is built, and row checks that are part of the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def positive(name: str, value: float) -> float:
    require(value > 0, f"{name} must be positive, got {value}")
    return value


def one_of(name: str, value: str, allowed) -> str:
    require(value in allowed, f"{name} must be one of {sorted(map(str, allowed))}, got {value!r}")
    return value


def checked(value: Column, condition: Column, message: str) -> Column:
    """``value`` where ``condition`` holds; the query fails with ``message`` elsewhere."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def no_nan(value: Column) -> Column:
    return F.when(F.isnan(value.cast("double")), F.raise_error(F.lit("NaN is not allowed here"))).otherwise(value)


def vector_of(value: Column, size: int) -> Column:
    """Fails for arrays of another length."""
    return checked(value, F.size(value) == size, f"expected {size} components")


def matrix_of(value: Column, rows: int, columns: int) -> Column:
    """Fails for nested arrays of another shape."""
    return checked(value, (F.size(value) == rows) & F.forall(value, lambda r: F.size(r) == columns), f"expected {rows} x {columns} components")


def rigid(rotation: Column, translation: Column) -> tuple[Column, Column]:
    """A 3 x 3 rotation and a vector of 3, or an error."""
    return matrix_of(rotation, 3, 3), vector_of(translation, 3)


def one_machine(spark) -> bool:
    """Whether driver and executors share a machine, so that a local folder is seen by all."""
    return spark.conf.get("spark.master", "").split("[")[0] == "local"
