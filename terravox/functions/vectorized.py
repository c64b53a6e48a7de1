"""Wrapping functions of numeric arrays as Arrow-batched column functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf


def array_function(shape: tuple[int, ...] | None = None, permute: tuple[int, ...] | None = None, result: str = "array<double>") -> Callable:
    """Decorator: a function of one stacked array (rows first) becomes a column function over array columns.

    Rows are reshaped to ``shape`` and their axes permuted (as in channels first) before the call; the result's rows
    come back flat.
    """

    def wrap(function: Callable[[np.ndarray], np.ndarray]):
        @pandas_udf(result)
        def run(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=object)
            stacked = np.stack(values.to_numpy())
            if shape is not None:
                stacked = stacked.reshape(len(values), *shape)
            if permute is not None:
                stacked = stacked.transpose(0, *[p + 1 for p in permute])
            out = np.asarray(function(stacked))
            return pd.Series(list(out.reshape(len(values), -1))) if result.startswith("array") else pd.Series(out.ravel())

        return run

    return wrap
