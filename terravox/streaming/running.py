"""Extensions for streams: running (n, mean, var) of events, windowed with a watermark, and key frames with state.

The batch library has no streams; its mergeable moments and its key-frame sweep carry over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def windowed_moments(events: DataFrame, *, time: str, value: str, by: list[str], window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(start, by, n, mean, var) by event-time window; rows later than ``lateness`` are dropped on a stream."""
    late = events.withWatermark(time, lateness) if events.isStreaming else events
    out = late.groupBy(F.window(time, window).alias("w"), *by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "mean", "var")


class KeyframeProcessor(StatefulProcessor):
    """Keeps a row if it lies ``threshold`` or more from the last kept one of its key."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "pos double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        at = pd.concat(list(rows)).sort_values(["ts", "idx"])
        kept = []
        for i, pos in zip(at.idx, at.pos):
            if last is None or abs(pos - last) >= self.threshold:
                kept.append(i)
                last = float(pos)
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame({"key": key[0], "idx": kept})

    def close(self) -> None:
        pass


def streaming_keyframes(events: DataFrame, threshold: float) -> DataFrame:
    """(key, idx) of the rows of a stream (key long, ts, idx long, pos double) that are kept; rows of a micro-batch are
    taken in time order."""
    return events.groupBy("key").transformWithStateInPandas(KeyframeProcessor(threshold), "key long, idx long", "Append", "none")
