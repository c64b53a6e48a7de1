"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..checks import one_machine

#: A word: a run of characters that are neither space nor one of tab .. carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)


#: Bytes of an Arrow batch between an executor and its Python workers; both sides hold some at a time.
BATCH_BYTES = 12 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Makes Arrow batches in this session no larger than ``most`` bytes from now on; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table that a query reads; Arrow batches of the session are bounded from here on."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all executors and the driver share.

    Where that setting is missing, the session's checkpoint folder is used; on one machine (tests) a temporary one is
    set once, and on a cluster, where nobody else would see it, a missing folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            base = set_dir.get()
        elif not one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="terravox-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it reread: its lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Scratch:
    """Tables written on the way to a result; ``clear`` deletes them once the result itself has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, purpose: str) -> DataFrame:
        path = shared_dir(self.spark, purpose)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, but: int = 0) -> None:
        """Deletes all tables, or all but the last so many."""
        keep = len(self.paths) - but
        for path in self.paths[:keep]:
            drop_written(self.spark, path)
        del self.paths[:keep]


_HELD: dict = {}


def held(name, make=None):
    """What a Python worker keeps from task to task: one operator's object at a time, so that idle ones don't add up.

    Without ``make`` everything is let go.
    """
    if name not in _HELD:
        _HELD.clear()
        if make is not None:
            _HELD[name] = make()
    return _HELD.get(name)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns memory that a Python worker has freed to the system, which allocators otherwise keep for later."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batches, rows: int, column: int | str, most: int = 8 << 20):
    """Arrow batches in pieces of so many rows and of so many bytes in a text column; a longer text comes alone."""
    for whole in batches:
        if not len(whole):
            continue
        sizes = pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy().astype("int64")
        ends = np.cumsum(sizes)
        at = 0
        while at < len(whole):
            limit = int(ends[at] - sizes[at]) + most
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, limit, side="right"))))
            yield whole.slice(at, stop - at)
            at = stop


def local_path(uri: str) -> str | None:
    """The POSIX path of a ``file:`` URI or plain path; None for any other store."""
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def write_bytes(uri: str, data) -> None:
    """Write a file so that it appears whole or not at all; a second attempt writes the same bytes."""
    if (path := local_path(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)
