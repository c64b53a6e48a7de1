"""Document boundaries and lengths in flat token files that have no index.

Every file is cut into blocks of a fixed number of ids.  A first pass finds the separators of each block
with one vectorised comparison and keeps, for each block, how many there are and where the last one stands.
A prefix scan over the blocks of all files in order yields how many documents end before a block and where
the document begins that is open at the block's start; a second pass emits each document that ends in the
block.  So a document may span any number of blocks or files, and no task reads more than a block.

Ids after the last separator form a last, unended document.  A separator right after another one ends an
empty document.  Files without ids and an empty folder give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokenfiles import mapped

BLOCK_TOKENS = 1 << 21


def block_table(spark: SparkSession, files: list[tuple[str, int]], block_tokens: int) -> DataFrame:
    """(block, path, lo, hi, base): the blocks of all files in order; base is the place of the file's first id."""
    rows = spark.createDataFrame([(i, p, n) for i, (p, n) in enumerate(files)], "file long, path string, n long")
    blocks = rows.where("n > 0").withColumn("base", F.sum("n").over(Window.orderBy("file")) - F.col("n"))
    cut = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(block_tokens)))
    blocks = blocks.select("path", "base", "n", cut.alias("lo"))
    return blocks.select((F.col("base") + F.col("lo")).alias("at"), "path", "base", "lo", F.least("n", F.col("lo") + block_tokens).alias("hi"))


def spread(blocks: DataFrame, tasks: int) -> DataFrame:
    return blocks.repartition(tasks, "at")


def scan_documents(spark: SparkSession, files: list[tuple[str, int]], kind: str, separator: int, *, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_index, start, n_tokens, ended): every document of ``files`` [(path, number of ids)] taken in a row.

    n_tokens counts the separator that ends the document.
    """
    total = sum(n for _, n in files)
    tasks = max(1, min(10_000, -(-total // block_tokens)))
    blocks = block_table(spark, files, block_tokens)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for b in batch.itertuples():
                ends = np.flatnonzero(mapped(b.path, kind)[b.lo : b.hi] == separator)
                out.append((b.at, b.path, b.base, b.lo, b.hi, len(ends), int(b.at + ends[-1] + 1) if len(ends) else None))
            yield pd.DataFrame(out, columns=["at", "path", "base", "lo", "hi", "ends", "next_start"]).astype({"next_start": "Int64"})

    counted = spread(blocks, tasks).mapInPandas(count, "at long, path string, base long, lo long, hi long, ends long, next_start long")
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row a block, not a document
    scanned = counted.select("*", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("first_doc"), F.coalesce(F.max("next_start").over(before), F.lit(0)).alias("open_start"))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples():
                ends = b.at + 1 + np.flatnonzero(mapped(b.path, kind)[b.lo : b.hi] == separator)
                starts = np.concatenate([[b.open_start], ends[:-1]]) if len(ends) else ends
                last = int(ends[-1]) if len(ends) else int(b.open_start)
                index = b.first_doc + np.arange(len(ends))
                yield pd.DataFrame({"doc_index": index, "start": starts, "n_tokens": ends - starts, "ended": True})
                if b.base + b.hi == total and last < total:
                    yield pd.DataFrame({"doc_index": [b.first_doc + len(ends)], "start": [last], "n_tokens": [total - last], "ended": [False]})

    return spread(scanned, tasks).mapInPandas(emit, "doc_index long, start long, n_tokens long, ended boolean")
