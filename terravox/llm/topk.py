"""Exact top-k inner products by columnar branch and bound.

Candidates lie in blocks of a bounded number of components, stored by dimension: each dimension of a block is contiguous, and
so is a block of dimensions.  For each query the products are accumulated one block of dimensions at a time.  What the
dimensions still to come can add is at most the product of the two remaining norms (Cauchy-Schwarz); candidates whose
sum plus that bound stays below the k-th best sum minus its bound are out, and the survivors are compacted before the
next block.  The survivors' sums are exact at the end.  Dimension blocks are taken in the order of the query's
mass.

Queries too come in blocks.  Candidate blocks are dealt to shards of some ``SHARD_BLOCKS``; each shard meets each query
block by an equi-join on the shard's number.  A query block passes a shard's blocks one after the other and carries
its k best along: candidates that can't reach the k-th best so far are out before the first product, so whole blocks
are skipped.  Each shard returns k rows a query at most, of which a windowed rank, applied before and after the
exchange, keeps k.

Components become floor(256 * x).  Vectors that are null or empty or hold null or non-finite components take no
part; vectors of different lengths are not compared.  Ties go to the smaller vec_id.  Rows repeated in full are
candidates of their own; a query's own vec_id is never a candidate.  A null vec_id takes no part.  Where
products could pass 2**53, whole numbers without bound are used and scores cut to the range of long.  An empty table gives an
empty result; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 5
SCALE = 256
DIM_BLOCK = 16
#: Rows of a block at most, and components.
CANDIDATES, QUERIES = 4096, 512
BLOCK_CELLS = 1 << 19
#: Candidate blocks of a shard, about.
SHARD_BLOCKS = 4
EXACT = 2**53


def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of up to ``size`` rows of (vec_id, v) of one length: (dim, ids, data by dimension) as bytes, from each scan task."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def block(dim: int) -> pd.DataFrame:
            own = held.pop(dim)
            matrix = np.floor(np.stack([v for _, v in own], axis=1) * SCALE)
            kind = "<i4" if np.abs(matrix).max(initial=0) < 2**31 else "<f8"
            return pd.DataFrame({"dim": [dim], "ids": [np.array([i for i, _ in own], "<i8").tobytes()], "data": [matrix.astype(kind).tobytes()]})

        for at in batches:
            for i, v in zip(at.vec_id, at.v):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= min(size, max(1, BLOCK_CELLS // len(v))):
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    blocks = rows.mapInPandas(pack, "dim int, ids binary, data binary")
    return written(blocks.select(F.monotonically_increasing_id().alias(name), "dim", "ids", "data"), name)


def unpacked(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and a row for each dimension."""
    own = np.frombuffer(ids, "<i8")
    return own, np.frombuffer(data, "<i4" if len(data) == 4 * dim * len(own) else "<f8").reshape(dim, -1).astype(float)


class Block:
    """Candidates by dimension."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        self.ids, self.data, self.top = ids, data, np.abs(data).max(initial=0)
        self.cuts = [(a, min(a + DIM_BLOCK, len(data))) for a in range(0, len(data), DIM_BLOCK)]
        self.columns = [data[a:b] for a, b in self.cuts]
        self.mass = np.stack([(m**2).sum(axis=0) for m in self.columns])
        self.whole_mass = self.mass.sum(axis=0)

    def best(self, i: int, row: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
        """(-score, vec_id) of the k best for query ``i``, without any that surely scores under ``least``."""
        most = max(np.abs(row).max(initial=0), self.top)
        if most * most * len(row) >= EXACT:
            whole = np.array([[int(x) for x in c] for c in self.data.T], object)
            scores = [max(-(2**63), min(2**63 - 1, int(s))) for s in whole @ np.array([int(x) for x in row], object)]
            return sorted((-s, j) for s, j in zip(scores, self.ids.tolist()) if j != i)[:k]
        parts = [row[a:b] for a, b in self.cuts]
        weight = np.array([(p**2).sum() for p in parts])
        turn, ahead = np.argsort(-weight, kind="stable"), float(weight.sum())
        alive = np.flatnonzero((self.ids != i) & (np.sqrt(ahead * self.whole_mass) * (1 + 1e-9) >= least))
        total, rest = np.zeros(len(alive)), self.whole_mass[alive]
        for n, t in enumerate(turn):
            if not len(alive):
                return []
            total += parts[t] @ (self.columns[t] if len(alive) == len(self.ids) else self.columns[t][:, alive])
            rest, ahead = np.maximum(rest - self.mass[t, alive], 0), float(weight[turn[n + 1 :]].sum())
            if n + 1 < len(turn):
                bound, low = np.sqrt(ahead * rest) * (1 + 1e-9), least
                if len(alive) > k:
                    low = max(low, np.partition(total - bound, len(alive) - k)[len(alive) - k])
                keep = total + bound >= low
                if not keep.all():
                    alive, total, rest = alive[keep], total[keep], rest[keep]
        if len(alive) > k:
            some = np.flatnonzero(total >= np.partition(total, len(alive) - k)[len(alive) - k])
            alive, total = alive[some], total[some]
        order = np.lexsort((self.ids[alive], -total))[:k]
        return [(-int(total[b]), int(self.ids[alive[b]])) for b in order]


class Search:
    """The k best of each query of a block, over candidate blocks that come one after the other."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids.tolist(), np.ascontiguousarray(data.T), k
        self.found: list[list[tuple[int, int]]] = [[] for _ in self.ids]

    def take(self, block: Block) -> None:
        for n, (i, row) in enumerate(zip(self.ids, self.rows)):
            own = self.found[n]
            least = float(-own[-1][0]) if len(own) == self.k else -np.inf
            if new := block.best(i, row, self.k, least):
                self.found[n] = sorted(own + new)[: self.k]

    def result(self) -> list[tuple[int, int, int]]:
        """(query_id, vec_id, score)."""
        return [(i, j, -s) for i, own in zip(self.ids, self.found) for s, j in own]


def top_k(df: DataFrame, is_query: Column, *, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, its k best among all other rows."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    rows = df.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.col(key).isNotNull())
    pick = [F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("v")]
    cand = packed(rows.select(*pick), CANDIDATES, "c_block")
    asked = packed(rows.where(is_query).select(*pick), QUERIES, "q_block")
    shards = cand.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SHARD_BLOCKS).alias("shards"))
    dealt = cand.join(shards, "dim").select("dim", F.pmod(F.xxhash64("c_block"), F.col("shards")).alias("shard"), "c_block", "ids", "data")
    to_all = asked.join(shards, "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "q_block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    # merged with the queries as the streamed side: a query block's units follow each other
    units = to_all.hint("merge").join(dealt, ["dim", "shard"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, search, blocks = None, None, {}
        for at in batches:
            for u in at.itertuples():
                if now != (u.shard, u.q_block):
                    if search:
                        yield pd.DataFrame(search.result(), columns=["query_id", "vec_id", "score"])
                    now, search = (u.shard, u.q_block), Search(*unpacked(u.q_ids, u.q_data, u.dim), k)
                if u.c_block not in blocks:
                    if len(blocks) >= 8 * SHARD_BLOCKS:
                        blocks.clear()
                    blocks[u.c_block] = Block(*unpacked(u.ids, u.data, u.dim))
                search.take(blocks[u.c_block])
        if search:
            yield pd.DataFrame(search.result(), columns=["query_id", "vec_id", "score"])

    found = units.select("dim", "shard", "q_block", "c_block", "q_ids", "q_data", "ids", "data").mapInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
