import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravox.llm import backoff, mixing, topk
from terravox.llm.common import WORD
from terravox.llm.queries import OP6_SQL

from ..helpers import same_as_sql
from .fixtures import documents, empty, local

INF, NAN = float("inf"), float("nan")


def vectors(spark):
    draw = np.random.default_rng(0)
    rows = [(i, draw.normal(scale=0.2, size=40).astype("f4").tolist()) for i in range(300)]
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, None), (303, []), (304, [1.0, None]), (305, [INF] * 40), (306, [NAN] * 40), (350, [0.0] * 40), (400, [1.0, 2.0]), (401, [3.0, 1.0]), (450, [1e30, 1.0]), (None, rows[0][1]), (100, rows[7][1])]
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, ids string, dim int")


def brute(rows, k):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 50 == 0:
            scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c)))), j) for j, c in ok if j != i and len(c) == len(q)]
            out.append((i, sorted(scores)[:k]))
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "SHARD_BLOCKS", 2)
    df = vectors(spark)
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    want = {}
    for q, best in brute(local(df, "vec_id", "embedding"), 5):
        want.setdefault(q, []).extend(best)
    want = {q: sorted(b)[:5] for q, b in want.items() if b}
    assert got == want
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_pruning_is_exact():
    draw = np.random.default_rng(1)
    c = np.floor(draw.normal(scale=60, size=(900, 64)))
    c[5] = c[9] = c[700]
    ids = draw.permutation(900)
    q = c[:20]
    search = topk.Search(ids[:20], q.T, 5)
    for a in range(0, 900, 130):  # what is found carries over to the next block
        search.take(topk.Block(ids[a : a + 130], np.ascontiguousarray(c[a : a + 130].T)))
    got = search.result()
    for n, i in enumerate(ids[:20].tolist()):
        s = c @ q[n]
        want = sorted((-int(v), int(j)) for v, j in zip(s, ids) if j != i)[:5]
        assert [(-x[2], x[1]) for x in got if x[0] == i] == want


def test_top_k_sql(spark, tmp_path):
    vectors(spark).where("vec_id < 300 or vec_id = 350").dropDuplicates(["vec_id"]).write.parquet(str(tmp_path / "embeddings.parquet"))
    df = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    same_as_sql(topk.top_k(df, F.col("vec_id") % 50 == 0), OP6_SQL, str(tmp_path))


def water(sizes, weights, budget, most):
    """Targets by rounds of resharing, in exact fractions."""
    total = budget * sum(sizes)
    share = [total * w / sum(weights) for w in weights]
    while True:
        over = [i for i, s in enumerate(share) if s > most * sizes[i]]
        if not over:
            return share
        excess = sum(share[i] - most * sizes[i] for i in over)
        for i in over:
            share[i] = Fraction(most * sizes[i])
        free = [i for i, s in enumerate(share) if s < most * sizes[i]]
        for i in free:
            share[i] += excess * weights[i] / sum(weights[j] for j in free)


def test_targets(spark):
    draw = np.random.default_rng(2)
    for n in (1, 2, 5, 17):
        sizes = [int(v) for v in draw.integers(0, 1000, n)]
        rows = spark.createDataFrame([(f"0s{i:02d}", s) for i, s in enumerate(sizes)], "source_key string, source_size long")
        got = [r["target"] for r in mixing.targets(rows).orderBy("source_key").collect()]
        want = water(sizes, [Fraction((5, 2, 1)[i % 3]) for i in range(n)], Fraction(3, 2), 2)
        assert np.allclose(got, [float(v) for v in want])


def test_mix_equals_sql(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    docs.write.parquet(str(tmp_path / "d" / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "d" / "documents.parquet"))
    got = mixing.mix_table(docs).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")
    same_as_sql(got, mixing.oracle(), str(tmp_path / "d"))


def test_mix_of_awkward_rows(spark):
    docs = documents(spark)
    got = mixing.mix_table(docs).collect()
    words = [len(WORD.findall(t or "")) for (t,) in local(docs, "text")]
    assert sorted(r["size"] for r in got) == sorted(words) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    rows = mixing.mix_rows(docs)
    assert rows.columns == docs.columns
    assert sum(len(WORD.findall(t)) for (t,) in local(rows, "text")) == sum(r["taken"] for r in got)
    assert sorted(map(tuple, mixing.mix_table(docs.repartition(3)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mix_table(empty(spark)).count() == mixing.mix_rows(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix_table(nothing).collect()] == [0, 0]


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("source"))
    named = mixing.mix_table(docs).join(docs.select("doc_id", "source"), "doc_id")
    sums = named.groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(sums) == 7 and all(abs(r["taken"] - r["target"]) <= 20 for r in sums)


def test_large_threshold_tables_join_without_broadcast(spark, monkeypatch):
    docs = documents(spark)
    want = sorted(map(tuple, mixing.mix_table(docs).collect()), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix_table(docs).collect()), key=repr) == want


def brute_backoff(texts, order, alpha, leave_out):
    docs = [WORD.findall(t or "") for t in texts]
    counts = Counter(tuple(d[i : i + n]) for d in docs for n in range(1, order + 1) for i in range(len(d) - n + 1))
    out = []
    for d in docs:
        own = Counter(tuple(d[i : i + n]) for n in range(1, order + 1) for i in range(len(d) - n + 1)) if leave_out else Counter()
        c = lambda g: counts[g] - own[g]  # noqa: B023, E731
        n = sum(map(len, docs)) - (len(d) if leave_out else 0)

        def score(g):
            if len(g) == 1:
                return c(g) / n if c(g) > 0 else alpha / (n + 1)  # noqa: B023
            return c(g) / c(g[:-1]) if c(g) > 0 and c(g[:-1]) > 0 else alpha * score(g[1:])  # noqa: B023

        out.append((len(d), sum(math.log(score(tuple(d[max(0, i - order + 1) : i + 1]))) for i in range(len(d)))))
    return out


@pytest.mark.parametrize(("order", "leave_out"), [(1, True), (2, True), (3, True), (3, False)])
def test_backoff_equals_brute_force(spark, order, leave_out):
    docs = documents(spark)
    rows = local(docs, "doc_id", "text")
    got = backoff.backoff_scores(docs, order=order, leave_out=leave_out, group_chars=20_000, part_grams=3000).collect()
    want = [(k, n, round(s, 5)) for (k, _), (n, s) in zip(rows, brute_backoff([t for _, t in rows], order, 0.4, leave_out))]
    assert sorted(((r["doc_id"], r["n_words"], round(r["log_score"], 5)) for r in got), key=repr) == sorted(want, key=repr)
    assert all((r["mean_log_score"] is None) == (r["n_words"] == 0) for r in got)


def test_backoff_of_nothing(spark):
    assert backoff.backoff_scores(empty(spark)).count() == 0
    none = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert sorted(map(tuple, backoff.backoff_scores(none).collect())) == [(1, 0, 0.0, None), (2, 0, 0.0, None)]


def test_blocks_that_cannot_reach_the_best_are_skipped():
    draw = np.random.default_rng(3)
    near, far = np.floor(draw.normal(scale=60, size=(64, 50))), np.floor(draw.normal(scale=0.5, size=(64, 50)))
    search = topk.Search(np.array([-1]), near[:, :1] * 4, 5)
    search.take(topk.Block(np.arange(50), near))
    block = topk.Block(np.arange(50, 100), far)
    block.columns = None  # no product is made
    search.take(block)
    assert len(search.result()) == 5
