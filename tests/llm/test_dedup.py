import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravox.llm import dartminhash as D
from terravox.llm.components import components

from .fixtures import documents, empty, local


def brute(rows, weights="set"):
    """Smallest key of each row's class, by comparing all texts."""
    sets = []
    for _, text in rows:
        h, c = D.shingles(text)
        sets.append(dict(zip(h.tolist(), c.tolist() if weights == "counts" else [1] * len(h))))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        keys = set(a) | set(b)
        low, high = (sum(f(a.get(k, 0), b.get(k, 0)) for k in keys) for f in (min, max))
        if high and 5 * low >= 4 * high:
            parent[find(j)] = find(i)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            smallest[find(i)] = min(key, smallest.get(find(i), key))
    return [smallest.get(find(i)) if sets[i] else rows[i][0] for i in range(len(rows))]


@pytest.mark.parametrize("weights", ["set", "counts"])
def test_classes_equal_brute_force(spark, weights):
    docs = documents(spark)
    rows = local(docs, "doc_id", "text")
    want = sorted(((k, c) for (k, _), c in zip(rows, brute(rows, weights))), key=repr)
    assert sorted(map(tuple, D.class_table(docs, weights=weights).collect()), key=repr) == want
    assert D.class_table(empty(spark)).count() == 0


def test_group_of_near_copies_without_all_pairs(spark):
    """A chain: each text is near the next only; and many edits of one base."""
    draw = np.random.default_rng(0)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for n in range(60):
        own = list(base)
        for at in draw.choice(150, 1 + n % 5, replace=False):
            own[at] = f"e{n}"
        texts.append(" ".join(own))
    chain = [f"c{i}" for i in range(300)]
    texts += [" ".join(chain[4 * k : 4 * k + 100]) for k in range(12)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((k, c) for (k, _), c in zip(rows, brute(rows)))
    assert sorted(map(tuple, D.class_table(docs).collect())) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_classes_of_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = local(docs, "doc_id", "text")
    want = sorted((k, c) for (k, _), c in zip(rows, brute(rows)))
    assert sorted(map(tuple, D.class_table(docs).collect())) == want


def test_keep_one(spark):
    docs = documents(spark)
    rows = local(docs, "doc_id", "text")
    kept = D.keep_one(docs)
    assert kept.columns == docs.columns
    apart = brute([(i, t) for i, (_, t) in enumerate(rows)])  # keys may be used twice, places are not
    worded = {c for c, (_, t) in zip(apart, rows) if (t or "").split()}
    bare = sum(not (t or "").split() for _, t in rows)
    found = local(kept, "doc_id", "text")
    assert len(found) == len(worded) + bare
    smallest = {}
    for c, (k, t) in zip(apart, rows):
        if c in worded and k is not None:
            smallest[c] = min(k, smallest.get(c, k))
    assert sorted(k for k, t in found if (t or "").split() and k is not None) == sorted(smallest.values())
    assert D.keep_one(empty(spark)).count() == 0


def test_signatures_estimate_weighted_similarity():
    draw = np.random.default_rng(3)
    a = {int(k): int(v) for k, v in zip(draw.integers(0, 2**62, 200), draw.integers(1, 9, 200))}
    b = {k: max(1, v + int(draw.integers(-2, 3))) for k, v in list(a.items())[:150]} | {int(k): 2 for k in draw.integers(0, 2**62, 40)}
    pack = lambda s: (np.array(sorted(s), np.uint64), np.array([s[k] for k in sorted(s)]))
    k = 2000
    x, y = D.Darts(k).signatures([pack(a), pack(b)])
    true = sum(min(a.get(i, 0), b.get(i, 0)) for i in a | b) / sum(max(a.get(i, 0), b.get(i, 0)) for i in a | b)
    assert abs((x == y).mean() - true) < 4 * math.sqrt(true * (1 - true) / k)
    alone = D.Darts(64).signatures([pack({5: 1}), pack({5: 3})])
    assert (alone != 0).all() and 0.1 < (alone[0] == alone[1]).mean() < 0.6  # a third
    fraction = D.Darts(64).signatures([(np.array([7], np.uint64), np.array([0.25]))])
    assert (fraction != 0).all()


def test_sketch_bound_keeps_pairs_at_the_limit(spark):
    draw = np.random.default_rng(4)
    k, n = D.BANDS * D.ROWS, 4000
    a = draw.integers(0, 2**63, (n, k)).astype(np.uint64)
    b = np.where(draw.random((n, k)) < 0.8, a, draw.integers(0, 2**63, (n, k)).astype(np.uint64))
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(D.sketches(a)[:300], D.sketches(b)[:300])], "a array<long>, b array<long>")
    differ = [r[0] for r in df.select(D.unlike(F.col("a"), F.col("b"), -(-k // 16))).collect()]
    nib = lambda s: (D.mix(s ^ D._M2) >> np.uint64(60))
    assert differ == (nib(a[:300]) != nib(b[:300])).sum(axis=1).tolist()
    assert ((nib(a) != nib(b)).sum(axis=1) <= D.most_unlike(k, 0.8)).all()


def test_components(spark):
    draw = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 360)] + [(5, 5), (None, 3)]
    parent = {}
    find = lambda i: i if parent.setdefault(i, i) == i else find(parent[i])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = sorted((i, find(i)) for i in parent)
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, components(df).collect())) == want
    assert components(df.where("false")).count() == 0
