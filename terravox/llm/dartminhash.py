"""Near-duplicate classes by DartMinHash signatures, banded joins and an exact check.

A document is the weighted set of its five-word shingles (words in lower case; a text of one to four words is
one shingle).  By default every distinct shingle weighs 1, so that the similarity is that of sets; with
``weights="counts"`` it weighs its number of occurrences and the similarity is sum of minima by sum of maxima.

Darts: over each shingle lies a quadrant of weight by rank.  In each dyadic layer of weight ([0,1), [1,2),
[2,4) ..) darts fall as a Poisson process along the rank axis whose gaps, weight positions and coordinates
are hashes of (shingle, layer, number), so every document sees the same darts.  A document catches the darts
under its weights up to a rank bound of t by its total weight, and keeps the earliest for each of k
coordinates; should one be empty, the bound is doubled.  Two documents agree in a coordinate with the
probability of their similarity.  k (ln k + 2) darts are expected whatever the document's length.

Links: signatures are cut into bands; documents that share a band are candidates.  A candidate pair counts
only if its exact similarity is 0.8 or more.  With 36 bands of 6, a pair at 0.8 is missed with probability
2e-5, one at 0.9 with 1e-12.

No group is expanded into pairs: exact copies are one node.  In the first rounds the member of a band with the most
company is compared with the members that are not yet in its component, and then leaves the band; a band whose
members are in one component is done.  In the last round every member outside a band's largest component is
compared with the others.  So each candidate pair is either checked or already connected and none is lost; a pair
is taken up in the first band that it shares only.  Before texts are fetched, four bits of every coordinate are
compared: pairs that differ in more of them than four standard deviations over what 0.8 makes likely are out,
which loses a pair at 0.8 with a probability of 3e-5.

Nulls, and texts without words: such a document is a class of its own.  A null key takes part by its text.  The
class id is the smallest key of the class (null, if all are null).  Repeated rows and ties in key are one class.  Very long
texts are taken whole.  An empty table gives an empty result.  Other columns are left behind by ``class_table`` and stay as
they are in ``keep_one``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, held, slices, written
from .components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 6
#: Coordinates of a signature: the first go into bands, all into the sketch.
COORDINATES = 432
ELEMENTS_AT_ONCE = 400_000
#: Members of a band that one share holds, about.
SHARE_ROWS = 1000
#: Rounds in which a band has one leader.
SINGLE_ROUNDS = 3

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53


def shingles(text: str | None, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as 64-bit hashes, in order, and their counts."""
    found = WORD.findall((text or "").lower())
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(words, len(ids))
    if n == 0:
        return ids, np.zeros(0, np.int64)
    out = np.full(len(ids) - n + 1, np.uint64(n))
    for i in range(n):
        out = mix(out * _M3 + ids[i : len(ids) - n + 1 + i])
    return np.unique(out, return_counts=True)


class Darts:
    def __init__(self, k: int):
        self.k = k

    def throw(self, elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, bound: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Rank and name of the earliest dart for each document and coordinate; rank is infinite if there is none."""
        k = self.k
        rank, name = np.full(docs * k, np.inf), np.zeros(docs * k, np.uint64)
        layers = 1 + int(max(0, math.ceil(math.log2(weights.max())))) if len(weights) else 0
        for layer in range(layers):
            low, width = (0.0, 1.0) if layer == 0 else (2.0 ** (layer - 1), 2.0 ** (layer - 1))
            at = np.flatnonzero(weights > low)
            seed, at_doc = mix(elements[at] + np.uint64((layer + 1) * int(_M3) % 2**64)), doc[at]
            limit, most, r, n = bound[at_doc], weights[at], np.zeros(len(at)), 0
            while len(seed):
                n += 1
                dart = mix(seed + np.uint64(n * int(_M2) % 2**64))
                r = r - np.log(unit(dart)) / (k * width)
                keep = r <= limit
                if not keep.all():
                    seed, at_doc, limit, most, r, dart = seed[keep], at_doc[keep], limit[keep], most[keep], r[keep], dart[keep]
                if not len(seed):
                    break
                place = mix(dart ^ _M3)
                inside = slice(None)
                if layer or (most < 1).any():
                    inside = low + width * unit(mix(place ^ _M1)) <= most
                key = at_doc[inside] * k + (place[inside] >> np.uint64(33)).astype(np.int64) % k
                ranks = r[inside]
                np.minimum.at(rank, key, ranks)
                first = ranks == rank[key]
                name[key[first]] = dart[inside][first]
        return rank.reshape(docs, k), name.reshape(docs, k)

    def signatures(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row of k dart names for each (elements, weights) of positive total weight."""
        out, todo, t = np.zeros((len(sets), self.k), np.uint64), np.arange(len(sets)), math.log(self.k) + 2
        while len(todo):
            again, a = [], 0
            while a < len(todo):
                b, size = a, 0
                while b < len(todo) and (b == a or size + len(sets[todo[b]][0]) <= ELEMENTS_AT_ONCE):
                    size += len(sets[todo[b]][0])
                    b += 1
                own = [sets[i] for i in todo[a:b]]
                doc = np.repeat(np.arange(len(own)), [len(e) for e, _ in own])
                weights = np.concatenate([w for _, w in own]).astype(float)
                bound = t / np.array([w.sum() for _, w in own], float)
                rank, name = self.throw(np.concatenate([e for e, _ in own]), weights, doc, bound, len(own))
                whole = np.isfinite(rank).all(axis=1)
                out[todo[a:b][whole]] = name[whole]
                again.append(todo[a:b][~whole])
                a = b
            todo, t = np.concatenate(again), 2 * t
        return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for i in range(rows):
        key = mix(key * _M3 + parts[:, :, i])
    return key.view(np.int64)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, sixteen coordinates a long."""
    n, k = signatures.shape
    nibbles = np.zeros((n, -(-k // 16), 16), np.uint64)
    nibbles.reshape(n, -1)[:, :k] = mix(signatures ^ _M2) >> np.uint64(60)
    out = np.zeros(nibbles.shape[:2], np.uint64)
    for i in range(16):
        out |= nibbles[:, :, i] << np.uint64(4 * i)
    return out.view(np.int64)


def unlike(a: Column, b: Column, longs: int) -> Column:
    """The number of coordinates whose four bits differ."""
    ones, total = F.lit(0x1111111111111111), None
    for i in range(longs):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        n = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(ones))
        total = n if total is None else total + n
    return total


def first_shared(a: Column, b: Column, bands: int) -> Column:
    """The first band key that two rows of keys have in common."""
    return F.coalesce(*[F.when(a[i] == b[i], a[i]) for i in range(bands)])


def most_unlike(k: int, similarity: float) -> int:
    p = (1 - similarity) * 15 / 16
    return math.ceil(k * p + 4 * math.sqrt(k * p * (1 - p)))


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], similarity: float) -> bool:
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - shared
    return shared >= similarity * total - 1e-9 and total > 0


def content(text: str = "text"):
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weights: str = "set", sketch: bool = True) -> DataFrame:
    """(content, class) for each distinct text; class is the smallest content number in it.

    ``sketch=False`` checks every candidate pair exactly, without the comparison of sketches before.

    Columns: content string (md5 of the text), node long, class long, first_key (smallest key with that text,
    null only if all are), copies of that key and text.
    """
    k = max(COORDINATES, bands * rows)
    weighed = (lambda s: s) if weights == "counts" else (lambda s: (s[0], np.ones(len(s[0]), np.int64)))
    scratch = Scratch(df.sparkSession)
    rows_in = df.select(F.col(key).alias("key"), content(text).alias("content"))
    kind = rows_in.schema["key"].dataType.simpleString()
    once = rows_in.groupBy("content", "key").agg(F.count("*").alias("copies"))
    first = once.groupBy("content").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "copies")).alias("first"))
    nodes = first.select("content", F.monotonically_increasing_id().alias("node"), F.col("first.key").alias("first_key"), F.col("first.copies").alias("copies"))
    nodes = scratch.write(nodes, "nodes")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("darts")
        darts = Darts(k)
        for at in slices(batches, 1000, "text"):
            sets = [weighed(shingles(t, words)) for t in at["text"].to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s[0])]
            found = darts.signatures([sets[i] for i in some])
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel())) for m in (band_keys(found[:, : bands * rows], bands, rows), sketches(found))]
            own = pa.array(some, pa.int64())
            yield pa.RecordBatch.from_arrays([at["key"].take(own), at["content"].take(own), *lists], ["key", "content", "bands", "sketch"])

    # signatures of copies are made and left: cheaper than bringing the texts together first
    texts = df.select(F.col(key).alias("key"), content(text).alias("content"), F.col(text).alias("text"))
    own = nodes.select("node", F.col("content").alias("node_content"), "first_key")
    same = lambda t: (t.content == own.node_content) & t.key.eqNullSafe(own.first_key)
    signatures = texts.mapInArrow(sign, f"key {kind}, content string, bands array<long>, sketch array<long>")
    signed = scratch.write(signatures.join(own, same(signatures)).select("node", "bands", "sketch"), "signatures")
    exploded = signed.select("node", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("band")
    members = scratch.write(exploded.join(shared, "band").distinct(), "members")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("darts")
        last, mine = None, None
        for at in slices(batches, 1000, "text_b"):
            good = []
            for a, x, y in zip(at["a"].to_pylist(), at["text_a"], at["text_b"].to_pylist()):
                if a != last:
                    last, mine = a, weighed(shingles(x.as_py(), words))
                good.append(similar(mine, weighed(shingles(y, words)), similarity))
            yield at.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    involved = members.select("node").distinct()
    labels = scratch.write(involved.select("node", F.col("node").alias("class")), "labels")
    sizes = members.groupBy("band").agg(F.count("*").alias("size"))
    company = members.join(sizes, "band").groupBy("node").agg(F.sum("size").alias("company"))
    drawn = scratch.write(signed.dropDuplicates(["node"]).join(company, "node"), "sketches")
    bodies, turn = None, 0
    while True:
        known = members.join(labels, "node")
        mixed = known.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("size")).where("lo < hi")
        # a large band is split into shares by a hash of the member; its heads go to every share
        shares = F.ceil(F.col("size") / SHARE_ROWS).cast("int")
        members = known.join(mixed, "band").select("band", "node", "class", shares.alias("shares"))
        members = scratch.write(members.withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")), "members")
        if members.isEmpty():
            break
        full = members.join(drawn, "node")
        named = [F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("node").alias("head"), F.col("class").alias("head_class"), F.col("sketch").alias("head_sketch"), F.col("bands").alias("head_bands")]
        if turn < SINGLE_ROUNDS:
            top = members.join(company, "node").groupBy("band").agg(F.max(F.struct("company", "node")).alias("top"))
            heads = top.select("band", F.col("top.node").alias("node")).join(full, ["band", "node"]).select("band", *named)
        else:
            counts = members.groupBy("band", "class").agg(F.count("*").alias("n"))
            largest = counts.groupBy("band").agg(F.max(F.struct("n", "class")).alias("top")).select("band", F.col("top.class").alias("largest"))
            heads = full.join(largest, "band").where("class <> largest").select("band", *named)
        heads = scratch.write(heads, "heads")
        near = unlike(F.col("sketch"), F.col("head_sketch"), -(-k // 16)) <= (most_unlike(k, similarity) if sketch else k)
        once_only = first_shared(F.col("bands"), F.col("head_bands"), bands) == F.col("band")
        pairs = full.join(heads, ["band", "share"]).where(F.expr("node <> head and class <> head_class") & once_only & near)
        pairs = scratch.write(pairs.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct(), "pairs")
        if not pairs.isEmpty():
            if bodies is None:
                own = own.join(involved, "node", "left_semi")
                bodies = scratch.write(texts.join(own, same(texts)).select("node", "text").dropDuplicates(["node"]), "texts")
            lined = pairs.join(bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
            lined = lined.join(bodies.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
            good = lined.mapInArrow(verify, "a long, b long")
            ends = good.join(labels.select(F.col("node").alias("a"), F.col("class").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("class").alias("y")), "b")
            merged = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
            relabelled = labels.join(merged.select(F.col("node").alias("class"), "component"), "class", "left")
            labels = scratch.write(relabelled.select("node", F.coalesce("component", "class").alias("class")), "labels")
        if turn == SINGLE_ROUNDS:
            break
        members = members.select("band", "node").join(heads.where("share = 0").select("band", F.col("head").alias("node")), ["band", "node"], "left_anti")
        turn += 1
    out = nodes.join(labels, "node", "left").select("content", "node", F.coalesce("class", "node").alias("class"), "first_key", "copies")
    out = written(out, "classes")
    scratch.clear()
    return out


def class_table(df: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, class_id) of every row: the smallest doc_id of the document's class."""
    classes = near_duplicates(df, key=key, text=text, **how)
    ids = classes.groupBy("class").agg(F.min("first_key").alias("class_id"))
    named = classes.join(ids, "class").select("content", "class_id")
    rows = df.select(F.col(key).alias("doc_id"), content(text).alias("content"), F.regexp_like(F.coalesce(F.col(text), F.lit("")), F.lit(WORD.pattern)).alias("worded"))
    return rows.join(named, "content").select("doc_id", F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def keep_one(df: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each class the row with the smallest key stays, whole.

    Rows without words all stay.
    """
    classes = near_duplicates(df, key=key, text=text, **how)
    pick = F.struct(F.col("first_key").isNull().alias("none"), "first_key", "content", "copies")
    kept = classes.groupBy("class").agg(F.min(pick).alias("pick")).select("pick.content", "pick.first_key", "pick.copies")
    own = {c: fresh(df, c) for c in ("content", "first_key", "copies", "worded", "own_content")}
    kept = written(kept, "kept").select(*[F.col(c).alias(own[c]) for c in ("content", "first_key", "copies")])
    worded = F.regexp_like(F.coalesce(df[text], F.lit("")), F.lit(WORD.pattern))
    marked = df.withColumn(own["worded"], worded).withColumn(own["own_content"], content(text))
    chosen = marked.where(F.col(own["worded"])).join(kept, (F.col(own["own_content"]) == F.col(own["content"])) & F.col(key).eqNullSafe(F.col(own["first_key"])))
    if kept.where(F.col(own["copies"]) > 1).isEmpty():
        out = chosen
    else:
        out = chosen.where(F.col(own["copies"]) == 1).union(chosen.where(F.col(own["copies"]) > 1).dropDuplicates([own["own_content"]]))
    return out.select(df.columns).union(marked.where(~F.col(own["worded"])).select(df.columns))
