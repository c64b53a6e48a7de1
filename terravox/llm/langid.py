"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  The vector of a letter trigram is the product (binding) of its
letters' vectors, the first rotated twice and the second once, so that order counts.  A document is the sum
(bundle) of its trigrams' vectors with their counts; a language is the sum of its labelled documents' unit
vectors.  A document gets the language whose prototype has the largest cosine with it, after the mean of all
prototypes has been taken off prototypes and document alike: what all languages share says nothing.

The best of these cosines can't be negative with two languages or more, so a text in none of them is told by its
likeness instead: the largest cosine with a prototype as it is, nothing taken off. It grows with the square root of
a short text's length, so with fewer than ``WHOLE_TRIGRAMS`` trigrams it is divided by the square root of their share.

Letters are alphabetic characters in lower case; each run of others is one blank.  Letters from U+0100 on
share the 256 letter vectors by a hash.

Learning uses labelled rows only, of each label a sample of ``SAMPLE_ROWS`` rows in expectation (all, if there are
fewer), picked by a hash of key and text; prediction sees the text alone and covers every whole text.

Nulls: a null text, or one without letters, is ``und`` with score 0; a null label teaches nothing.  If nothing
was learned, all are ``und``.  Ties go to the language that sorts first.  Repeated rows give repeated results, an
empty table an empty result.  Very long texts are taken whole, a piece at a time.  Other columns are left behind or, in
``filter_language``, stay as they are, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, held, slices

DIMENSIONS = 512
#: Rows of each label that teach, in expectation; all, if there are fewer.
SAMPLE_ROWS = 5_000
#: More labels than these are an error: their vectors go to the driver and every task (2 KB each).
MOST_LABELS = 10_000
#: Characters that are handled at once.
PIECE_CHARS = 1_000_000
#: Trigrams from which on likeness is taken as it is.
WHOLE_TRIGRAMS = 200
UNKNOWN = "und"
SLOTS = 256
BLANK = 32


class Letters:
    """Letter vectors and the products of the first two letters of a trigram."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.one = (draw.integers(0, 2, (SLOTS, dimensions), dtype=np.int8) * 2 - 1).astype(np.int8)
        first, second = np.roll(self.one, 2, axis=1), np.roll(self.one, 1, axis=1)
        self.two = (first[:, None, :] * second[None, :, :]).reshape(SLOTS * SLOTS, dimensions)

    def slots(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The letter slot of each code point of lower-case text, and which are letters."""
        letter = ((cp >= 97) & (cp <= 122)) | ((cp >= 0xDF) & (cp <= 0xFF) & (cp != 0xF7))
        slot = cp.astype(np.int32)
        other = np.flatnonzero((cp > 0xFF) | (cp == 0xAA) | (cp == 0xB5) | (cp == 0xBA))
        if len(other):
            kinds, which = np.unique(cp[other], return_inverse=True)
            letter[other] = np.array([chr(k).isalpha() for k in kinds])[which]
            slot[other] = ((cp[other].astype(np.uint64) * np.uint64(2654435761) >> np.uint64(11)) % np.uint64(SLOTS)).astype(np.int32)
        slot[~letter] = BLANK
        return slot, letter

    def kept(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the letters and of one blank after each run of letters, and which are edges (code point 0)."""
        cp = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        slot, letter = self.slots(cp)
        edge = cp == 0
        keep = letter | edge
        keep[1:] |= letter[:-1]
        return slot[keep], edge[keep]

    def trigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All trigrams of some texts as numbers, and the text each is from."""
        slot, edge = self.kept("\0" + "\0".join([(t.replace("\0", " ") if "\0" in t else t).lower() for t in texts]) + "\0")
        inner = np.append(edge[:-1] | (slot[:-1] != BLANK) | ~edge[1:], True)  # the edge is the blank after the last run
        slot, edge = slot[inner], edge[inner]
        doc = np.cumsum(edge) - 1
        inside = ~edge[1:-1]
        grams = (slot[:-2] * SLOTS + slot[1:-1]) * SLOTS + slot[2:]
        return grams[inside], doc[1:-1][inside]

    def pieces(self, text: str) -> Iterator[np.ndarray]:
        """The trigrams of one long text, some characters at a time; each piece takes the last two slots of the one before."""
        text, before, after_letter = text.replace("\0", " ").lower(), np.full(1, BLANK, np.int32), False
        for at in range(0, len(text), PIECE_CHARS):
            slot, letter = self.slots(np.frombuffer(text[at : at + PIECE_CHARS].encode("utf-32-le", "replace"), "<u4"))
            keep = letter.copy()
            keep[1:] |= letter[:-1]
            keep[0] |= after_letter
            after_letter = bool(letter[-1])
            last = [BLANK] if after_letter and at + PIECE_CHARS >= len(text) else []
            slot = np.concatenate([before, slot[keep], np.array(last, np.int32)])
            yield (slot[:-2] * SLOTS + slot[1:-1]) * SLOTS + slot[2:]
            before = slot[-2:]

    def add(self, out: np.ndarray, grams: np.ndarray, doc: np.ndarray) -> None:
        """Adds the trigrams' vectors to the rows of their texts, 8,192 distinct ones at a time."""
        n = len(out)
        cells, counts = np.unique(grams.astype(np.int64) * n + doc, return_counts=True)
        known, place = np.unique(cells // n, return_inverse=True)
        for a in range(0, len(known), 8192):
            lo, hi = np.searchsorted(place, [a, a + 8192])
            dense = np.zeros((n, min(8192, len(known) - a)), np.float32)
            dense[cells[lo:hi] % n, place[lo:hi] - a] = counts[lo:hi]
            g = known[a : a + 8192]
            out += dense @ (self.two[g >> 8] * self.one[g & 255]).astype(np.float32)

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: its unit vector, or zeros without letters."""
        return self.sized_bundles(texts)[0]

    def sized_bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The bundles, and the number of trigrams of each text."""
        out, sizes = np.zeros((len(texts), self.one.shape[1])), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):  # some texts together, a long one alone
            end, size = at, 0
            while end < len(texts) and end - at < 192 and (end == at or size + len(texts[end] or "") <= PIECE_CHARS):
                size += len(texts[end] or "")
                end += 1
            if size > PIECE_CHARS:
                for grams in self.pieces(texts[at]):
                    sizes[at] += len(grams)
                    self.add(out[at:end], grams, np.zeros(len(grams), np.int64))
            else:
                grams, doc = self.trigrams([t or "" for t in texts[at:end]])
                sizes[at:end] = np.bincount(doc, minlength=end - at)
                self.add(out[at:end], grams, doc)
            at = end
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms > 0, norms, 1)).astype(np.float32), sizes


def letters(dimensions: int) -> Letters:
    """One per Python worker."""
    return held(("letters", dimensions), lambda: Letters(dimensions))


def held_out(key: Column) -> Column:
    """Documents that teach nothing: crc32 of the key as text, remainder 2 by 4. A null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(df: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang", dimensions: int = DIMENSIONS, sample_rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Prototypes by language. What reaches the driver is one vector a language."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    rows = rows.where("label is not null").where(~held_out(F.col("key")))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    large = {r["label"]: r["n"] for r in counts if r["n"] > sample_rows}
    if large:
        draw = F.pmod(F.xxhash64(F.col("key"), F.col("text"), F.lit(3)), F.lit(1 << 30))
        # one literal: a local table would start Python workers of another kind, which stay for a while
        limits = json.dumps([{"label": k, "below": int(sample_rows / n * (1 << 30))} for k, n in large.items()])
        limits = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(limits), "array<struct<label:string,below:long>>")))
        rows = rows.join(F.broadcast(limits), "label", "left").where(F.col("below").isNull() | (draw < F.col("below"))).drop("below")

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for at in batches:
            vectors = np.round(letters(dimensions).bundles(at.text.tolist()).astype(float) * 2**32).astype(np.int64)  # whole numbers: any order adds up to the same
            for lang in at.label.unique():
                sums[lang] = sums.get(lang, 0) + vectors[(at.label == lang).values].sum(axis=0)
            del vectors
            give_back()
        for lang, v in sums.items():
            yield pd.DataFrame({"label": lang, "place": np.arange(dimensions), "value": v})

    sums = rows.mapInPandas(bundle, "label string, place int, value long").groupBy("label", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator():
        out.setdefault(r["label"], np.zeros(dimensions))[r["place"]] = float(r["value"])
    return {k: out[k] / np.linalg.norm(out[k]) for k in sorted(out) if np.linalg.norm(out[k])}


def classifier(prototypes: dict[str, np.ndarray]):
    """texts -> (languages, scores from 0 to 1)."""
    names = sorted(prototypes)
    if not names:
        return lambda texts: (np.array([UNKNOWN] * len(texts), object), np.zeros(len(texts)))
    matrix = np.stack([prototypes[n] for n in names])
    mean = matrix.mean(axis=0) if len(names) > 1 else np.zeros(matrix.shape[1])
    matrix = matrix - mean
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    source = letters(matrix.shape[1])

    def predict(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        vectors = source.bundles(texts)
        empty = ~vectors.any(axis=1)
        centred = vectors.astype(float) - mean
        cosines = np.round(centred @ matrix.T / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12), 6)
        best = cosines.argmax(axis=1)
        langs = np.array(names, object)[best]
        langs[empty] = UNKNOWN
        scores = np.clip((1 + cosines[np.arange(len(best)), best]) / 2, 0, 1)
        return langs, np.where(empty, 0.0, scores)

    return predict


def likeness(prototypes: dict[str, np.ndarray]):
    """texts -> likeness to the nearest language, from 0 to 1; -1 without letters or languages."""
    if not prototypes:
        return lambda texts: np.full(len(texts), -1.0)
    matrix = np.stack([prototypes[n] for n in sorted(prototypes)])
    source = letters(matrix.shape[1])

    def measure(texts: list[str | None]) -> np.ndarray:
        vectors, sizes = source.sized_bundles(texts)
        cosines = np.round((vectors.astype(float) @ matrix.T).max(axis=1), 6)
        likest = np.clip(cosines / np.sqrt(np.clip(sizes, 1, WHOLE_TRIGRAMS) / WHOLE_TRIGRAMS), 0, 1)
        return np.where(vectors.any(axis=1), likest, -1.0)

    return measure


def predict_table(df: DataFrame, prototypes: dict[str, np.ndarray], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = classifier(prototypes)
        for at in batches:
            langs, scores = predict(at.text.tolist())
            yield pd.DataFrame({"doc_id": at.doc_id, "held_out": at.held_out, "lang_pred": langs, "score": scores})

    rows = df.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInPandas(apply, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def filter_language(df: DataFrame, prototypes: dict[str, np.ndarray], *, text: str = "text", least: float) -> DataFrame:
    """The rows of ``df`` whose text has letters and a likeness of ``least`` or more to a language, columns as they are."""
    place = df.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = likeness(prototypes)
        for at in slices(batches, 2000, place):
            yield at.filter(pa.array(measure(at.column(place).to_pylist()) >= least))
            give_back()

    return df.mapInArrow(apply, df.schema)
