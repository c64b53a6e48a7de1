"""Quality rules from repetition coverage.

Words, lines and rolling hashes of word n-grams are handled with numpy, one document at a time.  For each
n-gram length the coverage is the share of word characters inside n-grams equal to an earlier one; for lines,
the share of word characters in lines equal to an earlier line.

Base figures: words are runs of ``[^\\x20\\x09-\\x0D]``; n_symbols counts ``#*$%&|<>``; n_dup_lines counts
lines (split at \\n) that hold a word and equal an earlier line; n_repeat_words counts words in 3-word
windows that occur twice or more, the first included.  A document fails the base rules with under 50 words
or more than half of its words in such windows; one that passes them is kept unless a coverage exceeds
its limit.

Nulls: a null text is one without words; it fails.  Very long texts are handled whole.  Repeated rows give
repeated results.  An empty table gives an empty result.  Other columns are left behind or, in ``filter_quality``,
kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, give_back, held, slices

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Largest share of word characters inside later copies of n-grams of so many words, and of lines. The base rules alone
#: hold a passage that stands twice to some 0.25; in sf0.1 no document labelled good that passes them exceeds 0.14.
COVERAGE_LIMITS = {5: 0.19, 6: 0.18, 8: 0.17, 10: 0.15}
LINE_LIMIT = 0.20

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _repeated(hashes: np.ndarray, first: bool) -> np.ndarray:
    """Which entries occur at least twice: with the first occurrence, or only those equal to an earlier one."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = True
    if first:
        out[order[:-1][same]] = True
    return out


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all windows of n ids."""
    mixed = (ids + np.uint64(1)) * _BASE
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for i in range(n):
        out = out * np.uint64(0x100000001B3) + mixed[i : len(mixed) - n + 1 + i]
    return out ^ (out >> np.uint64(32))


def covered(ids: np.ndarray, n: int, first: bool) -> np.ndarray | None:
    """Which words lie in an n-gram that occurs at least twice; None if there is no such n-gram.

    ``first``: the first occurrence counts too.
    """
    if len(ids) <= n:
        return None
    twice = _repeated(rolling(ids, n), first)
    if not twice.any():
        return None
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None, limits: dict[int, float] = COVERAGE_LIMITS, line_limit: float = LINE_LIMIT) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, line_coverage, ngram_coverage)."""
    text = text or ""
    words = WORD.findall(text)
    n_words = len(words)
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, n_words)
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    chars = int(lengths.sum())
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup_lines = dup_chars = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
            dup_chars += sum(map(len, WORD.findall(line)))
        elif WORD.search(line):
            seen.add(line)
    three = covered(ids, 3, True)
    repeat_words = 0 if three is None else int(three.sum())
    failed = n_words < MIN_WORDS or 100 * repeat_words > MAX_REPEAT_PERCENT * n_words
    worst, kept = 0.0, not failed
    line_share = dup_chars / chars if chars else 0.0
    kept &= line_share <= line_limit
    if three is not None:
        for n in sorted(limits):
            inside = covered(ids, n, False)
            if inside is None:  # longer n-grams don't repeat either
                break
            share = int(lengths[inside].sum()) / chars
            worst = max(worst, share)
            kept &= share <= limits[n]
    return n_words, chars, symbols, dup_lines, repeat_words, failed, bool(kept), line_share, worst


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_coverage double, ngram_coverage double"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def quality_table(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, figures, base_failed, kept, line_coverage, ngram_coverage) of every row, without a shuffle."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for at in batches:
            out = pd.DataFrame([measure(t) for t in at.text], columns=NAMES)
            out.insert(0, "doc_id", at.doc_id.values)
            yield out

    rows = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(apply, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def filter_quality(df: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns as they are."""
    place = df.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality")
        for at in slices(batches, 2000, place):
            yield at.filter(pa.array([measure(t)[6] for t in at.column(place).to_pylist()], pa.bool_()))
            give_back()

    return df.mapInArrow(apply, df.schema)
