"""Small documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, content string, node long, hash long, size long"
WORDS = [f"{a}{b}" for a in ("th", "an", "er", "ou", "st", "qu") for b in ("e", "ing", "on", "ly", "ed", "al")]


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def documents(spark):
    draw = random.Random(5)
    texts = [sentence(draw, 120) for _ in range(12)]
    near = texts[0].split(" ")
    near[60] = "changed"
    far = texts[1].split(" ")
    for i in range(0, 120, 6):
        far[i] = "other"
    texts += [" ".join(near), " ".join(far), texts[2], texts[2], None, None, "", " \t\n", "one two three", "one two three", sentence(draw, 30_000)]
    texts += ["the same line of words here again\n" * 20, "#*$ | <> & %\n\n", "日本語 テキスト", "x" * 5000, texts[3].upper()]
    langs = ["en", "fr", None]
    sources = ["b", "a", None, "ä", "b"]
    rows = [(i, t, langs[i % 3], sources[i % 5], len(t or ""), "k", "c", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[5], "en", "a", 1, "k", "c", 1, 2, 3), (None, None, None, None, None, None, None, None, None, None), (7, "another text under a used id", "en", "b", 5, "k", "c", 1, 2, 3)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return documents(spark).where(F.lit(False))


def local(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
