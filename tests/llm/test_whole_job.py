"""Cases in which an operator once did less than its whole job."""

import os
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from terravox.llm import backoff, chattree, dartminhash, langid, mixing, quality
from terravox.llm import queries as Q

from .fixtures import local
from .test_search_and_mix import brute_backoff

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_language_stage_rejects_what_is_in_no_learned_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null")
    draw = random.Random(4)
    garbage = [" ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(200)) for _ in range(20)]
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(garbage)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").union(more)
    kept = {i for (i,) in local(corpus_pipeline.language_id(spark, both, SF), "doc_id")}
    assert all(i >= 0 for i in kept)
    clean = [i for i, held in docs.select("doc_id", langid.held_out(docs.doc_id)).collect() if held]
    assert np.mean([i in kept for i in clean]) > 0.99
    learned = langid.learn(docs.where("lang <> 'fr'"))
    left = langid.filter_language(docs.where("lang = 'fr'"), learned, least=corpus_pipeline.LEAST_LANGUAGE_SCORE).count()
    assert left < 0.1 * docs.where("lang = 'fr'").count()


def test_a_passage_repeated_once_decides_beyond_the_base_rules():
    for passage, words in ((80, 400), (95, 400), (96, 400)):  # 40, 47.5 and 48 percent of the words
        twice = " ".join(f"p{i:03}" for i in range(passage))
        text = " ".join([twice, *(f"w{i:03}" for i in range(words - 2 * passage)), twice])
        base_failed, kept = quality.measure(text)[5:7]
        assert not base_failed and not kept
    line = " ".join(f"p{i:03}" for i in range(30))  # a clean document's opening and closing line
    assert quality.measure(" ".join([line, *(f"w{i:03}" for i in range(190)), line]))[6]


def test_chat_trees_share_turns_beyond_any_number(spark):
    say = lambda branch, n: [(t, ("user", "assistant")[t % 2], f"turn {t}" if t < 16 else f"{branch} {t}") for t in range(n)]
    talks = {10: say("a", 20), 11: say("b", 20), 12: [*say("a", 20), (20, "user", "more")], 13: say("b", 24), 14: say("a", 19)}
    rows = [(c, *turn) for c, talk in talks.items() for turn in talk]
    trees = chattree.build_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), Q.TOKENIZER).collect()
    emitted = [(r["part"], r["formatted"], r["position"], str(r["attends"])) for r in trees if not r["shared"]]
    paths = {(r["part"], *(x for x in talks[r["conv_id"]][: r["ordinal"] + 1])) for r in trees}
    assert len(trees) == len(rows) and len(emitted) == len(paths)  # each path once in a range


def test_the_query_scores_trigrams(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: round(r["log_score"], 3) for r in backoff.backoff_scores(docs, order=3).collect()}
    got = {r["doc_id"]: r["log_score"] for r in Q.queries()["op4_backoff_scores"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 0.002 for i in want)


def test_rows_repeated_in_full_are_scored_as_often_as_they_stand(spark):
    rows = [(1, "a b c d")] * 5 + [(2, "a b c e"), (None, "a b"), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] or 0, r["n_words"], round(r["log_score"], 9)) for r in backoff.backoff_scores(df).collect())
    want = [(k or 0, n, round(s, 9)) for (k, _), (n, s) in zip(rows, brute_backoff([t for _, t in rows], 3, 0.4, True))]
    assert got == sorted(want)


def test_equal_rows_at_the_threshold_are_taken_in_part(spark):
    """100 equal rows of 10 words and a target of 1,714: the second taking ends within them."""
    rows = [(1, "w " * 10, "a")] * 100 + [(i + 2, "v " * 10, "b") for i in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = {}
    for r in mixing.mix_table(docs).collect():
        total, target = got.get(r["doc_id"] == 1, (0, 0.0))
        got[r["doc_id"] == 1] = (total + r["taken"], r["target"])
    assert all(abs(total - target) <= 5 for total, target in got.values()) and 1000 < got[True][0] < 2000
    taken = Counter("b" if i > 1 else "a" for (i,) in local(mixing.mix_rows(docs), "doc_id"))
    assert {k: 10 * n for k, n in taken.items()} == {"a": got[True][0], "b": got[False][0]}


def test_clashing_columns_stay_as_they_are(spark):
    clash = ["source_key", "hash", "whole", "threshold", "tie", "copy", "second_hash", "second", "__hash", "__whole", "__own", "content", "first_key", "copies", "worded", "own_content", "WORDED", "grp", "times", "part"]
    clash = [c for i, c in enumerate(clash) if c.lower() not in [x.lower() for x in clash[:i]]]
    rows = [(i, " ".join(f"w{(i // 2) * 7 + k}" for k in range(60)), "ab"[i % 2], "en", *[f"{c}{i}" for c in clash]) for i in range(30)] + [(3, "same " * 3, "a", "en", *clash)] * 4
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", "lang", *clash])
    before = {tuple(r) for r in docs.collect()}
    for out in (mixing.mix_rows(docs), dartminhash.keep_one(docs), quality.filter_quality(docs), langid.filter_language(docs, langid.learn(docs), least=0.0)):
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= before
    assert dartminhash.keep_one(docs).count() == 16
    for table in (mixing.mix_table(docs), dartminhash.class_table(docs), quality.quality_table(docs), backoff.backoff_scores(docs)):
        assert table.count() == len(rows)


def test_large_bands_are_split(spark, monkeypatch):
    draw = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(60):
        own = list(base)
        for i in draw.sample(range(100), 2):
            own[i] = f"x{draw.random()}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, dartminhash.class_table(docs).collect()))
    monkeypatch.setattr(dartminhash, "SHARE_ROWS", 7)
    assert sorted(map(tuple, dartminhash.class_table(docs, sketch=False).collect())) == want
