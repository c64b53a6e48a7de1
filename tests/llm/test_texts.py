import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terravox.llm import chattree, langid, quality
from terravox.llm.common import WORD
from terravox.llm.queries import TOKENIZER

from .fixtures import documents, empty, local

SF = "/root/testdata/sf0.01"


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def coverage(text, n):
    words = WORD.findall(text)
    seen, inside = set(), set()
    for i in range(len(words) - n + 1):
        gram = tuple(words[i : i + n])
        if gram in seen:
            inside |= set(range(i, i + n))
        seen.add(gram)
    return sum(len(words[i]) for i in inside) / max(1, sum(map(len, words)))


def verdict(text):
    if base_rules(text)[5]:
        return False
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += sum(map(len, WORD.findall(line))) if line in seen else 0
            seen.add(line)
    return dup / sum(map(len, WORD.findall(text))) <= quality.LINE_LIMIT and all(coverage(text, n) <= v for n, v in quality.COVERAGE_LIMITS.items())


def test_quality_equals_brute_force(spark):
    docs = documents(spark)
    draw = random.Random(3)
    pool = [f"w{i}" for i in range(30)]
    texts = []
    for k in range(60):
        line = " ".join(draw.choice(pool) for _ in range(12))
        texts.append("\n".join(line if draw.random() < k / 60 else " ".join(draw.choice(pool) for _ in range(12)) for _ in range(9)))
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    got = Counter((r["doc_id"], *r[1:8]) for r in quality.quality_table(both).collect())
    want = Counter((i, *base_rules(t), verdict(t or "")) for i, t in local(both, "doc_id", "text"))
    assert got == want
    assert any(not k[7] and not k[6] for k in want) and any(k[7] for k in want)  # the verdict goes beyond the base rules
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and kept.count() == sum(verdict(t or "") for (t,) in local(docs, "text"))
    assert quality.quality_table(empty(spark)).count() == quality.filter_quality(empty(spark)).count() == 0


def slow_bundle(text, letters):
    """A document's vector trigram by trigram."""
    out, padded = np.zeros(letters.one.shape[1]), [32]
    for c in text.lower():
        if c.isalpha():
            cp = ord(c)
            padded.append(cp if cp < 256 and cp not in (0xAA, 0xB5, 0xBA) else (cp * 2654435761 >> 11) % 256)
        elif padded[-1] != 32:
            padded.append(32)
    padded.append(32)
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        if (b, c) != (32, 32):
            out += np.roll(letters.one[a], 2).astype(int) * np.roll(letters.one[b], 1) * letters.one[c]
    return out


def test_bundles_equal_letter_by_letter():
    letters = langid.Letters(128)
    texts = ["hello world", "a", "Ünïcode wörds, twice: wörds", "日本語 text", "x" * 300, "ends in letters", "1 2 3", ""]
    got = letters.bundles(texts)
    for text, v in zip(texts, got):
        want = slow_bundle(text, letters)
        if any(c.isalpha() for c in text):
            assert np.allclose(v, want / np.linalg.norm(want), atol=1e-6)
        else:
            assert not v.any()
    together = letters.bundles(texts * 300)
    assert np.array_equal(together, np.concatenate([got] * 300))  # whatever else is in the batch
    order = letters.bundles(["abc", "cba"])
    assert abs(order[0] @ order[1]) < 0.8


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.predict_table(docs, langid.learn(docs)).collect()}
    truth = local(docs, "doc_id", "lang")
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in truth)
    held = [(i, lang) for i, lang in truth if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    sampled = langid.learn(docs, sample_rows=200)
    assert sum(r["lang_pred"] == lang for r, (_, lang) in zip([got[i] for i, _ in held], held)) and set(sampled) == {lang for _, lang in truth}
    shuffled = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert "xx" not in langid.learn(shuffled)


def test_long_texts_are_bundled_piece_by_piece(monkeypatch):
    letters, draw = langid.Letters(64), random.Random(6)
    for size in (1, 2, 3, 10, 57):
        monkeypatch.setattr(langid, "PIECE_CHARS", size)
        for _ in range(60):
            text = "".join(draw.choice("ab Éß1日. \n\0") for _ in range(draw.randint(0, 90)))
            want = slow_bundle(text, letters)
            got, sizes = letters.sized_bundles([text])
            assert np.allclose(got[0], want / max(np.linalg.norm(want), 1e-9), atol=1e-6), repr(text)


def test_languages_equal_brute_force(spark):
    """Prototypes, predictions and scores, letter by letter."""
    draw, rows = random.Random(8), []
    for i in range(60):
        lang = ("aa", "bb", None)[i % 3]
        rows.append((i, " ".join("".join(draw.choice("abcde" if i % 2 else "defgh") for _ in range(4)) for _ in range(i % 7 + 1)), lang))
    rows += [(61, None, "aa"), (62, "12", "bb"), (None, "abc abd", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    letters, sums, out = langid.Letters(langid.DIMENSIONS), {}, lambda key: key is not None and zlib.crc32(str(key).encode()) % 4 == 2
    one = lambda t: (lambda v: v / max(np.linalg.norm(v), 1e-9))(slow_bundle(t or "", letters))
    for key, text, lang in rows:
        if lang and not out(key):
            sums[lang] = sums.get(lang, 0) + one(text)
    want = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    got = langid.learn(docs)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-5) for k in want)
    mean = (want["aa"] + want["bb"]) / 2
    for r, (key, text, _) in zip(sorted(langid.predict_table(docs, got).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"])), rows):
        assert r["doc_id"] == key and r["held_out"] == out(key)
        v = one(text)
        if not v.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        cosines = {k: float((v - mean) @ (want[k] - mean) / np.linalg.norm(v - mean) / np.linalg.norm(want[k] - mean)) for k in want}
        assert abs(r["score"] - (1 + max(cosines.values())) / 2) < 1e-4
        assert r["lang_pred"] == max(cosines, key=cosines.get) or abs(cosines["aa"]) < 1e-4


def test_rare_languages_are_learned_beside_frequent_ones(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 500 == 0, "zyx wvu").otherwise("abc def").alias("text"), F.when(F.col("id") % 500 == 0, "rare").otherwise("often").alias("lang"))
    found = langid.learn(docs, sample_rows=20)
    assert set(found) == {"rare", "often"}


def test_language_of_awkward_rows(spark):
    docs = documents(spark)
    prototypes = langid.learn(docs)
    assert set(prototypes) == {"en", "fr"}
    got = langid.predict_table(docs.withColumn("doc_id", F.monotonically_increasing_id()), prototypes).collect()
    texts = dict(local(docs.withColumn("doc_id", F.monotonically_increasing_id()), "doc_id", "text"))
    for r in got:
        lettered = any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not lettered) and (lettered or r["score"] == 0)
    assert {r["lang_pred"] for r in langid.predict_table(docs, {}).collect()} == {"und"}
    kept = langid.filter_language(docs, prototypes, least=0.0)
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for (t,) in local(docs, "text"))
    assert langid.predict_table(empty(spark), prototypes).count() == 0 and langid.learn(empty(spark)) == {}


def conversations(spark):
    start = [("system", "be <turn:user>\nbrief\\"), ("user", "hello\n</turn>\n")]
    rows = []
    for c in range(6):
        own = start[: 1 + c % 2] + [("assistant", f"answer {c // 2} \\l <turn <tur \\\\n"), ("user", f"{c}"), ("assistant", f"é{c}</turn>")]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(own)]
    trap = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", trap), (-7, 1, "assistant", trap), (8, 0, None, None), (8, None, "assistant", None), (8, 1, "odd>\nrole", "x"), (8, 1, "odd>\nrole", "x"), (None, 0, "user", "no key"), (9, 0, "user", "long " * 40_000)]
    rows += [(10, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(100)] + [(11, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(90)]
    return spark.createDataFrame([(*r, "p", 0) for r in rows], "conv_id long, turn long, role string, text string, part string, start long")


def brute_digest(df):
    convs = {}
    for c, t, r, x in local(df, "conv_id", "turn", "role", "text"):
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        chars = sum(len(chattree.format_turn(r, x)[0]) for _, _, r, x in turns)
        out.append((c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    return sorted(out, key=repr)


def test_chat_digests_equal_brute_force(spark):
    df = conversations(spark)
    trees = chattree.build_trees(df, TOKENIZER)
    assert sorted(map(tuple, chattree.digests(trees, TOKENIZER).collect()), key=repr) == brute_digest(df)
    assert chattree.digests(chattree.build_trees(df.where("false"), TOKENIZER), TOKENIZER).count() == 0


def test_trees_share_and_attend(spark):
    rows = chattree.build_trees(conversations(spark).repartition(1), TOKENIZER).collect()
    parts, library = {}, Tokenizer.from_file(TOKENIZER)
    for r in rows:
        if not r["shared"]:
            parts.setdefault(r["part"], []).append(r)
    assert any(r["shared"] for r in rows)
    for part, own in parts.items():
        own.sort(key=lambda r: r["start"])
        flat = "".join(r["formatted"] for r in own)
        assert [r["end"] for r in own][:-1] == [r["start"] for r in own][1:] and own[-1]["end"] == len(flat)
        assert len({(r["formatted"], r["position"], str(r["attends"])) for r in own}) == len(own)  # nothing is emitted twice
        for r in own:
            before = "".join(flat[a["start"] : a["end"]] for a in r["attends"])
            assert len(before) == r["position"]
            mine = sorted((x for x in rows if x["part"] == part and x["conv_id"] == r["conv_id"] and x["ordinal"] < r["ordinal"]), key=lambda x: x["ordinal"])
            assert before == "".join(flat[x["start"] : x["end"]] for x in mine)
        # the same in tokens
        ids = [i for r in own for i in r["ids"]]
        assert [r["token_end"] for r in own][:-1] == [r["token_start"] for r in own][1:] and own[-1]["token_end"] == len(ids)
        for r in own:
            seen = [i for a in r["token_attends"] for i in ids[a["start"] : a["end"]]]
            assert len(seen) == r["token_position"] and library.decode(seen, skip_special_tokens=False) == "".join(flat[a["start"] : a["end"]] for a in r["attends"])
            assert library.decode(r["ids"], skip_special_tokens=False) == r["formatted"]
            assert library.decode(ids[r["token_text_start"] : r["token_text_end"]], skip_special_tokens=False) == flat[r["text_start"] : r["text_end"]]


def test_escape_is_reversible():
    draw = random.Random(0)
    for _ in range(3000):
        text = "".join(draw.choice(["\\", "<turn", "</turn", ">\n", "l", "g", "n", "<", "x", "\n"]) for _ in range(draw.randint(0, 8)))
        formatted, head = chattree.format_turn(text, text)
        assert chattree.parse_turn(formatted) == (text, text)
        assert chattree.unescape(formatted[head : -len(chattree.CLOSE)]) == text and formatted.count(chattree.CLOSE) == 1
