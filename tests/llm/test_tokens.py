import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from terravox.llm import bpe, tokencount, tokenfiles

from .fixtures import documents, empty, local

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [*"ab 1'\n\té.,s ", "<|endoftext|>", "'s", " ", "  ", " ", "日本", "😀", "\u0085", "\x1c", "\x00", "\x01", "\xa0", "word, ", "end. "]


def odd_texts(n=3000):
    draw = random.Random(1)
    return ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_own_merges_equal_the_library(library):
    own, texts = bpe.Bpe(PATH), odd_texts()
    ids, sizes = own.coder.encode(pa.array(texts))
    for text, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        want = library.encode(text, add_special_tokens=False).ids
        assert got.tolist() == want, repr(text)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)
    assert own.decode([0, 10**6, 255]) == library.decode([0, 255], skip_special_tokens=False)  # broken UTF-8, unknown id


def test_every_code_point(library):
    own = bpe.Bpe(PATH)
    texts = [f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}! {chr(c)}  {chr(c)} " for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    ids, sizes = own.coder.encode(pa.array(texts))
    want = library.encode_batch(texts, add_special_tokens=False)
    for got, e in zip(np.split(ids, np.cumsum(sizes)[:-1]), want):
        assert got.tolist() == e.ids


def test_pieces_through_the_library(library):
    texts = odd_texts()
    for special in (False, True):
        library.encode_special_tokens = special
        ids, sizes = tokenfiles.LibraryEncoder(PATH, special, "<u2").encode(pa.array(texts), 2)
        for text, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
            assert got.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], repr(text)
    library.encode_special_tokens = False


def test_memo_overflow_changes_nothing(library):
    coder = tokenfiles.LibraryEncoder(PATH, False, "<u4")
    coder.coder.entries = 3
    for text in ["one two three four five six", "two three, seven. eight nine"] * 3:
        assert coder.encode(pa.array([text]), 2)[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_round_trip_over_documents(spark, library):
    docs = documents(spark)
    want = []
    for i, text in local(docs, "doc_id", "text"):
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert Counter(map(tuple, bpe.round_trip(docs, PATH).collect())) == Counter(want)
    assert bpe.round_trip(empty(spark), PATH).count() == 0
    coded = bpe.encode_table(docs, PATH)
    back = Counter((r[0], r[1]) for r in bpe.decode_table(coded, PATH).collect())
    assert back == Counter((i, t or "") for i, t in local(docs, "doc_id", "text"))
    assert bpe.decode_table(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first()["text"] == ""


def test_token_files(spark, tmp_path, library):
    docs, out = documents(spark), f"file://{tmp_path}/t"
    manifest = tokenfiles.write_tokens(docs, out, PATH, end_id=2)
    got = tokenfiles.read_tokens(spark, out, manifest).collect()
    rows = sorted(local(docs, "doc_id", "text"), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert manifest["type"] == "<u2" and [p["base"] for p in manifest["parts"]] == np.cumsum([0, *[p["tokens"] for p in manifest["parts"]]])[:-1].tolist()
    none = tokenfiles.write_tokens(empty(spark), f"{out}-none", PATH, end_id=2)
    assert none["parts"] == [] and tokenfiles.read_tokens(spark, f"{out}-none", none).count() == 0
    assert tokenfiles.token_type(1 << 16) == "<u2" and tokenfiles.token_type((1 << 16) + 1) == "<u4"


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_separator_scan(spark, tmp_path, block):
    draw = random.Random(block)
    parts = [[draw.choice([9, 9, 5, 6]) for _ in range(n)] for n in (11, 0, 1, 17)] + [[5, 5, 5]]
    files = []
    for i, p in enumerate(parts):
        (tmp_path / f"{i}").write_bytes(np.array(p, "<u2").tobytes())
        files.append((str(tmp_path / f"{i}"), len(p)))
    flat, want, start = [x for p in parts for x in p], [], 0
    for at, x in enumerate(flat):
        if x == 9:
            want.append((len(want), start, at + 1 - start, True))
            start = at + 1
    if start < len(flat):
        want.append((len(want), start, len(flat) - start, False))
    got = tokencount.scan_documents(spark, files, "<u2", 9, block_tokens=block)
    assert sorted(map(tuple, got.collect())) == want
    assert tokencount.scan_documents(spark, [], "<u2", 9).count() == 0


def test_counts_of_written_files(spark, tmp_path, library):
    docs, out = documents(spark), f"file://{tmp_path}/flat"
    manifest = tokenfiles.write_tokens(docs, out, PATH, end_id=50256, ordered=False, indexed=False, specials_as_text=True)
    files = [(f"{out}/part-{p['part']:06d}.tokens", p["tokens"]) for p in manifest["parts"]]
    got = tokencount.scan_documents(spark, files, manifest["type"], 50256, block_tokens=501).collect()
    library.encode_special_tokens = True
    want = Counter(1 + len(library.encode(t or "", add_special_tokens=False).ids) for (t,) in local(docs, "text"))
    library.encode_special_tokens = False
    assert Counter(r["n_tokens"] for r in got) == want and all(r["ended"] for r in got)


def test_other_tokenizers_get_whole_texts(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello  world, it's Fine", "", "ONE\ntwo <|endoftext|>", "a " * 50]
    library = Tokenizer.from_file(path)
    ids, sizes = tokenfiles.LibraryEncoder(path, False, "<u2").encode(pa.array(texts), 2)
    for text, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        assert got.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Bpe(path)
