"""Byte-level BPE by a priority queue of merge ranks over a doubly linked symbol list, and its inverse.

``Bpe`` is built from the vocabulary file of a public tokenizer (a parameter; never trained here) and
yields the ids of that tokenizer without template tokens, truncation or padding.  An added token's
string inside a text becomes that token's id.  A tokenizer of another kind (with a normalizer, another splitting
rule, marks at word ends) is an error when it is loaded.

Nulls: a null text encodes as the empty one (no ids), a null key stays.  Very long texts are handled piece by piece.
Repeated rows and equal keys give repeated results; of pairs that tie in rank the leftmost merges first.  An empty table
gives an empty result.  Other columns are left behind, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, held, slices
from .pieces import PieceCoder, splittable


#: The public pattern that splits text before the merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: What bounds a worker's memory, with ``give_back``.
MEMO_ENTRIES = 200_000
BATCH_ROWS, BATCH_BYTES = 4000, 2 << 20


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next free letter from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not splittable(spec):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        alphabet = byte_alphabet()
        letter_to_byte = {c: b for b, c in alphabet.items()}
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        raw = lambda s: bytes(letter_to_byte[c] for c in s)
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.strings: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = raw(token) if all(c in letter_to_byte for c in token) else token.encode()
        for token, i in self.added.items():
            self.strings[i] = token.encode()
        self.byte_id = [vocab.get(alphabet[b], -1) for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.split = regex.compile(SPLIT)
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.coder = PieceCoder(lambda pieces: [self.piece(p) for p in pieces], "<u4", MEMO_ENTRIES)

    def merge(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        ids = [i for b in word.encode("utf-8") if (i := self.byte_id[b]) >= 0]
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m[0], i, a, b, m[1]) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := merges.get((a, b)))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:  # stale: one of the two symbols has since been merged
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(queue, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(queue, (m[0], h, ids[h], new, m[1]))
        return [i for i in ids if i >= 0]

    def piece(self, text: str) -> bytes:
        out: list[int] = []
        for part in self.added_split.split(text) if self.added_split else [text]:
            if part in self.added:
                out.append(self.added[part])
                continue
            for word in self.split.findall(part):
                out += self.merge(word)
        return array("I", out).tobytes() if LITTLE else np.asarray(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.coder.encode(pa.array([text]))[0].tobytes()

    def decode(self, ids) -> str:
        """Vocabulary strings of ids in a row; bytes that are not UTF-8 become U+FFFD. Unknown ids vanish."""
        strings, n = self.strings, len(self.strings)
        return b"".join([strings[i] for i in ids if i < n]).decode("utf-8", "replace")


def loaded(path: str) -> Bpe:
    """One per Python worker."""
    return held(("bpe", path), lambda: Bpe(path))


def with_columns_safe(df: DataFrame, text: str, key: str) -> DataFrame:
    return df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def encode_table(df: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): every whole text encoded. No shuffle; other columns are left behind."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for at in slices(batches, BATCH_ROWS, "text", BATCH_BYTES):
            ids, sizes = bpe.coder.encode(at["text"])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([at["doc_id"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    rows = with_columns_safe(df, text, key)
    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_table(df: DataFrame, tokenizer: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text): ids joined back to text; null ids give the empty text."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(tokenizer)
        for at in batches:
            yield pd.DataFrame({"doc_id": at.doc_id, "text": [bpe.decode([] if x is None else x) for x in at.ids]})

    rows = df.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids"))
    return rows.mapInPandas(decode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded from the ids.

    One pass without a shuffle.  ``with_ids`` adds the ids themselves, as array<int>; else they never leave the worker.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for at in slices(batches, BATCH_ROWS, "text", BATCH_BYTES):
            ids, sizes = bpe.coder.encode(at["text"])
            ends = np.cumsum(sizes).tolist()
            coded = [ids[a:b] for a, b in zip([0, *ends], ends)]
            columns = {
                "doc_id": at["doc_id"],
                "n_tokens": pa.array(sizes),
                "ids_sha256": pa.array([hashlib.sha256(c.tobytes()).hexdigest() for c in coded], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(c.tolist()).encode()).hexdigest() for c in coded], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)
            del ids, coded, columns
            give_back()

    rows = with_columns_safe(df, text, key)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
