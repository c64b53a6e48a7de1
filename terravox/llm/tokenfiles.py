"""Flat token files: unsigned integers of all documents in a row, 64-bit document offsets beside them.

Layout of an output folder (any number of parts, numbered in document order):

* ``part-N.tokens``  ids of the part's documents, each followed by the end id; 16-bit if the vocabulary
  allows, else 32-bit, little-endian;
* ``part-N.offsets`` one unsigned 64-bit offset for each document, and one more for the end; counted
  from the part's first id;
* ``part-N.keys``    the documents' keys (64-bit, with a validity byte);
* ``manifest.json``  for each part its number of documents and ids and its base, which is the sum of the
  ids of all parts before it.  Base + offset is a document's place in the whole.

Each part is written by one task under a temporary name and then renamed, so a lost executor or a second
attempt leaves no half file; the same rows give the same bytes.

Nulls: a null text is the empty one, so that document has the end id alone; a null key sorts first.
Equal keys are ordered by text.  Very long texts are encoded whole.  An empty table gives an empty manifest.
Other columns of the input are left behind, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import held, local_path, slices, write_bytes
from .pieces import PieceCoder, splittable

KEYS = np.dtype([("key", "<i8"), ("valid", "u1")])


#: Pieces that may be encoded in one string: they begin with a blank and a character that is surely no white space,
#: and end with such a character.
JOINABLE = re.compile(r" (?:[!-~¡-ɏ]|[!-~¡-ɏ].*[!-~¡-ɏ])", re.DOTALL)
MEMO_ENTRIES = 900_000
BATCH_ROWS, BATCH_BYTES = 4000, 14 << 20


class LibraryEncoder:
    """The tokenizers library over whole texts, by distinct pieces (``pieces.py``) where the tokenizer allows that."""

    def __init__(self, path: str, specials_as_text: bool, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = specials_as_text
        alphabet = byte_alphabet()
        specials = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.widths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.widths[i] = len(token.encode()) if token in specials or not set(token) <= set(alphabet.values()) else len(token)
        with open(path, encoding="utf-8") as f:
            self.coder = PieceCoder(self.encode_new, kind, MEMO_ENTRIES) if splittable(json.load(f)) else None

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_new(self, pieces: list[str]) -> list[bytes]:
        """Pieces are joined to longer texts; a token's length in bytes tells where each piece's ids end."""
        joined = [p for p in pieces if JOINABLE.fullmatch(p)]
        width, out = int(self.kind[-1]), {}
        for a in range(0, len(joined), 20_000):  # the library's results are larger than their ids
            groups = [joined[b : b + 32] for b in range(a, min(len(joined), a + 20_000), 32)]
            for group, ids in zip(groups, self.library(["".join(g) for g in groups])):
                ids = np.asarray(ids, self.kind)
                ends = np.cumsum([len(p.encode()) for p in group])
                at = np.cumsum(self.widths[ids])
                cuts = np.searchsorted(at, ends)
                if len(at) and not np.array_equal(at[cuts], ends):
                    raise ValueError("a token crosses a border between pieces")
                cuts, flat = ((cuts + 1) * width).tolist(), ids.tobytes()
                out.update(zip(group, [flat[s:e] for s, e in zip([0, *cuts], cuts)]))
        alone = [p for p in pieces if p not in out]
        out.update((p, np.asarray(ids, self.kind).tobytes()) for p, ids in zip(alone, self.library(alone)))
        return [out[p] for p in pieces]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text's ended by the end id, and their numbers."""
        if self.coder is not None:
            return self.coder.encode(texts, end_id)
        ids = [np.asarray([*found, end_id], self.kind) for found in self.library(texts.to_pylist())]
        return np.concatenate([np.zeros(0, self.kind), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))


def encoder(path: str, specials_as_text: bool, kind: str) -> LibraryEncoder:
    """One per Python worker."""
    return held(("library", path, specials_as_text, kind), lambda: LibraryEncoder(path, specials_as_text, kind))


class OutFile:
    """Streams to a temporary name in the target's folder; ``commit`` renames it."""

    def __init__(self, uri: str):
        self.path = local_path(uri)
        if self.path is not None:
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
            self.f = open(self.part, "wb")  # noqa: SIM115
        else:
            from pyarrow import fs

            self.store, self.path = fs.FileSystem.from_uri(uri)
            self.store.create_dir(os.path.dirname(self.path), recursive=True)
            self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
            self.f = self.store.open_output_stream(self.part)
        self.write = self.f.write

    def commit(self) -> None:
        self.f.close()
        if hasattr(self, "store"):
            self.store.move(self.part, self.path)
        else:
            os.replace(self.part, self.path)


def mapped(uri: str, kind) -> np.ndarray:
    """The file as an array: memory-mapped where it lies in a POSIX folder."""
    if (path := local_path(uri)) is not None:
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def token_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_tokens(df: DataFrame, out: str, tokenizer: str, *, end_id: int, key: str = "doc_id", text: str = "text", ordered: bool = True, indexed: bool = True, specials_as_text: bool = False) -> dict:
    """Encode every whole text and write the folder described above; returns the manifest.

    ``ordered``: parts and documents ascend by key, by one range exchange of the texts.  Otherwise documents
    keep the place that the scan gives them and nothing is shuffled.  ``indexed=False`` writes tokens alone.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if ordered:
        tie = F.xxhash64("text")
        rows = rows.repartitionByRange(F.col("key").asc_nulls_first(), tie).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    from tokenizers import Tokenizer

    kind = token_type(max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files = TaskContext.get().partitionId(), {}
        coder, at, docs = encoder(tokenizer, specials_as_text, kind), 0, 0
        for batch in slices(batches, BATCH_ROWS, "text", BATCH_BYTES):
            if not files:
                files = {x: OutFile(f"{out}/part-{part:06d}.{x}") for x in (("tokens", "offsets", "keys") if indexed else ("tokens",))}
            ids, sizes = coder.encode(batch["text"], end_id)
            files["tokens"].write(ids.tobytes())
            if indexed:
                files["offsets"].write((at + np.cumsum(sizes) - sizes).astype("<u8").tobytes())
                keys = np.zeros(len(batch), KEYS)
                keys["valid"] = batch["key"].is_valid().to_numpy(zero_copy_only=False)
                keys["key"] = batch["key"].fill_null(0).to_numpy()
                files["keys"].write(keys.tobytes())
            at, docs = at + len(ids), docs + len(batch)
        if files:
            if indexed:
                files["offsets"].write(np.asarray([at], "<u8").tobytes())
            for f in files.values():
                f.commit()
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [docs], "tokens": [at]})

    parts = sorted(tuple(r) for r in rows.mapInArrow(write, "part long, docs long, tokens long").collect())  # one row a file
    base = np.concatenate([[0], np.cumsum([p[2] for p in parts])]).astype("int64").tolist()
    manifest = {"type": kind, "end_id": end_id, "parts": [{"part": p, "docs": d, "tokens": t, "base": b} for (p, d, t), b in zip(parts, base)]}
    write_bytes(f"{out}/manifest.json", json.dumps(manifest).encode())
    return manifest


def part_table(spark: SparkSession, manifest: dict) -> DataFrame:
    """The manifest's parts, each in a task of its own."""
    parts = [(p["part"], p["docs"], p["tokens"], p["base"]) for p in manifest["parts"]]
    return spark.createDataFrame(parts, "part long, docs long, tokens long, base long").repartition(max(1, len(parts)), "part")


def read_tokens(spark: SparkSession, out: str, manifest: dict) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the memory-mapped files.

    ids_crc32 is taken over the ids as little-endian unsigned 32-bit integers.
    """
    kind = manifest["type"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch.itertuples():
                tokens, offsets, keys = (mapped(f"{out}/part-{p.part:06d}.{x}", t) for x, t in (("tokens", kind), ("offsets", "<u8"), ("keys", KEYS)))
                for a in range(0, p.docs, 10_000):
                    b = min(p.docs, a + 10_000)
                    ends = offsets[a : b + 1].astype("int64")
                    crc = [zlib.crc32(tokens[s:e].astype("<u4").tobytes()) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
                    ids = pd.array(keys["key"][a:b].astype("int64"), "Int64")
                    ids[keys["valid"][a:b] == 0] = pd.NA
                    yield pd.DataFrame({"doc_id": ids, "start": p.base + ends[:-1], "n_tokens": np.diff(ends), "ids_crc32": np.asarray(crc, "int64")})

    return part_table(spark, manifest).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
