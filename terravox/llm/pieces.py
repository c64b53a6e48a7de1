"""Encoding texts piece by piece: each distinct piece of a batch is encoded once.

A text is cut at blanks between two characters that are surely no white space: there a token starts whatever
stands around it, so the ids of the pieces in a row are the ids of the text.  A full stop or comma after a letter or
digit starts a token too, and is taken off a piece's end.  Arrow splits and numbers the pieces of a batch; only
distinct ones reach Python, and those met before come from a memo of bounded size.

That holds for the tokenizers that ``splittable`` admits, which is checked when one is loaded.

Texts are not null here; an empty one has no ids, a very long one is cut like any other, repeated ones share their pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Where a text may be cut.
CUT = re.compile(r"(?<=[!-~¡-ɏ])(?= [!-~¡-ɏ])")
#: Texts with a blank at which they may not be cut, or with the mark that stands for a text's start.
UNEVEN = r"(^|[^!-~\x{a1}-\x{24f}]) | ([^!-~\x{a1}-\x{24f}]|$)|\x01"
START = "\x01"
ENDINGS = (".", ",")
#: Longer pieces are not remembered.
LONGEST = 64


def splittable(spec: dict) -> bool:
    """Whether ids of pieces in a row are surely the ids of the text: byte-level pairs with the plain splitting rule, no
    normalizer, no marks at word ends, no chance, and added tokens that neither hold a blank nor reach beyond their string."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
        return False
    added = spec.get("added_tokens", [])
    return all(not t.get(x) for t in added for x in ("lstrip", "rstrip", "single_word")) and all(t["content"] and " " not in t["content"] and START not in t["content"] for t in added)


class PieceCoder:
    """``encode_new`` maps distinct pieces that the memo lacks to the bytes of their ids, of integer type ``kind``."""

    def __init__(self, encode_new: Callable[[list[str]], list[bytes]], kind: str, entries: int):
        self.encode_new, self.kind, self.entries, self.memo = encode_new, kind, entries, {}
        self.endings = dict(zip(ENDINGS, encode_new(list(ENDINGS))))

    def distinct(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, which lack their leading blank, or have the mark of a start instead."""
        ends = [p[-1] if p[-1:] in ENDINGS and p[-2:-1].isalnum() else "" for p in pieces]
        bodies = [p[:-1] if e else p for p, e in zip(pieces, ends)]
        found = list(map(self.memo.get, bodies))
        if len(self.memo) > self.entries:  # begin again with what this batch has met before
            self.memo = {b: ids for b, ids in zip(bodies, found) if ids is not None}
        lacking = list({b for b, ids in zip(bodies, found) if ids is None})
        new = dict(zip(lacking, self.encode_new([b[1:] if b[:1] == START else " " + b for b in lacking])))
        self.memo.update((b, ids) for b, ids in new.items() if len(b) <= LONGEST)
        tail = self.endings | {"": b""}
        return [(new[b] if ids is None else ids) + tail[e] for b, ids, e in zip(bodies, found, ends)]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (not null) in a row, and the number of each text's; ``end_id`` ends every text."""
        even = pc.invert(pc.match_substring_regex(texts, UNEVEN)).to_numpy(zero_copy_only=False)
        if even.all():
            return self._split(texts, end_id)
        ids, sizes = self._split(texts.filter(pa.array(even)), end_id)
        cut = [CUT.split(t) for t in texts.filter(pa.array(~even)).to_pylist()]
        cut = [[START + c[0], *[p[1:] for p in c[1:]]] for c in cut]
        names = list({p for c in cut for p in c})
        known = dict(zip(names, self.distinct(names)))
        end = b"" if end_id is None else np.asarray([end_id], self.kind).tobytes()
        own = [np.frombuffer(b"".join([known[p] for p in c]) + end, self.kind) for c in cut]
        parts: list = [None] * len(texts)
        for i, part in zip(np.flatnonzero(even).tolist(), np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []):
            parts[i] = part
        for i, part in zip(np.flatnonzero(~even).tolist(), own):
            parts[i] = part
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _split(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        lists = pc.split_pattern(pc.binary_join_element_wise(START, texts, ""), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        found = self.distinct(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy()
        if end_id is not None:
            found.append(np.asarray([end_id], self.kind).tobytes())
            at = np.insert(at, offsets[1:], len(found) - 1)
            offsets = offsets + np.arange(len(offsets))
        flat = np.frombuffer(b"".join(found), self.kind)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // int(self.kind[-1])
        starts, own = (np.cumsum(lengths) - lengths)[at], lengths[at]
        ends = np.concatenate([[0], np.cumsum(own)])
        ids = flat[np.repeat(starts - ends[:-1], own) + np.arange(ends[-1])]
        return ids, np.diff(ends[offsets])
