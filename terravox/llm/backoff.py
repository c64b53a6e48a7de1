"""Stupid-backoff scores from n-gram counts of the corpus itself.

Three tables and two joins.  The documents' n-grams of one to ``order`` words are exploded as 64-bit hashes with
counts and partitioned by hash (``exploded``); the count table adds them up by n-gram, hash partition by hash
partition, and is joined there to what was exploded (``counted``); the joined counts go back to their documents, where
the scores are summed (``summed``).  A row of these tables is a packed block: what one group of documents has in
one hash partition, so that an n-gram costs some six bytes of exchange in place of the twenty of a plain row (README
has the figures).  A frequent n-gram is one entry a group, added up before the exchange, so it makes no partition hot.
Only blocks that hold an n-gram exist: their number never exceeds that of the n-grams.

Score of a word w after the history h of order - 1 words (fewer at the start of a document): c(hw) / c(h) if hw
was seen, else ``backoff`` times the score after the shorter history; a word alone scores c(w) / N.  By default
the document's own counts are taken off all counts (``leave_out``), since every n-gram has been seen in its own
document; a word seen nowhere else then scores ``backoff`` times 1 / (N + 1).

Words are runs of ``[^\\x20\\x09-\\x0D]`` as they are.

Nulls, and texts without words: n_words 0, log_score 0, null mean.  A null key is kept as it is; equal keys and ties
are scored row by row.  Rows repeated in full are put together, batch by batch, before they are grouped, and count and
come out as often as they stand.  Very long texts are scored whole; one lies in one group.  An empty table
gives an empty result; other columns are left behind, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dartminhash import mix

ORDER, BACKOFF = 3, 0.4
#: Code points of text in a group of documents, and n-grams in a hash partition, on average.
GROUP_CHARS, PART_GRAMS = 7_000_000, 1_500_000

_M = np.uint64(0x9E3779B97F4A7C15)


def plain(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column if isinstance(column, pa.Array) else pa.array([], column.type)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (none null) in a row, and the number of each text's words."""
    lists = pc.ascii_split_whitespace(texts)  # white space as in the word pattern
    if not len(lists):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(ends[0], ends[-1] - ends[0])
    whole = pc.not_equal(pc.binary_length(values), 0)
    before = np.concatenate([[0], np.cumsum(whole.to_numpy(zero_copy_only=False))])
    sizes = np.diff(before[ends - ends[0]])
    coded = values.filter(whole).dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    return hashes[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64), sizes


class Grams:
    """The n-grams of some texts, each of which stands ``times`` times."""

    def __init__(self, texts: pa.Array, times: np.ndarray, order: int):
        flat, self.sizes = words_of(texts)
        self.order, self.doc = order, np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(flat)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        mixed, lengths = mix(flat + _M), []
        for n in range(1, order + 1):
            h = np.full(len(flat), np.uint64(n))
            for i in range(n - 1, -1, -1):
                h = mix(h * _M + np.roll(mixed, i))
            h[h == 0] = 1
            h[self.place < n - 1] = 0  # the document is too short here
            lengths.append(h)
        every = np.concatenate(lengths)
        known, inverse = np.unique(every, return_inverse=True)
        counts = np.bincount(inverse, weights=np.tile(times[self.doc], order), minlength=len(known)).astype(np.int64)
        skip = int(len(known) > 0 and known[0] == 0)
        #: Distinct n-grams in order, how often they stand here, and of each length the number of the n-gram that ends at each word (-1: none).
        self.known, self.counts, self.at = known[skip:], counts[skip:], (inverse - skip).reshape(order, -1)

    def own(self, n: int) -> np.ndarray:
        """How often the n-gram that ends at each word stands in its own document."""
        at, out = self.at[n], np.ones(len(self.doc), np.int64)
        some = np.flatnonzero((at >= 0) & (self.counts[at] > 1)) if len(self.counts) else np.zeros(0, np.int64)
        _, inverse, counts = np.unique(at[some] * np.int64(max(1, len(self.sizes))) + self.doc[some], return_inverse=True, return_counts=True)
        out[some] = counts[inverse]
        return out

    def scores(self, others: np.ndarray, backoff: float, corpus_words: int, leave_out: bool) -> np.ndarray:
        """The sum of log scores of each text; ``others`` are the counts of ``known`` in all other groups."""
        totals, counts = self.counts + others, []
        for n in range(self.order):
            c = totals[self.at[n]] if len(totals) else np.zeros(len(self.doc), np.int64)
            counts.append(np.where(self.at[n] >= 0, c - self.own(n) if leave_out else c, 0))
        n = np.maximum(corpus_words - (self.sizes[self.doc] if leave_out else 0), 0)
        score = np.where(counts[0] > 0, counts[0] / np.maximum(n, 1), backoff / (n + 1))
        for length in range(1, self.order):
            history, inside = np.roll(counts[length - 1], 1), self.place >= length
            seen = inside & (counts[length] > 0) & (history > 0)
            score = np.where(seen, counts[length] / np.maximum(history, 1), np.where(inside, backoff * score, score))
        return np.bincount(self.doc, weights=np.log(score), minlength=len(self.sizes)).astype(float)


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, most of which hold zeros, compressed."""
    return zlib.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def unsqueezed(block: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(block), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<i8")


def packed_hashes(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending hashes as differences, without loss: the five low bytes as they are, the three high ones squeezed."""
    planes = np.diff(hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return planes[:, :5].tobytes(), zlib.compress(planes[:, 5:].T.tobytes(), 1)


def unpacked_hashes(low: bytes, high: bytes) -> np.ndarray:
    planes = np.zeros((len(low) // 5, 8), np.uint8)
    planes[:, :5] = np.frombuffer(low, np.uint8).reshape(-1, 5)
    planes[:, 5:] = np.frombuffer(zlib.decompress(high), np.uint8).reshape(3, -1).T
    return np.cumsum(planes.reshape(-1).view("<u8"), dtype=np.uint64)


def corpus_size(rows: DataFrame) -> tuple[int, int]:
    """Code points and words of all texts."""

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at in batches:
            yield pa.RecordBatch.from_pydict({"chars": [pc.sum(pc.utf8_length(at["text"])).as_py() or 0], "words": [int(words_in(at["text"]))]})

    got = rows.select("text").mapInArrow(size, "chars long, words long").agg(F.sum("chars").alias("chars"), F.sum("words").alias("words")).first()
    return int(got["chars"] or 0), int(got["words"] or 0)


def words_in(texts: pa.Array) -> int:
    return pc.sum(pc.greater(pc.binary_length(pc.ascii_split_whitespace(texts).flatten()), 0)).as_py() or 0


def grouped(rows: DataFrame, groups: int) -> DataFrame:
    """(grp, doc_id, times, sizes, texts): blocks of documents, grouped by a hash of key and text; rows repeated in full
    are put together in each batch, and a block's texts are compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at in batches:
            if not len(at):
                continue
            own = pa.Table.from_batches([at]).group_by(["grp", "doc_id", "text"]).aggregate([([], "count_all")]).sort_by("grp")
            grp, keys, texts, times = (plain(own[c]) for c in ("grp", "doc_id", "text", "count_all"))
            sizes = pc.binary_length(texts)
            first = np.flatnonzero(np.diff(grp.to_numpy(), prepend=-1)).astype(np.int32)
            cuts = pa.array([*first.tolist(), len(own)], pa.int32())
            blobs = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(own)]):
                blobs.append(pa.compress("".join(texts.slice(a, b - a).to_pylist()).encode(), "zstd", asbytes=True))
            lists = [pa.ListArray.from_arrays(cuts, v) for v in (keys, times, sizes.cast(pa.int32()))]
            yield pa.RecordBatch.from_arrays([grp.take(pa.array(first)), *lists, pa.array(blobs, pa.binary())], ["grp", "doc_id", "times", "sizes", "texts"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    named = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("grp"), "doc_id", "text")
    return named.mapInArrow(pack, f"grp int, doc_id array<{kind}>, times array<long>, sizes array<int>, texts binary")


def unpacked(at: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """(keys, times, texts) of a group's blocks."""
    keys, times, sizes = (pc.list_flatten(plain(at[c])) for c in ("doc_id", "times", "sizes"))
    whole = [int(n) for n in np.add.reduceat(np.append(sizes.to_numpy(), 0), np.cumsum([0, *pc.list_value_length(at["sizes"]).to_pylist()[:-1]]))]
    data = b"".join(pa.decompress(b.as_py(), n, "zstd", asbytes=True) for b, n in zip(at["texts"], whole))
    ends = np.concatenate([[0], np.cumsum(sizes.to_numpy(), dtype=np.int64)])
    texts = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype("<i8").tobytes()), pa.py_buffer(data))
    return keys, times.to_numpy(), texts


def exploded(docs: DataFrame, order: int, parts: int) -> DataFrame:
    """(part, grp, low, high, counts): the distinct n-grams of each group, in blocks by hash partition."""

    def explode(at: pa.Table) -> pa.Table:
        _, times, texts = unpacked(at)
        grams = Grams(texts, times, order)
        part = ((grams.known >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # ascending, as the hashes are
        first = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        cuts = list(zip(first, [*first[1:], len(part)]))
        blocks = [packed_hashes(grams.known[a:b]) for a, b in cuts]
        columns = [pa.array(part[first], pa.int32()), pa.array([at["grp"][0].as_py()] * len(cuts), pa.int32()), *(pa.array([b[i] for b in blocks], pa.binary()) for i in (0, 1)), pa.array([squeezed(grams.counts[a:b].astype("<i8")) for a, b in cuts], pa.binary())]
        return pa.table(columns, ["part", "grp", "low", "high", "counts"])

    return docs.groupBy("grp").applyInArrow(explode, "part int, grp int, low binary, high binary, counts binary")


def counted(blocks: DataFrame) -> DataFrame:
    """(part, grp, others): the count table of each hash partition, joined to its blocks: what all other groups have."""

    def count(at: pa.Table) -> pa.Table:
        grams = [unpacked_hashes(a.as_py(), b.as_py()) for a, b in zip(at["low"], at["high"])]
        counts = [unsqueezed(b.as_py()) for b in at["counts"]]
        every, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
        ends = np.cumsum([len(g) for g in grams])
        others = [squeezed((totals[inverse[e - len(g) : e]] - c).astype("<i8")) for g, c, e in zip(grams, counts, ends)]
        return pa.table([at["part"], at["grp"], pa.array(others, pa.binary())], ["part", "grp", "others"])

    return blocks.groupBy("part").applyInArrow(count, "part int, grp int, others binary")


def summed(docs: DataFrame, counts: DataFrame, order: int, backoff: float, corpus_words: int, leave_out: bool) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score): counts joined back to their group, scores summed by document."""

    def score(at: pa.Table, got: pa.Table) -> pa.Table:
        keys, times, texts = unpacked(at)
        grams = Grams(texts, times, order)
        got = got.sort_by("part")
        others = np.concatenate([np.zeros(0, np.int64), *(unsqueezed(b.as_py()) for b in got["others"])])
        if len(others) != len(grams.known):
            raise ValueError("the joined counts don't match the n-grams")
        logs = grams.scores(others, backoff, corpus_words, leave_out)
        mean = pa.array(logs / np.maximum(grams.sizes, 1), mask=grams.sizes == 0)
        rows = np.repeat(np.arange(len(keys)), times)
        return pa.table([keys, pa.array(grams.sizes, pa.int64()), pa.array(logs), mean], ["doc_id", "n_words", "log_score", "mean_log_score"]).take(pa.array(rows))

    kind = docs.schema["doc_id"].dataType.elementType.simpleString()
    return docs.groupBy("grp").cogroup(counts.groupBy("grp")).applyInArrow(score, f"doc_id {kind}, n_words long, log_score double, mean_log_score double")


def backoff_scores(df: DataFrame, *, key: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF, leave_out: bool = True, group_chars: int = GROUP_CHARS, part_grams: int = PART_GRAMS) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every row; counts are those of all rows."""
    rows = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chars, corpus_words = corpus_size(rows)
    docs = grouped(rows, max(1, -(-chars // group_chars)))
    blocks = exploded(docs, order, max(1, -(-corpus_words * order // part_grams)))
    return summed(docs, counted(blocks), order, backoff, corpus_words, leave_out)
