"""Chat formatting as prefix trees: turns that conversations share at their start are emitted once.

Template: a turn is ``<turn:ROLE>\\n`` + text + ``</turn>\\n``.  Inside roles and texts a backslash becomes two,
and ``<turn`` and ``</turn`` get ``\\l`` in place of their ``<`` (in roles also ``>`` becomes ``\\g`` and a line
feed ``\\n``), so no text can hold a mark and every text comes back as it was.

Conversations are ordered by the hashes of all paths down to their turns, each gets its rank in that order, and the
ranks are cut into ranges, so that those with a common start of any length follow each other; each range is walked
once.  A stack holds the turns on the path from the root to the
conversation at hand: turns already on it are not emitted again, the others are appended to the range's flat
sequence, which is thereby the depth-first order of its trees.  Each emitted turn carries

* its token ids, by the tokenizers library: head, text and closing mark are encoded apart, so that a text is a whole
  number of tokens and the loss mask falls between tokens; special tokens' strings inside a text stay text;
* its place in the range's sequence, [token_start, token_end) in tokens and [start, end) in code points;
* the position id of its first token (``token_position``; the others count on from it) and code point (``position``),
  which is its distance from the root, not from the sequence's start;
* the intervals of the sequence that it may attend to besides itself: its ancestors, joined where they touch, in tokens
  (``token_attends``) and code points (``attends``).

A tree is cut at range borders, where the shared start is emitted again; so no task holds more than one path.

Nulls: a null role or text is empty; rows with a null conversation key are one conversation.  Rows of one
conversation go by turn (null first), then role and text; repeated rows are turns of their own.  Very long
texts and conversations are streamed turn by turn; of a conversation eight bytes a turn are held together.  Ties in all
of conversation, turn, role and text are equal rows.  An empty table gives an empty result; other columns are left
behind, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held, written

OPEN, CLOSE = "<turn:", "</turn>\n"
ASSISTANT = "assistant"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<turn", "\\lturn").replace("</turn", "\\l/turn")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, at = [], 0
    letters = {"l": "<", "g": ">", "n": "\n", "\\": "\\"}
    while (i := text.find("\\", at)) >= 0:
        out += [text[at:i], letters[text[i + 1]]]
        at = i + 2
    return "".join(out) + text[at:]


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The formatted turn, and where its text begins; it ends before the closing mark."""
    head = OPEN + escape(role).replace(">", "\\g").replace("\n", "\\n") + ">\n"
    return head + escape(text) + CLOSE, len(head)


def parse_turn(formatted: str) -> tuple[str, str]:
    head, _, rest = formatted.removeprefix(OPEN).partition(">\n")
    return unescape(head), unescape(rest.removesuffix(CLOSE))


def _turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    empty = F.lit("")
    return df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"))


def library(path: str):
    """The tokenizer, one per Python worker."""

    def load():
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = True
        return tokenizer

    return held(("chat", path), load)


def placed(before: tuple | None, end: int, sizes: tuple[int, int, int]) -> tuple:
    """(start, end, position, start and end of the text, intervals) of a turn appended at ``end`` under ``before``, its
    parent; ``sizes`` are those of head, text and closing mark."""
    start, stop, position, attends = end, end + sum(sizes), 0, []
    if before is not None:
        s, e, p, _, _, above = before
        position = p + e - s
        attends = [*above[:-1], (above[-1][0], e)] if above and above[-1][1] == s else [*above, (s, e)]
    return start, stop, position, start + sizes[0], stop - sizes[2], attends


PLACE = ["start", "end", "position", "text_start", "text_end", "attends"]
PLACE_TYPES = "{0}start long, {0}end long, {0}position long, {0}text_start long, {0}text_end long, {0}attends array<struct<start: long, end: long>>"
TREE_TYPES = f"conv_id long, ordinal long, part long, {PLACE_TYPES.format('')}, {PLACE_TYPES.format('token_')}, role_is_loss boolean, shared boolean, formatted string, ids array<int>"


def build_trees(df: DataFrame, tokenizer: str, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn of each conversation, in the layout above.

    (conv_id, ordinal, part, start, end, position, text_start, text_end, attends, the same in tokens with the prefix
    ``token_``, role_is_loss, shared, formatted, ids): part numbers the ranges; text_start .. text_end is the turn's text
    in the sequence; ``formatted`` and ``ids`` are null where ``shared`` (the turn at [start, end) of that part holds them).
    """
    rows = _turns(df, conv, turn, role, text).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each turn with its number and the hash of the path down to it; after a conversation a row with its order key."""
        last, key, state, number = object(), bytearray(), b"", 0
        for at in batches:
            out = []
            for c, r, t in zip(at.conv_id, at.role, at.text):
                c = None if c is None or c != c else int(c)
                if c != last:
                    if number:
                        out.append((last, -1, None, None, None, bytes(key)))
                    last, key, state, number = c, bytearray(), b"", 0
                state = hashlib.blake2b(state + f"{len(r)}:{r}:{t}".encode(), digest_size=16).digest()
                key += state[:8]
                out.append((c, number, r, t, state, None))
                number += 1
            if out:
                yield frame(out)
        if number:
            yield frame([(last, -1, None, None, None, bytes(key))])

    def frame(out: list) -> pd.DataFrame:
        at = pd.DataFrame(out, columns=["conv_id", "ordinal", "role", "text", "path", "key"])
        return at.astype({"conv_id": "Int64"})

    chained = rows.mapInPandas(chain, "conv_id long, ordinal long, role string, text string, path binary, key binary")
    scratch = Scratch(df.sparkSession)
    chained = scratch.write(chained, "turns")
    ranks = chained.where("ordinal < 0").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    ranks = scratch.write(ranks.select(F.col("conv_id").alias("ranked"), F.monotonically_increasing_id().alias("rank")), "ranks")  # ascending over partitions, too
    turns = chained.where("ordinal >= 0").drop("key").join(ranks, F.col("conv_id").eqNullSafe(F.col("ranked")))
    ordered = turns.repartitionByRange("rank").sortWithinPartitions("rank", "ordinal")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, stack, end, token_end = TaskContext.get().partitionId(), [], 0, 0
        coder, heads = library(tokenizer), {}
        encode = lambda text: coder.encode(text, add_special_tokens=False).ids
        close = encode(CLOSE)
        for at in batches:
            out = []
            for c, n, r, t, path in zip(at.conv_id, at.ordinal, at.role, at.text, at.path):
                shared, formatted, ids = n < len(stack) and stack[n][0] == path, None, None
                if not shared:  # not emitted by a conversation before
                    del stack[n:]
                    formatted, head = format_turn(r, t)
                    if (start := formatted[:head]) not in heads:
                        if len(heads) > 1000:
                            heads.clear()
                        heads[start] = encode(start)
                    coded = [heads[start], encode(formatted[head : -len(CLOSE)]), close]
                    ids = [i for part_ids in coded for i in part_ids]
                    above = stack[-1] if stack else (None, None, None)
                    chars = placed(above[1], end, (head, len(formatted) - head - len(CLOSE), len(CLOSE)))
                    tokens = placed(above[2], token_end, tuple(map(len, coded)))
                    end, token_end = chars[1], tokens[1]
                    stack.append((path, chars, tokens))
                _, chars, tokens = stack[n]
                spans = [v for place in (chars, tokens) for v in (*place[:-1], [{"start": s, "end": e} for s, e in place[-1]])]
                out.append((c, n, part, *spans, r == ASSISTANT, shared, formatted, ids))
            columns = ["conv_id", "ordinal", "part", *PLACE, *[f"token_{c}" for c in PLACE], "role_is_loss", "shared", "formatted", "ids"]
            yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})

    trees = ordered.mapInPandas(walk, TREE_TYPES)
    trees = written(trees, "trees")  # ranges are sampled anew by each run, so places hold within one written table only
    scratch.clear()
    return trees


def read_turns(trees: DataFrame) -> DataFrame:
    """(conv_id, ordinal, ids, head, tail, loss, position, token_position) of every turn of every conversation, shared ones
    looked up; head and tail are the numbers of tokens before and after the turn's text."""
    own = trees.where("not shared").select("part", "token_start", F.col("ids").alias("whole"))
    found = trees.where("shared").join(own, ["part", "token_start"])
    head, tail = F.col("token_text_start") - F.col("token_start"), F.col("token_end") - F.col("token_text_end")
    columns = ["conv_id", "ordinal", head.alias("head"), tail.alias("tail"), F.col("role_is_loss").alias("loss"), "position", "token_position"]
    return trees.where("not shared").select(*columns, "ids").union(found.select(*columns, F.col("whole").alias("ids")))


def digests(trees: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the trees' token ids."""
    rows = read_turns(trees).repartition("conv_id").sortWithinPartitions("conv_id", "ordinal")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n, turns, loss, loss_chars, chars, tokens = object(), 0, None, None, 0, 0, 0
        coder = library(tokenizer)
        text_of = lambda ids: coder.decode(ids, skip_special_tokens=False)
        result = lambda: (last, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
        frame = lambda out: pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})
        for at in batches:
            out = []
            for c, ids, head, tail, is_loss, position, token_position in zip(at.conv_id, at.ids, at["head"], at["tail"], at.loss, at.position, at.token_position):
                c = None if c is None or c != c else int(c)
                if c != last:
                    if n:
                        out.append(result())
                    last, n, turns, loss, loss_chars, chars, tokens = c, 0, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                if (position, token_position) != (chars, tokens):
                    raise ValueError(f"conversation {c}: a turn at {position}, {token_position} follows {chars} code points, {tokens} tokens")
                formatted = text_of(ids)
                role, text = parse_turn(formatted)
                turns.update(f"{role}\n{text}\n".encode())
                if is_loss:
                    text = unescape(text_of(ids[head : len(ids) - tail]))
                    loss_chars += len(text)
                    loss.update(text.encode())
                n, chars, tokens = n + 1, chars + len(formatted), tokens + len(ids)
            if out:
                yield frame(out)
        if n:
            yield frame([result()])

    return rows.mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
