"""The queries of this subpackage, over whole tables with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, bpe, chattree, dartminhash, langid, mixing, quality, tokencount, tokenfiles, topk
from .common import shared_dir, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
END_OF_TEXT = 50256


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "tokens")
    manifest = tokenfiles.write_tokens(table(spark, sf_dir, "documents"), out, TOKENIZER, end_id=END_ID)
    return tokenfiles.read_tokens(spark, out, manifest)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents end with the end-of-text id here: no text encodes to it, while an id of a text may be 2."""
    out = shared_dir(spark, "flat")
    docs = table(spark, sf_dir, "documents")
    manifest = tokenfiles.write_tokens(docs, out, TOKENIZER, end_id=END_OF_TEXT, ordered=False, indexed=False, specials_as_text=True)
    files = [(f"{out}/part-{p['part']:06d}.tokens", p["tokens"]) for p in manifest["parts"]]
    return tokencount.scan_documents(spark, files, manifest["type"], END_OF_TEXT)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.class_table(table(spark, sf_dir, "documents"))


def op4_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff.backoff_scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", (F.round("log_score", 3) + 0.0).alias("log_score"), F.round("mean_log_score", 5).alias("mean_log_score"))


def op5_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chattree.digests(chattree.build_trees(rows.union(more), TOKENIZER), TOKENIZER)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict_table(docs, langid.learn(docs))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.quality_table(table(spark, sf_dir, "documents"))
    return rules.withColumns({c: F.round(c, 6) + 0.0 for c in ("line_coverage", "ngram_coverage")})


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_table(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_token_counts, op3_near_duplicates, op4_backoff_scores, op5_chat_trees, op6_exact_top_k, op7_language_id, op8_quality_rules, op9_bpe_round_trip, op10_source_mix)}


OP6_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


OP3_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)
SELECT x AS doc_id, min(y) AS class_id FROM r GROUP BY x"""

OP4_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, w, lag(w) OVER p AS h, lag(w, 2) OVER p AS k FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT w, count(*) AS c FROM t GROUP BY w), uo AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY doc_id, w),
b AS (SELECT h, w, count(*) AS c FROM g WHERE h IS NOT NULL GROUP BY h, w), bo AS (SELECT doc_id, h, w, count(*) AS c FROM g WHERE h IS NOT NULL GROUP BY doc_id, h, w),
r AS (SELECT k, h, w, count(*) AS c FROM g WHERE k IS NOT NULL GROUP BY k, h, w), ro AS (SELECT doc_id, k, h, w, count(*) AS c FROM g WHERE k IS NOT NULL GROUP BY doc_id, k, h, w),
n AS (SELECT doc_id, len(ws) AS own, sum(len(ws)) OVER () - len(ws) AS n FROM w),
c AS (SELECT g.doc_id, g.i, u.c - uo.c AS c3, uh.c - uoh.c AS c2, b.c - bo.c AS c23, bh.c - boh.c AS c12, r.c - ro.c AS c123, n.n
      FROM g JOIN n ON n.doc_id = g.doc_id JOIN u ON u.w = g.w JOIN uo ON uo.doc_id = g.doc_id AND uo.w = g.w
      LEFT JOIN u uh ON uh.w = g.h LEFT JOIN uo uoh ON uoh.doc_id = g.doc_id AND uoh.w = g.h
      LEFT JOIN b ON b.h = g.h AND b.w = g.w LEFT JOIN bo ON bo.doc_id = g.doc_id AND bo.h = g.h AND bo.w = g.w
      LEFT JOIN b bh ON bh.h = g.k AND bh.w = g.h LEFT JOIN bo boh ON boh.doc_id = g.doc_id AND boh.h = g.k AND boh.w = g.h
      LEFT JOIN r ON r.k = g.k AND r.h = g.h AND r.w = g.w LEFT JOIN ro ON ro.doc_id = g.doc_id AND ro.k = g.k AND ro.h = g.h AND ro.w = g.w),
f AS (SELECT doc_id, i, CASE WHEN c3 > 0 THEN c3 / n ELSE 0.4 / (n + 1) END AS one, CASE WHEN c23 > 0 AND c2 > 0 THEN c23 / c2 END AS two, CASE WHEN c123 > 0 AND c12 > 0 THEN c123 / c12 END AS three FROM c),
s AS (SELECT doc_id, i, one, coalesce(two, 0.4 * one) AS two, three FROM f),
q AS (SELECT doc_id, sum(ln(CASE WHEN i = 1 THEN one WHEN i = 2 THEN two ELSE coalesce(three, 0.4 * two) END)) AS s FROM s GROUP BY doc_id)
SELECT n.doc_id, own AS n_words, round(coalesce(s, 0), 3) + 0.0 AS log_score, round(s / own, 5) AS mean_log_score FROM n LEFT JOIN q ON q.doc_id = n.doc_id"""

_TEXT = "replace(replace(replace(text, '\\', '\\\\'), '<turn', '\\lturn'), '</turn', '\\l/turn')"
_ROLE = "replace(replace(" + _TEXT.replace("text", "role") + ", '>', '\\g'), chr(10), '\\n')"
OP5_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn:>') + 1 + length('</turn>') + 1 + length({_TEXT}) + length({_ROLE})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


def _covered(n: int) -> str:
    """Word characters in n-grams that equal an earlier one, by document."""
    return f"""k{n} AS (SELECT doc_id, sum(length(w)) AS c FROM (SELECT DISTINCT doc_id, i + o AS i FROM (
  SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS nth FROM (SELECT doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM d))), range(0, {n}) x(o)
  WHERE nth > 1) JOIN t USING (doc_id, i) GROUP BY doc_id)"""


def _op8_sql() -> str:
    limits = quality.COVERAGE_LIMITS
    share = lambda n: f"coalesce(k{n}.c, 0) / nullif(word_chars, 0)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
b AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS nth FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dl AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS c FROM l WHERE nth > 1 GROUP BY doc_id),
r3 AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d))), range(0, 3) x(o) WHERE times > 1) GROUP BY doc_id),
{", ".join(_covered(n) for n in limits)},
f AS (SELECT b.doc_id, n_words, word_chars, n_symbols, coalesce(dl.n, 0) AS n_dup_lines, coalesce(r3.n, 0) AS n_repeat_words,
  n_words < {quality.MIN_WORDS} OR 100 * coalesce(r3.n, 0) > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed, coalesce(coalesce(dl.c, 0) / nullif(word_chars, 0), 0) AS lc,
  {" AND ".join(f"coalesce({share(n)}, 0) <= {v}" for n, v in limits.items())} AS fine, coalesce(greatest({", ".join(share(n) for n in limits)}), 0) AS nc
  FROM b LEFT JOIN dl USING (doc_id) LEFT JOIN r3 USING (doc_id) {" ".join(f"LEFT JOIN k{n} USING (doc_id)" for n in limits)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lc <= {quality.LINE_LIMIT} AND fine AS kept,
  round(lc, 6) + 0.0 AS line_coverage, round(nc, 6) + 0.0 AS ngram_coverage FROM f"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_near_duplicates": OP3_SQL,
        "op4_backoff_scores": OP4_SQL,
        "op5_chat_trees": OP5_SQL,
        "op6_exact_top_k": OP6_SQL,
        "op8_quality_rules": _op8_sql(),
        "op10_source_mix": mixing.oracle(),
    }
