import os
import sys
from collections import Counter

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from terravox.llm import queries as Q
from terravox.llm.common import WORD

from ..helpers import same_as_sql
from .fixtures import documents, local
from .test_dedup import brute
from .test_texts import verdict

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@tables
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, name):
    same_as_sql(Q.queries()[name](spark, SF), Q.oracle_sql()[name], SF)


@tables
@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_has_a_row_for_each_document(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    if name.startswith("op5"):
        n = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1
    assert Q.queries()[name](spark, SF).count() == n


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} == {name.split("_")[0] for name in Q.queries()}
    assert "pipeline" in entry.queries()


def test_stages_over_awkward_rows(spark, tmp_path):
    docs = documents(spark)
    (tmp_path / "in").mkdir()
    docs.write.parquet(str(tmp_path / "in" / "documents.parquet"))
    now, counts = spark.read.parquet(str(tmp_path / "in" / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        before = local(now, "doc_id", "text")
        out = stage(spark, now, str(tmp_path / "in"))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        counts.append(now.count())
        if name != "token_ids":
            assert now.columns == docs.columns
        after = local(now, "doc_id", "text") if name != "token_ids" else None
        if name == "language_id":
            assert all(any(c.isalpha() for c in t) for _, t in after)
        elif name == "quality_rules":
            assert Counter(after) == Counter(r for r in before if verdict(r[1] or ""))
        elif name == "near_dedup":
            assert len(after) == len(set(brute([(i, t) for i, (_, t) in enumerate(before)]))) and set(after) <= set(before)
        elif name == "source_mix":
            assert set(after) <= set(before) and max(Counter(after).values()) <= 2
            size = lambda rows: sum(len(WORD.findall(t)) for _, t in rows)
            assert 0 < size(after) <= 2 * size(before)
        else:
            library = Tokenizer.from_file(Q.TOKENIZER)
            want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in before)
            assert Counter((r["doc_id"], tuple(r["ids"])) for r in now.collect()) == want
    assert counts[0] >= counts[1] >= counts[2] > 0
    assert corpus_pipeline.run(spark, str(tmp_path / "in")).count() == counts[-1]


def test_empty_input(spark, tmp_path):
    documents(spark).where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_base_library_does_not_need_this_one():
    import subprocess

    code = "import sys; sys.modules['terravox.llm'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 90"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__)).returncode == 0
