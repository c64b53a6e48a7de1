import os
from types import SimpleNamespace

import pyarrow as pa
import pytest

from terravox.llm import common


def test_slices_bound_rows_and_bytes():
    texts = ["a" * n for n in (5, 5, 5, 40, 0, 3, 3, 3, 3)] + [None]
    batch = pa.RecordBatch.from_pydict({"i": range(10), "text": texts})
    parts = [p["i"].to_pylist() for p in common.slices([batch, batch.slice(0, 0)], 4, "text", 12)]
    assert parts == [[0, 1], [2], [3], [4, 5, 6, 7], [8, 9]]
    assert [p["i"].to_pylist() for p in common.slices([batch.slice(6)], 2, 1, 100)] == [[6, 7], [8, 9]]


def test_a_worker_holds_one_object():
    made = []
    make = lambda v: made.append(v) or v
    assert common.held("a", lambda: make(1)) == 1 and common.held("a", lambda: make(2)) == 1
    assert common.held("b", lambda: make(3)) == 3 and common.held("a", lambda: make(4)) == 4
    common.held("none")
    assert made == [1, 3, 4] and not common._HELD


def test_scratch(spark):
    scratch = common.Scratch(spark)
    tables = [scratch.write(spark.range(n), "t") for n in (1, 2, 3)]
    paths = [common.local_path(p) for p in scratch.paths]
    scratch.clear(but=1)
    assert [os.path.exists(p) for p in paths] == [False, False, True] and tables[2].count() == 3
    scratch.clear()
    assert not any(map(os.path.exists, paths))


def test_batches_only_shrink(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    common.bound_batches(spark, 1000)
    common.bound_batches(spark, 5000)
    assert spark.conf.get(name).rstrip("bB") == "1000"
    spark.conf.set(name, before)


def test_files_appear_whole(tmp_path):
    common.write_bytes(f"file://{tmp_path}/d/x", b"12")
    common.write_bytes(f"file://{tmp_path}/d/x", b"34")
    assert os.listdir(tmp_path / "d") == ["x"] and (tmp_path / "d" / "x").read_bytes() == b"34"
    assert common.local_path("hdfs://host/x") is None


def test_no_local_folder_on_a_cluster():
    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)), setCheckpointDir=lambda path: None)
    session = lambda **conf: SimpleNamespace(conf={k.replace("_", "."): v for k, v in conf.items()}, sparkContext=context)
    assert common.shared_dir(session(spark_master="local[2]"), "t").startswith("file:///")
    assert common.shared_dir(session(spark_master="yarn", spark_checkpoint_dir="hdfs://shared"), "t").startswith("hdfs://shared/t-")
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(session(spark_master=master), "t")
