import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from terravox import checks
from terravox.functions import scalar as S
from terravox.operators import sparse
from terravox.queries import common


class Session:
    def __init__(self, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}


def test_local_folders_are_for_one_machine():
    shared = {"spark_checkpoint_dir": "hdfs://shared/"}
    assert common.scratch(Session(spark_master="local[4]"), "t").startswith("file:///")
    assert common.scratch(Session(spark_master="yarn", **shared), "t").startswith("hdfs://shared/terravox-t-")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            common.scratch(Session(spark_master=master), "t")


def test_shapes(spark):
    df = spark.createDataFrame([([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [1.0, 2.0, 3.0], [1.0])], "r array<array<double>>, t array<double>, bad array<double>")
    assert df.select(*checks.rigid(F.col("r"), F.col("t"))).first()[1] == [1.0, 2.0, 3.0]
    for wrong in (checks.vector_of(F.col("bad"), 3), checks.matrix_of(F.col("r"), 3, 4)):
        with pytest.raises(PySparkException):
            df.select(wrong).collect()
    with pytest.raises(ValueError):
        checks.positive("n", 0)
    with pytest.raises(ValueError):
        checks.one_of("mode", "x", ("a", "b"))


def test_text_and_time(spark):
    assert S.extension_for("a", True) == "a.npy" and S.extension_for("a.npy", True) == "a.npy" and S.extension_for("a", False, ".x") == "a.x"
    assert len(spark.range(1).select(S.utc_now()).first()[0]) == 19
    times = spark.createDataFrame([(-1,), (1999,), (-1001,)], "t long").select(F.unix_micros(S.micros_of_nanos(F.col("t")))).collect()
    assert [r[0] for r in times] == [-1, 1, -2]
    with pytest.raises(PySparkException):
        spark.range(1).select(S.pixels_to_inches(F.lit(-1))).collect()
    with pytest.raises(ValueError):
        S.rgba_of([F.lit(1.0)] * 5)


def test_tensor_to_arrays(spark):
    t = sparse.tensor(spark.createDataFrame([(1, 2, 3, 0.5)], "a int, b int, c int, v double"), ["a", "b", "c"], ["v"])
    coords, features = sparse.to_numpy(t)
    assert coords.tolist() == [[0, 1, 2, 3]] and np.allclose(features, [[0.5]]) and sparse.to_numpy(None) == (None, None)
