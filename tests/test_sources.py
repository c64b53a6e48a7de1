import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravox.functions.vectorized import array_function
from terravox.sources import arrays, lzf, pcd, ply, repository
from terravox.streaming import running

HEAD = "# .PCD v.7 - Point Cloud Data file format\nVERSION .7\nFIELDS x y n v\nSIZE 4 8 2 4\nTYPE F F U F\nCOUNT 1 1 1 3\nWIDTH {w}\nHEIGHT {h}\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {p}\nDATA {d}\n"
DTYPE = np.dtype([("x", "<f4"), ("y", "<f8"), ("n", "<u2"), ("v", "<f4", (3,))])


def body(n):
    out = np.zeros(n, DTYPE)
    out["x"], out["y"], out["n"], out["v"] = np.arange(n), np.arange(n) / 3, 60_000 + np.arange(n), np.arange(3 * n).reshape(n, 3)
    return out


def check(rows):
    rows = sorted(rows, key=lambda r: r["x"])
    assert [r["n"] for r in rows] == [60_000 + i for i in range(len(rows))]
    assert np.allclose([r["y"] for r in rows], np.arange(len(rows)) / 3) and rows[1]["v"] == [3.0, 4.0, 5.0]


@pytest.mark.parametrize("kind", ["ascii", "binary", "binary_compressed"])
def test_pcd_kinds(spark, tmp_path, kind):
    spark.dataSource.register(pcd.PcdSource)
    rows = body(6)
    data = HEAD.format(w=6, h=1, p=6, d=kind).encode()
    if kind == "ascii":
        data += "\n".join(" ".join(str(v) for v in (r["x"], r["y"], r["n"], *r["v"])) for r in rows).encode()
    elif kind == "binary":
        data += rows.tobytes()
    else:
        raw = b"".join(np.ascontiguousarray(rows[n]).tobytes() for n in DTYPE.names)
        packed = lzf.compress(raw)
        data += struct.pack("<II", len(packed), len(raw)) + packed
    (tmp_path / "a.pcd").write_bytes(data)
    check(spark.read.format("pcd").load(str(tmp_path / "a.pcd")).collect())


def test_pcd_grid_pruning_and_errors(spark, tmp_path):
    spark.dataSource.register(pcd.PcdSource)
    path = tmp_path / "g.pcd"
    path.write_bytes(HEAD.format(w=3, h=2, p=6, d="binary").encode() + body(6).tobytes())
    got = spark.read.format("pcd").option("columns", "row, col, x").load(str(path)).orderBy("x").collect()
    assert [(r["row"], r["col"]) for r in got] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    path.write_bytes(HEAD.format(w=3, h=2, p=5, d="binary").encode())
    with pytest.raises(ValueError):
        pcd.read_header(str(path))


def test_lzf_back_references():
    assert lzf.decompress(bytes([2]) + b"abc" + bytes([(4 << 5), 2]), 9) == b"abcabcabc"
    data = bytes(range(256)) * 3
    assert lzf.decompress(lzf.compress(data), len(data)) == data
    with pytest.raises(ValueError):
        lzf.decompress(bytes([(1 << 5), 5]), 3)


CUBE = """ply
format ascii 1.0
comment first
comment second
element vertex 4
property float x
property float y
property float z
property uchar red
element face 2
property list uchar int vertex_index
element edge 1
property int vertex1
property int vertex2
end_header
0 0 0 255
0 0 1 255
0 1 1 1
0 1 0 2
3 0 1 2
4 3 2 1 0
0 1
"""


def test_ply(spark, tmp_path):
    spark.dataSource.register(ply.PlySource)
    (tmp_path / "a.ply").write_text(CUBE)
    read = lambda p, e: spark.read.format("ply").option("element", e).load(str(p))
    assert ply.read_header(str(tmp_path / "a.ply")).comment == "first\nsecond"
    assert read(tmp_path / "a.ply", "vertex").count() == 4
    assert sorted(r["tri"] for r in read(tmp_path / "a.ply", "face").collect()) == [[0, 1, 2], [3, 1, 0], [3, 2, 1]]
    out = tmp_path / "b.ply"
    ply.write_ply(str(out), read(tmp_path / "a.ply", "vertex"), read(tmp_path / "a.ply", "face"), read(tmp_path / "a.ply", "edge"), comment="again")
    assert sorted(map(tuple, read(out, "vertex").collect())) == sorted(map(tuple, read(tmp_path / "a.ply", "vertex").collect()))
    assert read(out, "face").count() == 3 and [tuple(r) for r in read(out, "edge").collect()] == [(0, 1)]
    vertices = np.array([(1.5, -2)], [("x", ">f4"), ("n", ">i2")])
    big = b"ply\nformat binary_big_endian 1.0\nelement face 1\nproperty list uchar int vertex_index\nelement vertex 1\nproperty float x\nproperty short n\nend_header\n"
    (tmp_path / "c.ply").write_bytes(big + struct.pack(">B3i", 3, 5, 6, 7) + vertices.tobytes())
    assert [tuple(r) for r in read(tmp_path / "c.ply", "vertex").collect()] == [(1.5, -2)]
    assert read(tmp_path / "c.ply", "face").first()["tri"] == [5, 6, 7]
    with pytest.raises(ValueError):
        ply.fan([1, 2])


def test_array_files(spark, tmp_path):
    image = np.arange(24, dtype="<f4").reshape(2, 3, 4)  # rows, columns, channels
    (tmp_path / "d.bin").write_bytes(b"3&2&4&" + image.transpose(1, 0, 2).ravel(order="F").tobytes())
    got = {(r["row"], r["col"], r["ch"]): r["v"] for r in arrays.read_reconstruction(spark, str(tmp_path)).collect()}
    assert got == {(r, c, k): float(image[r, c, k]) for r in range(2) for c in range(3) for k in range(4)}
    np.save(tmp_path / "a.npy", np.arange(5.0))
    assert [r["v"] for r in arrays.read_npy(spark, str(tmp_path)).orderBy("i").collect()] == [0, 1, 2, 3, 4]
    colour = np.random.default_rng(0).integers(0, 256, (5, 7, 3)) / 255
    assert np.allclose(arrays.decode_png(arrays.encode_png(colour)), colour)
    assert arrays.find_paths(spark, str(tmp_path), lambda p: p.endswith(".npy")).count() == 1


def test_repository(spark, tmp_path):
    repo = repository.Repository(spark, str(tmp_path / "r"))
    df = spark.range(3)
    name = repo.add_item("a", df, kind="x")
    assert name == "a.parquet" and name in repo and repo.get_item(name).count() == 3 and repo.get_attribute(name) == {"kind": "x"}
    with pytest.raises(FileExistsError):
        repo.add_item("a", df)
    repo.add_item("a", spark.range(4), inplace=True, kind="y")
    repo.add_item("b", df, extension=".json")
    assert repo.get_item("b.json").count() == 3
    assert [r["name"] for r in repo.list_items(lambda n, a: a.get("kind") == "y").collect()] == ["a.parquet"]
    repo.del_item("a.parquet")
    for call in (repo.del_item, repo.get_item, repo.get_attribute):
        with pytest.raises(FileNotFoundError):
            call("a.parquet")
    with pytest.raises(RuntimeError):
        repository.format_of("x.dill")
    made = []
    keep = repository.materialized(str(tmp_path / "kept"))(lambda s, n: made.append(n) or s.range(n))
    assert keep(spark, 5).count() == keep(spark, 6).count() == 5 and made == [5]
    assert repository.clear_cache(spark, str(tmp_path / "kept"))


def test_array_function(spark):
    double = array_function(shape=(2, 2), permute=(1, 0))(lambda x: x * 2)
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "v array<double>")
    assert df.select(double(F.col("v"))).first()[0] == [2.0, 6.0, 4.0, 8.0]


def test_streams(spark, tmp_path):
    rows = [(1, i, float(v)) for i, v in enumerate((0, 1, 12, 13, 30))]
    events = spark.createDataFrame(rows, "key long, idx long, pos double").withColumn("ts", F.timestamp_seconds("idx"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    with_state = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    for k, v in with_state.items():
        spark.conf.set(k, v)
    query = running.streaming_keyframes(stream, 10.0).writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(r["idx"] for r in spark.table("kept").collect()) == [0, 2, 4]
    query = running.windowed_moments(stream, time="ts", value="pos", by=["key"], window="1 minute").writeStream.format("memory").queryName("m").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.table("m").first()["n"] == 5


def test_pcd_appends_overwrites_and_keeps_empty_tables(spark, tmp_path):
    spark.dataSource.register(pcd.PcdSource)
    path = str(tmp_path / "cloud")
    rows = spark.range(8).select(F.col("id").cast("int").alias("i"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v")).repartition(3)
    read = lambda: spark.read.format("pcd").load(path)
    for n in (1, 2):
        rows.write.format("pcd").mode("append").save(path)
        assert read().count() == 8 * n
    rows.where("i < 3").write.format("pcd").mode("overwrite").save(path)
    assert sorted((r["i"], r["v"]) for r in read().collect()) == [(i, [1.0, float(i)]) for i in range(3)]
    bad = rows.where("i < 5").withColumn("i", F.when(F.col("i") == 4, F.raise_error(F.lit("stop"))).otherwise(F.col("i")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("pcd").mode("overwrite").save(path)
    assert read().count() == 3  # a failed job leaves what was there
    rows.where("i < 0").write.format("pcd").mode("append").save(path)
    assert read().count() == 3
    rows.select("i").where("i < 0").write.format("pcd").mode("overwrite").save(path)
    assert read().count() == 0 and read().columns == ["i"]


def test_ply_unsigned_types(spark, tmp_path):
    spark.dataSource.register(ply.PlySource)
    path = str(tmp_path / "c.ply")
    df = spark.createDataFrame([(2, 255, 65_535, 4_294_967_295), (1, 0, 1, 2)], "o int, a int, b int, c long").repartition(2)
    ply.write_ply(path, df, types={"a": "uchar", "b": "ushort", "c": "uint"}, order="o")
    assert [tuple(r) for r in spark.read.format("ply").load(path).collect()] == [(0, 1, 2), (255, 65_535, 4_294_967_295)]
    assert b"property uchar a\nproperty ushort b\nproperty uint c" in (tmp_path / "c.ply").read_bytes()
    assert [p.name for p in tmp_path.iterdir() if "parts" in p.name or "tmp" in p.name] == []
    with pytest.raises(Exception, match="no uchar"):
        ply.write_ply(path, df.select((F.col("a") + 1).alias("a")), types={"a": "uchar"})


def test_repository_writers_wait_for_each_other(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from terravox.sources import repository

    root = f"file://{tmp_path}/repo"
    repository.Repository(spark, root)
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: repository.Repository(spark, root).add_item(f"t{k}", spark.range(k)), range(6)))
    repo = repository.Repository(spark, root)
    assert repo.catalog().count() == 6 and sorted(p.name for p in (tmp_path / "repo").iterdir() if "metadata" in p.name and not p.name.startswith(".")) == ["metadata.json"]
