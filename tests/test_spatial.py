import math
import random
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from terravox.functions import geometry as G
from terravox.functions import scalar as S
from terravox.operators import align, attention, camera, generators, images, parameters, sampling, sparse, tables, voxels, windows
from terravox.plans.physical import floor_div, literal_rows


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_voxel_grid(spark):
    at = [0.1, 0.4, 0.8, 1.2, 1.6, 2.0]
    cloud = spark.createDataFrame([(i, v, v, v, float(i + 1), [v, v]) for i, v in enumerate(at)], "idx long, x double, y double, z double, a double, b array<double>")
    grid = voxels.voxel_grid(cloud, 0.5, attributes=["a"], vectors={"b": 2}).orderBy("vx").collect()
    assert [r["count"] for r in grid] == [2, 1, 1, 1, 1]
    assert np.allclose([r["mx"] for r in grid], [0.25 + 0.5 * k for k in range(5)])
    assert np.allclose([r["cx"] for r in grid], [0.25, 0.8, 1.2, 1.6, 2.0])
    assert [r["a"] for r in grid] == [1.5, 3, 4, 5, 6]
    assert np.allclose([r["b"][1] for r in grid], [0.25, 0.8, 1.2, 1.6, 2.0])
    assert voxels.voxel_grid(cloud.where("false"), 0.5).count() == 0
    with pytest.raises(ValueError):
        voxels.voxel_grid(cloud, [0.5, 0.5])


def test_floor_division(spark):
    random.seed(3)
    values = [random.uniform(-5, 5) for _ in range(400)] + [k * 0.1 for k in range(-60, 60)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for size in (0.1, 0.2, 0.7):
        got = [r[1] for r in df.select("v", floor_div(F.col("v"), size)).collect()]
        assert got == [int(np.float64(v) // size) for v in values]


def test_row_container(spark):
    df = tables.allocate(spark, 10, __import__("terravox.schemas", fromlist=["POSES"]).POSES)
    assert df.columns == ["idx", "x", "y", "z", "qx", "qy", "qz", "qw"] and df.count() == 10
    assert rows(tables.take_rows(df, [3]).select("idx"), "idx") == [(3,)]
    assert rows(tables.slice_rows(df, 3, 5).select("idx"), "idx") == [(3,), (4,)]
    assert rows(tables.mask_rows(df, F.col("idx").isin(0, 2)).select("idx"), "idx") == [(0,), (2,)]
    assert rows(tables.take_rows(df, [7, 5, 3, 3, 3]).select("idx"), "idx") == [(3,), (5,), (7,)]
    assert rows(tables.take_rows(df, [-1], n=10).select("idx"), "idx") == [(9,)]


def test_nearest_asof_ties_and_ends(spark):
    base = spark.createDataFrame([(0, "a", 0), (1, "a", 10), (2, "a", 20)], "idx long, k string, ts_ns long")
    probes = spark.createDataFrame([(0, "a", -5), (1, "a", 5), (2, "a", 14), (3, "a", 99), (4, "b", 1)], "probe long, k string, ts_ns long")
    got = tables.align_timestamps(base, probes, by=["k"]).orderBy("probe").collect()
    assert [r["idx"] for r in got] == [0, 1, 1, 2, None]
    assert rows(tables.aligned_rows(base, probes, by=["k"]).select("idx"), "idx") == [(0,), (1,), (2,)]


def test_box(spark):
    corners = [(1, 1, 1), (1, 1, -1), (1, -1, -1), (1, -1, 1), (-1, 1, 1), (-1, 1, -1), (-1, -1, -1), (-1, -1, 1)]
    points = spark.createDataFrame([(0, 0.0), (1, 0.5), (2, 2.0), (3, -2.0)], "i int, v double")
    inside = G.inside_box([F.col("v")] * 3, corners)
    assert rows(points.select("i", inside), "i") == [(0, True), (1, True), (2, False), (3, False)]
    assert points.where(G.inside_box([F.col("v")] * 3, [(1, 1, 1)] * 8)).count() == 0


def test_rotations_round_trip(spark):
    draw = np.random.default_rng(0)
    q = draw.normal(size=(40, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(q)], "i int, a double, b double, c double, d double")
    r = G.quaternion_to_matrix([F.col(c) for c in "abcd"])
    back = G.matrix_to_quaternion(r)
    got = np.array(df.orderBy("i").select(*back).collect())
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    assert np.allclose(np.abs((got * unit).sum(axis=1)), 1)
    angles = G.matrix_to_euler(G.transpose(G.euler_to_matrix([F.lit(0.1), F.lit(0.2), F.lit(0.3)])))
    assert np.allclose(df.limit(1).select(*angles).first(), [0.1, 0.2, 0.3])
    ri, ti = G.invert_pose(r, [F.col("a"), F.col("b"), F.col("c")])
    same = G.camera_to_world(G.camera_to_world([F.lit(1.0), F.lit(2.0), F.lit(3.0)], r, [F.col("a"), F.col("b"), F.col("c")]), ri, ti)
    assert np.allclose(df.select(*same).collect(), [1, 2, 3])


def test_keyframes(spark):
    at = [0.0, 0.5, 1.6, 2.0, 4.0, 4.1]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(at)], "t int, i int, v double")
    got = sampling.keyframes(df, by=["t"], order=["i"], idx="i", xyz=("v",), min_distance=1.5)
    assert rows(got, "i") == [(0, 0), (0, 2), (0, 4), (0, 5)]
    turn = [(0, i, 0.0, 0.0, 0.0, math.sin(a / 2), math.cos(a / 2)) for i, a in enumerate((0.0, 0.01, 0.05, 0.06))]
    df = spark.createDataFrame(turn, "t int, i int, v double, qx double, qy double, qz double, qw double")
    got = sampling.keyframes(df, by=["t"], order=["i"], idx="i", xyz=("v",), quaternion=("qx", "qy", "qz", "qw"))
    assert rows(got, "i") == [(0, 0), (0, 2), (0, 3)]


def test_random_labels_are_a_bijection(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "l string")
    got = {r["l"]: r["random_label"] for r in sampling.randomize_labels(df, "l").collect()}
    assert sorted(got.values()) == [0, 1, 2]


def test_camera_guards_points_behind(spark):
    cam = camera.Camera(((10.0, 0, 5), (0, 10.0, 5), (0, 0, 1)), 10, 10)
    df = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 0.0, 0.0, 0.5), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, -1.0), (4, 9.0, 0.0, 1.0)], "idx long, x double, y double, z double")
    assert rows(camera.field_of_view(df, cam).select("idx"), "idx") == [(0,), (1,)]
    assert camera.index_map(df, cam).where("index >= 0").collect()[0]["index"] == 1
    back = camera.depth_to_points(camera.depth_image(df, cam), cam, valid_only=True).first()
    assert (back["depth"], round(back["x"], 6)) == (0.5, 0.025)
    with pytest.raises(PySparkException):
        camera.lookup_pixels(df, cam, camera.dense_grid(spark, 10, 10)).collect()


def image(spark, values):
    return spark.createDataFrame([(0, r, c, float(v)) for r, row in enumerate(values) for c, v in enumerate(row)], "img int, row int, col int, v double")


def test_inpaint(spark):
    got = images.inpaint(image(spark, [[-1, 0.5, 0.5], [0.5, -1, 0.5], [0.5, 0.5, -1]]))
    assert {r["v"] for r in got.collect()} == {0.5}
    assert {r["v"] for r in images.inpaint(image(spark, [[-1] * 3] * 3)).collect()} == {-1.0}
    with pytest.raises(ValueError):
        images.inpaint(image(spark, [[1]]), kernel=2)


def test_overlay_clamps_everywhere(spark):
    base, layer = image(spark, [[2, 0], [0, 0]]), image(spark, [[1, 1], [1, 1]])
    mask = spark.createDataFrame([(0, 0, 1, True)], "img int, row int, col int, masked boolean")
    assert rows(images.overlay_image(base, layer, mask=mask).select("row", "col", "v"), "row", "col") == [(0, 0, 1.0), (0, 1, 0.5), (1, 0, 0.0), (1, 1, 0.0)]


def test_hull_and_triangles():
    square = np.array([(0, 0), (0, 4), (4, 0), (4, 4), (2, 2)])
    assert len(images.hull_pixels(square)) == 25
    triangles = images.triangulate(square)
    area = sum(abs(images._half(*square[t])) / 2 for t in triangles)
    assert area == 16 and len(triangles) == 4
    assert len(images.hull_pixels(square[:2])) == 0 and len(images.triangulate(np.array([(0, 0), (1, 1), (2, 2)]))) == 0
    draw = np.random.default_rng(1)
    points = np.unique(draw.integers(0, 30, (40, 2)), axis=0)
    corners = images.hull_of(points)
    hull = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(corners, np.roll(corners, -1, axis=0)))) / 2
    assert sum(abs(images._half(*points[t])) / 2 for t in images.triangulate(points)) == hull


def test_blend_arrays(spark):
    one = spark.range(1)
    assert one.select(S.blend_arrays(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(2.0)))).first()[0] == [2.5, 2.5]
    with pytest.raises(PySparkException):
        one.select(S.blend_arrays(F.array(F.lit(1.0)), F.array(F.lit(4.0), F.lit(2.0)))).collect()


def test_stable_merge(spark):
    for lists, want in (([[1, 2, 3], [3, 4, 5], [5, 6, 7]], [1, 2, 3, 4, 5, 6, 7]), ([[3, 2, 1], [2, 1, 4]], [3, 2, 1, 4]), ([[], []], []), ([[1, 1], [2]], [1, 1, 2])):
        df = spark.createDataFrame([(lists,)], "l array<array<long>>")
        assert df.select(S.stable_merge(F.col("l"))).first()[0] == want


def test_triangle_fan(spark):
    df = spark.createDataFrame([([7, 6, 5, 4],)], "p array<int>")
    assert df.select(S.triangle_fan(F.col("p"))).first()[0] == [[7, 6, 5], [7, 5, 4]]
    with pytest.raises(PySparkException):
        spark.createDataFrame([([7, 6],)], "p array<int>").select(S.triangle_fan(F.col("p"))).collect()


def test_positional_encoding(spark):
    got = [r["v"] for r in generators.positional_encoding(spark, 3, 3).orderBy("pos", "slot").collect()]
    want = [f(p / 10000 ** (2 * (s // 2) / 3)) for p in range(3) for s, f in enumerate((math.sin, math.cos, math.sin))]
    assert np.allclose(got, want)
    assert generators.positional_encoding(spark, 0, 3).count() == generators.positional_encoding(spark, 3, 0).count() == 0


def test_sparse_sets(spark):
    schema = "idx long, batch int, x int, y int, z int, f array<float>"
    a = spark.createDataFrame([(0, 0, 0, 0, 0, [1.0]), (1, 0, 1, 0, 0, [2.0])], schema)
    b = spark.createDataFrame([(0, 0, 1, 0, 0, [5.0]), (1, 0, 5, 5, 5, [6.0])], schema)
    assert rows(sparse.difference(a, b).select("idx"), "idx") == [(0,)]
    assert sparse.difference(a, a).count() == 0
    assert [r["f"] for r in sparse.append_unique(a, b).orderBy("x").collect()] == [[1.0], [2.0], [6.0]]
    assert rows(sparse.sparse_sum(a, b, width=1).select("x", F.col("f")[0]), "x") == [(0, 1.0), (1, 7.0), (5, 6.0)]
    assert rows(sparse.neighbor_join(a, b, sparse.cube_offsets(3)).select("a_idx", "b_idx"), "a_idx") == [(0, 0), (1, 0)]
    assert len(sparse.cross_offsets(3)) == 7 and len(sparse.cube_offsets(3)) == 27
    assert [r["indices"] for r in sparse.batch_indices(a, 2).orderBy("batch").collect()] == [[0, 1], []]


def test_attention_layer_against_numpy(spark):
    draw = np.random.default_rng(2)
    fa, fb = draw.normal(size=(3, 2)), draw.normal(size=(4, 2))
    edges = [(0, 0), (0, 1), (1, 2), (1, 3), (1, 0)]
    w = [draw.normal(size=s) for s in ((4, 2), (4, 2), (4, 2), (2, 4))]
    a = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(fa)], "idx long, f array<double>")
    b = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(fb)], "idx long, f array<double>")
    e = spark.createDataFrame(edges, "a_idx long, b_idx long")
    got = attention.multi_head_attention(a, b, e, attention.AttentionWeights(*[m.tolist() for m in w], heads=2)).orderBy("idx").collect()
    q, k, v = fa @ w[0].T, fb @ w[1].T, fb @ w[2].T
    for i in range(3):
        own, out = [j for x, j in edges if x == i], np.zeros(4)
        for h in range(2):
            s = slice(2 * h, 2 * h + 2)
            logits = np.array([q[i, s] @ k[j, s] / math.sqrt(2) for j in own])
            if len(own):
                p = np.exp(logits - logits.max())
                out[s] = (p / (p.sum() + 1e-12)) @ v[own][:, s]
        assert np.allclose(got[i]["out"], w[3] @ out)
    with pytest.raises(ValueError):
        attention.AttentionWeights(w[0].tolist(), w[1].tolist(), w[2].tolist(), w[3].tolist(), heads=3).width()


def test_neighbors_grow_their_cells(spark, monkeypatch):
    draw = np.random.default_rng(4)
    s, d = draw.uniform(-1, 1, (30, 3)), draw.uniform(-1, 1, (200, 3))
    s[0] = 7.0
    src = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(s)], "i long, x double, y double, z double")
    dst = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(d)], "j long, x double, y double, z double")
    want = [int(((d - p) ** 2).sum(axis=1).argmin()) for p in s]
    assert [r["j"] for r in align.nearest_neighbors(src, dst).orderBy("i").collect()] == want
    monkeypatch.setattr(align, "ALL_PAIRS_ROWS", 10)
    assert [r["j"] for r in align.nearest_neighbors(src, dst).orderBy("i").collect()] == want


def test_ransac_without_inliers(spark):
    pairs = spark.createDataFrame([(i, float(i), 0.0, float(i * i), float(-i), 5.0 * i % 3, float(i % 2)) for i in range(8)], "idx long, sx double, sy double, sz double, dx double, dy double, dz double")
    found, marked = align.ransac(pairs, max_iterations=3, inlier_threshold=1e-9, seed=0)
    assert marked.where("inlier").count() < 8
    with pytest.raises(ValueError):
        align.ransac(pairs.limit(2))
    assert found.rotation.shape == (3, 3)


def test_parameter_tree(spark):
    rows_ = [("a.w", 0, "parameter", False, 200, [1.0]), ("a.b", 1, "parameter", False, 20, [1.0]), ("c.w", 2, "parameter", True, 200, [2.0]), ("c.b", 3, "parameter", True, 10, [2.0]), ("c.m", 4, "buffer", False, 1, [0.0])]
    t = spark.createDataFrame(rows_, "path string, ordinal int, kind string, requires_grad boolean, numel long, value array<float>")
    assert parameters.count_parameters(t).first()[0] == 430 and parameters.count_parameters(t, trainable_only=True).first()[0] == 210
    assert rows(parameters.frozen_layers(t), "name") == [("a",)] and rows(parameters.unfrozen_layers(t), "name") == [("c",)]
    assert rows(parameters.frozen_layers(t, full_path=True), "name") == [("a.b",), ("a.w",)]
    assert rows(parameters.grad_state(t).select("path"), "path") == [("c.b",), ("c.m",), ("c.w",)]
    assert rows(parameters.train_flags(t), "layer") == [("", True), ("a", False), ("c", True)]
    assert parameters.all_frozen(parameters.freeze(t)).first()[0] and not parameters.any_frozen(parameters.unfreeze(t)).first()[0]
    loaded, left = parameters.load_grad_state(t, spark.createDataFrame([("c.w", [9.0]), ("x", [1.0])], "path string, value array<float>"))
    assert loaded.where("path = 'c.w'").first()["value"] == [9.0] and [r[0] for r in left.collect()] == ["x"]
    assert parameters.same_state(t, t.select("*")).first()[0] and not parameters.same_state(t, t.limit(4)).first()[0]


def test_literal_rows(spark):
    assert rows(literal_rows(spark, [(1, "a"), (2, "b")], "n int, s string"), "n") == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("span", [None, 5, 1000])
def test_nearest_asof_equals_brute_force(spark, span):
    draw = random.Random(3)
    base = [(draw.choice(["a", "b", None]), i, draw.randint(0, 60)) for i in range(50)]
    probes = [(draw.choice(["a", "b", "c", None]), i, draw.randint(-20, 90)) for i in range(80)]
    b = spark.createDataFrame(base, "k string, idx long, ts_ns long")
    p = spark.createDataFrame(probes, "k string, probe long, ts_ns long")
    got = {r["probe"]: r["matched_ts_ns"] for r in tables.align_timestamps(b, p, by=["k"], span=span).collect()}
    for k, i, t in probes:
        own = [x for key, _, x in base if key == k]
        assert got[i] == (min(own, key=lambda x: (abs(x - t), -x)) if own else None)


def test_long_entities_align_in_linear_time(spark):
    n = 20_000
    b = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("idx"), (F.col("id") * 10).alias("ts_ns"))
    p = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("probe"), (F.col("id") * 10 + 4).alias("ts_ns"))
    began = time.perf_counter()
    assert tables.align_timestamps(b, p, by=["k"]).where("idx = probe").count() == n
    assert time.perf_counter() - began < 20


def test_points_that_are_not_finite_have_no_neighbour(spark, monkeypatch):
    monkeypatch.setattr(align, "ALL_PAIRS_ROWS", 1)
    bad = [(7, math.nan, 0.0, 0.0), (8, math.inf, 0.0, 0.0), (9, None, 0.0, 0.0)]
    src = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 5.0, 5.0, 5.0), *bad], "i long, x double, y double, z double")
    dst = spark.createDataFrame([(0, 0.1, 0.0, 0.0), (1, 4.0, 5.0, 5.0), *bad], "j long, x double, y double, z double")
    for radius in (math.inf, 2.0):
        got = align.nearest_neighbors(src, dst, radius=radius).collect()
        assert sorted((r["i"], r["j"]) for r in got) == [(0, 0), (1, 1)]
    assert align.nearest_neighbors(src.where("i > 6"), dst).count() == 0


def test_softmax_of_groups_with_null_keys(spark):
    rows = [("a", 1.0), ("a", 3.0), (None, 2.0), (None, 2.0), ("b", 1000.0)]
    got = windows.grouped_softmax(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]).collect()
    want = {("a", 1.0): 1 / (1 + math.exp(2)), ("a", 3.0): 1 / (1 + math.exp(-2)), (None, 2.0): 0.5, ("b", 1000.0): 1.0}
    assert len(got) == 5 and all(abs(r["softmax"] - want[r["k"], r["v"]]) < 1e-9 for r in got)


def test_voxel_order_equals_a_sort(spark):
    draw = random.Random(2)
    rows = [(i, draw.randint(-3, 3) + 0.5, draw.randint(-2, 2) + 0.5, draw.randint(-2, 2) + 0.5) for i in range(200)]
    got = {r["idx"]: r["position"] for r in voxels.voxel_order(spark.createDataFrame(rows, "idx long, x double, y double, z double"), 1.0).collect()}
    assert [got[i] for i, *_ in sorted(rows, key=lambda r: (r[1:], r[0]))] == list(range(200))


def test_box_lines_broadcast_nothing(spark):
    """The corners look small in the planner's figures, which an explode does not change, and grow with the boxes."""
    boxes = spark.range(3).select(F.col("id").alias("box"), *[F.lit(float(n)).alias(c) for n, c in enumerate(("lx", "ly", "lz"), 1)])
    made = generators.box_lines(generators.box_corners(boxes), eps=0.25)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("Exchange") <= 1
    assert rows(made.where("box = 1").groupBy("part").count(), "part") == [(0, 32), (1, 32), (2, 28)]
    ring = {(r["x"], r["y"], r["z"]) for r in made.where("box = 1 AND part = 0").collect()}
    assert len(ring) == 32 and all(y == 1.0 and (abs(x) == 0.5 or abs(z) == 1.5) for x, y, z in ring)


def test_box_lines_of_boxes_without_a_corner(spark):
    box = spark.range(1).select(F.col("id").alias("box"), *[F.lit(1.0).alias(c) for c in ("lx", "ly", "lz")])
    made = generators.box_lines(generators.box_corners(box).where("vertex <> 0"), eps=0.25)
    # a ring of corners 1, 5, 4 (two sides and a diagonal of floor(1.41 / 0.25) steps), a whole ring, and three struts
    assert rows(made.groupBy("part").count(), "part") == [(0, 4 + 4 + 5), (1, 16), (2, 9)]


def _cloud(spark, at, name):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], f"{name} long, x double, y double, z double")


def _joined_rows(df):
    """Rows that the joins of a query make, once it has run."""
    df.collect()
    todo, rows_out = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        if "Join" in kind:
            rows_out += node.metrics().get("numOutputRows").get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows_out


def test_neighbors_in_a_wide_radius_cost_what_near_ones_do(spark):
    n = 2000
    at = np.random.default_rng(6).normal(0, 0.12, (n, 3))
    got = align.nearest_neighbors(_cloud(spark, at + 0.004, "i"), _cloud(spark, at, "j"), radius=0.3)
    assert _joined_rows(got) < 30 * n  # of n * n pairs some 1.2 million are within the radius
    copies = align.nearest_neighbors(_cloud(spark, at[:300], "i"), _cloud(spark, np.repeat(at[:2], 500, axis=0), "j"), radius=2.0)
    assert _joined_rows(copies) < 30 * 300
    assert {r["j"] for r in copies.collect()} == {0, 500}


@pytest.mark.parametrize("levels", [None, 0, 7])
def test_neighbors_within_a_radius_equal_brute_force(spark, levels):
    draw = np.random.default_rng(7)
    tight = draw.normal(0, 1e-6, (60, 3))
    cases = [
        (draw.integers(-4, 5, (80, 3)) / 2, draw.integers(-4, 5, (200, 3)) * 1.0, 1.5),  # many ties, and cells' borders
        (np.r_[tight, draw.normal(0, 1, (20, 3))], np.r_[tight + [0.01, 0, 0], draw.normal(0, 1, (40, 3)), [[1e9, 0, 0]]], 0.5),
        (draw.normal(0, 1, (30, 3)) + [3, 0, 0], draw.normal(0, 1, (300, 3)), 2.0),  # mostly outside
        (1e8 + draw.integers(0, 30, (50, 3)) / 8, 1e8 + draw.integers(0, 30, (200, 3)) / 8, 3.0),
        (np.zeros((2, 3)), np.array([[0.5, 0, 0], [-0.5, 0, 0], [0, 0.5, 0]]), 0.5),  # just within
    ]
    for s, d, radius in cases:
        want = {}
        for i, p in enumerate(s):
            d2 = ((p - d) ** 2) @ np.ones(3)
            if d2.min() <= radius * radius:
                want[i] = int(d2.argmin())
        got = align.nearest_neighbors(_cloud(spark, s, "i"), _cloud(spark, d, "j"), radius=radius, levels=levels).collect()
        assert {r["i"]: r["j"] for r in got} == want and len(got) == len(want)


def test_closest_point_rounds_leave_settings_alone(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    at = np.random.default_rng(8).normal(0, 0.12, (300, 3))
    found = align.iterative_closest_point(_cloud(spark, at, "i"), _cloud(spark, at + [0.01, 0, -0.01], "j"), max_distance=0.3)
    assert np.allclose(found.translation, [0.01, 0, -0.01], atol=1e-6) and np.allclose(found.rotation, np.eye(3), atol=1e-6)
    assert found.matches.where("i = j").count() == 300
    assert spark.conf.get(key, None) == before
