import numpy as np
import pandas as pd
import pytest

from gaugeframe.operators import images as im
from gaugeframe.operators import meshes
from gaugeframe.operators import near, sampling
from gaugeframe.operators import sequential as sq

RNG = np.random.default_rng(7)


def test_claims_are_greedy_and_unique():
    scene = np.array([[0, 0, 0], [1, 0, 0], [1, 0, 0]], float)
    got = sq.claim_nearest(np.array([[0.9, 0, 0], [1, 0, 0], [1, 0, 0], [5, 5, 5]], float), scene, 0.5)
    assert [(i, j) for i, j, _ in got] == [(0, 1), (1, 2)]
    assert sq.claim_nearest(scene, np.zeros((0, 3)), 1.0) == []
    assert sq.claim_nearest(np.zeros((1, 3)), np.array([[0.5, 0, 0]]), 0.5)[0][2] == 0.5


def test_coverage_of_an_empty_scene(spark):
    m = spark.createDataFrame([("s", 0, 0.0, 0.0, 0.0)], "set_id string, ord long, x double, y double, z double")
    r = sq.coverage(m, m.where("ord > 5"), 1.0).first()
    assert (r.samples, r.matched, r.ratio, r.rmse) == (1, 0, 0.0, None)


def test_farthest_points():
    p = np.array([[0, 0, 0], [1, 0, 0], [10, 0, 0], [5, 0, 0], [5, 0, 0]], float)
    assert sq.farthest(p, 3, 0.0) == [0, 2, 3] and sq.farthest(p, 9, 4.9) == [0, 2, 3] and sq.farthest(p, 9, 5.0) == [0, 2]
    assert sq.farthest(np.zeros((0, 3)), 3, 0.0) == []


def test_line_fixture():
    d = np.array([0.5, 0.25, 1.0])
    p = np.array([i * d for i in range(8)] + [[3, 9, 1], [-4, 2, 2]])
    fit = sq.robust_line(p, 0.05, 6, 0.6, 5.0)
    assert fit["inliers"].sum() == 8 and np.allclose(np.abs(fit["direction"]), d / np.linalg.norm(d))
    assert sq.robust_line(p, 0.05, 9, 0.6, 5.0) is None
    assert len(sq.hypothesis_pairs(100, "ab")) == 256 and sq.hypothesis_pairs(100, "ab") == sq.hypothesis_pairs(100, "AB")


def test_affine_fixture():
    a = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float)
    b = np.array([[10, 20, 30], [12, 19, 30.2], [10.5, 23, 29.7], [9.75, 20.75, 34]], float)
    m, _ = sq.solve_affine(a, b)
    assert np.allclose(m, np.c_[b[1] - b[0], b[2] - b[0], b[3] - b[0], b[0]])
    assert sq.solve_affine(a * [1, 1, 0], b) is None
    assert sq.tetrahedron(a)[0] == 3 and sq.tetrahedron(a * [1, 1, 0])[0] == 2


def test_pose_fixture(spark):
    model = np.array([[0, 0, 0], [2, 0, 0], [0, 3, 0], [4, 1, 0], [1, 5, 0]], float)
    scene = model @ sq.euler(0, 0, 30).T + [10, -4, 2]
    found = sq.poses(spark, [(0.0, 0.0, 1.0), (0.0, 0.0, 1.0), (-45.0, 45.0, 15.0)])
    assert found.count() == 7
    r = sq.best_pose(sq.pose_search(found, model, scene, 0.05), 3).first()
    assert (r.matched, r.rz) == (5, 30.0) and (r.tx, r.ty, r.tz) == pytest.approx((10, -4, 2), abs=1e-12)
    with pytest.raises(ValueError):
        sq.poses(spark, [(0.0, 360.0, 1.0)] * 3)


def test_poses_enumerate_in_order(spark):
    got = [tuple(r)[1:] for r in sq.poses(spark, [(0.0, 1.0, 1.0), (0.0, 2.0, 1.0), (5.0, 6.0, 0.5)]).orderBy("index").collect()]
    assert got == [(x, y, z) for x in (0.0, 1.0) for y in (0.0, 1.0, 2.0) for z in (5.0, 5.5, 6.0)]


def test_multiple_instances():
    model = np.array([[0, 0, 0], [1, 0, 0], [0, 2, 0]], float)
    scene = np.vstack([model + 5, model + [9, 0, 0], [[50, 0, 0]]])
    got = sq.multiple_matches([np.eye(3)], model, scene, 0.01, 3, 5)
    assert [m for _, m, _ in got] == [3, 3]


def test_signs_at_faces_and_edges():
    t = np.array([[[0, 0, 0], [2, 0, 0], [0, 2, 0]]], float)
    d, k, s = sq.robust_sign(np.array([0.5, 0.5, 1.0]), t, np.array([7]))
    assert (d, k, s) == (1.0, 7, 1.0)
    d, k, s = sq.robust_sign(np.array([1.0, -1.0, 1.0]), t, np.array([7]))
    assert d == pytest.approx(2**0.5) and s == 1.0


def test_nearest_triangle_equals_numpy(spark):
    tri, pts = RNG.random((6, 9)), RNG.random((15, 3)) * 2 - 0.5
    cols = ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz")
    t = spark.createDataFrame([("m", i, *map(float, r)) for i, r in enumerate(tri)], f"mesh_id string, tri_id int, {cols}")
    p = spark.createDataFrame([("m", "s", i, *map(float, r)) for i, r in enumerate(pts)], "mesh_id string, set_id string, ord long, x double, y double, z double")
    for r in meshes.nearest_triangle(p, t).collect():
        q = pts[r.ord]
        all_ = [(np.linalg.norm(q - sq._closest(q, *x.reshape(3, 3))[0]), i, sq._closest(q, *x.reshape(3, 3))[1]) for i, x in enumerate(tri)]
        d, i, f = min(all_)
        assert r.distance == pytest.approx(d, abs=1e-9) and r.tri_id == i and r.feature == f


def test_large_meshes_keep_all_points(spark, monkeypatch):
    monkeypatch.setattr(meshes, "PER_CELL", 4)
    r = np.random.default_rng(3)
    tri = (r.random((300, 1, 3)) * 4 + r.random((300, 3, 3)) * 0.5).reshape(300, 9)
    pts = r.random((40, 3)) * 6 - 1
    cols = ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz")
    t = spark.createDataFrame([("m", i, *map(float, x)) for i, x in enumerate(tri)], f"mesh_id string, tri_id int, {cols}")
    p = spark.createDataFrame([("m", "s", i, *map(float, x)) for i, x in enumerate(pts)], "mesh_id string, set_id string, ord long, x double, y double, z double")
    met = meshes._candidates(p, t)
    assert met.count() < 40 * 300 / 3
    got = meshes.nearest_triangle(p, t).collect()
    assert len(got) == 40
    for k in got:
        near, _ = sq._closest_all(pts[k.ord], tri.reshape(-1, 3, 3))
        d = np.linalg.norm(near - pts[k.ord], axis=1)
        assert k.tri_id == d.argmin() and k.distance == pytest.approx(d.min(), abs=1e-9)
    one = [sq._closest(pts[0], *x.reshape(3, 3))[0] for x in tri]
    assert np.allclose(one, sq._closest_all(pts[0], tri.reshape(-1, 3, 3))[0])


def test_mesh_queries_take_all_points(spark, small):
    from gaugeframe import queries_geometry, queries_kernels

    n = queries_geometry.grids.points(spark, small).count()
    got = queries_geometry.QUERIES["c3_point_to_mesh"](spark, small).collect()
    assert len(got) == n and max(r.tri_id for r in got) > 80 and min(r.distance for r in got) < 0.5
    signs = {(r.mesh_id, r.ord): r for r in queries_kernels.QUERIES["c4_robust_sign"](spark, small).collect()}
    assert len(signs) == n and all(signs[r.mesh_id, r.ord].distance == pytest.approx(r.distance, abs=2e-5) for r in got)


@pytest.fixture(scope="module")
def ragged(spark, small, tmp_path_factory):
    """The small embeddings up to a last set of 54 points, so that sets, grids and fours end early."""
    d = str(tmp_path_factory.mktemp("ragged"))
    spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id < 454").write.parquet(f"{d}/embeddings.parquet")
    return d


def test_robust_signs_of_a_short_last_mesh(spark, ragged):
    from gaugeframe import queries_geometry, queries_kernels

    near_ = {(r.mesh_id, r.ord): r for r in queries_geometry.QUERIES["c3_point_to_mesh"](spark, ragged).collect()}
    got = {(r.mesh_id, r.ord): r for r in queries_kernels.QUERIES["c4_robust_sign"](spark, ragged).collect()}
    assert len(got) == 454 and set(got) == set(near_)
    rows = queries_geometry.grids.points(spark, ragged).where("set_id = 's4'").orderBy("ord").select("x", "y", "z", "raw_h").toPandas().to_numpy(float)
    tri = np.stack([rows[:-2, :3], rows[1:-1, :3], rows[2:, :3]], axis=1)
    for o, (x, y, z, h) in enumerate(rows):
        d, k, s = sq.robust_sign(np.array([x, y, z + h]), tri, np.arange(52))
        r = got["s4", o]
        assert (r.distance, r.tri_id, r.sign) == (pytest.approx(d, abs=1e-5), k, s) and near_["s4", o].distance == pytest.approx(d, abs=1e-5)


def test_robust_signs_without_coordinates(spark):
    cols = ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz")
    t = spark.createDataFrame([("m", 3, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 2.0, 0.0), ("m", 4, *[0.0] * 6, None, None, None), ("n", 1, *[None] * 9)], f"mesh_id string, tri_id int, {cols}")
    p = spark.createDataFrame([("m", 0, 0.5, 0.5, -1.0), ("m", 1, None, 0.5, 1.0), ("n", 0, 0.5, 0.5, 1.0), ("o", 0, 0.5, 0.5, 1.0)], "mesh_id string, ord long, x double, y double, z double")
    got = {tuple(r) for r in sq.robust_signs(p, t).collect()}
    assert got == {("m", 0, 1.0, 3, -1.0), ("m", 1, None, None, None), ("n", 0, None, None, None)}


def test_mesh_comparison_fixture(spark):
    cols = ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz")
    t = spark.createDataFrame([("m", 3, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 2.0, 0.0)], f"mesh_id string, tri_id int, {cols}")
    p = spark.createDataFrame([("m", "s", 0, 0.5, 0.5, 1.0), ("m", "s", 1, 0.5, 0.5, -2.0)], "mesh_id string, set_id string, ord long, x double, y double, z double")
    r = meshes.compare(meshes.nearest_triangle(p, t), -1.5, 1.5).first()
    assert (r.below, r.inside, r.above, r.mean_distance, r.mean_signed, r.success) == (1, 1, 0, 1.5, -0.5, True)
    edge = spark.createDataFrame([("m", "s", 0, 1.0, -1.0, 1.0)], "mesh_id string, set_id string, ord long, x double, y double, z double")
    assert not meshes.compare(meshes.nearest_triangle(edge, t), -9.0, 9.0).first().success


def test_mesh_comparison_recovers_signs(spark):
    cols = ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz")
    t = spark.createDataFrame([("m", 3, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 2.0, 0.0)], f"mesh_id string, tri_id int, {cols}")
    at = [(0.5, 0.5, 1.0), (1.0, -1.0, 1.0), (1.0, -1.0, -1.0), (1.0, -1.0, 0.0), (-3.0, -4.0, 0.5)]
    p = spark.createDataFrame([("m", "s", i, *x) for i, x in enumerate(at)], "mesh_id string, set_id string, ord long, x double, y double, z double")
    near = meshes.recover_signs(meshes.nearest_triangle(p, t), p, t)
    got = {r.ord: (r.signed, r.recovered) for r in near.collect()}
    assert got[0] == (1.0, False) and [got[i][1] for i in (1, 2, 3, 4)] == [True] * 4
    assert got[1][0] == pytest.approx(2**0.5) and got[2][0] == pytest.approx(-(2**0.5)) and got[3][0] == 1.0
    r = meshes.compare(near, -1.2, 1.2).first()
    assert (r.n, r.direct, r.recovered, r.unresolved, r.below, r.inside, r.above, r.success) == (5, 1, 4, 0, 1, 2, 2, True)
    r = np.random.default_rng(8)
    tri, pts = r.random((30, 3, 3)), r.random((40, 3)) * 2 - 0.5
    t = spark.createDataFrame([("m", i, *map(float, x.ravel())) for i, x in enumerate(tri)], f"mesh_id string, tri_id int, {cols}")
    p = spark.createDataFrame([("m", "s", i, *map(float, x)) for i, x in enumerate(pts)], "mesh_id string, set_id string, ord long, x double, y double, z double")
    for k in meshes.recover_signs(meshes.nearest_triangle(p, t), p, t).collect():
        d, _, sign = sq.robust_sign(pts[k.ord], tri, np.arange(30))
        assert k.signed == pytest.approx(sign * d, abs=1e-9)


def test_square_edges_fixture(spark):
    v = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    rows = [("m", k, *i, *[c for j in i for c in (*v[j], 0.0)]) for k, i in enumerate([(0, 1, 2), (0, 2, 3)])]
    cols = ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz")
    t = spark.createDataFrame(rows, f"mesh_id string, tri_id int, i0 int, i1 int, i2 int, {cols}")
    got = sorted((r.lo, r.hi, r.kind) for r in meshes.edges(t, 0.1, 1.0).collect())
    assert got == [(0, 1, "Boundary"), (0, 3, "Boundary"), (1, 2, "Boundary"), (2, 3, "Boundary")]


def test_near_join_equals_all_pairs(spark):
    a, b = RNG.random((30, 3)), RNG.random((40, 3))
    frame = lambda p: spark.createDataFrame([("s", i, *map(float, q)) for i, q in enumerate(p)], "set_id string, ord long, x double, y double, z double")
    got = {r.model: (r.scene, r.distance) for r in near.nearest(frame(a), frame(b), 0.15).collect()}
    for i, q in enumerate(a):
        d = np.linalg.norm(b - q, axis=1)
        j = int(np.argmin(d))
        assert (i in got) == (d[j] <= 0.15)
        if i in got:
            assert got[i][0] == j and got[i][1] == pytest.approx(d[j])


def test_feature_matches_cover_the_whole_table(spark, small, monkeypatch):
    from gaugeframe.queries_kernels import QUERIES

    monkeypatch.setattr(near, "QUERY_BLOCK", 10)
    monkeypatch.setattr(near, "TRAIN_BLOCK", 100)
    e = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    train = sorted(i for i in e if i % 20)
    got = {r["query"]: r for r in QUERIES["j11_feature_match"](spark, small).collect()}
    assert sorted(got) == sorted(i for i in e if i % 20 == 0)
    for i, r in got.items():
        d = sorted((float(np.linalg.norm(e[i] - e[j])), j) for j in train)
        assert r.train == d[0][1] and r.distance == pytest.approx(d[0][0], abs=1e-6) and r.good == (d[0][0] < 0.9 * d[1][0])


def test_large_sets_draw_seeded_pairs(spark):
    rows = [(k, i, float(i), 0.0, 0.0) for k, n in (("few", 23), ("many", 24), ("large", 300)) for i in range(n)] + [("same", i, 0.0, 0.0, float(i > 28)) for i in range(30)]
    got = {}
    for r in near.pairs(spark.createDataFrame(rows, "set_id string, ord long, x double, y double, z double")).collect():
        got.setdefault(r.set_id, []).append((r.i, r.j))
    assert sorted(got["few"]) == [(i, j) for i in range(23) for j in range(i + 1, 23)]
    assert sorted(got["many"]) == sorted(sq.hypothesis_pairs(24, "many")) and sorted(got["large"]) == sorted(sq.hypothesis_pairs(300, "large"))
    assert sorted(got["same"]) == [(i, 29) for i in range(29)]


def test_line_fits_and_matches_take_all_points(spark, small, monkeypatch):
    from gaugeframe import queries_kernels as k

    assert all(r.inliers > 40 for r in k.QUERIES["i2_line_fit"](spark, small).collect())
    monkeypatch.setattr(sq, "instances", lambda groups, *_: groups)
    sides = k.QUERIES["i9_multiple_matches"](spark, small).groupBy("set_id").pivot("side", [0, 1]).count().collect()
    assert {(r["0"], r["1"]) for r in sides} == {(3, 100)}


def test_representative_images_are_not_claimed():
    from gaugeframe.queries_kernels import QUERIES

    assert "a7_representative_images" not in QUERIES


def test_suppression():
    rows = pd.DataFrame({"kind": ["a", "a", "b", "a"], "x": [0, 1, 0, 50], "y": [0, 0, 0, 0], "w": [10] * 4, "h": [10] * 4, "score": [0.9, 0.95, 0.5, 0.1]})
    assert sq.suppress(rows, 0.5, 9) == [1, 2, 3] and sq.suppress(rows, 0.5, 1) == [1]
    assert sq.suppress_near(rows, 0.5) == [1, 3]
    assert sq.iou((0, 0, 2, 2), (1, 0, 2, 2)) == pytest.approx(1 / 3)
    assert [(y, x) for y, x, _ in sq.peaks(np.array([[5, 1, 4], [0, 0, 0]]), 3, 0, 0, 0.5)] == [(0, 0), (0, 2), (0, 1)]


def test_labels_equal_flood_fill():
    mask = RNG.random((20, 24)) > 0.6
    ids, n = im.label(mask)
    seen, count = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if not seen[y, x]:
            count += 1
            stack = [(y, x)]
            while stack:
                a, b = stack.pop()
                if 0 <= a < 20 and 0 <= b < 24 and mask[a, b] and not seen[a, b]:
                    seen[a, b] = count
                    stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert n == count and (ids == seen).all()


def drawn():
    a = np.full((60, 80), 20, np.uint8)
    a[10:30, 15:35] = 200
    a[40:50, 50:75] = 120
    return a


def test_blobs_and_masks():
    got = im.blobs(drawn(), 100, 10, 1000)
    assert [(b[1], b[4:8]) for b in got] == [(400, (15, 10, 20, 20)), (250, (50, 40, 25, 10))]
    assert len(im.blobs(drawn(), 100, 10, 1000, [(14, 9, 30, 30)])) == 1
    with pytest.raises(ValueError):
        im.blobs(drawn(), 100, 10, 1)


def test_contours_find_squares():
    got = im.contours(drawn(), 100, 10, 1000)
    assert [(c[3:7], c[7]) for c in got] == [((15, 10, 20, 20), True), ((50, 40, 25, 10), True)]
    assert im.trace(np.array([[True]])) == [(0, 0)]
    assert im.min_area_rect([(0, 0), (4, 0), (4, 2), (0, 2)])[2:4] in ((4.0, 2.0), (2.0, 4.0))


def test_corners_of_a_square():
    got = {(round(x), round(y)) for x, y, _ in im.corners(drawn()[:35, :45], 4)}
    assert len(got) == 4 and all(min(abs(x - 15), abs(x - 34)) <= 1 and min(abs(y - 10), abs(y - 29)) <= 1 for x, y in got)
    assert im.corners(np.zeros((9, 9), np.uint8)) == []


def test_template_is_found():
    a = RNG.integers(0, 255, (50, 60)).astype(np.uint8)
    got = im.match(a, a[20:32, 25:40], 90.0)
    assert got[0][1:3] == (25, 20) and got[0][-1] == pytest.approx(100, abs=1e-3)
    assert im.match(np.zeros((30, 30), np.uint8), a[:8, :8], 10.0) == []
    empty = a[:0, :5]
    assert im.match(a, empty, 10.0) == [] and im.edge_match(a, empty, 50, 150, 0.5) == [] and im.correlation(a, empty).size == 0
    score = im.correlation(a, a[5:11, 7:15])
    w = a[12:18, 9:17].astype(float)
    t = a[5:11, 7:15].astype(float)
    want = ((w - w.mean()) * (t - t.mean())).sum() / np.sqrt(((w - w.mean()) ** 2).sum() * ((t - t.mean()) ** 2).sum())
    assert score[12, 9] == pytest.approx(want, abs=1e-9)
    assert im.template_angles(-10, 10, 4) == [-8, -4, 0, 4, 8] and im.template_angles(1, 3, 5) == []


def test_edge_template_is_found():
    a = np.full((60, 80), 20, np.uint8)
    a[25:40, 30:50] = 220
    got = im.edge_match(a, a[20:45, 25:55], 50, 150, 0.9)
    assert got[0][1:3] == (25, 20) and got[0][-1] == pytest.approx(1.0)
    dark = 255 - a
    assert im.edge_match(dark, a[20:45, 25:55], 50, 150, 0.9) == []
    assert im.edge_match(dark, a[20:45, 25:55], 50, 150, 0.9, either_polarity=True)[0][1:3] == (25, 20)


def test_warps():
    a = drawn()
    assert (im.warp(a, np.array([[1.0, 0, 0], [0, 1, 0]]), 80, 60) == a).all()
    m = im.affine_from_points(np.array([[0, 0], [10, 0], [0, 10]], float), np.array([[5, 7], [15, 7], [5, 17]], float))
    assert np.allclose(m, [[1, 0, 5], [0, 1, 7]]) and im.affine_metrics(m)["rotation"] == 0
    with pytest.raises(ValueError):
        im.affine_from_points(np.array([[0, 0], [1, 1], [2, 2]], float), np.eye(3, 2))
    p = im.perspective(np.array([[0, 0], [79, 0], [79, 59], [0, 59]], float), np.array([[0, 0], [79, 0], [79, 59], [0, 59]], float))
    assert np.allclose(p, np.eye(3))
    assert im.rotate_scale(a, 50, 0).shape == (30, 40) and (im.rotate_scale(a, 100, 0) == a).all()


def test_filters():
    a = np.full((9, 9), 50, np.uint8)
    a[4, 4] = 250
    assert (im.median_blur(a, 3) == 50).all() and im.gaussian_blur(a, 3)[4, 4] < 250
    assert im.bilateral(a, 3, 5.0, 2.0)[4, 4] == 250
    edge = im.canny(np.where(np.arange(20) < 10, 0, 200)[None, :].repeat(20, axis=0).astype(np.uint8), 50, 150)
    assert set(np.nonzero(edge)[1]) <= {9, 10} and (edge.max(axis=1) == 255).all()


def test_channels():
    rgb = np.dstack([np.full((2, 3), v, np.uint8) for v in (10, 20, 30)])
    assert (im.unpack(3, 2, 3, rgb.tobytes()) == round(10 * 0.114 + 20 * 0.587 + 30 * 0.299)).all()
    for bad in ((0, 2, 1, b""), (3, 2, 2, b"x" * 12), (3, 2, 1, b"x")):
        with pytest.raises(ValueError):
            im.unpack(*bad)


def test_proposals():
    got = im.propose(RNG.integers(0, 255, (48, 48)).astype(np.uint8), 16, 8, 0.2, 3)
    assert [p[0] for p in got] == list(range(1, len(got) + 1)) and all(got[i][9] >= got[i + 1][9] for i in range(len(got) - 1))
    assert im.positions(0, 10, 4) == [0, 4, 8, 10] and im.propose(np.zeros((4, 4), np.uint8), 8, 4, 0.2, 3) == []


def test_homography_of_matches_with_strays(spark):
    rng = np.random.default_rng(2)
    src = rng.uniform(0, 200, (40, 2))
    m = np.array([[0.9, -0.2, 12.0], [0.25, 1.1, -7.0], [0.0004, -0.0003, 1.0]])
    dst = im.projected(m, src)
    dst[:12] += rng.uniform(30, 90, (12, 2))
    found, inside = im.robust_homography(src, dst, 1.0)
    assert inside.sum() == 28 and not inside[:12].any() and np.allclose(found, m, atol=1e-6)
    rows = [("a", *s, *t) for s, t in zip(src.tolist(), dst.tolist(), strict=True)] + [("few", 1.0, 2.0, 3.0, 4.0)] * 3 + [("line", float(i), float(i), float(i), 0.0) for i in range(6)]
    got = {r.set_id: r for r in im.feature_locations(spark.createDataFrame(rows, "set_id string, sx double, sy double, tx double, ty double"), 64, 48, 1.0).collect()}
    assert (got["a"].status, got["a"].good, got["a"].inliers, got["a"].score) == ("Success", 40, 28, 70.0)
    box = im.projected(m, np.array([[0.0, 0.0], [63.0, 47.0]]))
    assert np.allclose([got["a"].x, got["a"].y], box.mean(axis=0), atol=1e-5)
    assert got["few"].status == "FeatureNotEnoughMatches" and got["line"].status == "FeatureHomographyFailed"


def test_templates_of_a_table_are_found_in_their_images(spark, small, monkeypatch):
    rng = np.random.default_rng(4)
    pictures = {f"i{k}": rng.integers(0, 256, (40, 50)).astype(np.uint8) for k in range(3)}
    table = lambda rows, name: spark.createDataFrame([(k, a.shape[1], a.shape[0], 1, a.tobytes()) for k, a in rows], f"{name} string, width int, height int, channels int, data binary")
    images = table(pictures.items(), "image_id")
    templates = table([("t0", pictures["i0"][5:17, 8:24]), ("t2", pictures["i2"][20:30, 30:45])], "template_id")
    got = sorted((r.image_id, r.template_id, r.x, r.y) for r in im.match_templates(images, templates, 90.0).collect())
    assert got == [("i0", "t0", 8, 5), ("i2", "t2", 30, 20)]
    assert im.match_templates(images, templates.limit(0), 90.0).collect() == []
    monkeypatch.setattr(im, "MAX_TEMPLATE_BYTES", 10)
    with pytest.raises(ValueError, match="exceed"):
        im.match_templates(images, templates, 90.0)


def test_reversed_contrast_counts_as_a_whole():
    a = np.zeros((30, 30), np.uint8)
    a[10:20, 10:20] = 200
    t, half = a[5:25, 5:25], a.copy()
    half[10:20, 10:15], half[10:20, 15:20] = 55, 200
    model = im.edge_model(t, 40, 80)
    assert im.edge_scores(255 - a, model, t.shape, True).max() == pytest.approx(im.edge_scores(a, model, t.shape).max())
    assert im.edge_scores(255 - a, model, t.shape).max() < 0.5


def test_range_limits_equal_all_pairs(spark):
    r = np.random.default_rng(9)
    rows = [(k, float(r.integers(0, 12)), bool(r.integers(0, 2))) for k in ("a", "b", "c") for _ in range(25)] + [("one", 1.0, True), ("bad", 1.0, False)]
    got = {x.k: x for x in sampling.threshold_candidates(spark.createDataFrame(rows, "k string, v double, good boolean"), "k", "v", "good").where("kind = 'Range'").collect()}
    for k in {x[0] for x in rows}:
        own = [(v, g) for n, v, g in rows if n == k]
        values = sorted({v for v, _ in own})
        best = min((sum(g != (lo <= v <= hi) for v, g in own), sum(not g and lo <= v <= hi for v, g in own), hi - lo, -lo) for lo in values for hi in values if lo <= hi)
        assert (got[k].errors, got[k].false_accepts, got[k].hi - got[k].lo, -got[k].lo) == best


@pytest.mark.parametrize(("most", "gap"), [(454, ""), (402, ""), (401, ""), (454, " AND vec_id % 100 NOT IN (1, 2, 50)")])
def test_affine_sets_are_filled_up(spark, small, tmp_path, most, gap):
    from gaugeframe import queries_kernels

    spark.read.parquet(f"{small}/embeddings.parquet").where(f"vec_id < {most}{gap}").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries_kernels.QUERIES["i3_affine_solve"](spark, str(tmp_path)).collect()))
    last = (most - 1) % 100 // 4
    assert got == sorted((f"s{s}/{k}", True, 0.8, 1.5, 1.0, 0.0) for s in range(5) for k in range(25 if s < 4 else last + 1))
    own, filled = ({}, {})
    for held, f in ((own, queries_kernels._pairs), (filled, queries_kernels._filled_pairs)):
        for r in f(spark, str(tmp_path)).collect():
            held.setdefault(r.set_id, set()).add((r.x, r.y, r.z))
    assert min(map(len, own.values())) < 4 and set(map(len, filled.values())) == {4} and all(own[k] <= v for k, v in filled.items())
