import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import measure, registration, sampling
from gaugeframe.operators import neighbourhood as nb
from gaugeframe.operators.gates import Requirements, Roi
from gaugeframe.schemas import ERROR_CODES, metric, result_row
from gaugeframe.sources import grids
from gaugeframe.sources.grids import Meta


def grid(spark, rows, cols, values, **meta):
    return grids.from_flat(spark, "g", Meta(rows, cols, frame_id="sensor-top", **meta), values)


def one(df):
    got = df.collect()
    assert len(got) == 1
    return got[0]


THICK = [1.0, 1.1, 1.2, 1.3, None, 1.4]


def test_thickness_fixture(spark):
    m, c = grid(spark, 2, 3, THICK)
    r = one(measure.thickness(m, c, 1.0, 1.5, requirements=Requirements("mm", "mm", "sensor-top"), min_samples=5, min_coverage=0.8))
    assert (r.success, r.total, r.valid, r.missing) == (True, 6, 5, 1)
    assert r.coverage == pytest.approx(5 / 6) and r.mean_h == pytest.approx(1.2) and r.range_h == pytest.approx(0.4)


@pytest.mark.parametrize(
    "code,kw",
    [
        ("InputContractMismatch", {"requirements": Requirements("mm", "um", "sensor-top")}),
        ("InputContractMismatch", {"requirements": Requirements("mm", "mm", "Sensor-top")}),
        ("InvalidRoi", {"roi": Roi(1, 0, 2, 3)}),
        ("InvalidRoi", {"roi": Roi(-1, 0, 2, 3)}),
        ("InvalidParameter", {"low": 2.0}),
        ("InvalidParameter", {"min_samples": 0}),
        ("InsufficientValidSamples", {"min_samples": 6}),
        ("InsufficientValidCoverage", {"min_coverage": 0.9}),
    ],
)
def test_gates_in_order(spark, code, kw):
    m, c = grid(spark, 2, 3, THICK)
    r = one(measure.thickness(m, c, kw.pop("low", 1.0), 1.5, **kw))
    assert r.error_code == ERROR_CODES[code] and not r.success and r.outcome == "NotMeasured"


def test_limits_pass_and_out_of_tolerance_keeps_metrics(spark):
    m, c = grid(spark, 2, 3, THICK)
    assert one(measure.thickness(m, c, 1.0, 1.4)).success
    r = one(measure.thickness(m, c, 1.1, 1.3))
    assert (r.n_below, r.n_above, r.success, r.has_measurement, r.outcome, r.status) == (1, 1, False, True, "OutOfTolerance", "Failed")


def test_result_row_and_metric_case(spark):
    m, c = grid(spark, 2, 3, THICK)
    out = result_row(measure.thickness(m, c, 1.0, 1.5), "thickness", {"mean_h": "mm"})
    assert one(out.select(metric("Mean_H").alias("v"))).v == pytest.approx(1.2)
    bad = result_row(measure.thickness(m, c, 1.0, 1.5, min_samples=9), "thickness", {"mean_h": "mm"})
    r = one(bad.select("*", metric("mean_h").alias("v")))
    assert r.v is None and r.metrics == {} and r.message == "InsufficientData"


def test_meta_and_heights_are_checked(spark):
    with pytest.raises(ValueError):
        Meta(0, 3)
    with pytest.raises(ValueError):
        Meta(2, 3, col_pitch=0.0)
    with pytest.raises(ValueError):
        grid(spark, 2, 3, [1.0])
    _, c = grid(spark, 1, 3, [float("nan"), 1.0, None])
    assert [r.h for r in c.orderBy("col").collect()] == [None, 1.0, None]
    _, c = grid(spark, 1, 2, [float("inf"), 1.0])
    with pytest.raises(Exception, match="infinite"):
        c.collect()


def test_plane_is_recovered(spark):
    m, c = grid(spark, 3, 3, [0.5 * col - 0.25 * row + 2 for row in range(3) for col in range(3)])
    r = one(measure.warpage(m, c, 1e-9))
    assert r.slope_x == pytest.approx(0.5, abs=1e-12) and r.slope_y == pytest.approx(-0.25, abs=1e-12) and r.intercept == pytest.approx(2, abs=1e-12)
    assert r.peak_to_valley == pytest.approx(0, abs=1e-10) and r.success


def test_warpage_is_translation_invariant(spark):
    v = [math.sin(i) for i in range(30)]
    a = one(measure.warpage(*grid(spark, 5, 6, v), 1.0))
    b = one(measure.warpage(*grid(spark, 5, 6, [x + 100 for x in v]), 1.0))
    assert a.peak_to_valley == pytest.approx(b.peak_to_valley, abs=1e-9)


def test_degenerate_geometry(spark):
    m, c = grid(spark, 1, 5, [1.0, 2.0, 3.0, 4.0, 5.0])
    assert one(measure.warpage(m, c, 1.0)).error_code == ERROR_CODES["DegenerateGeometry"]


def test_region_summary_distribution_fixtures(spark):
    m, c = grid(spark, 3, 3, [1, 2, None, 4, 5, 6, 7, 8, 9])
    r = one(measure.region_statistics(m, c, Roi(1, 0, 2, 2)))
    assert (r.valid, r.sum_h, r.mean_h, r.coverage) == (4, 24, 6, 1)
    _, c = grid(spark, 1, 6, [0, 1, 2, None, 3, 4])
    r = one(measure.grid_summary(c, 2))
    assert (r.valid, r.zeros, r.non_finite, r.min_h, r.max_h, r.mean_h, r.peak_bin, r.peak_n) == (4, 1, 1, 1, 4, 2.5, 0, 2)
    _, c = grid(spark, 1, 5, [1, 2, None, 3, 4])
    assert [r.n for r in measure.histogram(c, "grid_id", "h", 2).orderBy("bin").collect()] == [2, 2]
    _, c = grid(spark, 1, 3, [7, 7, 7])
    assert [r.n for r in measure.histogram(c, "grid_id", "h", 3).orderBy("bin").collect()] == [3, 0, 0]


def test_completeness_fixture(spark):
    _, c = grid(spark, 4, 4, [10.0] * 8 + [11.0, 11.0, None, None] + [10.0] * 4)
    got = measure.completeness(c, Roi(0, 0, 1, 2), (2, 0), (1, 2), (1, 2), (1, 2), 0.5, 0.0, 2.0).orderBy("part_col").collect()
    assert [(r.disposition, r.relative) for r in got] == [("Pass", 1.0), ("Fail", None)]


def test_roles_repeatability(spark):
    rows = [("s", 0, "good-1", "Good", 2.0), ("s", 1, "good-1", "Good", 4.0), ("s", 2, "bad-1", "Bad", -10.0), ("s", 3, "bad-2", "Bad", 20.0)]
    obs = spark.createDataFrame(rows, "series_id string, idx int, sample_id string, role string, value double")
    got = {r.role: r for r in measure.evidence_by_role(obs).collect()}
    assert (got["Good"].samples, got["Good"].std_v, got["Bad"].samples, got["HeldOut"].n, got["HeldOut"].mean_v) == (1, 1.0, 2, 0, None)
    r = one(measure.repeatability(spark.createDataFrame([(1, v) for v in (10.0, 12.0, 14.0, 16.0)], "k int, v double"), "k", "v"))
    assert r.std_v == pytest.approx(2.581988897471611) and r.six_sigma == pytest.approx(15.491933384829668) and r.range_v == 6
    assert measure.repeatability(spark.createDataFrame([(1, 5.0)], "k int, v double"), "k", "v").collect() == []


def test_dual_thickness_gap_section(spark):
    p = [("s", i, float(x), h, float(z), h) for h in (10.0, 15.0) for i, (x, z) in enumerate([(0, 0), (1, 0), (0, 1), (1, 1)])]
    pts = spark.createDataFrame(p, "set_id string, ord long, x double, y double, z double, raw_h double")
    r = one(measure.dual_thickness(pts.where("y = 10"), pts.where("y = 15"), 4.0, 6.0))
    assert (r.mean_t, r.range_t, r.passed) == (5, 0, True)
    r = one(measure.flatness(pts.where("y = 10"), pts.where("y = 15"), 0.0))
    assert r.min_d == pytest.approx(5) and r.flatness == 0 and (r.min_ord, r.max_ord, r.passed) == (0, 0, True)
    r = one(measure.volume(pts.where("y = 10"), pts.where("y = 15"), 0.5, 10.0, 0.1))
    assert (r.above, r.below, r.net, r.passed) == (10, 0, 10, True)
    s = spark.createDataFrame([("s", -1.5, 10.0), ("s", 0.5, 15.0), ("s", 3.5, 5.0)], "set_id string, u double, h double")
    r = one(measure.cross_section(s, "set_id", "u", "h", 5.0, 0.1, 10.0, 0.1))
    assert (r.width, r.height_range, r.passed) == (5, 10, True)
    a = spark.createDataFrame([("s", 0.0, 100.0), ("s", 2.0, 100.0)], "set_id string, u double, h double")
    b = spark.createDataFrame([("s", 3.0, 104.0), ("s", 5.0, 104.0)], "set_id string, u double, h double")
    r = one(measure.gap_flush(a, b, "set_id", "u", "h", 1.0, 0.0, 4.0, 0.0))
    assert (r.gap, r.flush, r.gap_ok, r.flush_ok) == (1, 4, True, True)


def test_roi_mean_fixture(spark):
    px = spark.createDataFrame([("i", y, x, 10 if x < 4 else 100) for y in range(4) for x in range(8)], "image_id string, y int, x int, v int")
    got = {r.roi: r.value for r in measure.roi_means(px, [("a", 0, 0, 4, 4), ("b", 4, 0, 4, 4)]).collect()}
    assert got == {"a": 10.0, "b": 100.0}
    assert one(measure.roi_means(px, [("all", 0, 0, 8, 4)], True)).value == 45.0


def values(df):
    return [r.h for r in df.orderBy("row", "col").collect()]


def test_median_fixtures(spark):
    _, c = grid(spark, 3, 3, [1.0] * 4 + [100.0] + [1.0] * 4)
    out = nb.median_filter(c, 3)
    assert values(out) == [1.0] * 9 and out.where("changed").count() == 1
    _, c = grid(spark, 3, 1, [1.0, None, 5.0])
    assert values(nb.median_filter(c, 3)) == [1.0, None, 5.0]
    _, c = grid(spark, 2, 2, [1.0, 2.0, 3.0, 4.0])
    assert values(nb.median_filter(c, 3)) == [2.5] * 4
    with pytest.raises(ValueError):
        nb.median_filter(c, 4)


@pytest.mark.parametrize("spike,kept", [(100.0, None), (21.0, 21.0)])
def test_outlier_limit_is_strict(spark, spike, kept):
    _, c = grid(spark, 3, 3, [1.0] * 4 + [spike] + [1.0] * 4)
    out = nb.outlier_filter(c, 3, 20.0, 3)
    assert values(out)[4] == kept
    assert [(r.row, r.col) for r in out.where("outlier").collect()] == ([] if kept else [(1, 1)])


def test_edges_fixture(spark):
    _, c = grid(spark, 3, 4, [0, 5, 15, 25, 0, 7, 17, 27, 0, 9, 19, 29])
    assert [(r.line, r["at"], r.delta) for r in nb.step_edges(c, 10.0, "Rising").orderBy("line").collect()] == [(0, 1, 10), (1, 1, 10), (2, 1, 10)]


def test_level_surface_fixture(spark):
    _, c = grid(spark, 4, 4, [10 + 2 * col - 0.5 * row for row in range(4) for col in range(4)])
    out = values(nb.level_surface(c, [Roi(0, 0, 3, 4), Roi(2, 0, 2, 4)], 12))
    assert max(out) - min(out) < 1e-9 and out[0] == pytest.approx(10 + 3 - 0.75)


def test_threshold_fixture(spark):
    obs = spark.createDataFrame([("s", v, ok) for v, ok in ((2.0, True), (4.0, True), (-10.0, False), (20.0, False))], "k string, v double, ok boolean")
    got = {r.kind: r for r in sampling.threshold_candidates(obs, "k", "v", "ok").collect()}
    assert (got["Minimum"].lo, got["Minimum"].errors) == (2.0, 1)
    assert (got["Maximum"].hi, got["Maximum"].errors) == (4.0, 1)
    assert (got["Range"].lo, got["Range"].hi, got["Range"].errors) == (2.0, 4.0, 0)


def test_reject_all(spark):
    obs = spark.createDataFrame([("s", 1.0, False), ("s", 2.0, False)], "k string, v double, ok boolean")
    got = {r.kind: r for r in sampling.threshold_candidates(obs, "k", "v", "ok").collect()}
    assert got["Minimum"].reject_all and got["Maximum"].reject_all and got["Minimum"].errors == 0


AXES = ((0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
PT = "set_id string, ord long, row int, col int, x double, y double, z double"


def test_regrid_fixtures(spark):
    p = spark.createDataFrame([("s", 0, 2, 4, 0.1, 0.1, 10.0), ("s", 1, 2, 5, 1.1, 0.1, 20.0), ("s", 2, 3, 4, 0.1, 1.1, 30.0)], PT)
    cells, report = registration.regrid(p, *AXES, 2, 2, 1.0, 1.0, 0.70)
    assert [r.h for r in cells.orderBy("grid_row", "grid_col").collect()] == [10, 20, 30, None]
    r = one(report)
    assert (r.coverage, r.accepted, r.collisions, r.n_out) == (0.75, True, 0, 0)
    p = spark.createDataFrame([("s", 0, 9, 9, 0.75, 0.5, 90.0), ("s", 1, 3, 8, 0.25, 0.5, 30.0), ("s", 2, 3, 7, 0.25, 0.5, 20.0)], PT)
    cells, report = registration.regrid(p, *AXES, 1, 1, 1.0, 1.0)
    r = one(cells)
    assert (r.source_row, r.source_col, r.h, one(report).collisions) == (3, 7, 20.0, 2)
    out = spark.createDataFrame([("s", 0, 0, 0, 1.5, 0.5, 1.0), ("s", 1, 0, 1, 0.5, 0.5, 1.0)], PT)
    cells, report = registration.regrid(out, *AXES, 1, 1, 1.0, 1.0)
    assert cells.collect() == [] and not one(report).accepted
    with pytest.raises(ValueError):
        registration.regrid(out, *AXES, 4096, 4096, 1.0, 1.0)


def test_reconstruct_fixture(spark):
    _, c = grid(spark, 2, 2, [1.0, 2.0, 3.0, None])
    got = registration.reconstruct(c, (10.0, -4.0, 2.0), (1, 0, 0), (0, 0, 1), (0, 1, 0), 2.0, 3.0).orderBy("row", "col").collect()
    assert len(got) == 3 and tuple(got[0])[3:] == (1.0, 1.5, 11.0, -3.0, 3.5)


def test_affine_locators(spark):
    p = spark.createDataFrame([("s", 0, 0, 0, 1.0, 2.0, 3.0), ("s", 1, 0, 0, 1.0, 2.0, 3.0), ("t", 0, 0, 0, 1.0, 2.0, 3.0)], PT)
    m = [1.0, 0, 0, 10, 0, 1, 0, 20, 0, 0, 1, 30]
    got = {(r.set_id, r.ord): (r.ok, r.x) for r in registration.affine_apply(p, m).collect()}
    assert got == {("s", 0): (False, None), ("s", 1): (False, None), ("t", 0): (True, 11.0)}


def test_plane_report_worst_sample(spark):
    rng = np.random.default_rng(1)
    p = rng.random((40, 3))
    pts = spark.createDataFrame([("s", i, *map(float, q), float(q[1])) for i, q in enumerate(p)], "set_id string, ord long, x double, y double, z double, raw_h double")
    r = one(measure.plane_report(pts))
    a, *_ = np.linalg.lstsq(np.c_[p[:, 0], p[:, 2], np.ones(40)], p[:, 1], rcond=None)
    assert (r.a, r.b, r.c) == pytest.approx(tuple(a), abs=1e-9)
    e = np.abs(p[:, 1] - a[0] * p[:, 0] - a[1] * p[:, 2] - a[2])
    assert r.worst_ord == int(np.argmax(e))


def test_percentile_is_nearest_rank(spark):
    v = [float(i) for i in range(1, 8)]
    df = spark.createDataFrame([(1, x) for x in v], "k int, v double")
    for p in (0.1, 0.5, 0.9):
        assert one(measure.percentile_rank(df, "k", "v", p)).value == v[math.ceil(p * 7) - 1]


def test_rms_does_not_overflow(spark):
    df = spark.createDataFrame([(1e200,), (1e200,)], "v double")
    assert one(df.agg(measure.rms(F.col("v")).alias("r"))).r == pytest.approx(1e200)
