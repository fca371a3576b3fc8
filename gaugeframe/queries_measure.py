"""Queries over derived grids, points and series: sources, gates and measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import gates, measure
from .operators.gates import Requirements, Roi
from .oracle import rounded, tidy
from .oracle import sql_round as R
from .schemas import result_row
from .sources import grids
from .sources.grids import GRID_ROWS, GRID_SQL, OBS_SQL, PIXELS_SQL, POINTS_SQL, XY_SQL

ROI = Roi(10, 8, 60, 40)
AREA = GRID_ROWS * 64
_IN = "r BETWEEN 10 AND 69 AND c BETWEEN 8 AND 47"
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    """Registers a query and, if given, its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# -- sources and gates -----------------------------------------------------------
@query("a1_grid_cells", f"WITH {GRID_SQL} SELECT grid_id, count(*) AS cells, count(h) AS valid, {R('sum(h)')} AS sum_h FROM grid GROUP BY grid_id")
def a1_grid_cells(spark, d):
    return tidy(grids.dense_grid(spark, d).groupBy("grid_id").agg(F.count("*").alias("cells"), F.count("h").alias("valid"), F.sum("h").alias("sum_h")))


@query("a2_from_rows", "SELECT 'g' || label AS grid_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS row_, CAST(i AS INTEGER) AS col_, round(CAST(embedding[i + 1] AS DOUBLE), 6) + 0.0::DOUBLE AS h FROM (SELECT label, vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings) WHERE i = 3")
def a2_from_rows(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    arrays = e.groupBy(F.concat(F.lit("g"), F.col("label").cast("string")).alias("grid_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"]).alias("values"))
    return grids.from_rows(arrays).where("col = 3").select("grid_id", F.col("row").alias("row_"), F.col("col").alias("col_"), rounded("h").alias("h"))


SQL["a2_from_rows"] = "SELECT 'g' || label AS grid_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS row_, CAST(3 AS INTEGER) AS col_, " + R("CAST(embedding[4] AS DOUBLE)") + " AS h FROM embeddings"


@query("a3_cell_coordinates", f"WITH {XY_SQL} SELECT grid_id, r AS row_, c AS col_, {R('h')} AS h, x, y FROM xy WHERE r = 5 AND c BETWEEN 3 AND 9")
def a3_cell_coordinates(spark, d):
    cells = grids.dense_grid(spark, d).where((F.col("row") == 5) & F.col("col").between(3, 9))
    return tidy(grids.with_xy(cells, grids.dense_meta(spark, d)).withColumnsRenamed({"row": "row_", "col": "col_"}))


@query("a4_copy_out", f"WITH {GRID_SQL} SELECT grid_id, CAST(count(*) AS INTEGER) AS n, {R('sum(h * (r * 64 + c))')} AS weighted FROM grid GROUP BY grid_id")
def a4_copy_out(spark, d):
    out = grids.copy_out(grids.dense_grid(spark, d))
    total = F.aggregate(F.zip_with("values", F.sequence(F.lit(0), F.size("values") - 1), lambda v, i: F.coalesce(v, F.lit(0.0)) * i), F.lit(0.0), lambda a, v: a + v)
    return tidy(out.select("grid_id", F.size("values").alias("n"), total.alias("weighted")))


@query("b1_roi_filter", f"WITH {GRID_SQL} SELECT grid_id, count(*) AS cells FROM grid WHERE {_IN} GROUP BY grid_id")
def b1_roi_filter(spark, d):
    return gates.in_roi(grids.dense_grid(spark, d), ROI).groupBy("grid_id").agg(F.count("*").alias("cells"))


@query("b2_finite_filter", f"WITH {GRID_SQL} SELECT grid_id, count(*) AS cells FROM grid WHERE h IS NOT NULL GROUP BY grid_id")
def b2_finite_filter(spark, d):
    return gates.samples(grids.dense_grid(spark, d)).groupBy("grid_id").agg(F.count("*").alias("cells"))


@query("b3_input_contract", f"WITH {GRID_SQL} SELECT grid_id, 105 AS error_code FROM grid GROUP BY grid_id")
def b3_input_contract(spark, d):
    agg = gates.samples(grids.dense_grid(spark, d)).groupBy("grid_id").agg(F.count("h").alias("valid"))
    return gates.gated(grids.dense_meta(spark, d), agg, None, Requirements("mm", "um", "sensor-top")).select("grid_id", "error_code")


def _coverage_sql(code: str) -> str:
    return f"WITH {GRID_SQL} SELECT grid_id, {AREA}::BIGINT AS total, count(h) AS valid, {AREA} - count(h) AS missing, {R(f'count(h) / {AREA}::DOUBLE')} AS coverage, {code} AS error_code FROM grid GROUP BY grid_id"


@query("b4_coverage_gate", _coverage_sql(f"CASE WHEN count(h) < 6000 THEN 130 WHEN count(h) / {AREA}::DOUBLE < 0.942 THEN 131 ELSE 0 END"))
def b4_coverage_gate(spark, d):
    agg = gates.samples(grids.dense_grid(spark, d)).groupBy("grid_id").agg(F.count("h").alias("valid"))
    return tidy(gates.gated(grids.dense_meta(spark, d), agg, min_samples=6000, min_coverage=0.942).select("grid_id", "total", "valid", "missing", "coverage", "error_code"))


@query("b5_sample_summary", _coverage_sql("0"))
def b5_sample_summary(spark, d):
    agg = gates.samples(grids.dense_grid(spark, d)).groupBy("grid_id").agg(F.count("h").alias("valid"))
    return tidy(gates.gated(grids.dense_meta(spark, d), agg, min_samples=0).select("grid_id", "total", "valid", "missing", "coverage", "error_code"))


@query("b6_tolerance", f"WITH {POINTS_SQL} SELECT set_id, count(*) FILTER (abs(y - 0.0::DOUBLE) <= 0.1::DOUBLE) AS n_within FROM points GROUP BY set_id")
def b6_tolerance(spark, d):
    return grids.points(spark, d).groupBy("set_id").agg(F.count_if(gates.within(F.col("y"), 0.0, 0.1)).alias("n_within"))


@query("b7_peak_deviation", f"WITH {GRID_SQL}, s AS (SELECT grid_id, min(h) lo, max(h) hi, avg(h) m FROM grid GROUP BY grid_id) SELECT grid_id, {R('greatest(abs(m - lo), abs(hi - m))')} AS peak, greatest(abs(m - lo), abs(hi - m)) <= 0.45::DOUBLE AS within FROM s")
def b7_peak_deviation(spark, d):
    stats = measure.region_statistics(grids.dense_meta(spark, d), grids.dense_grid(spark, d))
    return tidy(measure.peak_deviation(stats, 0.45).select("grid_id", "peak", "within"))


# -- measurements ------------------------------------------------------------------
_THICK = """SELECT grid_id, total, valid, missing, {cov} AS coverage, {lo} AS min_h, {hi} AS max_h, {m} AS mean_h, {rg} AS range_h, n_below, n_above, {code} AS error_code,
 {code} = 0 AND n_below = 0 AND n_above = 0 AS success, CASE WHEN {code} <> 0 THEN 'NotMeasured' WHEN n_below = 0 AND n_above = 0 THEN 'Passed' ELSE 'OutOfTolerance' END AS outcome,
 CASE WHEN {code} <> 0 THEN 'InsufficientData' WHEN n_below = 0 AND n_above = 0 THEN 'Passed' ELSE 'Failed' END AS status
 FROM (SELECT grid_id, {area}::BIGINT AS total, count(h) AS valid, {area} - count(h) AS missing, min(h) AS lo, max(h) AS hi, avg(h) AS m,
  count(*) FILTER (h < {low}::DOUBLE) AS n_below, count(*) FILTER (h > {high}::DOUBLE) AS n_above FROM grid{where} GROUP BY grid_id)"""


def _thickness_sql(area: int, low: float, high: float, code: str, where: str = "") -> str:
    return f"WITH {GRID_SQL} " + _THICK.format(area=area, low=low, high=high, code=code, where=where, cov=R(f"valid / {area}::DOUBLE"), lo=R("lo"), hi=R("hi"), m=R("m"), rg=R("hi - lo"))


_THICK_COLS = ["grid_id", "total", "valid", "missing", "coverage", "min_h", "max_h", "mean_h", "range_h", "n_below", "n_above", "error_code", "success", "outcome", "status"]


@query("d1_thickness", _thickness_sql(AREA, -0.4, 0.4, "(CASE WHEN valid < 100 THEN 130 WHEN valid / 6400::DOUBLE < 0.9 THEN 131 ELSE 0 END)"))
def d1_thickness(spark, d):
    """Thickness of the dense grids with holes, with coverage gate."""
    return tidy(measure.thickness(grids.dense_meta(spark, d), grids.dense_grid(spark, d), -0.4, 0.4, min_samples=100, min_coverage=0.9).select(_THICK_COLS))


@query("d1_thickness_roi", _thickness_sql(2400, -0.35, 0.35, "(CASE WHEN valid < 10 THEN 130 ELSE 0 END)", f" WHERE {_IN}"))
def d1_thickness_roi(spark, d):
    return tidy(measure.thickness(grids.dense_meta(spark, d), grids.dense_grid(spark, d), -0.35, 0.35, roi=ROI, min_samples=10).select(_THICK_COLS))


@query("a11_result_sink", f"WITH {GRID_SQL} SELECT grid_id AS target_id, 'thickness' AS tool, {R('avg(h)')} AS mean_h, 'mm' AS unit FROM grid GROUP BY grid_id")
def a11_result_sink(spark, d):
    from .schemas import metric

    rows = measure.thickness(grids.dense_meta(spark, d), grids.dense_grid(spark, d), -1.0, 1.0)
    out = result_row(rows, "thickness", {"mean_h": "mm", "min_h": "mm", "max_h": "mm"})
    return out.select("target_id", "tool", rounded(metric("MEAN_H")).alias("mean_h"), F.element_at("metric_units", "mean_h").alias("unit"))


def _fit_sql(x: str, y: str, z: str, key: str, table: str) -> str:
    """Plane of z over x and y by centred sums."""
    return f"""fit AS (SELECT {key}, n, (sxz * syy - syz * sxy) / det AS a, (syz * sxx - sxz * sxy) / det AS b,
  mz - (sxz * syy - syz * sxy) / det * mx - (syz * sxx - sxz * sxy) / det * my AS c FROM (
  SELECT *, sxx * syy - sxy * sxy AS det FROM (SELECT {key}, count({z}) AS n, avg({x}) AS mx, avg({y}) AS my, avg({z}) AS mz, var_pop({x}) AS sxx, var_pop({y}) AS syy,
  covar_pop({x}, {y}) AS sxy, covar_pop({x}, {z}) AS sxz, covar_pop({y}, {z}) AS syz FROM {table} GROUP BY {key})))"""


@query("d2_warpage", f"""WITH {XY_SQL}, v AS (SELECT * FROM xy WHERE h IS NOT NULL), {_fit_sql("x", "y", "h", "grid_id", "v")},
 res AS (SELECT grid_id, a, b, c, h - (a * x + b * y + fit.c) AS e FROM (SELECT grid_id, x, y, h FROM v) JOIN fit USING (grid_id))
 SELECT grid_id, {R('min(a)')} AS slope_x, {R('min(b)')} AS slope_y, {R('min(c)')} AS intercept, {R('max(e) - min(e)')} AS peak_to_valley, {R('sqrt(avg(e * e))')} AS rms,
 max(e) - min(e) <= 0.8::DOUBLE AND sqrt(avg(e * e)) <= 0.2::DOUBLE AS success FROM res GROUP BY grid_id""")
def d2_warpage(spark, d):
    rows = measure.warpage(grids.dense_meta(spark, d), grids.dense_grid(spark, d), 0.8, 0.2)
    return tidy(rows.select("grid_id", "slope_x", "slope_y", "intercept", "peak_to_valley", "rms", "success"))


_DATUM = (0.01, 1.0, -0.002)


@query("d3_datum_deviation", f"""WITH {XY_SQL}, k AS (SELECT sqrt({'+'.join(f'{v}::DOUBLE*{v}::DOUBLE' for v in _DATUM)}) AS s),
 e AS (SELECT grid_id, r, c, h + ((0.01::DOUBLE / s) * x + (-0.002::DOUBLE / s) * y + 0.05::DOUBLE / s) / (1.0::DOUBLE / s) AS e FROM xy, k WHERE h IS NOT NULL)
 SELECT grid_id, {R('min(e)')} AS min_res, {R('max(e)')} AS max_res, {R('avg(e)')} AS mean_res, arg_min(r, {{'e': e, 'r': r, 'c': c}}) AS min_row, arg_min(c, {{'e': e, 'r': r, 'c': c}}) AS min_col,
 arg_min(r, {{'e': -e, 'r': r, 'c': c}}) AS max_row, arg_min(c, {{'e': -e, 'r': r, 'c': c}}) AS max_col FROM e GROUP BY grid_id""")
def d3_datum_deviation(spark, d):
    rows = measure.datum_deviation(grids.dense_meta(spark, d), grids.dense_grid(spark, d), _DATUM, 0.05, 1.0)
    return tidy(rows.select("grid_id", "min_res", "max_res", "mean_res", "min_row", "min_col", "max_row", "max_col"))


@query("d4_rms", f"WITH {GRID_SQL} SELECT grid_id, {R('sqrt(avg(h * h))')} AS rms FROM grid GROUP BY grid_id")
def d4_rms(spark, d):
    return tidy(grids.dense_grid(spark, d).groupBy("grid_id").agg(measure.rms("h").alias("rms")))


@query("d5_region_statistics", f"WITH {GRID_SQL} SELECT grid_id, count(h) AS valid, {R('sum(h)')} AS sum_h, {R('min(h)')} AS min_h, {R('max(h)')} AS max_h, {R('avg(h)')} AS mean_h, {R('count(h) / 2400::DOUBLE')} AS coverage FROM grid WHERE {_IN} GROUP BY grid_id")
def d5_region_statistics(spark, d):
    return tidy(measure.region_statistics(grids.dense_meta(spark, d), grids.dense_grid(spark, d), ROI).select("grid_id", "valid", "sum_h", "min_h", "max_h", "mean_h", "coverage"))


def _hist_sql(value: str, bins: int) -> str:
    return f"""v AS (SELECT grid_id, {value} AS v FROM grid), lim AS (SELECT grid_id, min(v) AS lo, max(v) AS hi FROM v GROUP BY grid_id),
 p AS (SELECT grid_id, CASE WHEN hi > lo THEN least({bins - 1}, CAST(floor((v - lo) / (hi - lo) * {bins}) AS INTEGER)) ELSE 0 END AS bin FROM v JOIN lim USING (grid_id) WHERE v IS NOT NULL),
 b AS (SELECT grid_id, bin, count(*) AS n FROM p GROUP BY ALL),
 hist AS (SELECT l.grid_id, CAST(k AS INTEGER) AS bin, coalesce(n, 0) AS n, lo, hi FROM (SELECT *, unnest(range(0, {bins})) AS k FROM lim) l LEFT JOIN b ON b.grid_id = l.grid_id AND b.bin = k)"""


_FLOAT = "CASE WHEN CAST(h AS FLOAT) <> 0 THEN CAST(CAST(h AS FLOAT) AS DOUBLE) END"


@query("d6_grid_summary", f"""WITH {GRID_SQL}, {_hist_sql(_FLOAT, 32)}, pk AS (SELECT grid_id, arg_min(bin, {{'n': -n, 'b': bin}}) AS peak_bin, max(n) AS peak_n, sum(n) AS s, min(lo) AS lo, max(hi) AS hi FROM hist GROUP BY grid_id)
 SELECT grid_id, total, valid, zeros, non_finite, {R('min_h')} AS min_h, {R('max_h')} AS max_h, {R('mean_h')} AS mean_h, peak_bin, peak_n, {R('peak_n / s')} AS peak_share, {R('lo + (hi - lo) / 32 * (peak_bin + 0.5)')} AS peak_center
 FROM (SELECT grid_id, count(*) AS total, count({_FLOAT}) AS valid, count(*) FILTER (CAST(h AS FLOAT) = 0) AS zeros, count(*) FILTER (h IS NULL) AS non_finite, min({_FLOAT}) AS min_h, max({_FLOAT}) AS max_h, avg({_FLOAT}) AS mean_h FROM grid GROUP BY grid_id) JOIN pk USING (grid_id)""")
def d6_grid_summary(spark, d):
    return tidy(measure.grid_summary(grids.dense_grid(spark, d), 32))


@query("d7_distribution", f"WITH {GRID_SQL}, {_hist_sql('h', 24)} SELECT grid_id, bin, n, {R('lo')} AS lo, {R('hi')} AS hi FROM hist")
def d7_distribution(spark, d):
    return tidy(measure.histogram(grids.dense_grid(spark, d), "grid_id", "h", 24))


@query("d8_completeness", f"""WITH {GRID_SQL}, ref AS (SELECT grid_id, avg(h) AS m FROM grid WHERE r BETWEEN 0 AND 9 AND c BETWEEN 0 AND 9 GROUP BY grid_id),
 own AS (SELECT grid_id, (r - 20) // 15 AS i, (c - 5) // 12 AS j, count(h) AS valid, avg(h) AS m FROM grid WHERE r >= 20 AND c >= 5 AND (r - 20) // 15 < 4 AND (c - 5) // 12 < 4 AND (r - 20) % 15 < 10 AND (c - 5) % 12 < 8 GROUP BY ALL),
 every AS (SELECT grid_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM (SELECT DISTINCT grid_id FROM grid), range(0, 4) a(i), range(0, 4) b(j))
 SELECT e.grid_id, e.i AS part_row, e.j AS part_col, coalesce(valid, 0) AS valid, {R('coalesce(valid, 0) / 80::DOUBLE')} AS coverage, {R('own.m - ref.m')} AS relative,
 CASE WHEN ref.m IS NULL THEN 'NotEvaluated' WHEN coalesce(valid, 0) / 80::DOUBLE < 0.9 OR own.m IS NULL THEN 'Fail' WHEN own.m - ref.m BETWEEN -0.02 AND 0.02 THEN 'Pass' ELSE 'Fail' END AS disposition
 FROM every e LEFT JOIN own ON own.grid_id = e.grid_id AND own.i = e.i AND own.j = e.j LEFT JOIN ref ON ref.grid_id = e.grid_id""")
def d8_completeness(spark, d):
    return tidy(measure.completeness(grids.dense_grid(spark, d), Roi(0, 0, 10, 10), (20, 5), (4, 4), (15, 12), (10, 8), 0.9, -0.02, 0.02))


@query("d9_evidence_by_role", f"""WITH {OBS_SQL}, every AS (SELECT series_id, role FROM (SELECT DISTINCT series_id FROM obs), (VALUES ('Good'), ('Bad'), ('HeldOut')) t(role)),
 a AS (SELECT series_id, role, count(DISTINCT sample_id) AS samples, count(value) AS n, min(value) AS lo, max(value) AS hi, avg(value) AS m, stddev_pop(value) AS s FROM obs GROUP BY ALL)
 SELECT series_id, role, coalesce(samples, 0) AS samples, coalesce(n, 0) AS n, lo AS min_v, hi AS max_v, {R('m')} AS mean_v, {R('s')} AS std_v FROM every LEFT JOIN a USING (series_id, role)""")
def d9_evidence_by_role(spark, d):
    return tidy(measure.evidence_by_role(grids.observations(spark, d)))


@query("d10_repeatability", f"SELECT l_suppkey AS series, count(*) AS n, {R('avg(l_quantity)', 4)} AS mean_v, {R('stddev_samp(l_quantity)', 4)} AS std_v, {R('max(l_quantity) - min(l_quantity)', 4)} AS range_v, {R('6 * stddev_samp(l_quantity)', 4)} AS six_sigma FROM lineitem GROUP BY 1 HAVING count(*) >= 2")
def d10_repeatability(spark, d):
    obs = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("series"), "l_quantity")
    return tidy(measure.repeatability(obs, "series", "l_quantity"), 4)


_HALVES = f"WITH {POINTS_SQL}, ref AS (SELECT * FROM points WHERE ord < 40), mea AS (SELECT * FROM points WHERE ord >= 40), {_fit_sql('x', 'z', 'y', 'set_id', 'ref')}"


def _halves(spark, d):
    p = grids.points(spark, d)
    return p.where("ord < 40"), p.where("ord >= 40")


@query("d11_dual_thickness", _HALVES + f""", t AS (SELECT set_id, raw_h - (a * x + b * z + c) AS t FROM mea JOIN fit USING (set_id))
 SELECT set_id, count(t) AS n, {R('min(t)')} AS min_t, {R('max(t)')} AS max_t, {R('avg(t)')} AS mean_t, {R('stddev_pop(t)')} AS std_t, count(*) FILTER (t < -0.2) AS n_below, count(*) FILTER (t > 0.2) AS n_above, {R('max(t) - min(t)')} AS range_t, count(*) FILTER (t < -0.2 OR t > 0.2) = 0 AS passed FROM t GROUP BY set_id""")
def d11_dual_thickness(spark, d):
    return tidy(measure.dual_thickness(*_halves(spark, d), -0.2, 0.2))


@query("d12_flatness")
def d12_flatness(spark, d):
    """Float distances, so that the last digits depend on the engine: held against NumPy in the tests."""
    return tidy(measure.flatness(*_halves(spark, d), 0.7))


@query("d13_volume", _HALVES + f""", t AS (SELECT set_id, y - (a * x + b * z + c) AS t FROM mea JOIN fit USING (set_id))
 SELECT set_id, {R('sum(greatest(t, 0)) * 0.25')} AS above, {R('sum(greatest(-t, 0)) * 0.25')} AS below, {R('sum(greatest(t, 0)) * 0.25 - sum(greatest(-t, 0)) * 0.25')} AS net, abs(sum(greatest(t, 0)) * 0.25 - sum(greatest(-t, 0)) * 0.25) <= 0.3 AS passed FROM t GROUP BY set_id""")
def d13_volume(spark, d):
    return tidy(measure.volume(*_halves(spark, d), 0.25, 0.0, 0.3))


@query("d14_cross_section", f"WITH {POINTS_SQL} SELECT set_id, count(*) AS n, {R('max(x) - min(x)')} AS width, {R('max(y) - min(y)')} AS height_range, abs(max(x) - min(x) - 0.6) <= 0.05 AND abs(max(y) - min(y) - 0.6) <= 0.05 AS passed FROM points GROUP BY set_id HAVING count(*) >= 2")
def d14_cross_section(spark, d):
    return tidy(measure.cross_section(grids.points(spark, d), "set_id", "x", "y", 0.6, 0.05, 0.6, 0.05))


@query("d15_gap_flush", f"""WITH {POINTS_SQL}, a AS (SELECT set_id, max(x) AS e, avg(y) AS m FROM points WHERE x < 0 GROUP BY set_id), b AS (SELECT set_id, min(x) AS s, avg(y) AS m FROM points WHERE x >= 0 GROUP BY set_id)
 SELECT set_id, {R('s - e')} AS gap, {R('b.m - a.m')} AS flush, abs(s - e - 0.01) <= 0.01 AS gap_ok, abs(b.m - a.m) <= 0.02 AS flush_ok FROM a JOIN b USING (set_id)""")
def d15_gap_flush(spark, d):
    p = grids.points(spark, d)
    return tidy(measure.gap_flush(p.where("x < 0"), p.where("x >= 0"), "set_id", "x", "y", 0.01, 0.01, 0.0, 0.02))


@query("d18_centroid", f"WITH {POINTS_SQL} SELECT set_id, {R('avg(x)')} AS x, {R('avg(y)')} AS y, {R('avg(z)')} AS z FROM points GROUP BY set_id")
def d18_centroid(spark, d):
    return tidy(grids.points(spark, d).groupBy("set_id").agg(*[F.avg(c).alias(c) for c in "xyz"]))


@query("d19_list_metrics", f"WITH {POINTS_SQL} SELECT set_id, count(*) AS count, {R('min(x)')} AS min_x, {R('max(x)')} AS max_x, {R('avg(x)')} AS avg_x, {R('min(y)')} AS min_y, {R('max(y)')} AS max_y, {R('avg(y)')} AS avg_y FROM points GROUP BY set_id")
def d19_list_metrics(spark, d):
    return tidy(measure.list_metrics(grids.points(spark, d), "set_id", ["x", "y"]))


_ROIS = [("left", 0, 0, 32, 64), ("right", 32, 0, 32, 64), ("mid", 16, 16, 32, 32)]
_ROI_VALUES = ", ".join(f"('{n}', {x}, {y}, {w}, {h})" for n, x, y, w, h in _ROIS)


@query("d20_roi_mean", f"WITH {PIXELS_SQL}, rois(roi, x0, y0, w, h) AS (VALUES {_ROI_VALUES}) SELECT image_id, roi, round_even(avg(v), 1) AS value, count(*) AS n FROM pixels, rois WHERE x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + h GROUP BY ALL")
def d20_roi_mean(spark, d):
    return measure.roi_means(grids.pixels(spark, d), _ROIS)


@query("d20_roi_deviation", f"WITH {PIXELS_SQL}, rois(roi, x0, y0, w, h) AS (VALUES {_ROI_VALUES}) SELECT image_id, roi, round_even(stddev_pop(v), 1) AS value, count(*) AS n FROM pixels, rois WHERE x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + h GROUP BY ALL")
def d20_roi_deviation(spark, d):
    return measure.roi_means(grids.pixels(spark, d), _ROIS, True)


@query("d21_image_statistics", f"WITH {PIXELS_SQL} SELECT image_id, y // 32 AS qy, x // 32 AS qx, count(*) FILTER (v <> 0) AS non_zero, CAST(sum(v) AS BIGINT) AS total, {R('avg(v)')} AS mean_v, {R('stddev_pop(v)')} AS std_v FROM pixels GROUP BY ALL")
def d21_image_statistics(spark, d):
    q = lambda c: F.floor(F.col(c) / 32).cast("int").alias(f"q{c}")
    return tidy(grids.pixels(spark, d).groupBy("image_id", q("y"), q("x")).agg(F.count_if(F.col("v") != 0).alias("non_zero"), F.sum("v").alias("total"), F.avg("v").alias("mean_v"), F.stddev_pop("v").alias("std_v")))


@query("d22_percentile", f"WITH {GRID_SQL} SELECT grid_id, {R('quantile_disc(h, 0.9)')} AS value FROM grid WHERE h IS NOT NULL GROUP BY grid_id")
def d22_percentile(spark, d):
    return tidy(measure.percentile_rank(grids.dense_grid(spark, d), "grid_id", "h", 0.9))


@query("d23_geometric_mean", f"WITH {POINTS_SQL} SELECT set_id, ord, {R('pow(least(1, greatest(0, x + 0.5)) * least(1, greatest(0, y + 0.5)) * least(1, greatest(0, z + 0.5)), 1 / 3.0::DOUBLE)')} AS score FROM points")
def d23_geometric_mean(spark, d):
    return tidy(grids.points(spark, d).select("set_id", "ord", measure.clamped_geometric_mean([F.col(c) + 0.5 for c in "xyz"]).alias("score")))


@query("d24_roll_up", f"WITH {POINTS_SQL} SELECT set_id, bool_and(abs(y) <= 0.25) AS passed, count(*) FILTER (abs(y) > 0.25) AS n_failed FROM points GROUP BY set_id")
def d24_roll_up(spark, d):
    return measure.roll_up(grids.points(spark, d).withColumn("ok", F.abs("y") <= 0.25), "set_id", "ok")


@query("i1_plane_fit", f"WITH {POINTS_SQL}, {_fit_sql('x', 'z', 'y', 'set_id', 'points')} SELECT set_id, n, {R('a')} AS a, {R('b')} AS b, {R('c')} AS c FROM fit")
def i1_plane_fit(spark, d):
    return tidy(measure.plane_report(grids.points(spark, d)).select("set_id", "n", "a", "b", "c"))
