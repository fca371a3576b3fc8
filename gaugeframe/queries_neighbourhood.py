"""Queries over neighbourhoods of grids and pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import neighbourhood as nb
from .operators.gates import Roi
from .oracle import tidy
from .oracle import sql_round as R
from .queries_measure import _fit_sql
from .sources import grids
from .sources.grids import GRID_SQL, PIXELS_SQL, POINTS_SQL

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _near(table: str, key: str, r: str, c: str, half: int) -> str:
    return f"{table} a JOIN {table} b ON a.{key} = b.{key} AND b.{r} BETWEEN a.{r} - {half} AND a.{r} + {half} AND b.{c} BETWEEN a.{c} - {half} AND a.{c} + {half}"


def _median_sql(half: int) -> str:
    return f"""WITH {GRID_SQL}, m AS (SELECT a.grid_id, a.r, a.c, any_value(a.h) AS h, median(b.h) AS m FROM {_near('grid', 'grid_id', 'r', 'c', half)} GROUP BY ALL)
 SELECT grid_id, r AS "row", c AS "col", {R('CASE WHEN h IS NOT NULL THEN m END')} AS h, h IS NOT NULL AND m <> h AS changed FROM m""".replace("GROUP BY ALL", "GROUP BY a.grid_id, a.r, a.c")


@query("e1_median_3", _median_sql(1))
def e1_median_3(spark, d):
    return tidy(nb.median_filter(grids.dense_grid(spark, d), 3))


@query("e1_median_5", _median_sql(2))
def e1_median_5(spark, d):
    return tidy(nb.median_filter(grids.dense_grid(spark, d), 5))


@query("e2_outliers", f"""WITH {GRID_SQL}, m AS (SELECT a.grid_id, a.r, a.c, any_value(a.h) AS h, median(b.h) FILTER (a.r <> b.r OR a.c <> b.c) AS m, count(b.h) FILTER (a.r <> b.r OR a.c <> b.c) AS n FROM {_near('grid', 'grid_id', 'r', 'c', 1)} GROUP BY a.grid_id, a.r, a.c)
 SELECT grid_id, r AS "row", c AS "col", {R('CASE WHEN NOT coalesce(n >= 3 AND abs(h - m) > 0.25, false) THEN h END')} AS h, coalesce(n >= 3 AND abs(h - m) > 0.25, false) AS outlier FROM m""")
def e2_outliers(spark, d):
    return tidy(nb.outlier_filter(grids.dense_grid(spark, d), 3, 0.25, 3))


def _edge_sql(strength: str, line: str, pos: str) -> str:
    return f"""WITH {GRID_SQL}, p AS (SELECT grid_id, {line} AS line, {pos} AS p, h, lead(h) OVER w AS h2 FROM grid WINDOW w AS (PARTITION BY grid_id, {line} ORDER BY {pos})),
 s AS (SELECT grid_id, line, p, h2 - h AS delta, {strength} AS s FROM p WHERE h IS NOT NULL AND h2 IS NOT NULL),
 n AS (SELECT *, row_number() OVER (PARTITION BY grid_id, line ORDER BY s DESC, p) AS k FROM s WHERE s >= 0.1)
 SELECT grid_id, line, p AS "at", {R('delta')} AS delta FROM n WHERE k = 1"""


@query("e3_edges_across", _edge_sql("abs(h2 - h)", "r", "c"))
def e3_edges_across(spark, d):
    return tidy(nb.step_edges(grids.dense_grid(spark, d), 0.1))


@query("e3_edges_down_rising", _edge_sql("h2 - h", "c", "r"))
def e3_edges_down_rising(spark, d):
    return tidy(nb.step_edges(grids.dense_grid(spark, d), 0.1, "Rising", "row"))


@query("e3_edges_falling", _edge_sql("h - h2", "r", "c"))
def e3_edges_falling(spark, d):
    return tidy(nb.step_edges(grids.dense_grid(spark, d), 0.1, "Falling"))


@query("e4_level_surface", f"""WITH {GRID_SQL}, ref AS (SELECT grid_id, r, c, CAST(CAST(h AS FLOAT) AS DOUBLE) AS h FROM grid WHERE h IS NOT NULL AND ((r < 30 AND c < 30) OR (r BETWEEN 20 AND 59 AND c BETWEEN 20 AND 59))),
 {_fit_sql('c', 'r', 'h', 'grid_id', 'ref')}, m AS (SELECT grid_id, avg(h) AS m FROM ref GROUP BY grid_id)
 SELECT g.grid_id, g.r AS "row", g.c AS "col", {R('g.h - (f.a * g.c + f.b * g.r) + (m.m - f.c)')} AS h FROM grid g JOIN fit f USING (grid_id) JOIN m USING (grid_id)""")
def e4_level_surface(spark, d):
    return tidy(nb.level_surface(grids.dense_grid(spark, d), [Roi(0, 0, 30, 30), Roi(20, 20, 40, 40)]))


_ADJ = """SELECT grid_id, r, c, h, '{n}' AS direction, lead(h) OVER (PARTITION BY grid_id, {l} ORDER BY {p}) AS h2 FROM grid"""


@query("e5_adjacent_edges", f"""WITH {GRID_SQL}, p AS ({_ADJ.format(n='right', l='r', p='c')} UNION ALL {_ADJ.format(n='below', l='c', p='r')})
 SELECT grid_id, r AS "row", c AS "col", direction, CAST(r + CASE WHEN h2 > h AND direction = 'below' THEN 1 ELSE 0 END AS INTEGER) AS anchor_row, CAST(c + CASE WHEN h2 > h AND direction = 'right' THEN 1 ELSE 0 END AS INTEGER) AS anchor_col, {R('greatest(h, h2)')} AS anchor_h FROM p WHERE abs(h2 - h) >= 0.3""")
def e5_adjacent_edges(spark, d):
    return tidy(nb.adjacent_edges(grids.dense_grid(spark, d), 0.3))


QUERIES["c8_adjacency_join"], SQL["c8_adjacency_join"] = e5_adjacent_edges, SQL["e5_adjacent_edges"]


@query("e6_line_gauge", f"""WITH {PIXELS_SQL}, w AS (SELECT image_id, y, x, lag(v) OVER s AS b, min(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS lo,
 count(*) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n FROM pixels WHERE y % 2 = 0 WINDOW s AS (PARTITION BY image_id, y ORDER BY x))
 SELECT image_id, y AS line, min(x) AS "at" FROM w WHERE n = 3 AND lo - b > 8 GROUP BY image_id, y""")
def e6_line_gauge(spark, d):
    return nb.line_gauge(grids.pixels(spark, d), 8, 3, 2)


@query("e7_subpixel", f"""WITH {GRID_SQL}, w AS (SELECT grid_id || '/' || r AS k, c, h AS v, lag(h) OVER s AS p, lead(h) OVER s AS n FROM grid WHERE h IS NOT NULL WINDOW s AS (PARTITION BY grid_id, r ORDER BY c))
 SELECT k, c AS "col", {R('CASE WHEN abs(p - 2 * v + n) <= 1e-7 THEN 0 ELSE least(0.5, greatest(-0.5, 0.5 * (p - n) / (p - 2 * v + n))) END')} AS "offset" FROM w WHERE p IS NOT NULL AND n IS NOT NULL""")
def e7_subpixel(spark, d):
    g = grids.dense_grid(spark, d).where("h IS NOT NULL").select(F.concat_ws("/", "grid_id", "row").alias("k"), "col", "h")
    return tidy(nb.subpixel(g, "k", "col", "h"))


@query("e8_local_direction", f"""WITH {POINTS_SQL} SELECT set_id, ord, {R('0.5 * atan2(2 * covar_pop(x, y) OVER w, var_pop(x) OVER w - var_pop(y) OVER w)', 5)} AS angle FROM points WINDOW w AS (PARTITION BY set_id ORDER BY ord ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""")
def e8_local_direction(spark, d):
    return tidy(nb.local_direction(grids.points(spark, d), "set_id", "ord", "x", "y", 4), 5)


@query("j1_threshold", f"WITH {PIXELS_SQL} SELECT image_id, y, x, CASE WHEN v > 128 THEN 255 ELSE 0 END AS v FROM pixels")
def j1_threshold(spark, d):
    return nb.threshold(grids.pixels(spark, d), 128)


@query("j1_threshold_range", f"WITH {PIXELS_SQL} SELECT image_id, y, x, CASE WHEN v BETWEEN 110 AND 140 THEN 0 ELSE 255 END AS v FROM pixels")
def j1_threshold_range(spark, d):
    return nb.threshold(grids.pixels(spark, d), 110, 140, True)


@query("j1_threshold_adaptive", f"WITH {PIXELS_SQL} SELECT a.image_id, a.y, a.x, CASE WHEN any_value(a.v) > avg(b.v) - 2 THEN 255 ELSE 0 END AS v FROM {_near('pixels', 'image_id', 'y', 'x', 1)} GROUP BY a.image_id, a.y, a.x")
def j1_threshold_adaptive(spark, d):
    return nb.adaptive_threshold(grids.pixels(spark, d), 3, 2)


@query("j2_box_filter", f"WITH {PIXELS_SQL} SELECT a.image_id, a.y, a.x, {R('avg(b.v)')} AS mean, any_value(a.v) AS v FROM {_near('pixels', 'image_id', 'y', 'x', 1)} GROUP BY a.image_id, a.y, a.x")
def j2_box_filter(spark, d):
    return tidy(nb.box_mean(grids.pixels(spark, d), 3))


def _weights(k) -> str:
    return ", ".join(f"({r - 1}, {c - 1}, {float(k[r][c])!r}::DOUBLE)" for r in range(3) for c in range(3) if k[r][c])


def _conv_sql(k) -> str:
    n = sum(1 for row in k for w in row if w)
    return f"WITH {PIXELS_SQL}, k(dy, dx, w) AS (VALUES {_weights(k)}) SELECT image_id, y - dy AS y, x - dx AS x, {R('sum(v * w)')} AS v FROM pixels, k GROUP BY image_id, y - dy, x - dx HAVING count(*) = {n}"


@query("j2_gaussian", _conv_sql(nb.GAUSS_3))
def j2_gaussian(spark, d):
    return tidy(nb.convolve(grids.pixels(spark, d), nb.GAUSS_3))


@query("j3_laplacian", _conv_sql(nb.LAPLACIAN))
def j3_laplacian(spark, d):
    return tidy(nb.convolve(grids.pixels(spark, d), nb.LAPLACIAN))


def _grad_sql(kx, ky) -> str:
    k = ", ".join(f"({r - 1}, {c - 1}, {kx[r][c]}, {ky[r][c]})" for r in range(3) for c in range(3))
    return f"WITH {PIXELS_SQL}, k(dy, dx, wx, wy) AS (VALUES {k}), g AS (SELECT image_id, y - dy AS y, x - dx AS x, CAST(sum(v * wx) AS DOUBLE) AS gx, CAST(sum(v * wy) AS DOUBLE) AS gy FROM pixels, k GROUP BY image_id, y - dy, x - dx HAVING count(*) = 9) SELECT image_id, y, x, gx, gy, {R('sqrt(gx * gx + gy * gy)')} AS magnitude FROM g"


@query("j3_sobel", _grad_sql(nb.SOBEL_X, nb.SOBEL_Y))
def j3_sobel(spark, d):
    return tidy(nb.gradient(grids.pixels(spark, d)))


@query("j3_scharr", _grad_sql(nb.SCHARR_X, nb.SCHARR_Y))
def j3_scharr(spark, d):
    return tidy(nb.gradient(grids.pixels(spark, d), nb.SCHARR_X, nb.SCHARR_Y))


def _morph(agg: str, source: str, name: str) -> str:
    return f"{name} AS (SELECT a.image_id, a.y, a.x, {agg}(b.v) AS v FROM {_near(source, 'image_id', 'y', 'x', 1)} GROUP BY a.image_id, a.y, a.x)"


@query("j4_erode", f"WITH {PIXELS_SQL}, {_morph('min', 'pixels', 'e')} SELECT * FROM e")
def j4_erode(spark, d):
    return nb.morphology(grids.pixels(spark, d), "erode")


@query("j4_open", f"WITH {PIXELS_SQL}, {_morph('min', 'pixels', 'e')}, {_morph('max', 'e', 'o')} SELECT * FROM o")
def j4_open(spark, d):
    return nb.morphology(grids.pixels(spark, d), "open")


@query("j4_close", f"WITH {PIXELS_SQL}, {_morph('max', 'pixels', 'e')}, {_morph('min', 'e', 'o')} SELECT * FROM o")
def j4_close(spark, d):
    return nb.morphology(grids.pixels(spark, d), "close")


@query("j7_preprocess", f"WITH {PIXELS_SQL} SELECT image_id, y, x, 255 - CASE WHEN v > 120 THEN 255 ELSE 0 END AS v FROM pixels")
def j7_preprocess(spark, d):
    return nb.preprocess(grids.pixels(spark, d), 120, True)
