"""Rigid transforms, orientation, regridding and reconstruction as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import dot, grid_coordinates, rotation, transformed


def _m(c: Column, i: int, j: int, width: int = 4) -> Column:
    return F.get(c, F.lit(i * width + j))


def rigid_diagnostics(m: Column) -> dict[str, Column]:
    """Of a 4 x 4 matrix (16 values): row and orthogonality errors, determinant, translation, angle."""
    r = [[_m(m, i, j) for j in range(3)] for i in range(3)]
    last = F.greatest(F.abs(_m(m, 3, 0)), F.abs(_m(m, 3, 1)), F.abs(_m(m, 3, 2)), F.abs(_m(m, 3, 3) - 1))
    ortho = F.greatest(*[F.abs(dot(r[i], r[j]) - (1.0 if i == j else 0.0)) for i in range(3) for j in range(i, 3)])
    det = r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1]) - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0]) + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0])
    t = [_m(m, i, 3) for i in range(3)]
    cos = (r[0][0] + r[1][1] + r[2][2] - 1) / 2
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos))))
    return {"row_error": last, "orthogonality_error": ortho, "determinant": det, "determinant_error": det - 1, "translation": F.sqrt(dot(t, t)), "angle": angle}


def is_rigid(m: Column, tolerance: float) -> Column:
    """Unit and orthogonal rows, determinant 1."""
    d = rigid_diagnostics(m)
    return (d["orthogonality_error"] <= tolerance) & (F.abs(d["determinant_error"]) <= tolerance)


def euler_matrix(rx: Column, ry: Column, rz: Column, tx, ty, tz) -> Column:
    """4 x 4 values of Rz Ry Rx with a translation."""
    r = rotation(rx, ry, rz)
    t = [F.lit(x) if not isinstance(x, Column) else x for x in (tx, ty, tz)]
    return F.array(*r[0:3], t[0], *r[3:6], t[1], *r[6:9], t[2], F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def orientation(normals: DataFrame, direction: tuple[float, float, float], grazing: float) -> DataFrame:
    """Grazing, SensorFacing or Away by the cosine of each normal with the viewing direction."""
    size = max(abs(v) for v in direction)
    unit = [v / size for v in direction]
    norm = sum(v * v for v in unit) ** 0.5
    unit = [v / norm for v in unit]
    n = [F.col(c) for c in ("nx", "ny", "nz")]
    big = F.greatest(*map(F.abs, n))
    scaled = [F.try_divide(c, big) for c in n]
    cos = F.try_divide(dot(scaled, [F.lit(v) for v in unit]), F.sqrt(dot(scaled, scaled)))
    cos = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos))
    state = F.when(F.abs(F.col("cosine")) <= grazing + 1e-12, "Grazing").when(F.col("cosine") < 0, "SensorFacing").otherwise("Away")
    return normals.withColumn("cosine", cos).withColumn("state", F.when(F.col("cosine").isNotNull(), state))


def affine_apply(points: DataFrame, matrix: list[float]) -> DataFrame:
    """Points through a 3 x 4 matrix.  A set with a repeated (row, col) locator fails as a whole: ``ok`` is false."""
    twice = points.groupBy("set_id", "row", "col").count().groupBy("set_id").agg((F.max("count") == 1).alias("ok"))
    p = transformed(matrix, F.col("x"), F.col("y"), F.col("z"))
    return points.withColumn("p", p).join(twice, "set_id").select("set_id", "ord", "ok", F.when(F.col("ok"), F.col("p.x")).alias("x"), F.when(F.col("ok"), F.col("p.y")).alias("y"), F.when(F.col("ok"), F.col("p.z")).alias("z"))


def regrid(points: DataFrame, origin, u, v, h, rows: int, cols: int, pitch_u: float, pitch_v: float, min_coverage: float = 0.0, max_cells: int = 4_194_304) -> tuple[DataFrame, DataFrame]:
    """(cells, report): per cell the point nearest its centre in the plane; ties by source row, then column.

    A set with any point outside the half-open bounds fails as a whole; cells
    without a point stay, without a height.
    """
    if rows * cols > max_cells:
        raise ValueError(f"{rows * cols} cells exceed {max_cells}")
    p = points.withColumns(grid_coordinates([F.col(c) for c in "xyz"], origin, u, v, h, pitch_u, pitch_v))
    out = ~(F.col("grid_row").between(0, rows - 1) & F.col("grid_col").between(0, cols - 1))
    away = lambda c, k, pitch: F.col(c) / pitch - (F.col(k) + 0.5)
    du, dv = away("u", "grid_col", pitch_u) * pitch_u, away("v", "grid_row", pitch_v) * pitch_v
    p = p.withColumn("d2", du * du + dv * dv)
    per = p.groupBy("set_id", "grid_row", "grid_col").agg(F.min(F.struct("d2", "row", "col", "height")).alias("b"), F.count("*").alias("n"), F.count_if(out).alias("n_out"))
    sets = per.groupBy("set_id").agg(F.sum("n_out").alias("n_out"), F.sum(F.when(F.col("n_out") == 0, F.col("n") - 1)).alias("collisions"), F.count_if(F.col("n_out") == 0).alias("filled"))
    report = sets.select("set_id", "n_out", F.coalesce("collisions", F.lit(0)).alias("collisions"), (F.col("filled") / (rows * cols)).alias("coverage"), ((F.col("n_out") == 0) & (F.col("filled") / (rows * cols) >= min_coverage)).alias("accepted"))
    every = sets.where("n_out = 0").select("set_id", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("grid_row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("grid_col"))
    cells = every.join(per, ["set_id", "grid_row", "grid_col"], "left").select("set_id", "grid_row", "grid_col", F.col("b.height").alias("h"), F.col("b.row").alias("source_row"), F.col("b.col").alias("source_col"))
    return cells, report


def reconstruct(cells: DataFrame, origin, u, v, h, pitch_u: float, pitch_v: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """Points at the centres of the cells with heights, within an optional range of heights."""
    c = cells.where("h IS NOT NULL")
    if low is not None:
        c = c.where(F.col("h").between(low, high))
    cu, cv = (F.col("col") + 0.5) * pitch_u, (F.col("row") + 0.5) * pitch_v
    at = lambda i: F.lit(float(origin[i])) + cu * float(u[i]) + cv * float(v[i]) + F.col("h") * float(h[i])
    return c.select("grid_id", "row", "col", cu.alias("u"), cv.alias("v"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def pose_equivalence(poses: DataFrame, order: int, axis: tuple[float, float, float], max_translation: float, max_rotation: float) -> DataFrame:
    """Two poses (rotations r1, r2 of 9 values, translations t1, t2) alike under turns of a full circle in ``order`` about an axis."""
    size = sum(v * v for v in axis) ** 0.5
    x, y, z = (v / size for v in axis)
    diff = [F.get("t2", F.lit(i)) - F.get("t1", F.lit(i)) for i in range(3)]
    # relative rotation in the model frame: r1' r2
    rel = [[sum((F.get("r1", F.lit(3 * k + i)) * F.get("r2", F.lit(3 * k + j)) for k in range(3)), F.lit(0.0)) for j in range(3)] for i in range(3)]
    best = []
    import math

    for k in range(order):
        a = 2 * math.pi * k / order
        c, s, q = math.cos(a), math.sin(a), 1 - math.cos(a)
        g = [[c + x * x * q, x * y * q - z * s, x * z * q + y * s], [y * x * q + z * s, c + y * y * q, y * z * q - x * s], [z * x * q - y * s, z * y * q + x * s, c + z * z * q]]
        trace = sum((rel[i][j] * g[i][j] for i in range(3) for j in range(3)), F.lit(0.0))
        cos = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (trace - 1) / 2))
        best.append(F.struct(F.degrees(F.acos(cos)).alias("angle"), F.lit(k).alias("k")))
    near = F.array_min(F.array(*best))
    rows = poses.withColumns({"translation": F.sqrt(dot(diff, diff)), "near": near})
    return rows.select("pose_id", "translation", F.col("near.angle").alias("rotation"), F.col("near.k").alias("operation"), ((F.col("translation") <= max_translation) & (F.col("near.angle") <= max_rotation)).alias("equivalent"))
