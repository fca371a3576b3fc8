"""Window-shaped operators over grids and pixel rows.

Neighbourhoods are reached in one of three ways, never by a join of the grid
with itself.  Rows and columns alone: ``lead``/``lag`` over the scanline.  Squares
with sums, minima or maxima: each cell is dealt to the cells whose window
holds it, and what meets in one task is combined before the shuffle.  Squares
with medians, which cannot be combined: tiles with a rim, in NumPy.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .gates import Roi
from .measure import plane


def windows(cells: DataFrame, key: str, row: str, col: str, value: str, size: int, weights: list[list[float]] | None = None) -> DataFrame:
    """(key, row, col, dr, dc, v, w) for every window that holds a cell: target coordinates first."""
    half = size // 2
    offsets = [(dr, dc, 1.0 if weights is None else float(weights[dr + half][dc + half])) for dr in range(-half, half + 1) for dc in range(-half, half + 1)]
    offsets = [o for o in offsets if o[2] != 0.0]
    table = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(w).alias("w")) for dr, dc, w in offsets])
    rows = cells.select(key, row, col, F.col(value).alias("v"), F.explode(table).alias("o"))
    # a source at (row, col) is at (dr, dc) from the target at (row - dr, col - dc)
    return rows.select(key, (F.col(row) - F.col("o.dr")).alias(row), (F.col(col) - F.col("o.dc")).alias(col), F.col("o.dr").alias("dr"), F.col("o.dc").alias("dc"), "v", F.col("o.w").alias("w"))


#: Side of the tiles that hold whole windows, in cells.
TILE = 128


def tiled(cells: DataFrame, key: str, row: str, col: str, value: str, half: int, kernel: Callable, outputs: str) -> DataFrame:
    """Runs ``kernel`` over tiles with a rim of ``half`` cells: for windows whose aggregate cannot be combined.

    A cell is dealt to the tiles whose rim holds it, nearly always one, so about
    one row a cell is shuffled, whatever the window.  ``kernel`` gets the heights
    (NaN where missing or absent) and which cells exist, both with the rim, and
    returns the output columns without it.
    """
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half) / TILE), F.floor((F.col(c) + half) / TILE)))
    dealt = cells.select(key, row, col, F.col(value).cast("double").alias("__v"), reach(row).alias("__tr")).select("*", reach(col).alias("__tc"))
    fields = [tuple(x.split()) for x in outputs.split(", ")]
    kinds = {"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}

    def run(t: pa.Table) -> pa.Table:
        y, x, v_ = (t[c].to_numpy() for c in (row, col, "__v"))
        r0, c0 = int(t["__tr"][0].as_py()) * TILE - half, int(t["__tc"][0].as_py()) * TILE - half
        side = TILE + 2 * half
        v, real = np.full((side, side), np.nan), np.zeros((side, side), bool)
        v[y - r0, x - c0], real[y - r0, x - c0] = v_.astype(float), True
        found = kernel(v, real)
        own = np.nonzero(real[half : side - half, half : side - half])
        out = [pa.array([t[key][0].as_py()] * len(own[0]), pa.string()), pa.array(own[0] + r0 + half, pa.int32()), pa.array(own[1] + c0 + half, pa.int32())]
        out += [pa.array(a[own], kinds[k], from_pandas=True) for (_, k), a in zip(fields, found, strict=True)]
        return pa.table(out, names=[key, row, col, *(n for n, _ in fields)])

    return dealt.groupBy(key, "__tr", "__tc").applyInArrow(run, f"{key} string, {row} int, {col} int, {outputs}")


def _window_median(v: np.ndarray, size: int, centre: bool) -> tuple[np.ndarray, np.ndarray]:
    """Median and number of the heights in each window, with or without its centre."""
    w = np.lib.stride_tricks.sliding_window_view(v, (size, size)).reshape(v.shape[0] - size + 1, v.shape[1] - size + 1, size * size)
    if not centre:
        w = np.delete(w, size * size // 2, axis=2)
    n = np.isfinite(w).sum(axis=2)
    w = np.sort(w, axis=2)  # missing ones last
    pick = lambda k: np.take_along_axis(w, np.maximum(k, 0)[:, :, None], axis=2)[:, :, 0]
    return (pick((n - 1) // 2) + pick(n // 2)) / 2, n


def median_filter(cells: DataFrame, size: int = 3) -> DataFrame:
    """Median of the window, the centre included; missing centres stay missing; borders are clipped."""
    if size not in (3, 5, 7):
        raise ValueError("size must be 3, 5 or 7")
    half = size // 2

    def kernel(v: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, _ = _window_median(v, size, True)
        c = v[half:-half, half:-half]
        there = np.isfinite(c)
        return np.where(there, m, np.nan), there & (m != c)

    return tiled(cells, "grid_id", "row", "col", "h", half, kernel, "h double, changed boolean")


def outlier_filter(cells: DataFrame, size: int = 3, max_deviation: float = 1.0, min_neighbours: int = 3) -> DataFrame:
    """Cells farther than the limit from the median of their neighbours (centre excluded) become missing."""
    if size not in (3, 5, 7):
        raise ValueError("size must be 3, 5 or 7")
    half = size // 2

    def kernel(v: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, n = _window_median(v, size, False)
        c = v[half:-half, half:-half]
        with np.errstate(invalid="ignore"):
            outlier = np.isfinite(c) & (n >= min_neighbours) & (np.abs(c - m) > max_deviation)
        return np.where(np.isfinite(c) & ~outlier, c, np.nan), outlier

    return tiled(cells, "grid_id", "row", "col", "h", half, kernel, "h double, outlier boolean")


def step_edges(cells: DataFrame, threshold: float, polarity: str = "Absolute", across: str = "col") -> DataFrame:
    """Strongest height step of each scanline, the first of equals; both cells of a pair must have heights."""
    line, pos = ("row", "col") if across == "col" else ("col", "row")
    w = Window.partitionBy("grid_id", line).orderBy(pos)
    pairs = cells.select("grid_id", line, pos, "h", F.lead("h").over(w).alias("h2"), F.lead(pos).over(w).alias("p2")).where(f"p2 = {pos} + 1 AND h IS NOT NULL AND h2 IS NOT NULL")
    delta = F.col("h2") - F.col("h")
    strength = {"Rising": delta, "Falling": -delta, "Absolute": F.abs(delta)}[polarity]
    best = pairs.select("grid_id", line, pos, delta.alias("delta"), strength.alias("s")).where(F.col("s") >= threshold)
    best = best.groupBy("grid_id", line).agg(F.min(F.struct((-F.col("s")).alias("k"), F.col(pos).alias("p"), "delta")).alias("b"))
    return best.select("grid_id", F.col(line).alias("line"), F.col("b.p").alias("at"), F.col("b.delta").alias("delta"))


def level_surface(cells: DataFrame, regions: list[Roi], min_samples: int = 3) -> DataFrame:
    """Heights without the tilt of the plane through the regions' cells (each cell once); the level moves to the regions' mean."""
    chosen = None
    for r in regions:
        chosen = r.holds() if chosen is None else chosen | r.holds()
    ref = cells.where(chosen).where("h IS NOT NULL").select("grid_id", "row", "col", F.col("h").cast("float").cast("double").alias("h"))
    fit = plane(ref, "grid_id", "col", "row", "h").where(F.col("n") >= min_samples)
    mean = ref.groupBy("grid_id").agg(F.avg("h").alias("mean_ref"))
    j = cells.join(fit.join(mean, "grid_id"), "grid_id")
    return j.select("grid_id", "row", "col", (F.col("h") - (F.col("a") * F.col("col") + F.col("b") * F.col("row")) + (F.col("mean_ref") - F.col("c"))).alias("h"))


def adjacent_edges(cells: DataFrame, step: float, right: bool = True, below: bool = True) -> DataFrame:
    """Neighbouring cells whose heights differ by ``step`` or more; the anchor is the higher end, the first of equals."""
    parts = []
    for use, line, pos, name in ((right, "row", "col", "right"), (below, "col", "row", "below")):
        if use:
            w = Window.partitionBy("grid_id", line).orderBy(pos)
            p = cells.select("grid_id", "row", "col", "h", F.lead("h").over(w).alias("h2"), F.lead(pos).over(w).alias("p2")).where(f"p2 = {pos} + 1").where(F.abs(F.col("h2") - F.col("h")) >= step)
            up = F.col("h2") > F.col("h")
            parts.append(p.select("grid_id", "row", "col", F.lit(name).alias("direction"), F.when(up & F.lit(name == "below"), F.col("row") + 1).otherwise(F.col("row")).alias("anchor_row"), F.when(up & F.lit(name == "right"), F.col("col") + 1).otherwise(F.col("col")).alias("anchor_col"), F.greatest("h", "h2").alias("anchor_h")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def line_gauge(px: DataFrame, contrast: float, thickness: int, step: int = 1, rising: bool = True, by_row: bool = True, forward: bool = True) -> DataFrame:
    """First edge of each sampled scanline: a contrast above the limit that lasts ``thickness`` pixels."""
    line, pos = ("y", "x") if by_row else ("x", "y")
    order = F.col(pos) if forward else -F.col(pos)
    w = Window.partitionBy("image_id", line).orderBy(order)
    sign = 1 if rising else -1
    before = F.lag("v").over(w)
    after = w.rowsBetween(0, thickness - 1)
    lowest = F.min(sign * F.col("v")).over(after)
    rows = px.where(F.pmod(F.col(line), F.lit(step)) == 0).select("image_id", line, pos, before.alias("before"), lowest.alias("lowest"), F.count("*").over(after).alias("n"))
    hits = rows.where((F.col("n") == thickness) & (F.col("lowest") - sign * F.col("before") > contrast))
    best = F.min(F.col(pos)) if forward else F.max(F.col(pos))
    return hits.groupBy("image_id", F.col(line).alias("line")).agg(best.alias("at"))


def subpixel(scores: DataFrame, key: str, pos: str, score: str) -> DataFrame:
    """Parabola through each interior score and its neighbours: offset in -0.5..0.5."""
    w = Window.partitionBy(key).orderBy(pos)
    rows = scores.select(key, pos, F.col(score).alias("c"), F.lag(score).over(w).alias("p"), F.lead(score).over(w).alias("n")).where("p IS NOT NULL AND n IS NOT NULL")
    bend = F.col("p") - 2 * F.col("c") + F.col("n")
    raw = F.try_divide(F.lit(0.5) * (F.col("p") - F.col("n")), bend)
    return rows.select(key, pos, F.when(F.abs(bend) <= 1e-7, 0.0).otherwise(F.least(F.lit(0.5), F.greatest(F.lit(-0.5), raw))).alias("offset"))


def local_direction(points: DataFrame, key: str, order: str, x: str, y: str, reach: int) -> DataFrame:
    """Direction of the total-least-squares line through each point's neighbours."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-reach, reach)
    sxx, syy, sxy = F.var_pop(x).over(w), F.var_pop(y).over(w), F.covar_pop(x, y).over(w)
    return points.select(key, order, (0.5 * F.atan2(2 * sxy, sxx - syy)).alias("angle"))


# -- pixel neighbourhoods ------------------------------------------------------------
def threshold(px: DataFrame, low: int, high: int | None = None, invert: bool = False) -> DataFrame:
    """255 above ``low`` (or from ``low`` to ``high``), else 0; the other way round if inverted."""
    hit = F.col("v") > low if high is None else F.col("v").between(low, high)
    return px.withColumn("v", F.when(~hit if invert else hit, 255).otherwise(0))


def box_mean(px: DataFrame, size: int) -> DataFrame:
    """Mean of the window's pixels that exist."""
    w = windows(px, "image_id", "y", "x", "v", size)
    own = F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), F.col("v")))
    return w.groupBy("image_id", "y", "x").agg(F.avg("v").alias("mean"), own.alias("v")).where("v IS NOT NULL")


def adaptive_threshold(px: DataFrame, size: int, offset: float) -> DataFrame:
    """255 where a pixel exceeds its window's mean less ``offset``."""
    return box_mean(px, size).select("image_id", "y", "x", F.when(F.col("v") > F.col("mean") - offset, 255).otherwise(0).alias("v"))


def convolve(px: DataFrame, weights: list[list[float]]) -> DataFrame:
    """Weighted sums of the windows that lie wholly in the image."""
    n = sum(1 for row in weights for w in row if w)
    w = windows(px, "image_id", "y", "x", "v", len(weights), weights=weights)
    out = w.groupBy("image_id", "y", "x").agg(F.sum(F.col("v") * F.col("w")).alias("v"), F.count("*").alias("n"))
    return out.where(F.col("n") == n).drop("n")


#: 3 x 3 kernels, fixed values.
SOBEL_X = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SOBEL_Y = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]
SCHARR_X = [[-3, 0, 3], [-10, 0, 10], [-3, 0, 3]]
SCHARR_Y = [[-3, -10, -3], [0, 0, 0], [3, 10, 3]]
LAPLACIAN = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]
GAUSS_3 = [[1 / 16, 2 / 16, 1 / 16], [2 / 16, 4 / 16, 2 / 16], [1 / 16, 2 / 16, 1 / 16]]


def gradient(px: DataFrame, kx=SOBEL_X, ky=SOBEL_Y) -> DataFrame:
    """Gradient components and magnitude, interior pixels: one pass for both kernels."""
    table = F.array(*[F.struct(F.lit(r - 1).alias("dr"), F.lit(c - 1).alias("dc"), F.lit(float(kx[r][c])).alias("wx"), F.lit(float(ky[r][c])).alias("wy")) for r in range(3) for c in range(3)])
    rows = px.select("image_id", "y", "x", "v", F.explode(table).alias("o")).select("image_id", (F.col("y") - F.col("o.dr")).alias("y"), (F.col("x") - F.col("o.dc")).alias("x"), (F.col("v") * F.col("o.wx")).alias("a"), (F.col("v") * F.col("o.wy")).alias("b"))
    out = rows.groupBy("image_id", "y", "x").agg(F.sum("a").alias("gx"), F.sum("b").alias("gy"), F.count("*").alias("n")).where("n = 9").drop("n")
    return out.withColumn("magnitude", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def morphology(px: DataFrame, op: str, size: int = 3) -> DataFrame:
    """erode, dilate, open or close with a square; pixels outside the image do not count."""
    if op in ("open", "close"):
        first, second = ("erode", "dilate") if op == "open" else ("dilate", "erode")
        return morphology(morphology(px, first, size), second, size)
    w = windows(px, "image_id", "y", "x", "v", size)
    own = F.max(((F.col("dr") == 0) & (F.col("dc") == 0)).cast("int"))
    pick = {"erode": F.min, "dilate": F.max}[op]
    return w.groupBy("image_id", "y", "x").agg(pick("v").alias("v"), own.alias("real")).where("real = 1").drop("real")


def preprocess(px: DataFrame, low: int | None = None, invert: bool = False) -> DataFrame:
    """Optional threshold, then optional inversion."""
    out = threshold(px, low) if low is not None else px
    return out.withColumn("v", 255 - F.col("v")) if invert else out
