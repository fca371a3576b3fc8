"""Measurements over grids: one aggregate pass each, grouped by grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import verdict
from ..sources.grids import with_xy
from .gates import Requirements, Roi, gated, samples

#: Smallest share of Sxx * Syy that the determinant of a plane fit may have.
DEGENERATE = 1e-12


def thickness(meta: DataFrame, cells: DataFrame, low: float, high: float, roi: Roi | None = None, requirements: Requirements | None = None, min_samples: int = 1, min_coverage: float = 0.0) -> DataFrame:
    """Minimum, maximum, mean, range and out-of-limit counts; the limits themselves pass."""
    agg = samples(cells, roi).groupBy("grid_id").agg(
        F.count("h").alias("valid"), F.min("h").alias("min_h"), F.max("h").alias("max_h"), F.avg("h").alias("mean_h"),
        F.count_if(F.col("h") < low).alias("n_below"), F.count_if(F.col("h") > high).alias("n_above"),
    )
    rows = gated(meta, agg, roi, requirements, min_samples, min_coverage, parameters_ok=low <= high and min_samples > 0 and 0 <= min_coverage <= 1)
    ok = (F.col("n_below") == 0) & (F.col("n_above") == 0)
    return rows.withColumn("range_h", F.col("max_h") - F.col("min_h")).withColumns(verdict(F.col("error_code"), ok))


def plane(samples_: DataFrame, key: str, x: str, y: str, z: str) -> DataFrame:
    """Per key: n, a, b, c of z = a x + b y + c and whether the fit is degenerate; centred sums."""
    s = samples_.groupBy(key).agg(
        F.count(z).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"),
        F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy"), F.covar_pop(x, y).alias("sxy"),
        F.covar_pop(x, z).alias("sxz"), F.covar_pop(y, z).alias("syz"),
    )
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    s = s.withColumn("det", det).withColumn("degenerate", (F.col("n") < 3) | (F.col("det") <= DEGENERATE * F.col("sxx") * F.col("syy")))
    a = F.try_divide(F.col("sxz") * F.col("syy") - F.col("syz") * F.col("sxy"), F.col("det"))
    b = F.try_divide(F.col("syz") * F.col("sxx") - F.col("sxz") * F.col("sxy"), F.col("det"))
    s = s.withColumns({"a": F.when(~F.col("degenerate"), a), "b": F.when(~F.col("degenerate"), b)})
    return s.select(key, "n", "a", "b", (F.col("mz") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).alias("c"), "degenerate")


def warpage(meta: DataFrame, cells: DataFrame, max_peak_to_valley: float, max_rms: float | None = None, roi: Roi | None = None, min_samples: int = 3, min_coverage: float = 0.0) -> DataFrame:
    """Peak to valley and RMS of the residuals to the least-squares plane."""
    xyz = with_xy(samples(cells, roi), meta)
    fit = plane(xyz, "grid_id", "x", "y", "h")
    res = xyz.join(fit, "grid_id").withColumn("res", F.col("h") - (F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c")))
    agg = res.groupBy("grid_id").agg(
        F.count("h").alias("valid"), F.first("a").alias("slope_x"), F.first("b").alias("slope_y"), F.first("c").alias("intercept"),
        F.min("res").alias("min_res"), F.max("res").alias("max_res"), rms("res").alias("rms"), F.first("degenerate").alias("degenerate"),
    )
    rows = gated(meta, agg, roi, None, max(3, min_samples), min_coverage)
    rows = rows.withColumn("error_code", F.when((F.col("error_code") == 0) & F.col("degenerate"), 140).otherwise(F.col("error_code")))
    rows = rows.withColumn("peak_to_valley", F.col("max_res") - F.col("min_res"))
    ok = F.col("peak_to_valley") <= max_peak_to_valley
    if max_rms is not None:
        ok = ok & (F.col("rms") <= max_rms)
    return rows.withColumns(verdict(F.col("error_code"), ok))


def rms(c: str | Column) -> Column:
    """Root mean square that survives large values: scaled by the largest magnitude."""
    c = F.col(c) if isinstance(c, str) else c
    big = F.max(F.abs(c))
    small = F.sqrt(F.avg(c * c))
    return F.when(big < 1e150, small).otherwise(big * F.sqrt(F.avg(F.pow(c / 1e150, F.lit(2)))) / (big / 1e150))


def datum_deviation(meta: DataFrame, cells: DataFrame, normal: tuple[float, float, float], offset: float, max_deviation: float, min_height_share: float = 0.1, roi: Roi | None = None) -> DataFrame:
    """Raw heights against the fixed plane nx X + ny H + nz Y + d = 0, with the first extreme cells."""
    size = sum(v * v for v in normal) ** 0.5
    ok_plane = size > 0 and abs(normal[1]) / size >= min_height_share
    nx, ny, nz, d = (v / size for v in (*normal, offset)) if ok_plane else (0.0, 1.0, 0.0, 0.0)
    res = with_xy(samples(cells, roi), meta).withColumn("res", F.col("h") + (nx * F.col("x") + nz * F.col("y") + d) / ny)
    agg = res.groupBy("grid_id").agg(
        F.count("h").alias("valid"), F.min("res").alias("min_res"), F.max("res").alias("max_res"), F.avg("res").alias("mean_res"),
        F.min(F.struct(F.col("res"), "row", "col")).alias("lo"), F.min(F.struct((-F.col("res")).alias("res"), "row", "col")).alias("hi"),
    )
    rows = gated(meta, agg, roi, parameters_ok=ok_plane)
    flat = {"min_row": F.col("lo.row"), "min_col": F.col("lo.col"), "max_row": F.col("hi.row"), "max_col": F.col("hi.col")}
    ok = F.greatest(F.abs("min_res"), F.abs("max_res")) <= max_deviation
    return rows.withColumns(flat).drop("lo", "hi").withColumns(verdict(F.col("error_code"), ok))


def region_statistics(meta: DataFrame, cells: DataFrame, roi: Roi | None = None) -> DataFrame:
    """Count, sum, minimum, maximum, mean and coverage of a region; null metrics when it is empty."""
    agg = samples(cells, roi).groupBy("grid_id").agg(F.count("h").alias("valid"), F.sum("h").alias("sum_h"), F.min("h").alias("min_h"), F.max("h").alias("max_h"), F.avg("h").alias("mean_h"))
    return gated(meta, agg, roi, min_samples=0)


def peak_deviation(stats: DataFrame, tolerance: float) -> DataFrame:
    """The larger distance of an extreme from the mean, held against a tolerance."""
    rows = stats.withColumn("peak", F.greatest(F.abs(F.col("mean_h") - F.col("min_h")), F.abs(F.col("max_h") - F.col("mean_h"))))
    return rows.withColumn("within", F.col("peak") <= tolerance)


def histogram(values: DataFrame, key: str, value: str, bins: int) -> DataFrame:
    """(key, bin, n, lo, hi) for every bin, empty ones too; all in bin 0 when the span is 0."""
    v = F.col(value)
    lim = values.where(v.isNotNull()).groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    span = F.col("hi") - F.col("lo")
    place = F.when(span > 0, F.least(F.lit(bins - 1), F.floor(F.try_divide(v - F.col("lo"), span) * bins).cast("int"))).otherwise(0)
    n = values.where(v.isNotNull()).join(lim, key).groupBy(key, place.alias("bin")).agg(F.count("*").alias("n"))
    every = lim.select(key, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(n, [key, "bin"], "left").select(key, "bin", F.coalesce("n", F.lit(0)).alias("n"), "lo", "hi")


def peak_bin(hist: DataFrame, key: str, bins: int) -> DataFrame:
    """The fullest bin of each key (the lowest of equals), its share and its centre."""
    best = hist.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("k"), "bin", "lo", "hi")).alias("b"), F.sum("n").alias("valid"))
    width = (F.col("b.hi") - F.col("b.lo")) / bins
    return best.select(key, F.col("b.bin").alias("peak_bin"), (-F.col("b.k")).alias("peak_n"), (-F.col("b.k") / F.col("valid")).alias("peak_share"), (F.col("b.lo") + width * (F.col("b.bin") + 0.5)).alias("peak_center"))


def grid_summary(cells: DataFrame, bins: int, zero_is_missing: bool = True) -> DataFrame:
    """Float heights: zero, missing and valid counts, extremes, mean and the fullest bin."""
    f = cells.withColumn("f", F.col("h").cast("float").cast("double"))
    use = f.withColumn("v", F.when(F.col("f") != 0, F.col("f")) if zero_is_missing else F.col("f"))
    agg = use.groupBy("grid_id").agg(F.count("*").alias("total"), F.count("v").alias("valid"), F.count_if(F.col("f") == 0).alias("zeros"), F.count_if(F.col("f").isNull()).alias("non_finite"), F.min("v").alias("min_h"), F.max("v").alias("max_h"), F.avg("v").alias("mean_h"))
    return agg.join(peak_bin(histogram(use, "grid_id", "v", bins), "grid_id", bins), "grid_id", "left")


def part_cells(cells: DataFrame, origin: tuple[int, int], layout: tuple[int, int], pitch: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """Cells that lie in a part of a layout, with its part_row and part_col."""
    if pitch[0] < size[0] or pitch[1] < size[1] or layout[0] <= 0 or layout[1] <= 0:
        raise ValueError("parts must not overlap")
    r, c = F.col("row") - origin[0], F.col("col") - origin[1]
    i, j = F.floor(r / pitch[0]).cast("int"), F.floor(c / pitch[1]).cast("int")
    inside = (r >= 0) & (c >= 0) & (i < layout[0]) & (j < layout[1]) & (r - i * pitch[0] < size[0]) & (c - j * pitch[1] < size[1])
    return cells.where(inside).withColumns({"part_row": i, "part_col": j})


def completeness(cells: DataFrame, reference: Roi, origin: tuple[int, int], layout: tuple[int, int], pitch: tuple[int, int], size: tuple[int, int], min_coverage: float, low: float, high: float) -> DataFrame:
    """Presence of each part of a layout: its mean above the reference's, its coverage, its disposition."""
    ref = samples(cells, reference).groupBy("grid_id").agg(F.avg("h").alias("ref"))
    own = part_cells(cells, origin, layout, pitch, size).groupBy("grid_id", "part_row", "part_col").agg(F.count("h").alias("valid"), F.avg("h").alias("mean_h"))
    ids = cells.select("grid_id").distinct()
    every = ids.select("grid_id", F.explode(F.sequence(F.lit(0), F.lit(layout[0] - 1))).alias("part_row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(layout[1] - 1))).alias("part_col"))
    rows = every.join(own, ["grid_id", "part_row", "part_col"], "left").join(ref, "grid_id", "left")
    rows = rows.withColumn("coverage", F.coalesce("valid", F.lit(0)) / (size[0] * size[1])).withColumn("relative", F.col("mean_h") - F.col("ref"))
    state = F.when(F.col("ref").isNull(), "NotEvaluated").when((F.col("coverage") < min_coverage) | F.col("relative").isNull(), "Fail").when(F.col("relative").between(low, high), "Pass").otherwise("Fail")
    return rows.select("grid_id", "part_row", "part_col", F.coalesce("valid", F.lit(0)).alias("valid"), "coverage", "relative", state.alias("disposition"))


def evidence_by_role(obs: DataFrame, roles: tuple[str, ...] = ("Good", "Bad", "HeldOut")) -> DataFrame:
    """Per series and role: samples, values, extremes, mean, population deviation; empty roles stay."""
    every = obs.select("series_id").distinct().select("series_id", F.explode(F.array(*map(F.lit, roles))).alias("role"))
    agg = obs.groupBy("series_id", "role").agg(F.countDistinct("sample_id").alias("samples"), F.count("value").alias("n"), F.min("value").alias("min_v"), F.max("value").alias("max_v"), F.avg("value").alias("mean_v"), F.stddev_pop("value").alias("std_v"))
    return every.join(agg, ["series_id", "role"], "left").na.fill(0, ["samples", "n"])


def repeatability(obs: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, sample deviation, six sigma and range; two values at least."""
    agg = obs.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean_v"), F.stddev_samp(value).alias("std_v"), (F.max(value) - F.min(value)).alias("range_v"))
    return agg.where("n >= 2").withColumn("six_sigma", 6 * F.col("std_v"))


def float_plane(points: DataFrame, key: str = "set_id") -> DataFrame:
    """Height-field plane y = a x + b z + c; the unit normal in float, as the distances to it."""
    fit = plane(points, key, "x", "z", "y")
    size = F.sqrt(F.col("a") * F.col("a") + 1 + F.col("b") * F.col("b"))
    flt = lambda c: c.cast("float")
    return fit.withColumns({"nx": flt(-F.col("a") / size), "ny": flt(1 / size), "nz": flt(-F.col("b") / size), "nd": flt(-F.col("c") / size)})


def signed_distance() -> Column:
    """Distance of (x, y, z) to a plane of ``float_plane``, in float arithmetic."""
    flt = lambda c: F.col(c).cast("float")
    return F.col("nx") * flt("x") + F.col("ny") * flt("y") + F.col("nz") * flt("z") + F.col("nd")


def plane_report(points: DataFrame) -> DataFrame:
    """Fit and worst sample (largest distance, the first of equals) of every set."""
    fit = float_plane(points)
    d = points.join(fit, "set_id").withColumn("d", signed_distance())
    worst = d.groupBy("set_id").agg(F.min(F.struct((-F.abs("d")).alias("k"), "ord")).alias("w"))
    return fit.join(worst, "set_id").select("set_id", "n", "a", "b", "c", F.col("w.ord").alias("worst_ord"), "degenerate")


def dual_thickness(reference: DataFrame, measured: DataFrame, low: float, high: float) -> DataFrame:
    """Raw heights above the reference plane: extremes, mean, population deviation, counts outside."""
    fit = plane(reference, "set_id", "x", "z", "y")
    t = measured.join(fit.select("set_id", "a", "b", "c"), "set_id").withColumn("t", F.col("raw_h") - (F.col("a") * F.col("x") + F.col("b") * F.col("z") + F.col("c")))
    agg = t.groupBy("set_id").agg(F.count("t").alias("n"), F.min("t").alias("min_t"), F.max("t").alias("max_t"), F.avg("t").alias("mean_t"), F.stddev_pop("t").alias("std_t"), F.count_if(F.col("t") < low).alias("n_below"), F.count_if(F.col("t") > high).alias("n_above"))
    return agg.withColumns({"range_t": F.col("max_t") - F.col("min_t"), "passed": (F.col("n_below") == 0) & (F.col("n_above") == 0)})


def flatness(reference: DataFrame, measured: DataFrame, tolerance: float) -> DataFrame:
    """Span of the signed distances to the reference plane, and where its ends are."""
    d = measured.join(float_plane(reference), "set_id").withColumn("d", signed_distance().cast("double"))
    agg = d.groupBy("set_id").agg(F.min("d").alias("min_d"), F.max("d").alias("max_d"), rms("d").alias("rms_d"), F.min(F.struct("d", "ord")).alias("lo"), F.min(F.struct((-F.col("d")).alias("k"), "ord")).alias("hi"))
    rows = agg.select("set_id", "min_d", "max_d", (F.col("max_d") - F.col("min_d")).alias("flatness"), "rms_d", F.col("lo.ord").alias("min_ord"), F.col("hi.ord").alias("max_ord"))
    return rows.withColumn("passed", F.col("flatness") <= tolerance)


def volume(reference: DataFrame, measured: DataFrame, cell_area: float, expected: float, tolerance: float) -> DataFrame:
    """Volume above and below the reference plane, and their sum against a tolerance."""
    fit = plane(reference, "set_id", "x", "z", "y")
    t = measured.join(fit.select("set_id", "a", "b", "c"), "set_id").withColumn("t", F.col("y") - (F.col("a") * F.col("x") + F.col("b") * F.col("z") + F.col("c")))
    agg = t.groupBy("set_id").agg((F.sum(F.greatest("t", F.lit(0.0))) * cell_area).alias("above"), (F.sum(F.greatest(-F.col("t"), F.lit(0.0))) * cell_area).alias("below"))
    return agg.withColumn("net", F.col("above") - F.col("below")).withColumn("passed", F.abs(F.col("net") - expected) <= tolerance)


def cross_section(points: DataFrame, key: str, axis: str, height: str, width: float, width_tol: float, drop: float, drop_tol: float) -> DataFrame:
    """Width along an axis and range of heights; two samples at least."""
    agg = points.groupBy(key).agg(F.count("*").alias("n"), (F.max(axis) - F.min(axis)).alias("width"), (F.max(height) - F.min(height)).alias("height_range"))
    ok = (F.abs(F.col("width") - width) <= width_tol) & (F.abs(F.col("height_range") - drop) <= drop_tol)
    return agg.where("n >= 2").withColumn("passed", ok)


def gap_flush(left: DataFrame, right: DataFrame, key: str, u: str, height: str, gap: float, gap_tol: float, flush: float, flush_tol: float) -> DataFrame:
    """Gap between the right's nearest and the left's farthest position; flush as difference of means."""
    a = left.groupBy(key).agg(F.max(u).alias("end_l"), F.avg(height).alias("mean_l"))
    b = right.groupBy(key).agg(F.min(u).alias("begin_r"), F.avg(height).alias("mean_r"))
    rows = a.join(b, key).select(key, (F.col("begin_r") - F.col("end_l")).alias("gap"), (F.col("mean_r") - F.col("mean_l")).alias("flush"))
    return rows.withColumns({"gap_ok": F.abs(F.col("gap") - gap) <= gap_tol, "flush_ok": F.abs(F.col("flush") - flush) <= flush_tol})


def roi_means(px: DataFrame, rois: list[tuple[str, int, int, int, int]], deviation: bool = False) -> DataFrame:
    """Mean (or population deviation) of the pixels of named regions (x, y, width, height), to one decimal, half to even."""
    named = F.array(*[F.struct(F.lit(n).alias("roi"), F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(w).alias("w"), F.lit(h).alias("h")) for n, x, y, w, h in rois])
    hit = F.filter(named, lambda r: (F.col("x") >= r["x0"]) & (F.col("x") < r["x0"] + r["w"]) & (F.col("y") >= r["y0"]) & (F.col("y") < r["y0"] + r["h"]))
    rows = px.select("image_id", "v", F.explode(F.transform(hit, lambda r: r["roi"])).alias("roi"))
    value = F.stddev_pop("v") if deviation else F.avg("v")
    return rows.groupBy("image_id", "roi").agg(F.bround(value, 1).alias("value"), F.count("*").alias("n"))


def percentile_rank(values: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """Nearest-rank percentile: the value of rank ceil(p n)."""
    return values.where(F.col(value).isNotNull()).groupBy(key).agg(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias("value"))


def clamped_geometric_mean(columns: list[Column]) -> Column:
    """Geometric mean of scores clamped to 0..1."""
    product = F.lit(1.0)
    for c in columns:
        product = product * F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return F.pow(product, F.lit(1.0 / len(columns)))


def list_metrics(results: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Count, and minimum, maximum and mean of each listed result column."""
    parts = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    return results.groupBy(key).agg(F.count("*").alias("count"), *parts)


def roll_up(results: DataFrame, key: str, ok: str) -> DataFrame:
    """All steps passed, and how many have not."""
    return results.groupBy(key).agg(F.bool_and(ok).alias("passed"), F.count_if(~F.col(ok)).alias("n_failed"))
