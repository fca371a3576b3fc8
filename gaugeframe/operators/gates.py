"""Regions, input contracts, sample counts and tolerance tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Roi:
    """Half-open region of cells."""

    row: int
    col: int
    rows: int
    cols: int

    def valid_for(self, rows: Column, cols: Column) -> Column:
        """Inside a grid of the given extent, in 64-bit arithmetic."""
        shape = self.row >= 0 and self.col >= 0 and self.rows > 0 and self.cols > 0
        return F.lit(shape) & (F.lit(self.row + self.rows).cast("long") <= rows) & (F.lit(self.col + self.cols).cast("long") <= cols)

    def holds(self) -> Column:
        """The cell is in the region: a range predicate that reaches the scan."""
        return F.col("row").between(self.row, self.row + self.rows - 1) & F.col("col").between(self.col, self.col + self.cols - 1)


@dataclass(frozen=True)
class Requirements:
    """Units and frame an inspection expects, compared letter by letter."""

    planar_unit: str
    height_unit: str
    frame_id: str

    def met(self) -> Column:
        return (F.col("planar_unit") == self.planar_unit) & (F.col("height_unit") == self.height_unit) & (F.col("frame_id") == self.frame_id)


def in_roi(cells: DataFrame, roi: Roi | None) -> DataFrame:
    """Cells of a region; no region is the whole grid."""
    return cells if roi is None else cells.where(roi.holds())


def samples(cells: DataFrame, roi: Roi | None = None) -> DataFrame:
    """Cells of a region with a height."""
    return in_roi(cells, roi).where("h IS NOT NULL")


def gated(meta: DataFrame, measured: DataFrame, roi: Roi | None = None, requirements: Requirements | None = None, min_samples: int = 1, min_coverage: float = 0.0, euclidean: bool = False, parameters_ok: bool = True) -> DataFrame:
    """Every grid of ``meta`` with total, valid, missing, coverage and error_code.

    ``measured`` has one row per grid with ``valid`` and any metrics.  Absent cells
    are samples too, so the total comes from the region's extent.  The first
    gate that fails gives the code: contract, region, parameters, count,
    coverage.
    """
    area = F.lit(None) if roi is None else F.lit(roi.rows * roi.cols)
    rows = meta.join(measured, "grid_id", "left")
    total = F.coalesce(area, F.col("rows") * F.col("cols")).cast("long")
    valid = F.coalesce(F.col("valid"), F.lit(0)).cast("long")
    coverage = F.when(total > 0, valid / total).otherwise(0.0)
    contract = requirements.met() if requirements else F.lit(True)
    if euclidean:
        contract = contract & (F.col("planar_unit") == F.col("height_unit"))
    region = roi.valid_for(F.col("rows"), F.col("cols")) if roi else F.lit(True)
    code = (
        F.when(F.lit(not parameters_ok), 120).when(~contract, 105).when(~region, 110)
        .when(valid < min_samples, 130).when(coverage < min_coverage, 131).otherwise(0)
    )
    return rows.withColumns({"total": total, "valid": valid, "missing": total - valid, "coverage": coverage, "error_code": code})


def within(actual: Column, expected: Column | float, tolerance: Column | float) -> Column:
    """Inclusive absolute tolerance."""
    return F.abs(actual - expected) <= tolerance


def image_regions(regions: DataFrame, sizes: DataFrame, whole_allowed: bool = True) -> DataFrame:
    """Regions (image_id, roi, x, y, w, h) held against image sizes: an empty one is the whole image if allowed."""
    j = regions.join(sizes.select("image_id", "width", "height"), "image_id", "left")
    empty = (F.col("w") == 0) | (F.col("h") == 0)
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("w") >= 0) & (F.col("h") >= 0) & (F.col("x") + F.col("w") <= F.col("width")) & (F.col("y") + F.col("h") <= F.col("height"))
    ok = F.when(empty, F.lit(whole_allowed)).otherwise(F.coalesce(inside, F.lit(False)))
    use = lambda c, whole: F.when(empty, whole).otherwise(F.col(c)).alias(c)
    return j.select("image_id", "roi", ok.alias("valid"), use("x", F.lit(0)), use("y", F.lit(0)), use("w", F.col("width")), use("h", F.col("height")))


def area_filter(rows: DataFrame, low: float, high: float, area: str = "area") -> DataFrame:
    """Rows with an area between two limits, both inclusive; limits out of order are an error."""
    if low > high:
        raise ValueError("least area above largest")
    return rows.where(F.col(area).between(low, high))
