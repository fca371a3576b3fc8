"""Height grids, points and images: from arrays, and derived from the given tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import GRID_META, IMAGES


@dataclass(frozen=True)
class Meta:
    """Extent, pitch, units and frame of a grid; blank units and ids take their defaults."""

    rows: int
    cols: int
    origin_x: float = 0.0
    origin_y: float = 0.0
    col_pitch: float = 1.0
    row_pitch: float = 1.0
    planar_unit: str = "mm"
    height_unit: str = "mm"
    frame_id: str = "unspecified"
    source_id: str = "unspecified"

    def __post_init__(self):
        extent = (self.origin_x, self.origin_y, self.col_pitch, self.row_pitch)
        if self.rows <= 0 or self.cols <= 0 or self.rows * self.cols > 2**31 - 1:
            raise ValueError("rows and cols must be positive and at most 2**31 - 1 cells")
        if not all(abs(v) < float("inf") for v in extent) or self.col_pitch <= 0 or self.row_pitch <= 0:
            raise ValueError("origin must be finite and pitch positive")


def clean_height(h: Column) -> Column:
    """NaN is missing: null.  An infinity is corrupt and raises."""
    h = h.cast("double")
    bad = F.abs(h) == float("inf")
    return F.when(F.isnan(h), None).when(bad, F.raise_error(F.lit("a height is infinite")).cast("double")).otherwise(h)


def from_flat(spark: SparkSession, grid_id: str, meta: Meta, values: list[float | None]) -> tuple[DataFrame, DataFrame]:
    """(meta, cells) of a row-major list of heights."""
    if len(values) != meta.rows * meta.cols:
        raise ValueError(f"{len(values)} values for {meta.rows} x {meta.cols} cells")
    frame = spark.createDataFrame([(grid_id, meta.rows, meta.cols, [None if v is None else float(v) for v in values])], "grid_id string, rows int, cols int, v array<double>")
    cells = frame.select("grid_id", "cols", F.posexplode("v").alias("i", "h"))
    cells = cells.select("grid_id", F.floor(F.col("i") / F.col("cols")).cast("int").alias("row"), F.pmod("i", "cols").alias("col"), clean_height(F.col("h")).alias("h"))
    info = spark.createDataFrame([(grid_id, *meta.__dict__.values())], GRID_META)
    return info, cells


def from_rows(arrays: DataFrame) -> DataFrame:
    """Cells of (grid_id, values array<array<double>>): row, then column."""
    rows = arrays.select("grid_id", F.posexplode("values").alias("row", "__r"))
    return rows.select("grid_id", "row", F.posexplode("__r").alias("col", "h")).withColumn("h", clean_height(F.col("h")))


def cell(cells: DataFrame, row: int, col: int) -> DataFrame:
    """The height at one cell of every grid."""
    return cells.where((F.col("row") == row) & (F.col("col") == col))


def with_xy(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Cells with x = origin + col * pitch and y = origin + row * pitch."""
    joined = cells.join(meta.select("grid_id", "origin_x", "origin_y", "col_pitch", "row_pitch"), "grid_id")
    return joined.select(cells.columns + [(F.col("origin_x") + F.col("col") * F.col("col_pitch")).alias("x"), (F.col("origin_y") + F.col("row") * F.col("row_pitch")).alias("y")])


def copy_out(cells: DataFrame) -> DataFrame:
    """All heights of each grid in row-major order (a grid is one array by definition)."""
    packed = cells.groupBy("grid_id").agg(F.array_sort(F.collect_list(F.struct("row", "col", "h"))).alias("v"))
    return packed.select("grid_id", F.transform("v", lambda s: s["h"]).alias("values"))


# -- relations derived from the given tables -------------------------------------
GRID_ROWS = 100


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("i", "v"))


def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells: every 100 vectors are a grid of 64 columns, with holes where (row + col) % 17 = 0."""
    r = F.pmod("vec_id", F.lit(GRID_ROWS)).cast("int")
    cells = _components(spark, sf_dir).select(F.concat(F.lit("g"), F.floor(F.col("vec_id") / GRID_ROWS).cast("long").cast("string")).alias("grid_id"), r.alias("row"), F.col("i").alias("col"), F.col("v").cast("double").alias("v"))
    return cells.select("grid_id", "row", "col", F.when((F.col("row") + F.col("col")) % 17 != 0, F.col("v")).alias("h"))


def dense_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta of the dense grids: pitch 0.5 by 2, origin (10, -4)."""
    ids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / GRID_ROWS).cast("long").alias("g")).distinct()
    m = Meta(GRID_ROWS, 64, 10.0, -4.0, 0.5, 2.0, "mm", "mm", "sensor-top", "embeddings")
    return ids.select(F.concat(F.lit("g"), F.col("g").cast("string")).alias("grid_id"), *[F.lit(v).alias(k) for k, v in m.__dict__.items()])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_id (by 100 vectors), ord, x, y, z from the first three components, raw_h from the fourth."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return e.select(F.concat(F.lit("s"), F.floor(F.col("vec_id") / GRID_ROWS).cast("long").cast("string")).alias("set_id"), F.pmod("vec_id", F.lit(GRID_ROWS)).cast("long").alias("ord"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), at(3).alias("raw_h"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 64 vectors are an 8-bit image of 64 columns: v = floor((value + 1) * 127.5) in 0..255."""
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v").cast("double") + 1) * 127.5).cast("int")))
    return _components(spark, sf_dir).select(F.concat(F.lit("i"), F.floor(F.col("vec_id") / 64).cast("long").cast("string")).alias("image_id"), F.pmod("vec_id", F.lit(64)).cast("int").alias("y"), F.col("i").alias("x"), v.alias("v"))


def images(px: DataFrame) -> DataFrame:
    """Packed images of pixel rows; absent pixels are 0."""

    def pack(t: pa.Table) -> pa.Table:
        y, x, v = (t[c].to_numpy() for c in ("y", "x", "v"))
        a = np.zeros((int(y.max()) + 1, int(x.max()) + 1), np.uint8)
        a[y, x] = v
        columns = [pa.array([t["image_id"][0].as_py()]), *(pa.array([n], pa.int32()) for n in (a.shape[1], a.shape[0], 1)), pa.array([a.tobytes()], pa.binary())]
        return pa.table(columns, names=["image_id", "width", "height", "channels", "data"])

    return px.select("image_id", "y", "x", "v").groupBy("image_id").applyInArrow(pack, IMAGES)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled series: role from quality and toxic, value from the document's length."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    role = F.when(F.col("toxic") == 1, "HeldOut").when(F.col("quality") == 1, "Good").otherwise("Bad")
    return docs.join(labels, "doc_id").select(F.col("lang").alias("series_id"), F.col("doc_id").cast("int").alias("idx"), F.col("source").alias("sample_id"), role.alias("role"), F.col("n_chars").cast("double").alias("value"))


#: The same derivations in SQL, for the oracle.
GRID_SQL = """grid AS (SELECT 'g' || (vec_id // 100) AS grid_id, CAST(vec_id % 100 AS INTEGER) AS r, CAST(i AS INTEGER) AS c,
  CASE WHEN (vec_id % 100 + i) % 17 <> 0 THEN CAST(embedding[i + 1] AS DOUBLE) END AS h
  FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings))"""
XY_SQL = GRID_SQL + ", xy AS (SELECT *, 10.0::DOUBLE + c * 0.5::DOUBLE AS x, -4.0::DOUBLE + r * 2.0::DOUBLE AS y FROM grid)"
POINTS_SQL = """points AS (SELECT 's' || (vec_id // 100) AS set_id, vec_id % 100 AS ord, CAST(embedding[1] AS DOUBLE) AS x,
  CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS raw_h FROM embeddings)"""
PIXELS_SQL = """pixels AS (SELECT 'i' || (vec_id // 64) AS image_id, CAST(vec_id % 64 AS INTEGER) AS y, CAST(i AS INTEGER) AS x,
  CAST(least(255, greatest(0, floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 127.5::DOUBLE))) AS INTEGER) AS v
  FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings))"""
OBS_SQL = """obs AS (SELECT lang AS series_id, doc_id AS idx, source AS sample_id,
  CASE WHEN toxic = 1 THEN 'HeldOut' WHEN quality = 1 THEN 'Good' ELSE 'Bad' END AS role, CAST(n_chars AS DOUBLE) AS value
  FROM documents JOIN labels USING (doc_id))"""
