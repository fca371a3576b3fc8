"""Fixed schemas of the relations, and the state machine of results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID_META = "grid_id string, rows int, cols int, origin_x double, origin_y double, col_pitch double, row_pitch double, planar_unit string, height_unit string, frame_id string, source_id string"
GRID_CELLS = "grid_id string, row int, col int, h double"
POINTS = "set_id string, ord long, row int, col int, x double, y double, z double, raw_h double"
TRIANGLES = "mesh_id string, tri_id int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"
IMAGES = "image_id string, width int, height int, channels int, data binary"
PIXELS = "image_id string, y int, x int, v int"
OBS = "series_id string, idx int, sample_id string, role string, value double"

#: Error codes of 3-D inspections and their statuses, fixed values.
ERROR_CODES = {
    "None": 0, "Unknown": 1, "InputHeightMapInvalid": 100, "InputContractMismatch": 105, "InvalidRoi": 110, "InvalidParameter": 120,
    "InsufficientValidSamples": 130, "InsufficientValidCoverage": 131, "DegenerateGeometry": 140, "ToolNotConfigured": 200, "ToolExecutionException": 210,
}
STATUSES = {
    0: "Passed", 100: "InvalidInput", 105: "InvalidInput", 110: "InvalidRoi", 120: "InvalidParameter", 130: "InsufficientData",
    131: "InsufficientData", 140: "DegenerateGeometry", 200: "ConfigurationError", 210: "Exception",
}


#: Error codes of 2-D tools by status, fixed values; any other code but 0 has failed.
IMAGE_STATUSES = {
    "InvalidInput": (100, 101, 1024),
    "InvalidRoi": (110, 401, 501, 602, 700, 800, 850, 901, 1020),
    "InvalidParameter": (
        120, 350, 351, 352, 360, 361, 370, 371, 380, 381, 382, 400, 402, 500, 503, 603, 604, 605, 701, 702, 801, 851, 903,
        1000, 1010, 1011, 1012, 1013, 1014, 1015, 1021, 1022,
    ),
    "ConfigurationError": (121, 130, 131, 200, 600, 601, 900, 902),
    "Timeout": (300,),
    "Canceled": (301,),
    "Exception": (210, 220, 502),
}


def image_status_of(code: Column) -> Column:
    """Status of a 2-D tool's error code: total over all integers."""
    out = F.when(code == 0, "Passed")
    for status, codes in IMAGE_STATUSES.items():
        out = out.when(code.isin(*codes), status)
    return out.otherwise("Failed")


def status_of(code: Column) -> Column:
    """Status of an error code; a code without one has failed."""
    out = None
    for k, v in STATUSES.items():
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out.otherwise("Failed")


def verdict(code: Column, within: Column) -> dict[str, Column]:
    """success, has_measurement, outcome and status from an error code and a tolerance test.

    A measurement out of tolerance has failed but stays measured.
    """
    measured = code == 0
    ok = measured & F.coalesce(within, F.lit(False))
    return {
        "success": ok,
        "has_measurement": measured,
        "outcome": F.when(~measured, "NotMeasured").when(ok, "Passed").otherwise("OutOfTolerance"),
        "status": F.when(measured & ~ok, "Failed").otherwise(status_of(code)),
    }


def result_row(df, tool: str, metrics: dict[str, str], target: str = "grid_id"):
    """The common result relation: one row per target with string-keyed metric maps."""
    entries = F.array(*[F.struct(F.lit(k), F.col(k).cast("double")) for k in metrics])
    units = F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in metrics.items()])
    measured = F.col("has_measurement")
    empty = lambda kind: F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(kind))
    return df.select(
        F.col(target).alias("target_id"), F.lit(tool).alias("tool"), "success", "has_measurement", "outcome", "error_code", "status",
        F.when(measured, "").otherwise(F.col("status")).alias("message"),
        F.when(measured, F.map_from_entries(entries)).otherwise(empty("array<double>")).alias("metrics"),
        F.when(measured, F.map_from_entries(units)).otherwise(empty("array<string>")).alias("metric_units"),
    )


def metric(name: str) -> Column:
    """A metric by name in either case, or null."""
    found = F.map_filter("metrics", lambda k, _: F.lower(k) == name.lower())
    return F.get(F.map_values(found), F.lit(0))
