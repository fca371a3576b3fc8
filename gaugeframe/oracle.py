"""Small helpers that keep a query and its SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def rounded(c: str | Column, digits: int = DIGITS) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def sql_round(x: str, digits: int = DIGITS) -> str:
    return f"(round({x}, {digits}) + 0.0::DOUBLE)"


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Every double of a result rounded."""
    return df.select([rounded(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])
