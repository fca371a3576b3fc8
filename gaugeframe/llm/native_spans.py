"""Where a regular expression matches, with DataFrame functions alone.

Spark returns what matched but not where.  Splitting at the same expression
gives the text between the matches; running sums of the measures of both give
the positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one inner running sum covers; keeps the work near linear.
_BLOCK = 128
NO_SPANS = "array<struct<start:bigint,end:bigint,match:string,part:string>>"


def _prefix(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """What ``combine`` makes of each beginning of a short array of longs."""
    begin = F.struct(zero.alias("s"), F.array().cast("array<bigint>").alias("a"))

    def step(acc: Column, v: Column) -> Column:
        now = combine(acc["s"], v)
        return F.struct(now.alias("s"), F.concat(acc["a"], F.array(now)).alias("a"))

    return F.aggregate(values, begin, step, lambda acc: acc["a"])


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once: higher-order functions would repeat what they hold twice."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """What an associative ``combine`` makes of each beginning of an array of longs, in blocks."""

    def whole(inner: Column) -> Column:
        before = F.concat(F.array(zero), _prefix(F.transform(inner, lambda x: F.element_at(x, -1)), combine, zero))
        none = F.array().cast("array<bigint>")
        return F.flatten(F.zip_with(inner, before, lambda x, o: F.transform(F.coalesce(x, none), lambda v: combine(o, v))))

    def blocks(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)))
        return F.when(F.size(v) > 0, let(F.transform(cut, lambda x: _prefix(x, combine, zero)), whole)).otherwise(F.array().cast("array<bigint>"))

    return let(values, blocks)


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array of longs."""
    return running(values, lambda a, b: a + b, F.lit(0).cast("long"))


def running_max(values: Column, least: int = -1) -> Column:
    """Inclusive running maxima of an array of longs, ``least`` at least."""
    return running(values, F.greatest, F.lit(least).cast("long"))


def running_min(values: Column, most: int = (1 << 62)) -> Column:
    """Inclusive running minima of an array of longs, ``most`` at most."""
    return running(values, F.least, F.lit(most).cast("long"))


def char_count(c: Column) -> Column:
    return F.char_length(c).cast("long")


def find(text: Column, pattern: Column | str, group: int = 0, measure: Callable[[Column], Column] = char_count) -> Column:
    """Array of (start, end, text of the match, text of ``group``) for all matches of a pattern.

    Leftmost, non-overlapping; positions count from 0 in ``measure``, the end is
    exclusive.  The pattern must not match an empty string.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern

    def spans(found: Column) -> Column:
        gaps = F.slice(F.split(text, p, -1), 1, F.size(found))
        ends = running_sums(F.zip_with(gaps, found, lambda g, m: measure(g) + measure(m)))
        parts = found if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
        placed = F.zip_with(found, ends, lambda m, e: F.struct((e - measure(m)).alias("start"), e.alias("end"), m.alias("match")))
        return F.zip_with(placed, parts, lambda s, g: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), g.alias("part")))

    return let(F.regexp_extract_all(text, p, F.lit(0)), lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(F.array().cast(NO_SPANS)))


def find_gated(text: Column, gate: Column, pattern: Column | str, group: int = 0, measure: Callable[[Column], Column] = char_count) -> Column:
    """``find`` where ``gate`` holds, else no spans."""
    return F.when(gate, find(text, pattern, group, measure)).otherwise(F.array().cast(NO_SPANS))
