"""Samples, ranks and candidate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arg_max(rows: DataFrame, key: str, score: str, y: str, x: str) -> DataFrame:
    """Best score of each key; ties by smaller y, then smaller x (strict order, no tolerance)."""
    best = rows.groupBy(key).agg(F.min(F.struct((-F.col(score)).alias("k"), F.col(y).alias("y"), F.col(x).alias("x"))).alias("b"))
    return best.select(key, F.col("b.y").alias(y), F.col("b.x").alias(x), (-F.col("b.k")).alias(score))


def top_per_cell(rows: DataFrame, key: str, y: str, x: str, score: str, height: int, width: int, cells: int = 4, k: int = 2) -> DataFrame:
    """The best ``k`` candidates of each cell of a cells x cells layout; ties by y, then x."""
    cell = lambda c, size: F.least(F.lit(cells - 1), F.floor(F.col(c) * cells / size).cast("int"))
    rows = rows.withColumns({"cell_y": cell(y, height), "cell_x": cell(x, width)})
    w = Window.partitionBy(key, "cell_y", "cell_x").orderBy(F.desc(score), y, x)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def even_sample(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Rows at (2 i + 1) n / (2 k) for i below k = min(most, n), in whole numbers; ``order`` counts from 0."""
    n = rows.groupBy(key).agg(F.count("*").alias("__n")).withColumn("__k", F.least(F.col("__n"), F.lit(most)))
    at = n.select(key, "__n", "__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1)).alias("sample"))
    at = at.select(key, "sample", F.floor((2 * F.col("sample") + 1) * F.col("__n") / (2 * F.col("__k"))).cast("long").alias(order))
    return at.join(rows, [key, order])


def floor_sample(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Rows at floor(i n / most): a template's points thinned."""
    n = rows.groupBy(key).agg(F.count("*").alias("__n"))
    at = n.select(key, "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("__n"), F.lit(most)) - 1)).alias("sample"))
    return at.select(key, "sample", F.when(F.col("__n") <= most, F.col("sample")).otherwise(F.floor(F.col("sample") * F.col("__n") / most)).cast("long").alias(order)).join(rows, [key, order])


def stride_sample(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Every ceil(n / most)-th row, ``most`` at most: what a display shows."""
    n = rows.groupBy(key).agg(F.count("*").alias("__n"))
    j = rows.join(n, key).withColumn("__s", F.ceil(F.col("__n") / most))
    return j.where((F.pmod(F.col(order), F.col("__s")) == 0) & (F.col(order) < F.col("__s") * most)).drop("__n", "__s")


def reindex(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """1-based index in order."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def ranked(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key in the given order, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most)


def threshold_candidates(obs: DataFrame, key: str, value: str, accepted: str) -> DataFrame:
    """Best minimum, maximum and range limit of each key by errors, false accepts, false rejects.

    Every distinct value is a candidate, and so is rejecting all (``reject_all``).
    Ties: the larger minimum, the smaller maximum, the narrowest range and then
    the larger minimum.  Counts come from running sums, never from pairing
    thresholds; a range's errors are a sum of what its two ends add, so the best
    lower end for each upper end is a running minimum.
    """
    good, bad = F.col(accepted).cast("long"), (~F.col(accepted)).cast("long")
    v = obs.groupBy(key, F.col(value).alias("t")).agg(F.sum(good).alias("g"), F.sum(bad).alias("b"))
    up = Window.partitionBy(key).orderBy("t")
    every = Window.partitionBy(key)
    v = v.select(key, "t", "g", "b", F.sum("g").over(up).alias("gu"), F.sum("b").over(up).alias("bu"), F.sum("g").over(every).alias("ga"), F.sum("b").over(every).alias("ba"))
    row = lambda lo, hi, fa, fr, tie: F.struct((fa + fr).alias("errors"), fa.alias("false_accepts"), fr.alias("false_rejects"), *[t.cast("double").alias(f"t{i}") for i, t in enumerate(tie)], lo.alias("lo"), hi.alias("hi"), F.lit(False).alias("reject_all"))
    nothing = F.lit(None).cast("double")
    t = F.col("t")
    low = row(t, nothing, F.col("ba") - F.col("bu") + F.col("b"), F.col("gu") - F.col("g"), [-t, F.lit(0)])
    high = row(nothing, t, F.col("bu"), F.col("ga") - F.col("gu"), [t, F.lit(0)])
    none = v.groupBy(key).agg(F.max("ga").alias("ga"))
    # rejecting all is the largest minimum and the smallest maximum, so it wins a tie
    sentinel = lambda kind: none.select(key, F.lit(kind).alias("kind"), F.struct(F.col("ga").alias("errors"), F.lit(0).cast("long").alias("false_accepts"), F.col("ga").alias("false_rejects"), F.lit(float("-inf")).alias("t0"), F.lit(0.0).alias("t1"), nothing.alias("lo"), nothing.alias("hi"), F.lit(True).alias("reject_all")).alias("c"))
    # with the lower end at a value: good ones before it are rejected, bad ones before it are not accepted
    lost, spared = F.col("gu") - F.col("g"), F.col("bu") - F.col("b")
    ends = v.withColumn("low", F.min(F.struct((lost - spared).alias("errors"), (-spared).alias("fa"), (-t).alias("lo"))).over(up))
    inside_b, outside_g = F.col("bu") + F.col("low.fa"), F.col("ga") - F.col("gu") + F.col("low.errors") - F.col("low.fa")
    both = ends.select(key, F.lit("Range").alias("kind"), row(-F.col("low.lo"), t, inside_b, outside_g, [t + F.col("low.lo"), F.col("low.lo")]).alias("c"))
    rows = v.select(key, F.lit("Minimum").alias("kind"), low.alias("c")).unionByName(v.select(key, F.lit("Maximum").alias("kind"), high.alias("c"))).unionByName(both)
    rows = rows.unionByName(sentinel("Minimum")).unionByName(sentinel("Maximum"))
    best = rows.groupBy(key, "kind").agg(F.min("c").alias("c"))
    return best.select(key, "kind", *[F.col(f"c.{n}").alias(n) for n in ("lo", "hi", "errors", "false_accepts", "false_rejects", "reject_all")])
