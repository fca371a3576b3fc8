"""Connected components of an edge table, by rounds of minimum labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A key with more than one in so many rows is hot; so there are fewer hot keys than this.
HOT_SHARE = 10_000


def spread_join(big: DataFrame, small: DataFrame, on: str | list[str], by: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join of ``big`` with ``small``, one row a key, in which hot keys are dealt over many tasks.

    ``weight`` is the column of ``small`` with the rows that ``big`` has of a key (it
    goes), ``total`` all rows of ``big``.  A key with more than ``total / HOT_SHARE``
    rows is dealt by ``by`` over tasks in proportion to its rows.  There are
    fewer than ``HOT_SHARE`` such keys, so their list is sent to all machines.
    """
    on = [on] if isinstance(on, str) else on
    salts = F.ceil(F.col(weight) * HOT_SHARE / max(1, total)).cast("int")
    hot = F.broadcast(small.where(F.col(weight) * HOT_SHARE > max(1, total)).select(*on, salts.alias("salts")))
    salt = F.coalesce(F.pmod(F.xxhash64(*by), "salts"), F.lit(0)).cast("int")
    dealt = big.join(hot, on, "left").withColumn("salt", salt).drop("salts")
    last = F.coalesce(F.col("salts"), F.lit(1)) - 1
    copies = small.drop(weight).join(hot, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("salts")
    return dealt.join(copies, [*on, "salt"], how).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of ``edges`` (a, b) with the least node it reaches.

    Alternating stars: the large step links each node's larger neighbours to
    its least neighbour, the small step the smaller ones, until nothing
    changes.  Each round is written to the shared folder; only one number
    per round comes to the driver.  The edges of a large class's root are dealt
    over several tasks.  Every round that changes anything brings some label
    down, so the rounds end by themselves.
    """
    spark = edges.sparkSession
    now = common.materialise(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    n, before = now.count(), None
    pair = ["u", "v"]
    while True:
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w")).select("u", F.least("u", "m").alias("m"), "w")
        large = spread_join(both, least, "u", ["v"], "w", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.materialise(spark, large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w"))
        small = spread_join(large, least, "u", ["v"], "w", n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = common.materialise(spark, small.union(least.select("u", "m")).distinct())
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*pair).cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        n, before = state.n, state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
