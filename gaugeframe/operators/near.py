"""Nearest-neighbour joins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucketed(model: DataFrame, scene: DataFrame, reach: float, key: str = "set_id") -> DataFrame:
    """Pairs of one key within ``reach`` of each other: an equi-join on cells as wide as the reach.

    Model points stay in their own cell; scene points are dealt to the 27 cells
    around theirs, so each pair meets once and the condition never becomes a
    nested loop.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    m = model.select(F.col(key), F.col("ord").alias("model"), *[F.col(c).alias(f"m{c}") for c in "xyz"], *[cell(c).alias(f"k{c}") for c in "xyz"])
    around = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(k).alias("z")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    s = scene.select(F.col(key), F.col("ord").alias("scene"), *[F.col(c).alias(f"s{c}") for c in "xyz"], F.explode(around).alias("o"))
    s = s.select(key, "scene", "sx", "sy", "sz", *[(F.floor(F.col(f"s{c}") / reach) + F.col(f"o.{c}")).alias(f"k{c}") for c in "xyz"])
    d2 = sum(((F.col(f"m{c}") - F.col(f"s{c}")) * (F.col(f"m{c}") - F.col(f"s{c}")) for c in "xyz"), F.lit(0.0))
    return m.join(s, [key, "kx", "ky", "kz"]).withColumn("d2", d2).where(F.col("d2") <= reach * reach)


def nearest(model: DataFrame, scene: DataFrame, reach: float, key: str = "set_id") -> DataFrame:
    """Per model point the nearest scene point within reach; ties by scene order."""
    best = bucketed(model, scene, reach, key).groupBy(key, "model").agg(F.min(F.struct("d2", "scene")).alias("b"))
    return best.select(key, "model", F.col("b.scene").alias("scene"), F.sqrt("b.d2").alias("distance"))


#: Query and train descriptors of one block of comparisons, and queries compared at a time.
QUERY_BLOCK, TRAIN_BLOCK, AT_ONCE = 2_048, 4_096, 128


def ratio_matches(query: DataFrame, train: DataFrame, ratio: float) -> DataFrame:
    """For each query descriptor its nearest one, and whether it is clearly nearer than the second.

    Every query meets every train descriptor, in blocks that spread over the
    tasks; a block gives the two nearest (ties by id).  Queries with fewer than
    two train descriptors have no row.
    """
    rows = lambda df, name: df.select(F.col("id").cast("long").alias(name), F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL")
    q, t = rows(query, "query"), rows(train, "train")
    nq, nt = (max(1, -(-df.count() // size)) for df, size in ((q, QUERY_BLOCK), (t, TRAIN_BLOCK)))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n).cast("long"))
    q = q.select("query", "v", deal("query", nq).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nt - 1).cast("long"))).alias("tb"))
    t = t.select("train", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("qb"), deal("train", nt).alias("tb"))

    def nearest_two(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("train", kind="stable")
            a, b, ids = np.vstack(left.v.to_numpy()), np.vstack(right.v.to_numpy()), right.train.to_numpy()
            bb = (b * b).sum(axis=1)
            for at in range(0, len(a), AT_ONCE):
                x = a[at : at + AT_ONCE]
                xx = (x * x).sum(axis=1)
                rough = xx[:, None] + bb - 2.0 * (x @ b.T)
                k = min(2, len(b)) - 1
                most = np.partition(rough, k, axis=1)[:, k] + 1e-9 * (1.0 + xx + bb.max())
                for i, name in enumerate(left["query"].iloc[at : at + AT_ONCE]):
                    near = np.flatnonzero(rough[i] <= most[i])
                    d = np.sqrt(((b[near] - x[i]) ** 2).sum(axis=1))
                    out += [(name, ids[near[j]], d[j]) for j in np.argsort(d, kind="stable")[:2]]
        return pd.DataFrame(out, columns=["query", "train", "d"])

    two = q.groupBy("qb", "tb").cogroup(t.groupBy("qb", "tb")).applyInPandas(nearest_two, "query long, train long, d double")
    best = two.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("d", "train"))).alias("b")).where(F.size("b") > 1)
    first, second = F.col("b")[0], F.col("b")[1]
    return best.select("query", first["train"].alias("train"), first["d"].alias("distance"), (first["d"] < ratio * second["d"]).alias("good"))


def pairs(points: DataFrame, key: str = "set_id", most: int = 256) -> DataFrame:
    """All pairs i < j of a set, or ``most`` seeded ones of a set that has more pairs than that.

    Seeded pairs are drawn by the SHA-256 of the set's name and the attempt over
    the points in order; a pair that was drawn before or whose points coincide
    is drawn again.
    """
    n = points.groupBy(key).count()
    few = F.col("count") * (F.col("count") - 1) / 2 <= most
    p = points.join(n.where(few).select(key), key)
    a = p.select(key, F.col("ord").alias("i"))
    b = p.select(key, F.col("ord").alias("j"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        name, ids, at = pdf[key].iloc[0], pdf.ord.to_numpy(), pdf[["x", "y", "z"]].to_numpy(float)
        drawn = seeded_pairs(len(ids), str(name), most, lambda i, j: np.linalg.norm(at[j] - at[i]) <= 1e-12)
        return pd.DataFrame([(name, ids[i], ids[j]) for i, j in drawn], columns=[key, "i", "j"])

    large = points.join(n.where(~few).select(key), key).select(key, F.col("ord").cast("long").alias("ord"), "x", "y", "z")
    return a.join(b, key).where("i < j").unionByName(large.groupBy(key).applyInPandas(draw, f"{key} string, i long, j long"))


def seeded_pairs(n: int, seed: str, most: int, same: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Up to ``most`` different pairs of n places by the SHA-256 of seed and attempt, without those that are the ``same``."""
    out, seen = [], set()
    for attempt in range(n * n * 32):
        if len(out) == most:
            break
        h = hashlib.sha256(f"{seed.upper()}|{attempt}".encode()).digest()
        i, j = sorted((int.from_bytes(h[:4], "big") % n, int.from_bytes(h[4:8], "big") % n))
        if i != j and (i, j) not in seen:
            seen.add((i, j))
            if not same(i, j):
                out.append((i, j))
    return out
