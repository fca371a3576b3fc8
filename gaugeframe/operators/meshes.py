"""Triangle meshes: lookups, edges, normals, selection and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import cross, dot, minus, triangle_nearest


def look_up(indices: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh_id, tri_id, ax..cz) by three equi-joins; an index without a vertex leaves nulls."""
    out = indices
    for k, n in enumerate("abc"):
        v = vertices.select("mesh_id", F.col("v_id").alias(f"i{k}"), *[F.col(c).alias(f"{n}{c}") for c in "xyz"])
        out = out.join(v, ["mesh_id", f"i{k}"], "left")
    return out.select("mesh_id", "tri_id", "i0", "i1", "i2", *[f"{n}{c}" for n in "abc" for c in "xyz"])


def edges(triangles: DataFrame, min_length: float = 0.0, crease: float | None = None) -> DataFrame:
    """Boundary edges (one owner) and creases (two owners at an angle of ``crease`` degrees or more)."""
    p = lambda n: [F.col(f"{n}{c}") for c in "xyz"]
    normal = cross(minus(p("b"), p("a")), minus(p("c"), p("a")))
    t = triangles.withColumns({f"n{c}": k for c, k in zip("xyz", normal, strict=True)})
    edge = lambda i, j, a, b: F.struct(
        F.least(i, j).alias("lo"), F.greatest(i, j).alias("hi"), F.sqrt(dot(minus(p(b), p(a)), minus(p(b), p(a)))).alias("length"),
    )
    e = t.select("mesh_id", "tri_id", "nx", "ny", "nz", F.explode(F.array(edge("i0", "i1", "a", "b"), edge("i1", "i2", "b", "c"), edge("i0", "i2", "a", "c"))).alias("e"))
    owners = e.groupBy("mesh_id", F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi")).agg(
        F.count("*").alias("owners"), F.min("e.length").alias("length"),
        F.min(F.struct("tri_id", "nx", "ny", "nz")).alias("f"), F.max(F.struct("tri_id", "nx", "ny", "nz")).alias("g"),
    )
    f, g = ([F.col(f"{k}.n{c}") for c in "xyz"] for k in "fg")
    cos = F.try_divide(dot(f, g), F.sqrt(dot(f, f)) * F.sqrt(dot(g, g)))
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos))))
    kind = F.when(F.col("owners") > 2, "Error").when(F.col("owners") == 1, "Boundary").otherwise("Crease")
    rows = owners.withColumn("angle", F.when(F.col("owners") == 2, angle)).withColumn("kind", kind).where(F.col("length") >= min_length)
    keep = F.col("kind") != "Crease"
    if crease is not None:
        keep = keep | (F.col("angle") >= crease)
    return rows.where(keep).select("mesh_id", "lo", "hi", "owners", "length", "angle", "kind")


def normal_quality(indices: DataFrame, vertices: DataFrame, unit_tolerance: float = 1e-3) -> DataFrame:
    """Counts over declared vertex normals and how they agree with the faces."""
    n = [F.col(c) for c in ("nx", "ny", "nz")]
    size = F.sqrt(dot(n, n))
    v = vertices.groupBy("mesh_id").agg(
        F.count("*").alias("vertices"), F.count_if("has_normal").alias("present"),
        F.count_if(F.col("has_normal") & (size > 0)).alias("non_zero"), F.count_if(F.col("has_normal") & (F.abs(size - 1) <= unit_tolerance)).alias("unit"),
    )
    t = look_up(indices, vertices)
    p = lambda k: [F.col(f"{k}{c}") for c in "xyz"]
    face = cross(minus(p("b"), p("a")), minus(p("c"), p("a")))
    area = F.sqrt(dot(face, face))
    t = t.withColumns({"fx": face[0], "fy": face[1], "fz": face[2], "area": area})
    corner = t.select("mesh_id", "tri_id", "fx", "fy", "fz", "area", F.explode(F.array("i0", "i1", "i2")).alias("v_id")).join(vertices.select("mesh_id", "v_id", "nx", "ny", "nz", "has_normal"), ["mesh_id", "v_id"], "left")
    cos = F.try_divide(dot([F.col("fx"), F.col("fy"), F.col("fz")], n), F.col("area") * size)
    c = corner.withColumn("cos", F.when(F.col("has_normal") & (F.col("area") > 0), cos)).groupBy("mesh_id").agg(
        F.count_if(F.col("has_normal").isNull()).alias("invalid_corners"), F.min("cos").alias("min_alignment"), F.avg("cos").alias("mean_alignment"),
        F.count_if(F.col("cos") > 0).alias("consistent"), F.count_if(F.col("cos") < 0).alias("reversed"),
    )
    d = t.groupBy("mesh_id").agg(F.count("*").alias("triangles"), F.count_if(F.col("area") == 0).alias("degenerate"))
    out = v.join(d, "mesh_id", "left").join(c, "mesh_id", "left")
    state = F.when(F.col("present") == 0, "Missing").when((F.col("invalid_corners") > 0) | (F.col("degenerate") > 0) | (F.col("unit") < F.col("vertices")), "Defective").when(F.col("reversed") > 0, "Reversed").otherwise("Consistent")
    return out.withColumn("state", state)


def select_surface(triangles: DataFrame, internal: DataFrame, hidden: DataFrame, drop_duplicates: bool = True) -> DataFrame:
    """Triangles that neither list excludes; of exact duplicates the first stays."""
    out = triangles.join(internal, ["mesh_id", "tri_id"], "left_anti").join(hidden, ["mesh_id", "tri_id"], "left_anti")
    if drop_duplicates:
        corner = F.array_sort(F.array(*[F.struct(*[F.col(f"{n}{c}").alias(c) for c in "xyz"]) for n in "abc"]))
        w = Window.partitionBy("mesh_id", "__k").orderBy("tri_id")
        out = out.withColumn("__k", corner).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__k", "__n")
    return out


def overlap(internal: DataFrame, hidden: DataFrame) -> DataFrame:
    """Triangles in both exclusion lists, which is an error."""
    return internal.intersect(hidden)


#: Triangles of a mesh that share a cell, about; meshes up to this size have one cell.
PER_CELL = 256


def _candidates(points: DataFrame, triangles: DataFrame, room: float = 0.0) -> DataFrame:
    """Points beside the triangles of their mesh that can be nearest, or as near but for ``room``; ``n`` holds what triangle_nearest gives.

    Triangles are bucketed by the cell of their centre.  The farthest corner of
    the nearest cell's box bounds a point's distance, so cells whose boxes begin
    beyond it are left out; no mesh is too large.
    """
    p = lambda k: [F.col(f"{k}{c}") for c in "xyz"]
    t = triangles.withColumns({f"__m{c}": (F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3 for c in "xyz"})
    size = t.groupBy("mesh_id").agg(F.ceil(F.cbrt(F.count("*") / PER_CELL)).alias("__k"), *[f(f"__m{c}").alias(f"__{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    part = lambda c: F.coalesce(F.least(F.col("__k") - 1, F.floor(F.try_divide(F.col(f"__m{c}") - F.col(f"__lo{c}"), F.col(f"__hi{c}") - F.col(f"__lo{c}")) * F.col("__k"))), F.lit(0).cast("long"))
    whole = F.col("__mx").isNotNull() & F.col("__my").isNotNull() & F.col("__mz").isNotNull()
    cell = F.when(whole, (part("x") * F.col("__k") + part("y")) * F.col("__k") + part("z")).otherwise(F.lit(-1).cast("long"))
    t = t.join(size, "mesh_id").withColumn("__cell", cell).select(*triangles.columns, "__cell")
    corners = lambda f, c: f(f"a{c}", f"b{c}", f"c{c}")
    boxes = t.groupBy("mesh_id", "__cell").agg(*[g(F.when(F.col("__cell") >= 0, corners(f, c))).alias(f"__{n}{c}") for c in "xyz" for n, f, g in (("lo", F.least, F.min), ("hi", F.greatest, F.max))])
    least = [F.greatest(F.lit(0.0), F.col(f"__lo{c}") - F.col(c), F.col(c) - F.col(f"__hi{c}")) for c in "xyz"]
    most = [F.greatest(F.abs(F.col(c) - F.col(f"__lo{c}")), F.abs(F.col(c) - F.col(f"__hi{c}"))) for c in "xyz"]
    w = Window.partitionBy("mesh_id", "set_id", "ord")
    # a box without coordinates (an index without a vertex) stays, as does all of a point without
    null = F.col("__lox").isNull()
    met = points.join(boxes, "mesh_id").withColumns({"__near": F.when(~null, F.sqrt(dot(least, least))), "__far": F.when(~null, F.sqrt(dot(most, most)))}).withColumn("__most", F.min("__far").over(w))
    met = met.where(F.coalesce(F.col("__near") <= F.col("__most") * (1 + 1e-9) + room + 1e-9, F.lit(True))).select(*points.columns, "__cell")
    return met.join(t, ["mesh_id", "__cell"]).withColumn("n", triangle_nearest(p(""), p("a"), p("b"), p("c")))


def nearest_triangle(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Per point the nearest triangle of its mesh (ties: lowest tri_id), unsigned and signed distance.

    A point meets only triangles of its own mesh; the sign holds for face
    interiors only (see ``recover_signs``).
    """
    j = _candidates(points, triangles)
    best = j.groupBy("mesh_id", "set_id", "ord").agg(F.min(F.struct("n.d2", "tri_id", "n.feature", "n.side")).alias("b"))
    d = F.sqrt("b.d2")
    sign = F.when(F.col("b.d2") == 0, 0.0).when(F.col("b.feature") == "Face", F.col("b.side"))
    return best.select("mesh_id", "set_id", "ord", d.alias("distance"), F.col("b.tri_id").alias("tri_id"), F.col("b.feature").alias("feature"), (sign * d).alias("signed"))


#: Triangles this little farther than the nearest one have a say in a recovered sign, fixed value.
NEAR = 2.0**-23


def recover_signs(near: DataFrame, points: DataFrame, triangles: DataFrame) -> DataFrame:
    """``nearest_triangle`` with the signs it left open, and whether a sign was ``recovered``.

    Among the triangles within ``NEAR`` of the nearest, the nearest face interior
    decides, else the most upright one (ties: lowest tri_id); a point in its
    plane counts as above.
    """
    keys = ["mesh_id", "set_id", "ord"]
    p = lambda k: [F.col(f"{k}{c}") for c in "xyz"]
    j = _candidates(points.join(near.where(F.col("signed").isNull()).select(*keys, F.col("distance").alias("__d")), keys), triangles, NEAR)
    normal = cross(minus(p("b"), p("a")), minus(p("c"), p("a")))
    side = dot(minus(p(""), p("a")), normal)
    d, face = F.sqrt("n.d2"), F.col("n.feature") == "Face"
    upright = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.abs(side), F.sqrt(dot(normal, normal)) * d), F.lit(0.0)))
    j = j.where(d <= F.col("__d") + NEAR)
    best = j.groupBy(*keys).agg(F.min(F.struct((~face).alias("edge"), F.when(face, d).otherwise(-upright).alias("by"), "tri_id", d.alias("d"), side.alias("side"))).alias("b"))
    found = best.select(*keys, F.when(F.col("b.side") < 0, -F.col("b.d")).otherwise(F.col("b.d")).alias("__s"))
    out = near.join(found, keys, "left").withColumn("recovered", F.col("signed").isNull() & F.col("__s").isNotNull())
    return out.withColumn("signed", F.coalesce("signed", "__s")).drop("__s")


def compare(near: DataFrame, low: float, high: float) -> DataFrame:
    """Counts below, within and above the tolerance, of signs found directly and recovered, and statistics of both distances; one unresolved sign fails the set."""
    recovered = F.col("recovered") if "recovered" in near.columns else F.lit(False)
    stats = [f.alias(f"{n}_{c}") for c in ("distance", "signed") for n, f in (("min", F.min(c)), ("max", F.max(c)), ("mean", F.avg(c)), ("std", F.stddev_pop(c)), ("rms", F.sqrt(F.avg(F.col(c) * F.col(c)))))]
    signs = [F.count_if(F.col("signed").isNotNull() & ~recovered).alias("direct"), F.count_if(recovered).alias("recovered")]
    agg = near.groupBy("mesh_id", "set_id").agg(F.count("*").alias("n"), *signs, F.count_if(F.col("signed").isNull()).alias("unresolved"), F.count_if(F.col("signed") < low).alias("below"), F.count_if(F.col("signed").between(low, high)).alias("inside"), F.count_if(F.col("signed") > high).alias("above"), *stats)
    return agg.withColumn("success", F.col("unresolved") == 0)
