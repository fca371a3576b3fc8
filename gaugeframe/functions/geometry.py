"""Geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc(c: Column) -> Column:
    """Towards zero, to a 32-bit integer."""
    return c.cast("int")


def line_intersection(a: list[Column], b: list[Column]) -> Column:
    """Crossing of the lines through integer points (x1, y1, x2, y2); null when parallel.

    Homogeneous: products are taken in 64 bits, so they cannot overflow.
    """
    a, b = ([c.cast("long") for c in p] for p in (a, b))
    la = (a[1] - a[3], a[2] - a[0], a[0] * a[3] - a[2] * a[1])
    lb = (b[1] - b[3], b[2] - b[0], b[0] * b[3] - b[2] * b[1])
    w = la[0] * lb[1] - lb[0] * la[1]
    x = F.try_divide((la[1] * lb[2] - lb[1] * la[2]).cast("double"), w.cast("double"))
    y = F.try_divide((la[2] * lb[0] - lb[2] * la[0]).cast("double"), w.cast("double"))
    return F.when(w != 0, F.struct(x.alias("x"), y.alias("y")))


def vertex_angle(ax, ay, bx, by, cx, cy) -> Column:
    """Angle at b between a and c, in degrees; null where a side has no length."""
    ux, uy, vx, vy = ax - bx, ay - by, cx - bx, cy - by
    cos = F.try_divide(ux * vx + uy * vy, F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy))
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos))))


def bearing(ax, ay, bx, by) -> Column:
    """Direction from a to b in degrees, -180..180."""
    return F.degrees(F.atan2(by - ay, bx - ax))


def bearing360(ax, ay, bx, by) -> Column:
    return F.pmod(bearing(ax, ay, bx, by) + 360.0, F.lit(360.0))


def signed_angle(ax, ay, bx, by, cx, cy) -> Column:
    """Angle from ba to bc by cross and dot product, in radians."""
    dot = (ax - bx) * (cx - bx) + (ay - by) * (cy - by)
    cross = (ax - bx) * (cy - by) - (ay - by) * (cx - bx)
    return F.atan2(cross, dot)


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Winding angle of a fixed polygon around a point: inside where it does not vanish."""
    total = F.lit(0.0)
    for (px, py), (qx, qy) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        total = total + signed_angle(F.lit(px), F.lit(py), x, y, F.lit(qx), F.lit(qy))
    return F.abs(total) > 1e-6


def segments_cross(p: list[Column], q: list[Column]) -> Column:
    """Parameters and crossing of two segments (x1, y1, x2, y2); null parameters when parallel."""
    dx1, dy1, dx2, dy2 = p[2] - p[0], p[3] - p[1], q[2] - q[0], q[3] - q[1]
    den = dy1 * dx2 - dx1 * dy2
    t1 = F.try_divide((p[0] - q[0]) * dy2 + (q[1] - p[1]) * dx2, den)
    t2 = F.try_divide((q[0] - p[0]) * dy1 + (p[1] - q[1]) * dx1, -den)
    hit = F.coalesce(t1.between(0, 1) & t2.between(0, 1), F.lit(False))
    return F.struct(t1.alias("t1"), t2.alias("t2"), hit.alias("hit"), F.when(hit, p[0] + dx1 * t1).alias("x"), F.when(hit, p[1] + dy1 * t1).alias("y"))


def opposite_sides(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """c and d lie on different sides of the line ab, or one lies on it."""
    side = lambda px, py: F.signum(((bx - ax) * (py - ay) - (by - ay) * (px - ax)).cast("double"))
    return side(cx, cy) * side(dx, dy) <= 0


def extended(x, y, degrees, length) -> Column:
    """The point at a length along a direction, truncated to integers."""
    return F.struct(trunc(x + F.cos(F.radians(degrees)) * length).alias("x"), trunc(y + F.sin(F.radians(degrees)) * length).alias("y"))


def rect_center(x, y, w, h) -> Column:
    """Integer centre: halves are cut off."""
    return F.struct((x + trunc(w / 2)).alias("x"), (y + trunc(h / 2)).alias("y"))


def binary_text(n: Column, width: int) -> Column:
    """Two's complement digits, padded with zeros; never cut."""
    b = F.bin(n)
    return F.when(F.length(b) >= width, b).otherwise(F.lpad(b, width, "0"))


def transformed(m: list[Column] | list[float], x, y, z) -> Column:
    """A 3 x 4 matrix (row by row) applied to a point."""
    m = [c if isinstance(c, Column) else F.lit(float(c)) for c in m]
    row = lambda i: m[4 * i] * x + m[4 * i + 1] * y + m[4 * i + 2] * z + m[4 * i + 3]
    return F.struct(row(0).alias("x"), row(1).alias("y"), row(2).alias("z"))


def rotation(rx, ry, rz) -> list[Column]:
    """Rz Ry Rx of angles in degrees, row by row."""
    cx, sx, cy, sy, cz, sz = (f(F.radians(a)) for a in (rx, ry, rz) for f in (F.cos, F.sin))
    return [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, -sy, cy * sx, cy * cx]


def pair_dimensions(a: list[Column], b: list[Column], axis: tuple[float, float, float] = (0.0, 1.0, 0.0)) -> Column:
    """Distance, part along the axis, planar width and elevation of a pair of points; null when they coincide."""
    d = [q - p for p, q in zip(a, b, strict=True)]
    size = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    along = sum((c * k for c, k in zip(d, axis, strict=True)), F.lit(0.0))
    width = F.sqrt(F.greatest(F.lit(0.0), size * size - along * along))
    return F.when(size > 1e-9, F.struct(size.alias("distance"), along.alias("axial"), width.alias("width"), F.degrees(F.atan2(along, width)).alias("elevation")))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def three_point_plane(a: list[Column], b: list[Column], c: list[Column]) -> Column:
    """Unit normal by pick order and offset; null for collinear points."""
    u, v = minus(b, a), minus(c, a)
    n = cross(u, v)
    size, scale = F.sqrt(dot(n, n)), F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    ok = (scale > 0) & (F.coalesce(F.try_divide(size, scale), F.lit(0.0)) > 1e-12)
    unit = [F.try_divide(k, size) for k in n]
    return F.when(ok, F.struct(unit[0].alias("nx"), unit[1].alias("ny"), unit[2].alias("nz"), (-dot(unit, a)).alias("d")))


def two_point_line(a: list[Column], b: list[Column]) -> Column:
    """Unit direction and length; null when the points coincide."""
    d = minus(b, a)
    size = F.sqrt(dot(d, d))
    return F.when(size > 1e-9, F.struct(*[F.try_divide(k, size).alias(n) for k, n in zip(d, ("dx", "dy", "dz"), strict=True)], size.alias("length")))


def line_approach(p: list[Column], u: list[Column], q: list[Column], v: list[Column]) -> Column:
    """Closest approach of two lines (point, unit direction): parameters, gap, angle; null when parallel."""
    w = minus(p, q)
    b, d, e = dot(u, v), dot(u, w), dot(v, w)
    den = 1 - b * b
    s, t = F.try_divide(b * e - d, den), F.try_divide(e - b * d, den)
    gap = [w[i] + s * u[i] - t * v[i] for i in range(3)]
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(b))))
    return F.when(den > 1e-12, F.struct(s.alias("s"), t.alias("t"), F.sqrt(dot(gap, gap)).alias("gap"), angle.alias("angle")))


def triangle_nearest(p: list[Column], a: list[Column], b: list[Column], c: list[Column]) -> Column:
    """Nearest point of a triangle: squared distance, feature (Face, Edge, Vertex) and side of the face.

    By the regions of the barycentric plane; a degenerate triangle falls back to
    its edges, since none of the face conditions holds there.
    """
    ab, ac, ap = minus(b, a), minus(c, a), minus(p, a)
    d1, d2 = dot(ab, ap), dot(ac, ap)
    bp, cp = minus(p, b), minus(p, c)
    d3, d4, d5, d6 = dot(ab, bp), dot(ac, bp), dot(ab, cp), dot(ac, cp)
    vc, vb, va = d1 * d4 - d3 * d2, d5 * d2 - d1 * d6, d3 * d6 - d5 * d4
    at = lambda v, w: [a[i] + ab[i] * v + ac[i] * w for i in range(3)]
    zero, one = F.lit(0.0), F.lit(1.0)
    t_ab = F.coalesce(F.try_divide(d1, d1 - d3), zero)
    t_ac = F.coalesce(F.try_divide(d2, d2 - d6), zero)
    t_bc = F.coalesce(F.try_divide(d4 - d3, (d4 - d3) + (d5 - d6)), zero)
    den = va + vb + vc
    v, w = F.coalesce(F.try_divide(vb, den), zero), F.coalesce(F.try_divide(vc, den), zero)
    cases = [
        ((d1 <= 0) & (d2 <= 0), at(zero, zero), "Vertex"), ((d3 >= 0) & (d4 <= d3), at(one, zero), "Vertex"),
        ((vc <= 0) & (d1 >= 0) & (d3 <= 0), at(t_ab, zero), "Edge"), ((d6 >= 0) & (d5 <= d6), at(zero, one), "Vertex"),
        ((vb <= 0) & (d2 >= 0) & (d6 <= 0), at(zero, t_ac), "Edge"), ((va <= 0) & (d4 >= d3) & (d5 >= d6), at(1 - t_bc, t_bc), "Edge"),
    ]
    pick = lambda f, last: _chain([(k, f(x, n)) for k, x, n in cases], last)
    near = [pick(lambda x, n, i=i: x[i], at(v, w)[i]) for i in range(3)]
    off = minus(p, near)
    normal = cross(ab, ac)
    return F.struct(dot(off, off).alias("d2"), pick(lambda x, n: F.lit(n), F.lit("Face")).alias("feature"), F.signum(dot(normal, ap)).alias("side"))


def _chain(cases, last) -> Column:
    out = None
    for k, x in cases:
        out = F.when(k, x) if out is None else out.when(k, x)
    return out.otherwise(last)


def grid_coordinates(p: list[Column], origin, u, v, h, pitch_u: float, pitch_v: float) -> dict[str, Column]:
    """Coordinates along reference axes and the cell they fall in."""
    lit = lambda k: [F.lit(float(x)) for x in k]
    w = minus(p, lit(origin))
    cu, cv, ch = (dot(w, lit(k)) for k in (u, v, h))
    return {"u": cu, "v": cv, "height": ch, "grid_col": F.floor(cu / pitch_u).cast("int"), "grid_row": F.floor(cv / pitch_v).cast("int")}


def seeded_index(seed: Column, attempt: Column, n: Column) -> Column:
    """An index below n from the SHA-256 of seed|attempt: its first 32 bits."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(F.upper(seed), F.lit("|"), attempt.cast("string")), 256), 1, 8), 16, 10).cast("long"), n)


def rect_text(x, y, w, h) -> Column:
    return F.concat_ws(",", *(c.cast("string") for c in (x, y, w, h)))


def parse_rect(text: Column) -> Column:
    """x,y,width,height of a region text; null unless it has four integers."""
    parts = F.split(text, ",")
    value = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("int")
    ok = (F.size(parts) == 4) & value(0).isNotNull() & value(1).isNotNull() & value(2).isNotNull() & value(3).isNotNull()
    return F.when(ok, F.struct(*[value(i).alias(n) for i, n in enumerate(("x", "y", "w", "h"))]))
