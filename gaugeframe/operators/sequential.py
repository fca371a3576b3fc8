"""Operators whose order of decisions is their meaning: NumPy kernels, one group at a time.

A group is one set, mesh or model: small by nature (samples of a surface), and
spread over the cluster by its key.  Kernels are plain functions over arrays, so
that tests call them without Spark.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near import seeded_pairs


# -- coverage ------------------------------------------------------------------------------
def claim_nearest(model: np.ndarray, scene: np.ndarray, reach: float, free: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Model samples in order each take the nearest scene sample that is still free, if within reach.

    Of equally near ones the first in scene order.  (model, scene, distance) rows.
    """
    free = np.ones(len(scene), bool) if free is None else free.copy()
    out = []
    for i, p in enumerate(model):
        if not free.any():
            break
        d2 = ((scene - p) ** 2).sum(axis=1)
        d2[~free] = np.inf
        j = int(np.argmin(d2))
        d = float(np.sqrt(d2[j]))
        if d <= reach:
            free[j] = False
            out.append((i, j, d))
    return out


def coverage(model: DataFrame, scene: DataFrame, reach: float, key: str = "set_id") -> DataFrame:
    """Per set: samples, matches, ratio and RMSE of the greedy claim; an empty scene covers nothing."""
    m = model.select(key, F.lit(0).alias("side"), "ord", "x", "y", "z")
    both = m.unionByName(scene.select(key, F.lit(1).alias("side"), "ord", "x", "y", "z"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "ord"], kind="stable")
        a, b = (pdf[pdf.side == k][["x", "y", "z"]].to_numpy(float) for k in (0, 1))
        if not len(a):
            return pd.DataFrame({key: [], "samples": [], "matched": [], "ratio": [], "rmse": []})
        d = np.array([x[2] for x in claim_nearest(a, b, reach)])
        rmse = float(np.sqrt(np.mean(d * d))) if len(d) else None
        return pd.DataFrame({key: [pdf[key].iloc[0]], "samples": [len(a)], "matched": [len(d)], "ratio": [len(d) / len(a)], "rmse": [rmse]})

    return both.groupBy(key).applyInPandas(run, f"{key} string, samples long, matched long, ratio double, rmse double")


def claims(model: DataFrame, scene: DataFrame, reach: float, key: str = "set_id") -> DataFrame:
    """The matched pairs of the greedy claim, by order numbers."""
    m = model.select(key, F.lit(0).alias("side"), "ord", "x", "y", "z")
    both = m.unionByName(scene.select(key, F.lit(1).alias("side"), "ord", "x", "y", "z"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "ord"], kind="stable")
        a, b = (pdf[pdf.side == k] for k in (0, 1))
        found = claim_nearest(a[["x", "y", "z"]].to_numpy(float), b[["x", "y", "z"]].to_numpy(float), reach)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(found), "model": [a.ord.iloc[i] for i, _, _ in found], "scene": [b.ord.iloc[j] for _, j, _ in found], "distance": [d for _, _, d in found]})

    return both.groupBy(key).applyInPandas(run, f"{key} string, model long, scene long, distance double")


# -- sampling --------------------------------------------------------------------------------
def farthest(points: np.ndarray, most: int, separation: float) -> list[int]:
    """From the first point on, the one farthest from all chosen; ends at ``most`` or at the separation."""
    if not len(points):
        return []
    chosen, near = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(most, len(points)):
        k = int(np.argmax(near))
        if near[k] <= separation:
            break
        chosen.append(k)
        near = np.minimum(near, np.linalg.norm(points - points[k], axis=1))
    return chosen


def key_points(points: DataFrame, most: int, separation: float, key: str = "set_id") -> DataFrame:
    """Farthest-point samples of every set, in order of choice."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        at = farthest(pdf[["x", "y", "z"]].to_numpy(float), most, separation)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(at), "rank": range(len(at)), "ord": pdf.ord.to_numpy()[at]})

    return points.select(key, "ord", "x", "y", "z").groupBy(key).applyInPandas(run, f"{key} string, rank long, ord long")


# -- lines -------------------------------------------------------------------------------------
MAX_HYPOTHESES, MAX_ROUNDS = 256, 10


def hypothesis_pairs(n: int, seed: str, same: Callable[[int, int], bool] = lambda i, j: False) -> list[tuple[int, int]]:
    """All pairs, or 256 different ones drawn by the SHA-256 of seed and attempt; pairs of the ``same`` place take up none."""
    if n * (n - 1) // 2 <= MAX_HYPOTHESES:
        return [(i, j) for i in range(n) for j in range(i + 1, n) if not same(i, j)]
    return seeded_pairs(n, seed, MAX_HYPOTHESES, same)


def total_least_squares(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroid and main direction."""
    c = p.mean(axis=0)
    _, v = np.linalg.eigh((p - c).T @ (p - c))
    d = v[:, -1]
    return c, d if d[np.argmax(np.abs(d))] > 0 else -d


def _distances(p: np.ndarray, anchor: np.ndarray, d: np.ndarray) -> np.ndarray:
    w = p - anchor
    return np.linalg.norm(w - np.outer(w @ d, d), axis=1)


def robust_line(p: np.ndarray, residual: float, min_inliers: int, min_ratio: float, min_span: float, seed: str = "") -> dict | None:
    """Best-supported line through pairs of points, refined by total least squares until its inliers stay."""

    def supported(inside: np.ndarray, d: np.ndarray) -> float | None:
        n = int(inside.sum())
        if n < max(2, min_inliers) or n < min_ratio * len(p):
            return None
        t = p[inside] @ d
        span = float(t.max() - t.min())
        return span if span >= min_span else None

    best = None
    for i, j in hypothesis_pairs(len(p), seed, lambda i, j: np.linalg.norm(p[j] - p[i]) <= 1e-12):
        d = p[j] - p[i]
        size = np.linalg.norm(d)
        if size <= 1e-12:
            continue
        d = d / size
        e = _distances(p, p[i], d)
        inside = e <= residual
        span = supported(inside, d)
        if span is not None:
            rank = (-int(inside.sum()), float(np.sqrt(np.mean(e[inside] ** 2))), -span, i, j)
            if best is None or rank < best[0]:
                best = (rank, inside)
    if best is None:
        return None
    inside = best[1]
    for k in range(1, MAX_ROUNDS + 1):
        c, d = total_least_squares(p[inside])
        e = _distances(p, c, d)
        new = e <= residual
        if supported(new, d) is None:
            return None
        if (new == inside).all():
            t = (p[new] - c) @ d
            return {"anchor": c, "direction": d, "inliers": new, "rms": float(np.sqrt(np.mean(e[new] ** 2))), "span": float(t.max() - t.min()), "rounds": k}
        inside = new
    return None


def line_fits(points: DataFrame, residual: float, min_inliers: int, min_ratio: float, min_span: float, key: str = "set_id") -> DataFrame:
    """Robust line of every set; ``success`` is false where no line has the support."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf[key].iloc[0]
        fit = robust_line(pdf.sort_values("ord")[["x", "y", "z"]].to_numpy(float), residual, min_inliers, min_ratio, min_span, str(name))
        row = {key: name, "success": fit is not None}
        d = fit["direction"] if fit else [None] * 3
        row |= {"inliers": int(fit["inliers"].sum()) if fit else 0, "dx": d[0], "dy": d[1], "dz": d[2], "rms": fit["rms"] if fit else None, "span": fit["span"] if fit else None}
        return pd.DataFrame([row])

    return points.select(key, "ord", "x", "y", "z").groupBy(key).applyInPandas(run, f"{key} string, success boolean, inliers long, dx double, dy double, dz double, rms double, span double")


# -- registration ----------------------------------------------------------------------------------
def solve_affine(a: np.ndarray, b: np.ndarray, max_condition: float = 1e10) -> tuple[np.ndarray, float] | None:
    """The 3 x 4 matrix that maps four points to four points, and the condition of the system; None if singular."""
    if a.shape != (4, 3) or b.shape != (4, 3):
        raise ValueError("four pairs of points are needed")
    m = np.hstack([a, np.ones((4, 1))])
    if np.linalg.matrix_rank(m) < 4:
        return None
    inverse = np.linalg.inv(m)
    condition = float(np.abs(m).sum(axis=1).max() * np.abs(inverse).sum(axis=1).max())
    return ((inverse @ b).T, condition) if condition <= max_condition else None


def affine_fits(pairs: DataFrame, key: str = "set_id") -> DataFrame:
    """Matrix of every set's four pairs (ord, x, y, z -> tx, ty, tz), condition, determinant and largest residual."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        a, b = pdf[["x", "y", "z"]].to_numpy(float), pdf[["tx", "ty", "tz"]].to_numpy(float)
        fit = solve_affine(a, b) if len(pdf) == 4 else None
        if fit is None:
            return pd.DataFrame([{key: pdf[key].iloc[0], "success": False, "matrix": None, "condition": None, "determinant": None, "residual": None}])
        m, c = fit
        e = np.linalg.norm(np.hstack([a, np.ones((4, 1))]) @ m.T - b, axis=1).max()
        return pd.DataFrame([{key: pdf[key].iloc[0], "success": True, "matrix": m.ravel().tolist(), "condition": c, "determinant": float(np.linalg.det(m[:, :3])), "residual": float(e)}])

    return pairs.select(key, "ord", "x", "y", "z", "tx", "ty", "tz").groupBy(key).applyInPandas(run, f"{key} string, success boolean, matrix array<double>, condition double, determinant double, residual double")


def tetrahedron(p: np.ndarray) -> tuple[int, float]:
    """Rank of the edges from the first point, and the volume normalised by the longest edge."""
    e = p[1:] - p[0]
    longest = max(float(np.linalg.norm(p[i] - p[j])) for i in range(4) for j in range(i))
    if longest == 0:
        return 0, 0.0
    return int(np.linalg.matrix_rank(e / longest, tol=1e-9)), abs(float(np.linalg.det(e))) / 6 / longest**3


def landmark_checks(pairs: DataFrame, min_volume: float, key: str = "set_id") -> DataFrame:
    """Whether both sides' four landmarks span space well enough."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        if len(pdf) != 4:
            return pd.DataFrame([{key: pdf[key].iloc[0], "rank_a": 0, "rank_b": 0, "volume_a": 0.0, "volume_b": 0.0, "valid": False}])
        (ra, va), (rb, vb) = (tetrahedron(pdf[c].to_numpy(float)) for c in (["x", "y", "z"], ["tx", "ty", "tz"]))
        return pd.DataFrame([{key: pdf[key].iloc[0], "rank_a": ra, "rank_b": rb, "volume_a": va, "volume_b": vb, "valid": ra == rb == 3 and min(va, vb) >= min_volume}])

    return pairs.select(key, "ord", "x", "y", "z", "tx", "ty", "tz").groupBy(key).applyInPandas(run, f"{key} string, rank_a int, rank_b int, volume_a double, volume_b double, valid boolean")


# -- poses -----------------------------------------------------------------------------------------
MAX_POSES, MAX_EXPANDED = 1_000_000, 10_000_000


def axis_values(low: float, high: float, step: float) -> list[float]:
    """low, low + step, ... up to high, with a little room for rounding."""
    return [low + i * step for i in range(int(np.floor((high - low) / step + 1e-12)) + 1)]


def euler(rx: float, ry: float, rz: float) -> np.ndarray:
    """Rz Ry Rx of angles in degrees."""
    (cx, sx), (cy, sy), (cz, sz) = ((np.cos(a), np.sin(a)) for a in np.radians([rx, ry, rz]))
    x = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
    y = np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]])
    z = np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])
    return z @ y @ x


def poses(spark, axes: list[tuple[float, float, float]]) -> DataFrame:
    """Enumerated Euler grid: index, rx, ry, rz; more than the budget is refused before anything is built."""
    values = [axis_values(*a) for a in axes]
    n = len(values[0]) * len(values[1]) * len(values[2])
    if n > MAX_POSES:
        raise ValueError(f"{n} poses exceed {MAX_POSES}")
    ny, nz = len(values[1]), len(values[2])
    at = lambda v, i: F.element_at(F.array(*map(F.lit, v)), (i + 1).cast("int"))
    i = F.col("id")
    return spark.range(n).select(i.alias("index"), at(values[0], F.floor(i / (ny * nz))).alias("rx"), at(values[1], F.floor(F.pmod(i, F.lit(ny * nz)) / nz)).alias("ry"), at(values[2], F.pmod(i, F.lit(nz))).alias("rz"))


def pose_search(candidates: DataFrame, model: np.ndarray, scene: np.ndarray, reach: float) -> DataFrame:
    """Coverage of the scene by the model in every pose, centroids aligned: one row per pose."""
    spark = candidates.sparkSession
    shared = spark.sparkContext.broadcast((model, scene))

    def run(batches):
        m, s = shared.value
        cm, cs = m.mean(axis=0), s.mean(axis=0)
        for pdf in batches:
            rows = []
            for k, rx, ry, rz in zip(pdf["index"], pdf.rx, pdf.ry, pdf.rz, strict=True):
                r = euler(rx, ry, rz)
                t = cs - r @ cm
                d = np.array([x[2] for x in claim_nearest(m @ r.T + t, s, reach)])
                rows.append((k, rx, ry, rz, *t, len(d), float(np.sqrt(np.mean(d * d))) if len(d) else float("inf")))
            yield pd.DataFrame(rows, columns=["index", "rx", "ry", "rz", "tx", "ty", "tz", "matched", "rmse"])

    return candidates.mapInPandas(run, "index long, rx double, ry double, rz double, tx double, ty double, tz double, matched long, rmse double")


def best_pose(scored: DataFrame, min_matched: int) -> DataFrame:
    """Most matches, then least error, then first enumerated; nothing below the minimum."""
    best = scored.agg(F.min(F.struct((-F.col("matched")).alias("k"), "rmse", "index", "rx", "ry", "rz", "tx", "ty", "tz")).alias("b"))
    return best.select((-F.col("b.k")).alias("matched"), *[F.col(f"b.{c}").alias(c) for c in ("rmse", "index", "rx", "ry", "rz", "tx", "ty", "tz")]).where(F.col("matched") >= min_matched)


def multiple_matches(rotations: list[np.ndarray], model: np.ndarray, scene: np.ndarray, reach: float, min_matched: int, most: int) -> list[tuple[int, int, float]]:
    """Repeatedly the best placement of the model (every sample on every free scene sample); its samples are claimed.

    (rotation, matched, rmse) of each instance.
    """
    if len(rotations) * len(model) * len(scene) > MAX_EXPANDED or most > 1000:
        raise ValueError("candidate budget exceeded")
    free, out = np.ones(len(scene), bool), []
    while len(out) < most and free.sum() >= min_matched:
        best = None
        for k, r in enumerate(rotations):
            turned = model @ r.T
            for i in range(len(model)):
                for j in np.flatnonzero(free):
                    found = claim_nearest(turned + (scene[j] - turned[i]), scene, reach, free)
                    d = np.array([x[2] for x in found])
                    rank = (-len(found), float(np.sqrt(np.mean(d * d))) if len(d) else np.inf, k, i, int(j))
                    if best is None or rank < best[0]:
                        best = (rank, found)
        if best is None or -best[0][0] < min_matched:
            break
        for _, j, _ in best[1]:
            free[j] = False
        out.append((best[0][2], -best[0][0], best[0][1]))
    return out


def instances(groups: DataFrame, rotations: list[np.ndarray], reach: float, min_matched: int, most: int, key: str = "set_id") -> DataFrame:
    """``multiple_matches`` of every set; rows carry side (0 model, 1 scene), ord, x, y, z."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "ord"], kind="stable")
        a, b = (pdf[pdf.side == k][["x", "y", "z"]].to_numpy(float) for k in (0, 1))
        found = multiple_matches(rotations, a, b, reach, min_matched, most) if len(a) and len(b) else []
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(found), "instance": range(len(found)), "rotation": [x[0] for x in found], "matched": [x[1] for x in found], "rmse": [x[2] for x in found]})

    return groups.select(key, "side", "ord", "x", "y", "z").groupBy(key).applyInPandas(run, f"{key} string, instance long, rotation long, matched long, rmse double")


# -- signs -----------------------------------------------------------------------------------------
#: Room for float coordinates, fixed value.
NEAR = 2.0**-23


def robust_sign(p: np.ndarray, triangles: np.ndarray, ids: np.ndarray) -> tuple[float, int, float]:
    """(distance, triangle, sign): among the triangles as near as the nearest, a face interior or else the most upright decides."""
    normal = np.cross(triangles[:, 1] - triangles[:, 0], triangles[:, 2] - triangles[:, 0])
    size = np.linalg.norm(normal, axis=1)
    normal = normal / np.where(size > 0, size, 1.0)[:, None]
    near, face = _closest_all(p, triangles)
    d = np.linalg.norm(p - near, axis=1)
    best = float(d.min())
    at = np.flatnonzero(d <= best + NEAR)
    tri = int(min(ids[i] for i in at if d[i] == best))
    if best == 0:
        return 0.0, tri, 0.0
    sides = np.array([float(np.dot(normal[i], p - near[i])) / max(d[i], 1e-300) for i in at])
    inside = [k for k, i in enumerate(at) if face[i]]
    order = inside or range(len(at))
    k = min(order, key=lambda k: (-abs(sides[k]), ids[at[k]]))
    return best, tri, -1.0 if sides[k] < 0 else 1.0  # a point in the plane of the triangle counts as outside


def _closest(p, a, b, c):
    """Nearest point of a triangle and the feature it lies on."""
    ab, ac = b - a, c - a
    n = np.cross(ab, ac)
    nn = float(n @ n)
    if nn > 0:
        w = p - a
        v = float(np.cross(w, ac) @ n) / nn
        u = float(np.cross(ab, w) @ n) / nn
        if v > 0 and u > 0 and v + u < 1:
            return a + ab * v + ac * u, "Face"
    best = None
    for s, e in ((a, b), (b, c), (a, c)):
        d = e - s
        t = min(1.0, max(0.0, float((p - s) @ d) / max(float(d @ d), 1e-300)))
        q = s + d * t
        k = float(((p - q) ** 2).sum())
        if best is None or k < best[0]:
            best = (k, q, "Vertex" if t in (0.0, 1.0) else "Edge")
    return best[1], best[2]


def _closest_all(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_closest`` for all triangles: nearest points, and whether they lie inside the face."""
    a, ab, ac = t[:, 0], t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]
    n = np.cross(ab, ac)
    nn = (n * n).sum(axis=1)
    over = np.where(nn > 0, nn, 1.0)
    v, u = (np.cross(p - a, ac) * n).sum(axis=1) / over, (np.cross(ab, p - a) * n).sum(axis=1) / over
    face = (nn > 0) & (v > 0) & (u > 0) & (v + u < 1)
    s, d = t[:, [0, 1, 0]], t[:, [1, 2, 2]] - t[:, [0, 1, 0]]
    at = np.clip(((p - s) * d).sum(axis=2) / np.maximum((d * d).sum(axis=2), 1e-300), 0.0, 1.0)
    q = s + d * at[..., None]
    edge = q[np.arange(len(t)), ((p - q) ** 2).sum(axis=2).argmin(axis=1)]
    return np.where(face[:, None], a + ab * v[:, None] + ac * u[:, None], edge), face


def robust_signs(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Distance, triangle and recovered sign of every point of a mesh's set.

    A triangle without all its coordinates (an index without a vertex) is nowhere
    near; a point without its own, or with no whole triangle, has nulls.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        t = right[[f"{n}{c}" for n in "abc" for c in "xyz"]].to_numpy(float).reshape(-1, 3, 3)
        whole = np.isfinite(t).all(axis=(1, 2))
        t, ids = t[whole], right.tri_id.to_numpy()[whole]
        at = left[["x", "y", "z"]].to_numpy(float)
        signs = (robust_sign(p, t, ids) if len(t) and np.isfinite(p).all() else (None, None, None) for p in at)
        rows = [(m, o, *s) for m, o, s in zip(left.mesh_id, left.ord, signs, strict=True)] if len(right) else []
        return pd.DataFrame(rows, columns=["mesh_id", "ord", "distance", "tri_id", "sign"])

    return points.select("mesh_id", "ord", "x", "y", "z").groupBy("mesh_id").cogroup(triangles.groupBy("mesh_id")).applyInPandas(run, "mesh_id string, ord long, distance double, tri_id long, sign double")


# -- suppression -----------------------------------------------------------------------------------
def iou(a, b) -> float:
    """Overlap of two rectangles (x, y, w, h) as a share of their union."""
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / union if union > 0 else 0.0


def suppress(rows: pd.DataFrame, max_overlap: float, most: int) -> list[int]:
    """Positions kept by greedy overlap suppression within one kind: by score, then y, then x."""
    kept: list[int] = []
    order = rows.assign(i=range(len(rows))).sort_values(["score", "y", "x"], ascending=[False, True, True], kind="stable").i
    boxes = rows[["x", "y", "w", "h"]].to_numpy().tolist()
    kinds = rows.kind.tolist()
    for i in order:
        if all(kinds[i] != kinds[j] or iou(boxes[i], boxes[j]) <= max_overlap for j in kept):
            kept.append(i)
            if len(kept) >= most:
                break
    return kept


def suppress_near(rows: pd.DataFrame, share: float, least: float = 4.0) -> list[int]:
    """Positions kept when a centre nearer than max(least, share * shorter side) to a better one goes."""
    kept: list[int] = []
    order = rows.assign(i=range(len(rows))).sort_values(["score", "y", "x"], ascending=[False, True, True], kind="stable").i
    x, y, side = rows.x.to_numpy(), rows.y.to_numpy(), np.minimum(rows.w, rows.h).to_numpy()
    for i in order:
        if all(np.hypot(x[i] - x[j], y[i] - y[j]) >= max(least, share * side[i]) for j in kept):
            kept.append(i)
    return kept


def peaks(score: np.ndarray, most: int, reach_y: int, reach_x: int, least: float = -np.inf) -> list[tuple[int, int, float]]:
    """Best score, then blank its surroundings, again and again: (y, x, score)."""
    left, out = score.astype(float).copy(), []
    while len(out) < most:
        y, x = np.unravel_index(int(np.argmax(left)), left.shape)
        if not left[y, x] > least:
            break
        out.append((int(y), int(x), float(left[y, x])))
        left[max(0, y - reach_y) : y + reach_y + 1, max(0, x - reach_x) : x + reach_x + 1] = -np.inf
    return out


def suppressed(candidates: DataFrame, max_overlap: float, most: int) -> DataFrame:
    """Candidates (image_id, kind, x, y, w, h, score) left by overlap suppression, ranked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = suppress(pdf, max_overlap, most)
        return pdf.iloc[at].assign(rank=range(1, len(at) + 1))

    rows = candidates.select("image_id", "kind", "x", "y", "w", "h", "score")
    return rows.groupBy("image_id").applyInPandas(run, "image_id string, kind string, x int, y int, w int, h int, score double, rank long")


def distinct_centres(candidates: DataFrame, share: float = 0.5) -> DataFrame:
    """Candidates left when near duplicates of better ones go."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[suppress_near(pdf, share)]

    rows = candidates.select("image_id", "x", "y", "w", "h", "score")
    return rows.groupBy("image_id").applyInPandas(run, "image_id string, x int, y int, w int, h int, score double")
