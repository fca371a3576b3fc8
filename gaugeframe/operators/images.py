"""Image kernels in NumPy: one image a row, many images over the cluster.

Arrays are (height, width) of unsigned bytes; ``on_images`` runs a kernel over
packed images in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SIDE = 32768


def unpack(width: int, height: int, channels: int, data: bytes) -> np.ndarray:
    """Grey values; three and four channels are weighted (0.114, 0.587, 0.299 for blue, green, red)."""
    if width <= 0 or height <= 0 or channels not in (1, 3, 4) or len(data) != width * height * channels:
        raise ValueError("image is empty or its size does not fit")
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return a[:, :, 0].copy()
    return np.rint(a[:, :, 0] * 0.114 + a[:, :, 1] * 0.587 + a[:, :, 2] * 0.299).astype(np.uint8)


def on_images(images: DataFrame, kernel: Callable[[np.ndarray], list[tuple]], columns: list[tuple[str, str]]) -> DataFrame:
    """Rows that ``kernel`` gives for each packed image, behind its image_id."""
    names = [c for c, _ in columns]

    def run(batches):
        for pdf in batches:
            rows = [(i, *r) for i, w, h, c, d in zip(pdf.image_id, pdf.width, pdf.height, pdf.channels, pdf.data, strict=True) for r in kernel(unpack(w, h, c, d))]
            yield pd.DataFrame(rows, columns=["image_id", *names])

    return images.select("image_id", "width", "height", "channels", "data").mapInPandas(run, ", ".join(["image_id string", *(f"{n} {t}" for n, t in columns)]))


def as_image(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], list[tuple]]:
    """A kernel image -> image as rows (width, height, channels, data)."""

    def run(a: np.ndarray) -> list[tuple]:
        out = f(a)
        return [(out.shape[1], out.shape[0], 1, np.clip(out, 0, 255).astype(np.uint8).tobytes())]

    return run


def as_pixels(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], list[tuple]]:
    """A kernel image -> image as pixel rows (y, x, v)."""

    def run(a: np.ndarray) -> list[tuple]:
        out = np.clip(f(a), 0, 255).astype(int)
        y, x = np.indices(out.shape)
        return list(zip(y.ravel().tolist(), x.ravel().tolist(), out.ravel().tolist(), strict=True))

    return run


IMAGE_COLUMNS = [("width", "int"), ("height", "int"), ("channels", "int"), ("data", "binary")]


def _mirrored(a: np.ndarray, half: int) -> np.ndarray:
    """Border by reflection without the edge pixel; an image of one pixel repeats it."""
    return np.pad(a, half, "reflect" if min(a.shape) > half else "edge")


def _stack(a: np.ndarray, size: int) -> np.ndarray:
    """All pixels of every size x size window, as the last axis."""
    p = _mirrored(a, size // 2)
    return np.lib.stride_tricks.sliding_window_view(p, (size, size)).reshape(*a.shape, size * size)


def convolve(a: np.ndarray, k: np.ndarray) -> np.ndarray:
    h, w = k.shape
    p = np.pad(a.astype(float), ((h // 2, h // 2), (w // 2, w // 2)), "reflect" if min(a.shape) > max(h, w) // 2 else "edge")
    return np.einsum("ijkl,kl->ij", np.lib.stride_tricks.sliding_window_view(p, (h, w)), k)


def gaussian_kernel(size: int, sigma: float = 1.0) -> np.ndarray:
    x = np.arange(size) - size // 2
    g = np.exp(-(x * x) / (2 * sigma * sigma))
    return np.outer(g, g) / g.sum() ** 2


def median_blur(a: np.ndarray, size: int) -> np.ndarray:
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(a, size // 2, "edge"), (size, size)).reshape(*a.shape, -1), axis=2).astype(np.uint8)


def gaussian_blur(a: np.ndarray, size: int, sigma: float = 1.0) -> np.ndarray:
    return np.rint(convolve(a, gaussian_kernel(size, sigma))).astype(np.uint8)


def bilateral(a: np.ndarray, size: int, sigma_color: float, sigma_space: float) -> np.ndarray:
    """Means weighted by distance in place and in value."""
    v = _stack(a, size).astype(float)
    o = np.arange(size) - size // 2
    space = np.exp(-(o[:, None] ** 2 + o[None, :] ** 2) / (2 * sigma_space**2)).ravel()
    w = space * np.exp(-((v - a[:, :, None].astype(float)) ** 2) / (2 * sigma_color**2))
    return np.rint((v * w).sum(axis=2) / w.sum(axis=2)).astype(np.uint8)


SOBEL = np.array([[-1.0, 0, 1], [-2, 0, 2], [-1, 0, 1]])


def canny(a: np.ndarray, low: float, high: float) -> np.ndarray:
    """255 on thin edges: non-maximum suppression, then hysteresis from strong to weak neighbours."""
    gx, gy = convolve(a, SOBEL), convolve(a, SOBEL.T)
    m = np.abs(gx) + np.abs(gy)
    p = np.pad(m, 1)
    angle = np.degrees(np.arctan2(gy, gx)) % 180
    sector = ((angle + 22.5) // 45).astype(int) % 4
    steps = [(0, 1), (1, 1), (1, 0), (1, -1)]
    thin = np.zeros(a.shape, bool)
    for k, (dy, dx) in enumerate(steps):
        ahead = p[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]]
        behind = p[1 - dy : 1 - dy + a.shape[0], 1 - dx : 1 - dx + a.shape[1]]
        thin |= (sector == k) & (m >= ahead) & (m > behind)
    weak, edge = thin & (m > low), thin & (m > high)
    while True:
        q = np.pad(edge, 1)
        grown = weak & np.lib.stride_tricks.sliding_window_view(q, (3, 3)).any(axis=(2, 3))
        if (grown == edge).all():
            return np.where(edge, 255, 0).astype(np.uint8)
        edge = grown


def sample(a: np.ndarray, y: np.ndarray, x: np.ndarray, fill: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear values at (y, x), and where they lie in the image."""
    ok = (x >= 0) & (y >= 0) & (x <= a.shape[1] - 1) & (y <= a.shape[0] - 1)
    x0, y0 = np.clip(np.floor(x).astype(int), 0, a.shape[1] - 1), np.clip(np.floor(y).astype(int), 0, a.shape[0] - 1)
    x1, y1 = np.minimum(x0 + 1, a.shape[1] - 1), np.minimum(y0 + 1, a.shape[0] - 1)
    fx, fy = np.clip(x - x0, 0, 1), np.clip(y - y0, 0, 1)
    f = a.astype(float)
    v = (f[y0, x0] * (1 - fx) + f[y0, x1] * fx) * (1 - fy) + (f[y1, x0] * (1 - fx) + f[y1, x1] * fx) * fy
    return np.where(ok, v, fill), ok


def rotate_scale(a: np.ndarray, percent: float, degrees: float) -> np.ndarray:
    """Scaled, then turned counter-clockwise about the centre; a tiny angle is none."""
    if percent <= 0:
        raise ValueError("scale must be positive")
    h, w = max(1, round(a.shape[0] * percent / 100)), max(1, round(a.shape[1] * percent / 100))
    if max(h, w) > MAX_SIDE:
        raise ValueError("image would be too large")
    y, x = np.mgrid[0:h, 0:w].astype(float)
    if abs(degrees) > 1e-6:
        c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
        cy, cx = (h - 1) / 2, (w - 1) / 2
        x, y = c * (x - cx) - s * (y - cy) + cx, s * (x - cx) + c * (y - cy) + cy
    v, _ = sample(a, (y + 0.5) * a.shape[0] / h - 0.5 if h != a.shape[0] else y, (x + 0.5) * a.shape[1] / w - 0.5 if w != a.shape[1] else x)
    return np.rint(v)


def affine_from_points(src: np.ndarray, dst: np.ndarray, min_area: float = 1e-6) -> np.ndarray:
    """2 x 3 matrix of three point pairs; triangles without area are refused."""
    for t in (src, dst):
        u, v = t[1] - t[0], t[2] - t[0]
        if abs(u[0] * v[1] - u[1] * v[0]) / 2 <= min_area:
            raise ValueError("the three points span no area")
    return np.linalg.solve(np.hstack([src, np.ones((3, 1))]), dst).T


def affine_metrics(m: np.ndarray) -> dict[str, float]:
    """Scales, shear and rotation of a 2 x 3 matrix."""
    a, b, c, d = m[0, 0], m[0, 1], m[1, 0], m[1, 1]
    sx = float(np.hypot(a, c))
    shear = (a * b + c * d) / sx if sx else 0.0
    return {"scale_x": sx, "scale_y": (a * d - b * c) / sx if sx else 0.0, "shear": shear, "rotation": float(np.degrees(np.arctan2(c, a)))}


def warp(a: np.ndarray, m: np.ndarray, width: int, height: int, min_valid: float = 0.0) -> np.ndarray:
    """The image through a 2 x 3 or 3 x 3 matrix; too few covered pixels are an error."""
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError("output size out of range")
    full = m if m.shape == (3, 3) else np.vstack([m, [0, 0, 1]])
    inv = np.linalg.inv(full)
    y, x = np.mgrid[0:height, 0:width].astype(float)
    p = np.tensordot(inv, np.stack([x, y, np.ones_like(x)]), axes=1)
    v, ok = sample(a, p[1] / p[2], p[0] / p[2])
    if ok.mean() < min_valid:
        raise ValueError("too few pixels are covered")
    return np.rint(v)


def perspective(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """3 x 3 matrix of four point pairs."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3)


def projected(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Points under a 3 x 3 matrix; NaN where it sends them to infinity."""
    q = np.column_stack([p, np.ones(len(p))]) @ m.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.abs(q[:, 2:]) > 1e-12, q[:, :2] / q[:, 2:], np.nan)


def least_squares_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The 3 x 3 matrix that fits point pairs best: the smallest singular vector of the normalised equations."""

    def normal(p: np.ndarray) -> np.ndarray:
        c = p.mean(axis=0)
        k = np.sqrt(2) / max(float(np.linalg.norm(p - c, axis=1).mean()), 1e-12)
        return np.array([[k, 0, -k * c[0]], [0, k, -k * c[1]], [0, 0, 1]])

    a, b = normal(src), normal(dst)
    s, d = projected(a, src), projected(b, dst)
    one, zero = np.ones(len(s)), np.zeros((len(s), 3))
    h = np.column_stack([s, one])
    rows = np.vstack([np.hstack([h, zero, -d[:, :1] * h]), np.hstack([zero, h, -d[:, 1:] * h])])
    m = np.linalg.inv(b) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ a
    return m / m[2, 2] if abs(m[2, 2]) > 1e-12 else None


#: Draws of four pairs for a homography, and the fewest matches that one is sought for.
DRAWS, LEAST_MATCHES = 512, 4


def robust_homography(src: np.ndarray, dst: np.ndarray, reach: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
    """Matrix and inliers of the best of ``DRAWS`` seeded draws of four pairs, fitted again to all its inliers."""
    n = len(src)
    if n < LEAST_MATCHES:
        return None
    rng, best = np.random.default_rng(seed), None
    inside = lambda m: np.nan_to_num(np.linalg.norm(projected(m, src) - dst, axis=1), nan=np.inf) <= reach
    for _ in range(DRAWS):
        at = rng.choice(n, 4, replace=False)
        try:
            m = perspective(src[at], dst[at])
        except np.linalg.LinAlgError:
            continue  # three in a line
        k = inside(m)
        if np.isfinite(m).all() and (best is None or k.sum() > best[1].sum()):
            best = (m, k)
            if k.all():
                break
    if best is None or best[1].sum() < LEAST_MATCHES:
        return None
    m = least_squares_homography(src[best[1]], dst[best[1]])
    if m is not None and inside(m).sum() >= best[1].sum():
        best = (m, inside(m))
    return best


HOMOGRAPHY_SQL = "set_id string, status string, good long, inliers long, score double, matrix array<double>, x double, y double, angle double"


def feature_locations(matches: DataFrame, width: float, height: float, reach: float = 3.0) -> DataFrame:
    """Where the good matches of each set place a template of the given size.

    ``matches``: set_id, (sx, sy) in the template, (tx, ty) in the image; one set is
    one pair of images.  Fewer than ``LEAST_MATCHES`` matches, or no matrix, is a
    status of its own; the score is the share of inliers in per cent, to one place.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values(["sx", "sy", "tx", "ty"], kind="stable")
        name, n = pdf.set_id.iloc[0] if len(pdf) else None, len(pdf)
        found = robust_homography(pdf[["sx", "sy"]].to_numpy(float), pdf[["tx", "ty"]].to_numpy(float), reach)
        columns = [c.split()[0] for c in HOMOGRAPHY_SQL.split(", ")]
        if found is None:
            status = "FeatureNotEnoughMatches" if n < LEAST_MATCHES else "FeatureHomographyFailed"
            return pd.DataFrame([(name, status, n, 0, 0.0, None, None, None, None)] if n else [], columns=columns)
        m, inside = found
        box = projected(m, np.array([[0, 0], [0, height - 1], [width - 1, height - 1], [width - 1, 0]], float))
        middle, side = (box[0] + box[2]) / 2, box[1] - box[0]
        k = int(inside.sum())
        row = (name, "Success", n, k, round(100.0 * k / n, 1), m.ravel().tolist(), *middle.tolist(), float(np.degrees(np.arctan2(side[1], side[0]))))
        return pd.DataFrame([row], columns=columns)

    return matches.select("set_id", "sx", "sy", "tx", "ty").groupBy("set_id").applyInPandas(run, HOMOGRAPHY_SQL)


# -- blobs and contours --------------------------------------------------------------------------
def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components, numbered in row-major order of their first pixel."""
    n = mask.size
    ids = np.where(mask, np.arange(n).reshape(mask.shape), n)
    while True:
        p = np.pad(ids, 1, constant_values=n)
        least = np.lib.stride_tricks.sliding_window_view(p, (3, 3)).min(axis=(2, 3))
        new = np.where(mask, least, n)
        flat = np.append(new.ravel(), n)
        new = np.where(mask, flat[new], n)  # jump to the label's own label
        if (new == ids).all():
            break
        ids = new
    roots = np.unique(ids[mask])
    out = np.zeros(mask.shape, int)
    out[mask] = np.searchsorted(roots, ids[mask]) + 1
    return out, len(roots)


def blobs(a: np.ndarray, threshold: int, low: float, high: float, masks: list[tuple[int, int, int, int]] = ()) -> list[tuple]:
    """(index, area, cx, cy, x, y, w, h, angle) of bright components between two areas, but those inside a mask."""
    if low > high:
        raise ValueError("least area above largest")
    ids, n = label(a > threshold)
    out = []
    for k in range(1, n + 1):
        y, x = np.nonzero(ids == k)
        x0, y0, w, h = int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1
        if not low <= len(x) <= high or any(mx <= x0 and my <= y0 and x0 + w <= mx + mw and y0 + h <= my + mh for mx, my, mw, mh in masks):
            continue
        cx, cy = float(x.mean()), float(y.mean())
        angle = 0.5 * np.degrees(np.arctan2(2 * ((x - cx) * (y - cy)).mean(), ((x - cx) ** 2).mean() - ((y - cy) ** 2).mean()))
        out.append((len(out) + 1, len(x), cx, cy, x0, y0, w, h, float(angle)))
    return out


BLOB_COLUMNS = [("index", "int"), ("area", "int"), ("cx", "double"), ("cy", "double"), ("x", "int"), ("y", "int"), ("w", "int"), ("h", "int"), ("angle", "double")]
#: Neighbours clockwise from the east, (dy, dx).
_RING = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def trace(mask: np.ndarray) -> list[tuple[int, int]]:
    """Outer border of the component that holds the first set pixel, as (x, y) in order."""
    at = np.argwhere(mask)
    if not len(at):
        return []
    start = tuple(int(v) for v in at[0])
    inside = lambda p: 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p]
    out, here, back = [start], start, 4
    first = None
    for _ in range(8 * mask.size):
        for k in range(1, 9):
            d = (back + k) % 8
            nxt = (here[0] + _RING[d][0], here[1] + _RING[d][1])
            if inside(nxt):
                break
        else:
            break
        if first is None:
            first = (nxt, d)
        elif here == start and (nxt, d) == first:
            out.pop()
            break
        out.append(nxt)
        here, back = nxt, (d + 4) % 8
    return [(x, y) for y, x in out]


def simplify(points: list[tuple[int, int]], epsilon: float) -> list[tuple[int, int]]:
    """Closed polygon thinned so that no dropped point is farther than ``epsilon`` from it."""
    if len(points) < 3:
        return list(points)
    p = np.array(points, float)
    far = int(np.argmax(((p - p[0]) ** 2).sum(axis=1)))
    keep = {0, far}
    stack = [(0, far), (far, len(p))]
    ring = np.vstack([p, p[:1]])
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = ring[b] - ring[a]
        w = ring[a + 1 : b] - ring[a]
        size = np.hypot(*d)
        e = np.abs(d[0] * w[:, 1] - d[1] * w[:, 0]) / size if size else np.hypot(w[:, 0], w[:, 1])
        k = int(np.argmax(e))
        if e[k] > epsilon:
            keep.add(a + 1 + k)
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return [points[i] for i in sorted(keep)]


def polygon_area(points: list[tuple[int, int]]) -> float:
    x, y = np.array(points, float).T if len(points) else (np.zeros(0), np.zeros(0))
    return abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2


def min_area_rect(points: list[tuple[int, int]]) -> tuple[float, float, float, float, float]:
    """(cx, cy, w, h, angle) of the smallest rectangle around the points, by the directions of their hull."""
    p = np.unique(np.array(points, float), axis=0)
    best = None
    d = np.diff(np.vstack([p, p[:1]]), axis=0) if len(p) < 3 else np.vstack([p[None, :, :] - p[:, None, :]]).reshape(-1, 2)
    angles = np.unique(np.round(np.arctan2(d[:, 1], d[:, 0]) % (np.pi / 2), 9))
    for t in angles:
        c, s = np.cos(t), np.sin(t)
        u, v = p @ [c, s], p @ [-s, c]
        w, h = np.ptp(u), np.ptp(v)
        if best is None or w * h < best[0] - 1e-9:
            mu, mv = (u.max() + u.min()) / 2, (v.max() + v.min()) / 2
            best = (w * h, c * mu - s * mv, s * mu + c * mv, w, h, float(np.degrees(t)))
    return tuple(float(x) for x in best[1:])


def contours(a: np.ndarray, threshold: int, low: float, high: float, epsilon: float = 1.0) -> list[tuple]:
    """(index, points, area, x, y, w, h, square) of component borders between two areas.

    A square has four convex corners within 5 degrees of a right angle.
    """
    ids, n = label(a > threshold)
    out = []
    for k in range(1, n + 1):
        border = trace(ids == k)
        area = polygon_area(border)
        if not low <= area <= high:
            continue
        poly = simplify(border, epsilon)
        x, y = zip(*border, strict=True)
        out.append((len(out) + 1, len(poly), area, min(x), min(y), max(x) - min(x) + 1, max(y) - min(y) + 1, is_square(poly)))
    return out


CONTOUR_COLUMNS = [("index", "int"), ("points", "int"), ("area", "double"), ("x", "int"), ("y", "int"), ("w", "int"), ("h", "int"), ("square", "boolean")]


def is_square(poly: list[tuple[int, int]]) -> bool:
    if len(poly) != 4:
        return False
    p = np.array(poly, float)
    turns = []
    for i in range(4):
        u, v = p[i - 1] - p[i], p[(i + 1) % 4] - p[i]
        turns.append(np.sign(u[0] * v[1] - u[1] * v[0]))
        if abs(np.degrees(np.arccos(np.clip(u @ v / (np.hypot(*u) * np.hypot(*v)), -1, 1))) - 90) > 5:
            return False
    return len(set(turns)) == 1


# -- corners ---------------------------------------------------------------------------------------
def corners(a: np.ndarray, most: int = 1000, quality: float = 0.1, distance: float = 5.0, k: float = 0.04) -> list[tuple[float, float, float]]:
    """(x, y, response) of Harris corners: local maxima above a share of the best, apart from each other, sub-pixel."""
    gx, gy = convolve(a, SOBEL), convolve(a, SOBEL.T)
    box = np.ones((3, 3))
    xx, yy, xy = convolve(gx * gx, box), convolve(gy * gy, box), convolve(gx * gy, box)
    r = xx * yy - xy * xy - k * (xx + yy) ** 2
    top = r.max()
    if top <= 0:
        return []
    local = np.lib.stride_tricks.sliding_window_view(np.pad(r, 1, constant_values=-np.inf), (3, 3)).max(axis=(2, 3))
    y, x = np.nonzero((r == local) & (r >= quality * top))
    order = np.lexsort((x, y, -r[y, x]))
    out: list[tuple[float, float, float]] = []
    for i in order:
        if all((x[i] - q[0]) ** 2 + (y[i] - q[1]) ** 2 >= distance**2 for q in out):
            out.append((float(x[i]), float(y[i]), float(r[y[i], x[i]])))
            if len(out) >= most:
                break

    def bend(p, c, n):
        d = p - 2 * c + n
        return float(np.clip(0.5 * (p - n) / d, -0.5, 0.5)) if abs(d) > 1e-7 else 0.0

    q = np.pad(r, 1, "edge")
    return [(px + bend(q[int(py) + 1, int(px)], v, q[int(py) + 1, int(px) + 2]), py + bend(q[int(py), int(px) + 1], v, q[int(py) + 2, int(px) + 1]), v) for px, py, v in out]


CORNER_COLUMNS = [("x", "double"), ("y", "double"), ("response", "double")]


# -- matching --------------------------------------------------------------------------------------
def correlation(a: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Normalised correlation of a template at every place where it fits, -1..1; flat windows score 0."""
    if not t.size or t.shape[0] > a.shape[0] or t.shape[1] > a.shape[1]:
        return np.zeros((0, 0))
    f = a.astype(float)
    k = t.astype(float) - t.mean()
    norm = float(np.sqrt((k * k).sum()))
    size = tuple(np.array(a.shape) + np.array(t.shape) - 1)
    spec = np.fft.irfft2(np.fft.rfft2(f, size) * np.fft.rfft2(k[::-1, ::-1], size), size)
    h, w = t.shape
    dot = spec[h - 1 : a.shape[0], w - 1 : a.shape[1]]
    total = lambda x: np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    box = lambda s: s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]
    var = box(total(f * f)) - box(total(f)) ** 2 / (h * w)
    flat = (var <= 1e-6) | (norm <= 1e-9)
    return np.where(flat, 0.0, np.clip(dot / np.where(flat, 1.0, np.sqrt(np.maximum(var, 0)) * max(norm, 1e-300)), -1, 1))


def template_angles(low: float, high: float, step: float) -> list[float]:
    """Multiples of ``step`` in the range; 0 belongs to it where the range holds it."""
    if step <= 0:
        return [0.0]
    out = {i * step for i in range(int(np.ceil(low / step)), int(np.floor(high / step)) + 1)}
    if low <= 0 <= high:
        out.add(0.0)
    return sorted(out)


def match(a: np.ndarray, t: np.ndarray, min_score: float, most: int = 1, angles: list[float] = (0.0,), scales: list[float] = (100.0,)) -> list[tuple]:
    """(rank, x, y, w, h, angle, scale, score in percent) above the score; near duplicates of better ones go."""
    rows = []
    if not t.size:
        return rows
    for s in scales:
        for g in angles:
            k = rotate_scale(t, s, g) if s != 100.0 or abs(g) > 1e-6 else t
            score = correlation(a, k)
            if not score.size:
                continue
            left = score.copy()
            h, w = k.shape
            for _ in range(most):
                y, x = np.unravel_index(int(np.argmax(left)), left.shape)
                if not left[y, x] * 100 > min_score:
                    break
                rows.append((int(x), int(y), w, h, float(g), float(s), float(left[y, x]) * 100))
                left[max(0, y - h // 2) : y + h // 2 + 1, max(0, x - w // 2) : x + w // 2 + 1] = -np.inf
    rows.sort(key=lambda r: (-r[6], r[1], r[0]))
    kept: list[tuple] = []
    for r in rows:
        c = (r[0] + r[2] / 2, r[1] + r[3] / 2)
        if all(np.hypot(c[0] - q[0] - q[2] / 2, c[1] - q[1] - q[3] / 2) >= max(4.0, 0.5 * min(r[2], r[3])) for q in kept):
            kept.append(r)
            if len(kept) >= most:
                break
    return [(i, *r) for i, r in enumerate(kept, 1)]


MATCH_COLUMNS = [("rank", "int"), ("x", "int"), ("y", "int"), ("w", "int"), ("h", "int"), ("angle", "double"), ("scale", "double"), ("score", "double")]


#: Bytes of all templates of one search, which go to every worker.
MAX_TEMPLATE_BYTES = 64 << 20


def match_templates(images: DataFrame, templates: DataFrame, min_score: float, most: int = 1, angles: list[float] = (0.0,), scales: list[float] = (100.0,)) -> DataFrame:
    """``match`` of every template in every image: image_id, template_id and the columns of a match.

    ``templates`` is a table like that of images, with template_id.  It is sent to
    all workers, so its size is checked first; beyond ``MAX_TEMPLATE_BYTES`` it
    must be searched in parts.
    """
    size = templates.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    if size > MAX_TEMPLATE_BYTES:
        raise ValueError(f"{size} bytes of templates exceed {MAX_TEMPLATE_BYTES}")
    known = [(r.template_id, unpack(r.width, r.height, r.channels, bytes(r.data))) for r in templates.orderBy("template_id").collect()]
    shared = images.sparkSession.sparkContext.broadcast(known)
    kernel = lambda a: [(name, *r) for name, t in shared.value for r in match(a, t, min_score, most, angles, scales)]
    return on_images(images, kernel, [("template_id", "string"), *MATCH_COLUMNS])


def edge_model(t: np.ndarray, low: float, high: float, most: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Edge points of a template (y, x) and their unit gradients (gy, gx), thinned evenly."""
    gx, gy = convolve(t, SOBEL), convolve(t, SOBEL.T)
    m = np.hypot(gx, gy)
    y, x = np.nonzero((canny(t, low, high) > 0) & (m > 0))
    if len(y) > most:
        at = np.arange(most) * len(y) // most
        y, x = y[at], x[at]
    return np.stack([y, x], axis=1), np.stack([gy[y, x] / m[y, x], gx[y, x] / m[y, x]], axis=1)


def edge_scores(a: np.ndarray, model: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], either_polarity: bool = False) -> np.ndarray:
    """Mean dot product of unit gradients at every place where the template fits.

    With ``either_polarity`` a template whose contrast is reversed as a whole counts
    as much: the size of the mean, not the mean of the sizes.
    """
    h, w = a.shape[0] - shape[0] + 1, a.shape[1] - shape[1] + 1
    points, grad = model
    if h <= 0 or w <= 0 or not len(points):
        return np.zeros((max(h, 0), max(w, 0)))
    gx, gy = convolve(a, SOBEL), convolve(a, SOBEL.T)
    m = np.hypot(gx, gy)
    uy, ux = np.divide(gy, m, out=np.zeros_like(gy), where=m > 0), np.divide(gx, m, out=np.zeros_like(gx), where=m > 0)
    out = np.zeros((h, w))
    for (y, x), (ty, tx) in zip(points, grad, strict=True):
        out += uy[y : y + h, x : x + w] * ty + ux[y : y + h, x : x + w] * tx
    return (np.abs(out) if either_polarity else out) / len(points)


def edge_match(a: np.ndarray, t: np.ndarray, low: float, high: float, min_score: float, most: int = 1, either_polarity: bool = False) -> list[tuple]:
    """(rank, x, y, sub-pixel x and y, score) of the places at or above the score; ties by y, then x."""
    score = edge_scores(a, edge_model(t, low, high), t.shape, either_polarity) if t.size else np.zeros((0, 0))
    if not score.size:
        return []
    left, out = score.copy(), []
    ry, rx = (max(1, int(0.35 * n)) for n in t.shape)
    while len(out) < most:
        y, x = (int(v) for v in np.unravel_index(int(np.argmax(left)), left.shape))
        if left[y, x] < min_score or not np.isfinite(left[y, x]):
            break

        def shift(line, i):
            if not 0 < i < len(line) - 1:
                return 0.0
            d = line[i - 1] - 2 * line[i] + line[i + 1]
            return float(np.clip(0.5 * (line[i - 1] - line[i + 1]) / d, -0.5, 0.5)) if abs(d) > 1e-7 else 0.0

        out.append((len(out) + 1, x, y, x + shift(score[y], x), y + shift(score[:, x], y), float(left[y, x])))
        left[max(0, y - ry) : y + ry + 1, max(0, x - rx) : x + rx + 1] = -np.inf
    return out


EDGE_COLUMNS = [("rank", "int"), ("x", "int"), ("y", "int"), ("sub_x", "double"), ("sub_y", "double"), ("score", "double")]


def positions(first: int, last: int, stride: int) -> list[int]:
    """Every ``stride`` from the first on; the last always belongs."""
    out = list(range(first, last + 1, stride))
    return out if out and out[-1] == last else [*out, last]


def propose(a: np.ndarray, size: int, stride: int, max_overlap: float, most: int, low: float = 50, high: float = 150, least: tuple[float, float, float, float] = (0, 0, 0, 0)) -> list[tuple]:
    """Pattern candidates: contrast, edge density, balance of quadrants and directions, their quality, uniqueness.

    (rank, x, y, w, h, contrast, density, quadrants, directions, quality, uniqueness).
    """
    from .sequential import iou

    if a.shape[0] < size or a.shape[1] < size:
        return []
    edges = canny(a, low, high) > 0
    gx, gy = np.abs(convolve(a, SOBEL)), np.abs(convolve(a, SOBEL.T))
    clamp = lambda v: min(1.0, max(0.0, v))
    rows = []
    for y in positions(0, a.shape[0] - size, stride):
        for x in positions(0, a.shape[1] - size, stride):
            win = (slice(y, y + size), slice(x, x + size))
            e, h = edges[win], size // 2
            quads = [int(q.sum()) for q in (e[:h, :h], e[:h, h:], e[h:, :h], e[h:, h:])]
            sx, sy = float(gx[win].sum()), float(gy[win].sum())
            f = (float(a[win].std()), float(e.mean()), min(quads) / max(quads) if max(quads) else 0.0, min(sx, sy) / max(sx, sy) if max(sx, sy) > 0 else 0.0)
            if all(v >= m for v, m in zip(f, least, strict=True)):
                parts = (clamp(f[0] / 48), clamp(f[1] / 0.08), clamp(f[2]), clamp(f[3]))
                rows.append((float(np.prod(parts)) ** 0.25, y, x, f))
    rows.sort(key=lambda r: (-r[0], r[1], r[2]))
    kept: list[tuple] = []
    for q, y, x, f in rows:
        if all(iou((x, y, size, size), (k[1], k[2], size, size)) <= max_overlap for k in kept):
            score = correlation(a, a[y : y + size, x : x + size])
            score[max(0, y - size // 2) : y + size // 2 + 1, max(0, x - size // 2) : x + size // 2 + 1] = -1
            kept.append((len(kept) + 1, x, y, size, size, *f, q, float(1 - max(0.0, score.max()))))
            if len(kept) >= most:
                break
    return kept


PROPOSAL_COLUMNS = [("rank", "int"), ("x", "int"), ("y", "int"), ("w", "int"), ("h", "int"), ("contrast", "double"), ("density", "double"), ("quadrants", "double"), ("directions", "double"), ("quality", "double"), ("uniqueness", "double")]
