"""Array kernels on 3-D volumes (z, y, x), in NumPy; ``per_volume`` runs one over rows.

A volume travels as a struct of shape, spacing and origin (x, y, z), a dtype name and raw
bytes, and is only opened inside a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from spindrift.shipping import ship

VOLUME = "struct<shape:array<int>,spacing:array<double>,origin:array<double>,dtype:string,data:binary>"


def pack(a: np.ndarray, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0)) -> dict:
    return {"shape": list(a.shape), "spacing": list(map(float, spacing)), "origin": list(map(float, origin)), "dtype": str(a.dtype), "data": np.ascontiguousarray(a).tobytes()}


def unpack(v) -> tuple[np.ndarray, tuple, tuple]:
    v = v.asDict() if hasattr(v, "asDict") else v
    return np.frombuffer(v["data"], v["dtype"]).reshape([int(n) for n in v["shape"]]), tuple(v["spacing"]), tuple(v["origin"])


def per_volume(df: DataFrame, kernel: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """``kernel`` over every row as a dict, giving rows of ``schema``; ``status`` and
    ``error`` are added, and a row that fails becomes one row with its error."""
    ship(df.sparkSession)
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    out += [{**r, "status": "ok", "error": None} for r in kernel(row)]
                except Exception as e:  # one bad volume must not fail the job
                    out.append({**{n: row.get(n) for n in names}, "status": "failed", "error": f"{type(e).__name__}: {e}"[:500]})
            yield pd.DataFrame(out, columns=[*names, "status", "error"])

    return df.mapInPandas(run, f"{schema}, status string, error string")


def same_geometry(a: dict, b: dict, tol: float = 1e-3) -> bool:
    """Equal sizes, spacing and origin within ``tol``."""
    return list(a["shape"]) == list(b["shape"]) and all(abs(x - y) <= tol for k in ("spacing", "origin") for x, y in zip(a[k], b[k]))


def gaussian_kernel(sigma: float, order: int = 0) -> np.ndarray:
    r = max(1, int(math.ceil(4 * sigma)))
    x = np.arange(-r, r + 1, dtype=float)
    g = np.exp(-x * x / (2 * sigma * sigma))
    g /= g.sum()
    if order == 1:
        return -x / sigma**2 * g
    if order == 2:
        k = (x * x / sigma**4 - 1 / sigma**2) * g
        return k - k.mean()
    return g


def convolve_axis(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Convolution along an axis with the edge voxels repeated."""
    r = len(kernel) // 2
    p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(a.ndim)], mode="edge")
    out = np.zeros(a.shape, float)
    for i, w in enumerate(kernel[::-1]):
        out += w * np.take(p, range(i, i + a.shape[axis]), axis=axis)
    return out


def hessian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Scale-normalised second derivatives, (..., 3, 3)."""
    k = [gaussian_kernel(sigma, o) for o in range(3)]
    out = np.empty((*a.shape, 3, 3))
    for i in range(3):
        for j in range(i, 3):
            order = [0, 0, 0]
            order[i] += 1
            order[j] += 1
            d = np.asarray(a, float)
            for axis in range(3):
                d = convolve_axis(d, k[order[axis]], axis)
            out[..., i, j] = out[..., j, i] = sigma**2 * d
    return out


def surface_elements(h: np.ndarray) -> dict[str, np.ndarray]:
    """Eigenvalues by falling magnitude, first eigenvector, and the three shape measures."""
    val, vec = np.linalg.eigh(h)
    order = np.argsort(-np.abs(val), axis=-1)
    val = np.take_along_axis(val, order, -1)
    first = np.take_along_axis(vec, order[..., None, :1], -1)[..., 0]
    m = np.abs(val)
    return {"values": val, "normal": first, "surfaceness": m[..., 0] - m[..., 1], "curvedness": m[..., 1] - m[..., 2], "pointedness": m[..., 2]}


def dots(a: np.ndarray, d_min: float, d_max: float, scales: int = 4, radius: int = 2) -> list[tuple[int, int, int, float, float]]:
    """(z, y, x, sigma, score) of bright blobs between two diameters: local maxima of the
    dot measure above the mean of all local maxima of their scale."""
    out = []
    for s in np.geomspace(d_min / 4, d_max / 4, scales):
        val = surface_elements(hessian(a, float(s)))["values"]
        big = np.where(val[..., 0] != 0, val[..., 0], 1)
        dot = np.where((val < 0).all(axis=-1), np.abs(val[..., 2]) * (val[..., 2] / big) ** 2, 0.0)
        peak = dot.copy()
        for axis in range(3):
            p = np.pad(peak, [(radius, radius) if i == axis else (0, 0) for i in range(3)], mode="edge")
            peak = np.max([np.take(p, range(i, i + a.shape[axis]), axis=axis) for i in range(2 * radius + 1)], axis=0)
        hit = (dot == peak) & (dot > 0)
        if hit.any():
            level = dot[hit].mean()
            out += [(int(z), int(y), int(x), float(s), float(dot[z, y, x])) for z, y, x in zip(*np.nonzero(hit)) if dot[z, y, x] >= level]
    return sorted(out, key=lambda r: (-r[4], r[:3]))


def direction_histogram(a: np.ndarray, sigma: float = 1.5, bins: int = 90, percentile: float = 50.0) -> np.ndarray:
    """Two histograms of the surface normals' angles, each weighted by surfaceness and
    summing to 1 (or to 0 in a flat block)."""
    e = surface_elements(hessian(a, sigma))
    w = e["surfaceness"]
    w = np.where(w >= np.percentile(w, percentile), w, 0.0)
    n = e["normal"]
    theta = np.degrees(np.arccos(np.clip(n[..., 0], -1, 1)))
    phi = np.degrees(np.arctan2(n[..., 1], n[..., 2])) % 180
    total = w.sum()
    out = []
    for angle in (theta % 180, phi):
        h = np.bincount(np.minimum((angle.ravel() * bins / 180).astype(int), bins - 1), w.ravel(), bins)
        out.append(h / total if total > 0 else h)
    return np.concatenate(out)


def tall_peaks(h: np.ndarray, z: float = 3.0) -> np.ndarray:
    """Bins that stand out of their half of the histogram."""
    half = len(h) // 2
    out = []
    for part in (h[:half], h[half:]):
        s = part.std()
        out.append((part - part.mean()) / s > z if s > 0 else np.zeros(len(part), bool))
    return np.concatenate(out)


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels from 1 of the 6-connected components, by joining equal runs of indexes."""
    idx = np.full(mask.shape, -1)
    idx[mask] = np.arange(mask.sum())
    n = int(mask.sum())
    root = np.arange(n)
    pairs = []
    for axis in range(mask.ndim):
        a, b = np.take(idx, range(mask.shape[axis] - 1), axis=axis), np.take(idx, range(1, mask.shape[axis]), axis=axis)
        ok = (a >= 0) & (b >= 0)
        pairs.append((a[ok], b[ok]))
    i, j = (np.concatenate(x) for x in zip(*pairs))
    while True:
        lo, hi = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        live = lo != hi
        if not live.any():
            break
        np.minimum.at(root, hi[live], lo[live])
        while (root[root] != root).any():
            root = root[root]
    _, label = np.unique(root, return_inverse=True)
    out = np.zeros(mask.shape, np.int32)
    out[mask] = label + 1
    return out, int(label.max() + 1) if n else 0


def crop_resample(image: dict, mask: dict, *, label: int = 1, pad_mm: float = 20.0, spacing: float = 1.0) -> tuple[dict, dict]:
    """Both volumes cut to the label's box with a margin and resampled to cubes, the image
    linearly and the mask by nearest voxel."""
    if not same_geometry(image, mask):
        raise ValueError("image and mask differ in geometry")
    a, sp, org = unpack(image)
    m, _, _ = unpack(mask)
    at = np.nonzero(m == label)
    if not len(at[0]):
        raise ValueError(f"label {label} is not in the mask")
    step = np.array(sp[::-1])
    lo = np.maximum(np.array([i.min() for i in at]) - np.round(pad_mm / step).astype(int), 0)
    hi = np.minimum(np.array([i.max() for i in at]) + np.round(pad_mm / step).astype(int) + 1, a.shape)
    box = tuple(slice(x, y) for x, y in zip(lo, hi))
    a, m = a[box].astype(float), (m[box] == label).astype(np.uint8)
    size = np.maximum(1, np.round(np.array(a.shape) * step / spacing).astype(int))
    for axis in range(3):
        pos = np.clip(np.arange(size[axis]) * spacing / step[axis], 0, a.shape[axis] - 1)
        i = np.minimum(pos.astype(int), max(0, a.shape[axis] - 2))
        f = (pos - i).reshape([-1 if k == axis else 1 for k in range(3)])
        j = np.minimum(i + 1, a.shape[axis] - 1)
        a = np.take(a, i, axis) * (1 - f) + np.take(a, j, axis) * f
        m = np.take(m, np.clip(np.round(pos).astype(int), 0, m.shape[axis] - 1), axis)
    origin = [o + x * s for o, x, s in zip(org, lo[::-1], sp)]
    return pack(a.astype(np.float32), (spacing,) * 3, origin), pack(m, (spacing,) * 3, origin)


def match_histogram(a: np.ndarray, reference: np.ndarray, points: int = 50) -> np.ndarray:
    """Intensities mapped so that quantiles above the mean agree with the reference's."""
    q = np.linspace(0, 1, points + 2)
    src, ref = np.quantile(a[a > a.mean()], q), np.quantile(reference[reference > reference.mean()], q)
    src, ref = np.concatenate([[a.min()], src]), np.concatenate([[reference.min()], ref])
    src, keep = np.unique(src, return_index=True)
    return np.interp(a, src, ref[keep])


def fill_polygons(polygons: list[tuple[list[float], list[float]]], shape: tuple[int, int], *, even_odd: bool = True) -> np.ndarray:
    """Mask of polygons (xs, ys) in voxel coordinates: crossings counted row by row; with
    ``even_odd`` overlapping polygons cut holes, without it they are joined."""
    h, w = shape
    out = np.zeros(shape, bool)
    cx = np.arange(w)
    for xs, ys in polygons:
        xs, ys = np.asarray(xs, float), np.asarray(ys, float)
        one = np.zeros(shape, bool)
        x2, y2 = np.roll(xs, -1), np.roll(ys, -1)
        for row in range(max(0, math.floor(ys.min())), min(h, math.ceil(ys.max()) + 1)):
            cut = (ys <= row) != (y2 <= row)
            at = xs[cut] + (row - ys[cut]) * (x2[cut] - xs[cut]) / (y2[cut] - ys[cut])
            one[row] = (at[None, :] > cx[:, None]).sum(axis=1) % 2 == 1
        out = out ^ one if even_odd else out | one
    return out


def staple(masks: np.ndarray, iterations: int = 100, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability, sensitivity, specificity) of readers (readers x voxels) by EM."""
    d = np.asarray(masks, float).reshape(len(masks), -1)
    prior = np.clip(d.mean(), 1e-6, 1 - 1e-6)
    p, q = np.full(len(d), 0.99), np.full(len(d), 0.99)
    for _ in range(iterations):
        a = np.log(prior) + (d * np.log(p)[:, None] + (1 - d) * np.log1p(-p)[:, None]).sum(axis=0)
        b = np.log1p(-prior) + ((1 - d) * np.log(q)[:, None] + d * np.log1p(-q)[:, None]).sum(axis=0)
        w = 1 / (1 + np.exp(np.clip(b - a, -700, 700)))
        p2 = np.clip((d * w).sum(axis=1) / max(w.sum(), 1e-12), 1e-6, 1 - 1e-6)
        q2 = np.clip(((1 - d) * (1 - w)).sum(axis=1) / max((1 - w).sum(), 1e-12), 1e-6, 1 - 1e-6)
        done = max(np.abs(p2 - p).max(), np.abs(q2 - q).max()) < tol
        p, q = p2, q2
        if done:
            break
    return w.reshape(np.asarray(masks).shape[1:]), p, q


def dice(a: np.ndarray, b: np.ndarray) -> float:
    total = a.sum() + b.sum()
    return float(2 * (a & b).sum() / total) if total else math.nan


def mask_statistics(image: np.ndarray, mask: np.ndarray, spacing=(1.0, 1.0, 1.0)) -> dict:
    at = np.nonzero(mask)
    n = len(at[0])
    out = {"n_voxels": n, "volume_mm3": n * float(np.prod(spacing))}
    if n:
        v = image[at]
        out |= {"mean": float(v.mean()), "min": float(v.min()), "max": float(v.max())}
        for name, i in zip("zyx", at):
            out |= {f"bbox_{name}_min": int(i.min()), f"bbox_{name}_max": int(i.max()), f"centroid_{name}": float(i.mean())}
    return out


def first_order(values: np.ndarray, bin_width: float = 25.0) -> dict[str, float]:
    """First-order intensity features of the voxels of a region."""
    v = np.asarray(values, float).ravel()
    if not len(v):
        return {}
    mean, var = v.mean(), v.var()
    edges = np.floor((v - math.floor(v.min() / bin_width) * bin_width) / bin_width).astype(int)
    p = np.bincount(edges) / len(v)
    p = p[p > 0]
    p10, p25, p50, p75, p90 = np.percentile(v, [10, 25, 50, 75, 90])
    inner = v[(v >= p10) & (v <= p90)]
    sd = math.sqrt(var)
    return {
        "Energy": float((v * v).sum()),
        "Entropy": float(-(p * np.log2(p)).sum()),
        "Minimum": float(v.min()),
        "10Percentile": float(p10),
        "90Percentile": float(p90),
        "Maximum": float(v.max()),
        "Mean": float(mean),
        "Median": float(p50),
        "InterquartileRange": float(p75 - p25),
        "Range": float(v.max() - v.min()),
        "MeanAbsoluteDeviation": float(np.abs(v - mean).mean()),
        "RobustMeanAbsoluteDeviation": float(np.abs(inner - inner.mean()).mean()),
        "RootMeanSquared": float(math.sqrt((v * v).mean())),
        "Skewness": float(((v - mean) ** 3).mean() / sd**3) if sd else 0.0,
        "Kurtosis": float(((v - mean) ** 4).mean() / var**2) if var else 0.0,
        "Variance": float(var),
        "Uniformity": float((p * p).sum()),
    }


def sphere(n: int, radius: float, value: float = 1.0) -> np.ndarray:
    """Phantom: a ball in the middle of an n-cube."""
    z, y, x = np.indices((n, n, n)) - (n - 1) / 2
    return np.where(z * z + y * y + x * x <= radius * radius, value, 0.0).astype(np.float32)


def spiked_sphere(n: int, radius: float, spikes: int = 6, length: float = 6.0, width: float = 1.5) -> np.ndarray:
    """Phantom: a ball with straight spikes along the axes and diagonals."""
    a = sphere(n, radius)
    dirs = np.array([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1), (1, 1, 1), (-1, -1, -1), (1, -1, 1), (-1, 1, -1)], float)[:spikes]
    pts = np.indices((n, n, n)).reshape(3, -1).T - (n - 1) / 2
    for d in dirs / np.linalg.norm(dirs, axis=1, keepdims=True):
        along = pts @ d
        off = np.linalg.norm(pts - along[:, None] * d, axis=1)
        hit = (along > 0) & (along <= radius + length) & (off <= width * (1 - np.clip((along - radius) / length, 0, 1)) + 0.3)
        a.reshape(-1)[hit] = 1.0
    return a
