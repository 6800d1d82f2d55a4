"""Masks by thresholds and growing, blocks around points, and comparison of two volumes."""

from __future__ import annotations

import math

import numpy as np

from spindrift.kernels.volumes import components, same_geometry, unpack


def filled(mask: np.ndarray) -> np.ndarray:
    """A 2-D mask without holes: background that doesn't reach the border becomes mask."""
    label, n = components(~mask)
    edge = np.unique(np.concatenate([label[0], label[-1], label[:, 0], label[:, -1]])) if label.size else np.zeros(0, int)
    outside = np.zeros(n + 1, bool)
    outside[edge] = True
    outside[0] = False
    return ~outside[label]


def lung_mask(ct: np.ndarray, low: float = -900.0, high: float = -400.0) -> np.ndarray:
    """Voxels between the two densities, with the holes of each slice filled."""
    inside = (ct > low) & (ct < high)
    return np.stack([filled(s) for s in inside]) if len(ct) else inside


def grow(ct: np.ndarray, seed: tuple[int, int, int], low: float = -500.0, high: float = 200.0, reach: int = 12, fallback: float = 5.0) -> np.ndarray:
    """The connected voxels between the densities that hold the seed, no further than
    ``reach`` from it along each axis; a ball around the seed where it isn't one of them."""
    box = tuple(slice(max(0, s - reach), s + reach + 1) for s in seed)
    at = tuple(s - b.start for s, b in zip(seed, box))
    block = ct[box]
    label, _ = components((block > low) & (block < high))
    if label[at]:
        part = label == label[at]
    else:
        distance = sum((g - a) ** 2 for g, a in zip(np.indices(block.shape), at))
        part = distance <= fallback**2
    out = np.zeros(ct.shape, np.uint8)
    out[box] = part
    return out


def block_around(volume: np.ndarray, center: tuple[int, int, int], scale: float, boundary: int = 2) -> tuple[np.ndarray, tuple[int, ...]]:
    """The cube of ceil(4 scale) + 2 boundary voxels, made odd, around a point, and its corner;
    outside the volume the nearest voxel is repeated."""
    size = (math.ceil(4 * scale) + 2 * boundary) | 1
    corner = tuple(c - size // 2 for c in center)
    index = np.ix_(*[np.clip(np.arange(c, c + size), 0, n - 1) for c, n in zip(corner, volume.shape)])
    return volume[index].astype(np.float32), corner


def compare_volumes(a: dict, b: dict, tol: float = 1e-6) -> dict:
    """Whether the geometry agrees and, where the sizes do, the largest and mean difference
    and how many voxels differ by more than ``tol``."""
    out = {"same_geometry": same_geometry(a, b), "max_diff": None, "mean_diff": None, "n_over": None}
    if list(a["shape"]) == list(b["shape"]):
        gap = np.abs(unpack(a)[0].astype(float) - unpack(b)[0].astype(float))
        out |= {"max_diff": float(gap.max(initial=0.0)), "mean_diff": float(gap.mean()) if gap.size else 0.0, "n_over": int((gap > tol).sum())}
    return out
