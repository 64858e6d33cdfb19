"""Centred windows over whole arrays, edges repeated, as the column forms in ``operators.windows``."""

from __future__ import annotations

import numpy as np


def padded(x: np.ndarray, size: int) -> np.ndarray:
    """Readings with the ends repeated for windows of ``size``; an even size leans left."""
    left = size // 2
    return np.concatenate([np.repeat(x[:1], left, axis=0), x, np.repeat(x[-1:], size - 1 - left, axis=0)])


def mean(x: np.ndarray, size: int) -> np.ndarray:
    """Rolling mean along the first axis.

    A window is the end of one block of ``size`` and the start of the next, so sums only ever add
    and nothing cancels, unlike differences of one long running sum.
    """
    if size <= 1 or not len(x):
        return x.astype(float)
    p = padded(x, size)
    blocks = -(-len(p) // size)
    full = np.concatenate([p, np.zeros((blocks * size - len(p), *p.shape[1:]))]).reshape(blocks, size, *p.shape[1:])
    ahead = np.cumsum(full, axis=1).reshape(blocks * size, *p.shape[1:])
    back = np.cumsum(full[:, ::-1], axis=1)[:, ::-1].reshape(blocks * size, *p.shape[1:])
    i = np.arange(len(x))
    total = np.where((i % size == 0).reshape(-1, *[1] * (p.ndim - 1)), 0.0, back[i]) + ahead[i + size - 1]
    return total / size


def median(x: np.ndarray, size: int) -> np.ndarray:
    """Rolling median of an odd number of readings."""
    return np.median(np.lib.stride_tricks.sliding_window_view(padded(x, size), size), axis=-1) if len(x) else x


def ramp(x: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """0 below lo, 1 above hi, linear between."""
    return np.clip((x - lo) / max(hi - lo, 1e-6), 0, 1)


def gradient(x: np.ndarray) -> np.ndarray:
    """Central differences, one-sided at the ends; 0 for a single reading."""
    return np.gradient(x) if len(x) > 1 else np.zeros(len(x))


def hampel(x: np.ndarray, half: int, nsig: float) -> tuple[np.ndarray, np.ndarray]:
    """Readings with outliers replaced by their rolling median, and which those are."""
    med = median(x, 2 * half + 1)
    dev = np.abs(x - med)
    bad = dev > nsig * (1.4826 * median(dev, 2 * half + 1) + 1e-9)
    return np.where(bad, med, x), bad
