"""Butterworth designs and their steady states, on the driver: closed forms, no fitting."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np


@dataclass(frozen=True)
class Filter:
    """Numerator and denominator of a digital filter, a[0] = 1."""

    b: tuple[float, ...]
    a: tuple[float, ...]

    @property
    def padlen(self) -> int:
        return 3 * max(len(self.a), len(self.b))


def prototype(order: int) -> np.ndarray:
    """Poles of the analog low-pass of cutoff 1."""
    k = np.arange(order)
    return np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))


def _digital(zeros: np.ndarray, poles: np.ndarray, gain: complex) -> Filter:
    """Bilinear transform at sample rate 2, then zeros and poles multiplied out."""
    fs2 = 4.0
    gain = gain * np.prod(fs2 - zeros) / np.prod(fs2 - poles)
    z = np.concatenate([(fs2 + zeros) / (fs2 - zeros), -np.ones(len(poles) - len(zeros))])
    p = (fs2 + poles) / (fs2 - poles)
    return Filter(tuple(np.real(gain * np.poly(z)).tolist()), tuple(np.real(np.poly(p)).tolist()))


def warp(wn: float) -> float:
    return 4 * np.tan(np.pi * wn / 2)


def low_pass(order: int, wn: float) -> Filter:
    """wn: cutoff as a share of half the sample rate, in (0, 1)."""
    if not 0 < wn < 1:
        raise ValueError("cutoff must lie in (0, 1)")
    w = warp(wn)
    return _digital(np.zeros(0), prototype(order) * w, w**order)


def band_pass(order: int, lo: float, hi: float) -> Filter:
    if not 0 < lo < hi < 1:
        raise ValueError("band must lie in (0, 1)")
    w1, w2 = warp(lo), warp(hi)
    width, centre = w2 - w1, np.sqrt(w1 * w2)
    half = prototype(order) * width / 2
    root = np.sqrt(half**2 - centre**2)
    return _digital(np.zeros(order), np.concatenate([half + root, half - root]), width**order)


@lru_cache(maxsize=4096)
def states(f: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """z' = A z + B x, y = C z + D x, of the transposed direct form."""
    n = max(len(f.a), len(f.b)) - 1
    a, b = np.zeros(n + 1), np.zeros(n + 1)
    a[: len(f.a)], b[: len(f.b)] = f.a, f.b
    A = np.zeros((n, n))
    A[:, 0] = -a[1:]
    A[:-1, 1:] += np.eye(n - 1)
    return A, b[1:] - a[1:] * b[0], np.eye(n)[0], b[0]


@lru_cache(maxsize=4096)
def steady(f: Filter) -> np.ndarray:
    """State that a constant input of 1 leaves unchanged."""
    A, B, _, _ = states(f)
    return np.linalg.solve(np.eye(len(B)) - A, B)
