"""Motion of a camera from its frames: what a decoder must give, and all that follows from matched points.

Decoding and point tracking are a *backend*: an object with ``open(path)`` that gives frames per second and
matched points of successive frames.  None is part of this library; with one, ``video_rates`` and
``track_video`` spread the intervals of many files over tasks.  The geometry is numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.session import ship

# fixed values: least points for a pair, inliers at which quality begins and what it takes to be full, trials, confidence
LEAST, BEGIN, FULL, TRIALS = 40, 60, 150, 1000
SEED = 1_000_000


class Clip(Protocol):
    """An opened file."""

    fps: float
    camera: np.ndarray
    distortion: np.ndarray

    def matches(self, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(frame, points before, points in it), pixels, for each frame from first + 1 to last that can be read."""
        ...


class Backend(Protocol):
    def open(self, path: str) -> Clip: ...


def undistorted(points: np.ndarray, camera: np.ndarray, distortion: np.ndarray) -> np.ndarray:
    """Directions (x, y at depth 1) of fisheye pixels, by Newton's method on the radius."""
    p = (points - camera[:2, 2]) / np.array([camera[0, 0], camera[1, 1]])
    r = np.linalg.norm(p, axis=1)
    theta, k = r.copy(), np.asarray(distortion, float)
    for _ in range(20):
        s = theta * theta
        value = theta * (1 + s * (k[0] + s * (k[1] + s * (k[2] + s * k[3])))) - r
        slope = 1 + s * (3 * k[0] + s * (5 * k[1] + s * (7 * k[2] + s * 9 * k[3])))
        theta = np.clip(theta - value / np.where(np.abs(slope) > 1e-9, slope, 1.0), 0, 1.55)
    return p * np.where(r > 1e-9, np.tan(theta) / np.maximum(r, 1e-9), 1.0)[:, None]


def _essential(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Essential matrix of eight or more matched directions."""
    rows = np.einsum("ni,nj->nij", b, a).reshape(len(a), 9)
    u, _, vt = np.linalg.svd(np.linalg.svd(rows)[2][-1].reshape(3, 3))
    return u @ np.diag([1.0, 1.0, 0.0]) @ vt


def _rotation_vector(m: np.ndarray) -> np.ndarray:
    c = np.clip((np.trace(m) - 1) / 2, -1, 1)
    v = np.array([m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]])
    angle = np.arccos(c)
    return v / 2 if angle < 1e-9 else v * angle / (2 * np.sin(angle))


def pair_rotation(before: np.ndarray, after: np.ndarray, camera: np.ndarray, distortion: np.ndarray, frame: int, threshold: float = 0.002) -> tuple[np.ndarray, float]:
    """Rotation vector between two frames and its quality 0..1; zeros where too few points agree.

    Trials of eight points, seeded by the frame so that any split into tasks gives the same; of the
    two rotations of the essential matrix the smaller.
    """
    none = np.zeros(3), 0.0
    if len(before) < LEAST:
        return none
    a, b = (np.c_[undistorted(p, camera, distortion), np.ones(len(p))] for p in (before, after))
    rng = np.random.default_rng(SEED + frame)
    best, cost, model = np.zeros(len(a), bool), np.inf, np.zeros((3, 3))

    def distance(e: np.ndarray) -> np.ndarray:
        ea, eb = a @ e.T, b @ e
        return np.abs((b * ea).sum(axis=1)) / np.sqrt(ea[:, 0] ** 2 + ea[:, 1] ** 2 + eb[:, 0] ** 2 + eb[:, 1] ** 2 + 1e-30)

    left = TRIALS
    while left > 0:
        left -= 1
        pick = rng.choice(len(a), 8, replace=False)
        e = _essential(a[pick], b[pick])
        d = np.minimum(distance(e), threshold)
        if d.sum() < cost:  # by distances, not by counts: chance agreement costs
            cost, best, model = d.sum(), d < threshold, e
            share = best.mean() ** 8
            left = min(left, int(np.ceil(np.log(0.001) / np.log(max(1 - share, 1e-12)))) if share < 1 else 0)
    if best.sum() < LEAST:
        return none
    for _ in range(3):  # fit again to the points that agree best, so that chance agreement has no part in it
        d = distance(model)
        near = best & (d <= max(3 * np.median(d[best]), 1e-9))
        model = _essential(a[near], b[near])
    u, _, vt = np.linalg.svd(model)
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    turns = [u @ m @ vt for m in (w, w.T)]
    vectors = [_rotation_vector(m * np.sign(np.linalg.det(m))) for m in turns]
    quality = float(np.clip((best.sum() - BEGIN) / FULL, 0, 1)) if best.sum() >= BEGIN else 0.0
    return min(vectors, key=np.linalg.norm), quality


def similarity(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Shift, roll (rad) and log scale that take points to their matches, by least squares."""
    a, b = before - before.mean(axis=0), after - after.mean(axis=0)
    re, im = (a * b).sum(), (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum()
    size = (a * a).sum()
    return after.mean(axis=0) - before.mean(axis=0), float(np.arctan2(im, re)), float(np.log(np.hypot(re, im) / size)) if size > 0 and (re or im) else 0.0


def _spread(intervals: DataFrame, backend: Backend, fields: list[str], of: Callable[[Clip, int, np.ndarray, np.ndarray], list[float]]) -> DataFrame:
    """One task's worth an interval: rows (path, a, b, frame, t, fields...) of the frames from a to b."""
    ship(intervals.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, a, b in batch.itertuples(index=False):
                clip = backend.open(path)
                rows = [(path, a, b, frame, (frame - 0.5) / clip.fps, *of(clip, frame, p, q)) for frame, p, q in clip.matches(int(a * clip.fps), int(b * clip.fps) + 1)]
                yield pd.DataFrame(rows, columns=["path", "a", "b", "frame", "t", *fields])

    schema = "path string, a double, b double, frame bigint, t double, " + ", ".join(f"{f} double" for f in fields)
    rows = intervals.select("path", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")).dropna().distinct()
    return rows.repartition("path", "a", "b").mapInPandas(run, schema)


def video_rates(intervals: DataFrame, backend: Backend) -> DataFrame:
    """Measured rates (rad/s, camera frame) of the intervals (path, a, b): path, a, b, frame, t, ox, oy, oz, quality."""

    def of(clip: Clip, frame: int, p: np.ndarray, q: np.ndarray) -> list[float]:
        turn, quality = pair_rotation(p, q, clip.camera, clip.distortion, frame)
        return [*(turn * clip.fps).tolist(), quality]

    return _spread(intervals, backend, ["ox", "oy", "oz", "quality"], of)


def track_video(intervals: DataFrame, backend: Backend) -> DataFrame:
    """Apparent motion of rendered frames: wx, wy, wroll (deg/s), dlogs (log scale a second) and quality; NaN where too few points match."""

    def of(clip: Clip, frame: int, p: np.ndarray, q: np.ndarray) -> list[float]:
        if len(p) < LEAST:
            return [float("nan")] * 4 + [0.0]
        shift, roll, scale = similarity(p, q)
        turn = np.degrees(np.arctan2(shift, [clip.camera[0, 0], clip.camera[1, 1]])) * clip.fps
        return [float(turn[0]), float(turn[1]), float(np.degrees(roll) * clip.fps), scale * clip.fps, float(np.clip((len(p) - BEGIN) / FULL, 0, 1))]

    return _spread(intervals, backend, ["wx", "wy", "wroll", "dlogs", "quality"], of)
