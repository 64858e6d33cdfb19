"""Noise of a rate series, its adaptive cleaning, and the intervals that follow from it.

The rate ``fs`` of a series is a column (``aggregates.sample_rate``): bands and cutoffs are in hertz
and windows in seconds, so filters and window lengths follow each series' own rate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.config import Config
from gyrolith.functions import quat as Qn
from gyrolith.functions import rolling
from gyrolith.functions.design import Filter, band_pass, low_pass
from gyrolith.operators.filters import Pass, run_pass
from gyrolith.operators.intervals import find_intervals, in_any
from gyrolith.operators.windows import uniform_filter

AXES = ("wx", "wy", "wz")
ALPHA_S = 0.2


def window_rows(seconds: float, fs: float, rounded: bool = False) -> int:
    """Readings in a time: truncated, or rounded half away from zero; at least three."""
    rows = seconds * fs
    return max(3, math.floor(rows + 0.5) if rounded else int(rows))


def noise_band(fs: float, cfg: Config) -> Filter:
    lo, hi = cfg.noise_band
    return band_pass(2, lo / (fs / 2), min(hi, 0.475 * fs) / (fs / 2))


def cleanable(fs: float, cfg: Config) -> bool:
    """Whether the noise band and the light cutoff exist at this rate."""
    return bool(math.isfinite(fs) and fs > 0 and cfg.noise_band[0] < min(cfg.noise_band[1], 0.475 * fs) and cfg.light_cutoff < fs / 2)


def envelope(bands: np.ndarray, fs: float, cfg: Config) -> np.ndarray:
    """Largest axis of the rolling RMS of band-passed columns."""
    return np.sqrt(rolling.mean(bands * bands, window_rows(cfg.noise_window_ms / 1000, fs, True))).max(axis=1)


def noise_envelope(df: DataFrame, keys: Sequence[str], axes: Sequence[str], fs: float, cfg: Config, out: str = "noise") -> DataFrame:
    """Largest axis of the rolling RMS in the noise band."""
    band, span = noise_band(fs, cfg), range(len(axes))
    step = Pass(
        axes, [out], lambda fs: [(band, list(span), "both")], finish=lambda given, x, y, fs: [envelope(np.stack(y, axis=1), fs, cfg)],
        after_rows=4, after_s=cfg.noise_window_ms / 2000,
    )
    return run_pass(df, keys, step, fs)


def ramp_smoothed(df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float, fs: float, seconds: float, out: str) -> DataFrame:
    """A linear ramp of a value, then its rolling mean."""
    rows = df.withColumn("__r", Qn.ramp(F.col(value), lo, hi))
    return uniform_filter(rows, keys, ["__r"], window_rows(seconds, fs), [out]).drop("__r")


def adaptive_clean(df: DataFrame, keys: Sequence[str], cfg: Config = Config(), axes: Sequence[str] = AXES, plain_cutoff: float | None = None, step_time: str | None = None) -> DataFrame:
    """Rates in rad/s of a numbered series with its rate ``fs`` to cleaned rates and their diagnosis.

    Adds per axis ``c*`` (cleaned, rad/s), ``light_*`` and ``strong_*`` (deg/s), then noise (deg/s),
    alpha and spike_frac.  ``plain_cutoff`` filters all readings alike instead, with alpha 0.
    ``step_time``: times between readings, from which a series of one shard without ``fs`` gets it.
    A series whose rate is unknown or too low for the band keeps its rows, the added columns null.
    Spikes, filters and averages are one pass over the series.
    """
    keys, n = list(keys), len(axes)
    short = [a[-1] for a in axes]
    light, strong, clean = ([f"{p}{s}" for s in short] for p in ("light_", "strong_", "c"))
    plain = plain_cutoff is not None

    def rate(x: list[np.ndarray]) -> float:
        middle = float(np.median(x[n]))
        return 1.0 / middle if middle > 0 else float("nan")

    def prepare(x: list[np.ndarray], fs: float) -> list[np.ndarray]:
        parts = [rolling.hampel(np.degrees(c), cfg.hampel_window, cfg.hampel_sigma) for c in x[:n]]
        return [p[0] for p in parts] + [p[1].astype(float) for p in parts]

    def jobs(fs: float) -> list | None:
        cut = lambda hz: low_pass(2, hz / (fs / 2))
        every = list(range(n))
        if plain:
            return [(cut(plain_cutoff), every, "both")] if math.isfinite(fs) and fs > 2 * plain_cutoff else None
        if not cleanable(fs, cfg):
            return None
        return [(noise_band(fs, cfg), every, "both"), (cut(cfg.light_cutoff), every, "both"), (cut(cfg.strong_cutoff), every, "both")]

    def finish(given: list[np.ndarray], x: list[np.ndarray], y: list[np.ndarray], fs: float) -> list[np.ndarray]:
        if plain:
            lo = hi = np.stack(y, axis=1)
            noise = alpha = np.zeros(len(lo))
        else:
            bands, lo, hi = (np.stack(y[k * n : (k + 1) * n], axis=1) for k in range(3))
            noise = envelope(bands, fs, cfg)
            alpha = rolling.mean(rolling.ramp(noise, cfg.noise_low, cfg.noise_high), window_rows(ALPHA_S, fs))
        made = np.radians(lo * (1 - alpha[:, None]) + hi * alpha[:, None])
        return [*made.T, *lo.T, *hi.T, noise, alpha]

    inputs = [*axes, *([step_time] if step_time else [])]
    step = Pass(
        inputs, [*clean, *light, *strong, "noise", "alpha", "spike_frac"], jobs, prepare, finish, lambda x: np.mean(x[n:], axis=0).sum(),
        rate=rate if step_time else None, around=2 * cfg.hampel_window, after_rows=8, after_s=(cfg.noise_window_ms / 1000 + ALPHA_S) / 2,
    )
    return run_pass(df, keys, step)


def optical_alpha(diag: DataFrame, keys: Sequence[str], cfg: Config, out: str = "alpha_opt") -> DataFrame:
    """The ramp of the patch where it has a noise range of its own."""
    finish = lambda given, x, y, fs: [rolling.mean(rolling.ramp(x[0], *cfg.optical_noise), window_rows(ALPHA_S, fs))]
    return run_pass(diag, keys, Pass(["noise"], [out], lambda fs: [], finish=finish, after_rows=4, after_s=ALPHA_S / 2))


def severe_intervals(diag: DataFrame, keys: Sequence[str], time: str, cfg: Config = Config()) -> DataFrame:
    return find_intervals(diag, keys, time, F.col("noise") > cfg.severe, cfg.severe_pad, cfg.severe_merge, 0.2)


def noisy_intervals(diag: DataFrame, keys: Sequence[str], time: str, cfg: Config = Config(), alpha: str = "alpha") -> DataFrame:
    return find_intervals(diag, keys, time, F.col(alpha) > 0.15, cfg.patch_pad, cfg.patch_merge, 0.2)


def quiet_intervals(diag: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Where calibration may look: long and clean, drawn in a little."""
    return find_intervals(diag, keys, time, F.col("alpha") < 0.02, -0.2, 0.0, 3.0)


def noise_classes(diag: DataFrame, keys: Sequence[str], time: str, noisy: DataFrame, severe: float = 4.5, out: str = "label") -> DataFrame:
    """Add each reading's class: 'clean' outside the noisy intervals, in them 'severe' above that noise, else 'mild'."""
    keys = list(keys)
    hit = in_any(diag.select(*keys, "pos", time), noisy, keys, time).select(*keys, "pos", F.lit(True).alias("__hit"))
    rows = diag.join(hit, [*keys, "pos"], "left")
    return rows.withColumn(out, F.when(F.col("__hit").isNull(), "clean").when(F.col("noise") > severe, "severe").otherwise("mild")).drop("__hit")
