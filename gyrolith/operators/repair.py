"""Alignment of a measured rate stream to the sensor's, the patch of noisy bursts by it, the splice.

Work per burst or alignment is numpy inside a grouped chunk.  A burst is a stretch of one clip
(seconds), which bounds it; an alignment takes the good calibration readings of a series and the
cleaned rows beside them (``beside``), not the series.  Everything around it is joins, windows and
passes over numbered series.  ``fs``, the rate of a series, is a column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.config import Config
from gyrolith.functions import quat as Qn
from gyrolith.functions import rolling
from gyrolith.functions.design import low_pass
from gyrolith.operators.aggregates import local_rate
from gyrolith.operators.detect import ALPHA_S, window_rows
from gyrolith.operators.filters import Pass, filtfilt, run_pass
from gyrolith.operators.intervals import next_time, within
from gyrolith.operators.ordered import blocked, number, own
from gyrolith.operators.shards import floats, map_group_chunks
from gyrolith.session import durable

FIT_LEAST, FIT_QUALITY, FIT_R2 = 200, 0.5, 0.8
SCAN_S, SCAN_STEP, ROUNDS = 0.06, 0.002, 3


def _columns(f, x: np.ndarray) -> np.ndarray:
    return np.stack([filtfilt(f, x[:, k]) for k in range(x.shape[1])], axis=1)


def _at(tq: np.ndarray, t: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.stack([np.interp(tq, t, x[:, k]) for k in range(x.shape[1])], axis=1)


def fit_alignment(tv: np.ndarray, optical_deg: np.ndarray, tm: np.ndarray, gyro_deg: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Time shift, orthogonal map and R2 that carry the optical rates onto the sensor's.

    Three rounds of: map by Procrustes at the present shift, then the shift of best mean
    correlation on a grid about it.  The optical readings are filtered as one contiguous series;
    the sensor's are smoothed already (``smoothed``).
    """
    f = low_pass(2, 5.0 / 50.0)
    seen = lambda shift: _columns(f, _at(tv + shift, tm, gyro_deg))
    mine = _columns(f, optical_deg)
    shift, n = 0.0, np.zeros((3, 3))
    for _ in range(ROUNDS):
        u, _, vt = np.linalg.svd(mine.T @ seen(shift))
        n = u @ vt
        made = mine @ n
        centred = made - made.mean(axis=0)
        best = (-np.inf, shift)
        for k in range(round(2 * SCAN_S / SCAN_STEP) + 1):
            at = shift - SCAN_S + SCAN_STEP * k
            g = seen(at)
            g = g - g.mean(axis=0)
            with np.errstate(invalid="ignore", divide="ignore"):
                r = ((g * centred).sum(axis=0) / (np.sqrt((g * g).sum(axis=0)) * np.sqrt((centred * centred).sum(axis=0)))).mean()
            if r > best[0]:  # never for NaN
                best = (r, at)
        shift = best[1]
    g, made = seen(shift), mine @ n
    total = ((g - g.mean(axis=0)) ** 2).sum()
    return shift, n, float(1 - ((g - made) ** 2).sum() / total) if total > 0 else float("nan")


def _side_by_side(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both tables' rows under one schema with ``__side`` 0 and 1, for one shuffle."""
    return left.withColumn("__side", F.lit(0)).unionByName(right.withColumn("__side", F.lit(1)), allowMissingColumns=True)


def smoothed(gyro: DataFrame, keys: Sequence[str], rate: Sequence[str], outs: Sequence[str]) -> DataFrame:
    """Rates averaged over a hundredth of a second (at least one reading)."""
    size = lambda fs: max(1, int(fs / 100)) if np.isfinite(fs) else 1
    step = Pass(rate, outs, lambda fs: [], finish=lambda given, x, y, fs: [rolling.mean(c, size(fs)) for c in x], after_rows=2, after_s=0.005)
    return run_pass(gyro, keys, step)


def beside(gyro: DataFrame, optical: DataFrame, keys: Sequence[str], time: str, optical_time: str, span: float) -> DataFrame:
    """Rows of a numbered series that interpolation within ``span`` of the optical times can ask for.

    A row is kept if some optical time lies between the rows on both its sides, ``span`` added.
    """
    rows, w = blocked(gyro, keys, 1)
    rows = own(rows.withColumns({"__a": F.lag(time).over(w) - span, "__z": F.lead(time).over(w) + span}))
    far = F.lit(float("inf"))
    rows = rows.withColumns({"__a": F.coalesce("__a", F.col(time) - span), "__z": F.coalesce("__z", far)})
    # the first and last row stand for all times beyond them
    rows = rows.withColumn("__a", F.when(F.col("pos") == 0, -far).otherwise(F.col("__a")))
    rows = next_time(rows, optical.select(*keys, F.col(optical_time).alias("__t")), keys, "__a", "__t", "__next", 16.0)
    return rows.where(F.col("__next") <= F.col("__z")).drop("__a", "__z", "__next")


def video_alignment(optical: DataFrame, gyro: DataFrame, keys: Sequence[str], time: str = "t", rate: Sequence[str] = ("ox", "oy", "oz"), gyro_time: str = "tm", gyro_rate: Sequence[str] = ("cx", "cy", "cz")) -> DataFrame:
    """(keys..., shift, n, r2, status) per series; both rates in rad/s, gyro numbered and with ``fs``.

    status: 'ok', 'few' (under 200 good readings; the rest null) or 'poor' (R2 below 0.8 or none).
    """
    keys = list(keys)
    left = optical.where(F.col("quality") > FIT_QUALITY).select(*keys, F.col(time).alias("t"), *[F.col(r).alias(f"v{k}") for k, r in enumerate(rate)]).dropna()
    outs = [f"__v{k}" for k in range(3)]
    right = gyro.select(*keys, "pos", "n", "fs", F.col(gyro_time).alias("t"), *gyro_rate).dropna()
    right = beside(smoothed(right, keys, gyro_rate, outs), left, keys, "t", "t", ROUNDS * SCAN_S + 0.01)
    right = right.select(*keys, "t", *[F.col(o).alias(f"v{k}") for k, o in enumerate(outs)])
    rows = _side_by_side(left, right, keys)
    types = dict(rows.dtypes)

    def run(tab: pa.Table, group: np.ndarray) -> pa.Table:
        t, side = floats(tab, "t"), tab.column("__side").to_numpy()
        v = np.degrees(np.stack([floats(tab, f"v{k}") for k in range(3)], axis=1))
        heads, res = [], []
        order = np.lexsort((t, side, group))
        for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            o, g = at[side[at] == 0], at[side[at] == 1]
            heads.append(at[0])
            if len(o) < FIT_LEAST or len(g) < 2:
                res.append((None, None, None, "few"))
                continue
            shift, n, r2 = fit_alignment(t[o], v[o], t[g], v[g])
            res.append((shift, n.tolist(), r2, "ok" if r2 >= FIT_R2 else "poor"))
        out = tab.select(keys).take(pa.array(heads))
        kinds = (pa.float64(), pa.list_(pa.list_(pa.float64())), pa.float64(), pa.string())
        for k, name in enumerate(("shift", "n", "r2", "status")):
            out = out.append_column(name, pa.array([r[k] for r in res], kinds[k]))
        return out

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", shift double, n array<array<double>>, r2 double, status string"
    return map_group_chunks(rows, keys, run, schema)


def _measured_motion(cfg: Config) -> Pass:
    """Of the light rates: the hand-back band (``__m*``), its rate of turn (``__rate``) and the ramp of the patch (``__alpha``)."""

    def jobs(fs: float) -> list | None:
        cut = cfg.handback_cutoff or cfg.optical_cutoff
        if not np.isfinite(fs) or fs <= 2 * max(cut, cfg.fast_wide_cutoff):
            return None
        out = [(low_pass(2, cut / (fs / 2)), [0, 1, 2], "both")]
        return out + ([(low_pass(2, cfg.fast_wide_cutoff / (fs / 2)), [0, 1, 2], "both")] if cfg.fast_wide_cutoff else [])

    def finish(given: list[np.ndarray], x: list[np.ndarray], y: list[np.ndarray], fs: float) -> list[np.ndarray]:
        medium = np.stack(y[:3], axis=1)
        rate = rolling.mean(np.linalg.norm(medium, axis=1), window_rows(0.1, fs))
        if cfg.fast_wide_cutoff:
            weight = rolling.ramp(rate, *cfg.fast_wide_ramp)
            if cfg.fast_wide_accel:
                weight = weight * np.clip(1 - rolling.mean(np.abs(rolling.gradient(rate) * fs), window_rows(0.1, fs)) / cfg.fast_wide_accel, 0, 1)
            weight = rolling.mean(weight, window_rows(0.15, fs))[:, None]
            medium = medium * (1 - weight) + np.stack(y[3:], axis=1) * weight
        alpha = given[4]
        if cfg.optical_noise:
            alpha = rolling.mean(rolling.ramp(given[3], *cfg.optical_noise), window_rows(ALPHA_S, fs))
        return [*medium.T, rate, alpha]

    return Pass(["light_x", "light_y", "light_z", "noise", "alpha"], ["__mx", "__my", "__mz", "__rate", "__alpha"], jobs, finish=finish, after_rows=16, after_s=0.3)


def optical_patch(diag: DataFrame, optical: DataFrame, align: DataFrame, noisy: DataFrame, keys: Sequence[str], cfg: Config = Config(), time: str = "tm", fps: float | None = None) -> DataFrame:
    """Cleaned rates with the noisy bursts replaced by measured motion: adds rx, ry, rz (rad/s).

    diag: a cleaned numbered series (``adaptive_clean``); optical: t, ox, oy, oz, quality of the
    noisy sections; align: shift, n; noisy: a, b.  Rows outside bursts keep their cleaned rates.
    ``fps``: rate of the optical stream, else of its first readings.
    """
    keys = list(keys)
    axes = ("x", "y", "z")
    medium = [f"__m{a}" for a in axes]
    rows = run_pass(diag, keys, _measured_motion(cfg))
    rows = durable(rows)
    turned = optical.join(align.where("status = 'ok'").select(*keys, "shift", "n"), keys)
    deg = Qn.times_matrix(tuple(F.degrees(c) for c in ("ox", "oy", "oz")), F.col("n"))
    turned = turned.select(*keys, (F.col("t") + F.col("shift")).alias("t"), *[c.alias(f"p{a}") for c, a in zip(deg, axes)], "quality").dropna(subset=[*keys, "t"])
    if fps is None:
        own = number(turned.withColumn("__t", F.col("t")), keys, ["t"], F.floor(F.col("t") / 16).cast("long"))
        turned = turned.join(local_rate(own, keys, "t"), keys)
    else:
        turned = turned.withColumn("fps", F.lit(float(fps)))
    bursts = noisy.select(*keys, "a", "b")
    inside = within(rows.select(*keys, "pos", F.col(time).alias("t"), *medium, "__rate", "noise", "fs", *[f"strong_{a}" for a in axes]), bursts, keys, "t", slot=60.0)
    seen = within(turned, bursts, keys, "t", widen=0.3, slot=60.0)
    both = _side_by_side(inside, seen, keys)
    part = [*keys, "a", "b"]
    types = dict(both.dtypes)

    def run(tab: pa.Table, group: np.ndarray) -> pa.Table | None:
        t, side = floats(tab, "t"), tab.column("__side").to_numpy()
        pick, made = [], []
        order = np.lexsort((t, side, group))
        get = lambda names, at: np.stack([floats(tab, c)[at] for c in names], axis=1)
        for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            g, o = at[side[at] == 0], at[side[at] == 1]
            quality = floats(tab, "quality")[o]
            if len(o) < 30 or not len(g) or (quality < 0.3).mean() > 0.3:
                continue
            fs = float(floats(tab, "fs")[g[0]])
            v = get([f"p{a}" for a in axes], o)
            bad = quality < 0.3
            if bad.any():
                v[bad] = _at(t[o][bad], t[o][~bad], v[~bad])
            rate = float(floats(tab, "fps")[o[0]])
            v = _columns(low_pass(2, min(cfg.optical_cutoff, 0.45 * rate) / (rate / 2)), v)
            video = _at(t[g], t[o], v)
            gyro_rate = floats(tab, "__rate")[g]
            video_rate = rolling.mean(np.linalg.norm(video, axis=1), window_rows(0.1, fs))
            lo_r, hi_r = cfg.fast_handback
            lo_n, hi_n = cfg.gyro_trust_noise
            trust = 1 - rolling.ramp(floats(tab, "noise")[g].max(), lo_n, hi_n)
            wf = trust * rolling.ramp(gyro_rate, lo_r, hi_r) + (1 - trust) * rolling.ramp(np.minimum(gyro_rate, video_rate), lo_r, hi_r)
            wf = rolling.mean(wf, window_rows(0.15, fs))[:, None]
            if cfg.anchor_mode:
                base = get([f"strong_{a}" for a in axes], g)
                corr = video - base
                f_anchor = low_pass(2, cfg.anchor_cutoff / (fs / 2))
                if len(g) > 3 * max(len(f_anchor.a), len(f_anchor.b)) * 10:
                    corr = np.stack([filtfilt(f_anchor, corr[:, k], min(len(g) - 1, int(2 * fs))) for k in range(3)], axis=1)
                out = base + (1 - wf) * corr
            else:
                out = (1 - wf) * video + wf * get(medium, g)
            pick.append(g)
            made.append(out)
        if not pick:
            return None
        rows_ = np.concatenate(pick)
        out = tab.select([*keys, "pos"]).take(pa.array(rows_))
        for k, a in enumerate(axes):
            out = out.append_column(f"__p{a}", pa.array(np.concatenate(made)[:, k]))
        return out

    schema = ", ".join(f"`{k}` {types[k]}" for k in (*keys, "pos")) + ", " + ", ".join(f"__p{a} double" for a in axes)
    patched = map_group_chunks(both, part, run, schema).dropDuplicates([*keys, "pos"])
    rows = rows.join(patched, [*keys, "pos"], "left")
    w = Qn.ramp(F.col("__alpha") / 0.35, 0.0, 1.0)
    partner = [F.degrees(f"c{a}") if cfg.optical_noise else F.col(f"light_{a}") for a in axes]
    final = {
        f"r{a}": F.when(F.col(f"__p{a}").isNull(), F.col(f"c{a}")).otherwise(F.radians((1 - w) * p + w * F.col(f"__p{a}"))) for a, p in zip(axes, partner)
    }
    rows = rows.withColumns(final)
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


def _qmul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w1, x1, y1, z1 = a.T
    w2, x2, y2, z2 = b.T
    return np.stack([w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2, w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2, w1 * y2 - x1 * z2 + y1 * w2 + z1 * x2, w1 * z2 + x1 * y2 - y1 * x2 + z1 * w2], axis=1)


def _qexp(v: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(v, axis=1)
    k = np.where(angle > 1e-12, np.sin(angle / 2) / np.maximum(angle, 1e-300), 0.5)
    q = np.concatenate([np.cos(angle / 2)[:, None], v * k[:, None]], axis=1)
    return q / np.linalg.norm(q, axis=1)[:, None]


def _qlog(q: np.ndarray) -> np.ndarray:
    q = np.where(q[:, :1] < 0, -q, q)
    n = np.linalg.norm(q[:, 1:], axis=1)
    k = np.where(n > 1e-12, 2 * np.arcsin(np.clip(n, 0, 1)) / np.maximum(n, 1e-300), 2.0)
    return q[:, 1:] * k[:, None]


def _slerp(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    d = (a * b).sum(axis=1)
    b = np.where(d[:, None] < 0, -b, b)
    angle = np.arccos(np.clip(np.abs(d), 0, 1))
    s = np.sin(angle)
    flat = s < 1e-6
    safe = np.where(flat, 1.0, s)
    wa = np.where(flat, 1 - w, np.sin((1 - w) * angle) / safe)
    wb = np.where(flat, w, np.sin(w * angle) / safe)
    q = a * wa[:, None] + b * wb[:, None]
    return q / np.linalg.norm(q, axis=1)[:, None]


def _smooth(x: np.ndarray) -> np.ndarray:
    c = np.clip(x, 0, 1)
    return c * c * (3 - 2 * c)


def prefix_rotations(start: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """start, start s1, start s1 s2, ...: the non-commutative prefix product by doubling.

    Rounds of pairwise products, log2(n) of them; agrees with the sequential product to rounding.
    """
    q = np.concatenate([start[None, :], steps])
    d = 1
    while d < len(q):
        q[d:] = _qmul(q[:-d].copy(), q[d:].copy())
        d *= 2
    return q


def splice_burst(t: np.ndarray, q: np.ndarray, omega: np.ndarray, ramp_s: float) -> tuple[np.ndarray, float]:
    """Orientations of one burst rebuilt from patched rates, and the drift closed (degrees)."""
    steps = _qexp(omega[:-1] * np.diff(t)[:, None])
    made = prefix_rotations(q[0], steps)
    made /= np.linalg.norm(made, axis=1)[:, None]
    drift = _qlog(_qmul(made[-1:] * np.array([1, -1, -1, -1]), q[-1:]))[0]
    s = _smooth((t - t[0]) / max(t[-1] - t[0], 1e-9))
    made = _qmul(made, _qexp(s[:, None] * drift))
    r = np.minimum(_smooth((t - t[0]) / ramp_s), _smooth((t[-1] - t) / ramp_s))
    return _slerp(q, made, r), float(np.degrees(np.linalg.norm(drift)))


def splice_orientation(telemetry: DataFrame, rates: DataFrame, severe: DataFrame, keys: Sequence[str], cfg: Config = Config(), time: str = "t", q: Sequence[str] = ("w", "x", "y", "z"), r: Sequence[str] = ("rx", "ry", "rz")) -> tuple[DataFrame, DataFrame]:
    """Orientation with the severe bursts rebuilt, and (keys..., a, b, drift_deg) of the bursts.

    telemetry: numbered orientation; rates: numbered rates, of which row pos turns orientation pos
    into pos + 1.  Rows outside bursts are the very same values.  Bursts of fewer than nine
    orientations are left alone.
    """
    keys = list(keys)
    rows = telemetry.select(*keys, "pos", F.col(time).alias("t"), *[F.col(c).alias(f"q{k}") for k, c in enumerate(q)])
    rows = rows.join(rates.select(*keys, "pos", *[F.col(c).alias(f"o{k}") for k, c in enumerate(r)]), [*keys, "pos"], "left")
    inside = within(rows, severe.select(*keys, "a", "b"), keys, "t", slot=60.0)
    part = [*keys, "a", "b"]
    types = dict(inside.dtypes)

    def run(tab: pa.Table, group: np.ndarray) -> pa.Table | None:
        t = floats(tab, "t")
        order = np.lexsort((tab.column("pos").to_numpy(), group))
        quat = np.stack([floats(tab, f"q{k}") for k in range(4)], axis=1)
        rate = np.stack([floats(tab, f"o{k}") for k in range(3)], axis=1)
        pick, made, drift = [], [], []
        for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if len(at) < 9:
                continue
            new, d = splice_burst(t[at], quat[at], rate[at], cfg.ramp)
            pick.append(at)
            made.append(new)
            drift.append(np.full(len(at), d))
        if not pick:
            return None
        out = tab.select([*part, "pos"]).take(pa.array(np.concatenate(pick)))
        new = np.concatenate(made)
        for k in range(4):
            out = out.append_column(f"n{k}", pa.array(new[:, k]))
        return out.append_column("drift_deg", pa.array(np.concatenate(drift)))

    schema = ", ".join(f"`{k}` {types[k]}" for k in (*part, "pos")) + ", n0 double, n1 double, n2 double, n3 double, drift_deg double"
    new = map_group_chunks(inside, part, run, schema)
    bursts = new.groupBy(*part).agg(F.first("drift_deg").alias("drift_deg"))
    # of overlapping bursts the later one wins, as if written in order
    best = new.groupBy(*keys, "pos").agg(F.max_by(F.struct("n0", "n1", "n2", "n3"), F.struct("a", "b")).alias("__n"))
    joined = telemetry.join(best, [*keys, "pos"], "left")
    out = joined.withColumns({c: F.when(F.col("__n").isNull(), F.col(c)).otherwise(F.col(f"__n.n{k}")) for k, c in enumerate(q)})
    return out.drop("__n"), bursts
