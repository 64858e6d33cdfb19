"""Quality metrics of rendered motion: banded RMS by mask, residuals, differences, event ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.functions import quat as Qn
from gyrolith.functions.design import Filter, band_pass, low_pass
from gyrolith.operators import aggregates as A
from gyrolith.operators import windows as W
from gyrolith.operators.filters import apply_filters
from gyrolith.operators.intervals import interp_asof
from gyrolith.session import durable

# fixed values: bands in hertz
PAN, WOBBLE, SHAKE = (0.05, 1.0), (2.0, 8.0), (8.0, 30.0)


def band(lo: float, hi: float, fs: float) -> Filter:
    """Second-order band, its upper edge kept below 0.45 of the rate; a low-pass from 0."""
    hi = min(hi, 0.45 * fs)
    return low_pass(2, hi / (fs / 2)) if lo <= 0 else band_pass(2, lo / (fs / 2), hi / (fs / 2))


def greedy_peaks(df: DataFrame, keys: Sequence[str], time: str, value: str, apart: float, most: int) -> DataFrame:
    """The strongest rows by |value|, each further than ``apart`` from every stronger one kept.

    One round a rank: an aggregate per series over what the peaks so far leave, so ``most`` bounds
    the rounds and only peaks are kept.  The readings are written once and every round reads those.
    Ties go to the earlier time.
    """
    keys = list(keys)
    rows = durable(df.select(*keys, F.col(time).alias("t"), F.col(value).alias("v")).dropna())
    best = F.max_by(F.struct("t", "v"), F.struct(F.abs("v"), -F.col("t"))).alias("p")
    peaks = durable(rows.groupBy(*keys).agg(best).select(*keys, F.array("p").alias("ps")))
    for _ in range(most - 1):
        left = rows.join(peaks, keys).where(F.forall("ps", lambda p: F.abs(F.col("t") - p["t"]) > apart))
        more = left.groupBy(*keys).agg(best)
        new = durable(peaks.join(more, keys, "left").select(*keys, F.when(F.col("p").isNull(), F.col("ps")).otherwise(F.concat("ps", F.array("p"))).alias("ps")))
        peaks = new
    out = peaks.select(*keys, F.posexplode("ps").alias("r", "p"))
    return out.select(*keys, (F.col("r") + 1).alias("rank"), F.col("p.t").alias(time), F.col("p.v").alias(value))


def render_metrics(track: DataFrame, keys: Sequence[str], fs: float, labels: DataFrame | None = None) -> DataFrame:
    """Pan (deg), wobble and shake (deg/s) and zoom (%) RMS per series, or per series and label.

    track: numbered, wx, wy, wroll in deg/s and dlogs; labels: (keys..., pos, label), a row for each
    label a reading has.  Masks under two seconds give null.
    """
    keys = list(keys)
    axes = ["wx", "wy", "wroll"]
    rows = track
    rows = W.angle_integral(rows, keys, [*axes, "dlogs"], fs, [f"int_{a}" for a in [*axes, "dlogs"]])
    both = [*axes, "dlogs"]
    jobs = [
        ([f"int_{a}" for a in both], band(*PAN, fs), [f"pan_{a}" for a in both]),
        (axes, band(*WOBBLE, fs), [f"wob_{a}" for a in axes]),
        (axes, band(*SHAKE, fs), [f"shk_{a}" for a in axes]),
    ]
    rows = apply_filters(rows, keys, jobs)
    by = keys
    if labels is not None:
        rows, by = rows.join(labels, [*keys, "pos"]), [*keys, "label"]
    each = {n: A.rms([F.col(f"{p}_{a}") for a in axes]) for n, p in (("pan", "pan"), ("wobble", "wob"), ("shake", "shk"))}
    each["zoom"] = A.rms([F.col("pan_dlogs")]) * 100
    enough = F.count(F.lit(1)) >= int(2 * fs)
    return rows.groupBy(*by).agg(*[F.when(enough, c).alias(n) for n, c in each.items()])


def residual_rates(track: DataFrame, path: DataFrame, keys: Sequence[str], fs: float) -> DataFrame:
    """Rates left over after the intended camera path: track minus the path's rates, mapped by the
    least-squares 3x3 of readings of quality above 0.4.  Adds res_x, res_y, res_z."""
    keys = list(keys)
    step = W.rates(path.withColumn("__t", F.col("pos") / F.lit(fs)), keys, "__t", ["w", "x", "y", "z"], ["tm", "px", "py", "pz"])
    step = step.select(*keys, "pos", *[F.degrees(c).alias(c) for c in ("px", "py", "pz")])
    both = track.join(step, [*keys, "pos"])
    fit = A.least_squares(both.where(F.col("quality") > 0.4), keys, ["px", "py", "pz"], ["wx", "wy", "wroll"])
    both = both.join(fit, keys)
    made = Qn.times_matrix((F.col("px"), F.col("py"), F.col("pz")), F.col("m"))
    return both.withColumns({f"res_{a}": F.col(w) - m for a, w, m in zip("xyz", ("wx", "wy", "wroll"), made)}).drop("px", "py", "pz", "m")


def best_shift(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, span: float, steps: int, shard: float = 16.0) -> DataFrame:
    """Sub-frame shift of b that brings it closest to a: least median absolute difference.

    Candidates travel with the rows; ties go to the smallest shift.
    """
    keys = list(keys)
    grid = F.array(*[F.lit(-span + 2 * span * k / (steps - 1)) for k in range(steps)])
    q = a.select(*keys, F.col("t").alias("__t"), F.col(value).alias("__v"), F.explode(grid).alias("shift")).withColumn("t", F.col("__t") + F.col("shift"))
    at = interp_asof(q.select(*keys, "t", "__v", "shift"), b.select(*keys, "t", value), keys, "t", [value], shard)
    gap = at.select(*keys, "shift", F.abs(F.col(value) - F.col("__v")).alias("__g")).where(F.col("__g").isNotNull() & ~F.isnan("__g"))
    score = A.exact_medians(durable(gap), [*keys, "shift"], "__g").select(*keys, "shift", (-F.col("median")).alias("score"))
    return A.best_of(score, keys, "score", "shift", []).withColumn("score", -F.col("score"))


def continuity(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per series the largest reading, the largest jump and the number of NaN, over all columns."""
    rows = W.difference(df, keys, values, [f"__d_{v}" for v in values])
    clean = lambda c: F.when(~F.isnan(c), F.abs(c))
    most = lambda names: F.greatest(*[F.max(clean(c)) for c in names]) if len(names) > 1 else F.max(clean(names[0]))
    nans = sum((A.nan_count(F.col(v)) for v in values), F.lit(0))
    return rows.groupBy(*keys).agg(most(values).alias("largest"), most([f"__d_{v}" for v in values]).alias("jump"), nans.alias("n_nan"))


def band_ratio(df: DataFrame, keys: Sequence[str], raw: Sequence[str], out: Sequence[str], fs: float, bands: Sequence[tuple[float, float]]) -> DataFrame:
    """RMS per band of two sets of axes, and the correlation of their slow part (below 3 Hz)."""
    keys = list(keys)
    name = lambda s, b, k: f"__{s}{b}_{k}"
    axes = range(len(raw))
    jobs = [([*raw, *out], band(lo, hi, fs), [*[name("r", b, k) for k in axes], *[name("o", b, k) for k in axes]]) for b, (lo, hi) in enumerate(bands)]
    rows = apply_filters(df, keys, jobs)
    each = []
    for b, (lo, hi) in enumerate(bands):
        r, o = ([name(s, b, k) for k in axes] for s in "ro")
        told = (A.rms([F.col(c) for c in r]).alias("rms_raw"), A.rms([F.col(c) for c in o]).alias("rms_out"), A.mean_correlation(list(zip(r, o))).alias("corr"))
        each.append(F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), *told))
    return rows.groupBy(*keys).agg(F.array(*each).alias("b")).select(*keys, F.explode("b").alias("b")).select(*keys, "b.*")


def event_ratios(df: DataFrame, keys: Sequence[str], time: str, raw: str, out: str, fs: float, apart: float = 2.0, most: int = 12, cut: float = 3.0) -> DataFrame:
    """(keys..., rank, time, ratio): of the strongest slow events of ``raw``, how much of each is left in ``out``."""
    keys = list(keys)
    rows = durable(apply_filters(df.select(*keys, "pos", "n", time, raw, out), keys, [([raw, out], band(0, cut, fs), ["__r", "__o"])]))
    peaks = greedy_peaks(rows, keys, time, "__r", apart, most).select(*keys, "rank", time)
    return peaks.join(rows, [*keys, time]).select(*keys, "rank", time, F.try_divide("__o", "__r").alias("ratio"))


def zone_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], axes: Sequence[str], fs: float, bands: Sequence[tuple[float, float]], label: str = "label") -> DataFrame:
    """(keys..., lo, hi, label, rms): banded RMS of a minus b by a's label, rows matched by position up to the shorter one's end."""
    keys = list(keys)
    other = b.select(*keys, "pos", *[F.col(c).alias(f"__b_{c}") for c in axes])
    short = b.groupBy(*keys).agg((F.max("pos") + 1).alias("__n"))
    both = a.join(other, [*keys, "pos"]).join(short, keys).withColumn("n", F.least("n", "__n"))
    both = both.select(*keys, "pos", "n", label, *[(F.col(c) - F.col(f"__b_{c}")).alias(f"__d_{c}") for c in axes])
    jobs = [([f"__d_{c}" for c in axes], band(lo, hi, fs), [f"__f{k}_{c}" for c in axes]) for k, (lo, hi) in enumerate(bands)]
    rows = apply_filters(both, keys, jobs)
    each = F.array(*[F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), A.rms([F.col(f"__f{k}_{c}") for c in axes]).alias("rms")) for k, (lo, hi) in enumerate(bands)])
    return rows.groupBy(*keys, label).agg(each.alias("b")).select(*keys, label, F.inline("b"))


def render_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], axes: Sequence[str], fs: float, span: float, bands: Sequence[tuple[float, float]], steps: int = 31, label: str = "label", shard: float = 16.0) -> DataFrame:
    """``zone_difference`` of two tracks after the sub-frame shift that brings b closest to a (by the first axis).

    a, b: numbered, with ``t``; a with its label.  Adds the shift.
    """
    keys = list(keys)
    shift = durable(best_shift(a.select(*keys, "t", axes[0]), b.select(*keys, "t", axes[0]), keys, axes[0], span, steps, shard)).select(*keys, "shift")
    at = a.join(shift, keys).select(*keys, "pos", (F.col("t") + F.col("shift")).alias("t"))
    moved = interp_asof(at, b.select(*keys, "t", *axes), keys, "t", list(axes), shard)
    return zone_difference(a, moved, keys, axes, fs, bands, label).join(shift, keys)


def rate_cache(orientation: DataFrame, keys: Sequence[str], time: str = "t", track: DataFrame | None = None) -> DataFrame:
    """Rates in deg/s of orientation series at their mid times, with the median quality of a series' track if one is given."""
    keys = list(keys)
    rates = W.rates(orientation, keys, time, ["w", "x", "y", "z"])
    out = rates.select(*keys, "pos", "n", "tm", *[F.degrees(c).alias(c) for c in ("wx", "wy", "wz")])
    if track is None:
        return out
    quality = durable(track.select(*keys, "quality").where(F.col("quality").isNotNull() & ~F.isnan("quality")))
    return out.join(A.exact_medians(quality, keys, "quality").select(*keys, F.col("median").alias("quality")), keys, "left")
