"""The repair chain from orientation stream and measured motion to a repaired orientation.

Every series gets a status row instead of failing the job: 'short', 'no rate' (all its times equal),
'slow' (its rate is too low for the noise band), 'healthy', 'few' or 'poor' (no usable alignment),
'unmeasured' (no motion measured in its bursts), 'repaired'.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.config import Config
from gyrolith.operators import filters
from gyrolith.operators import windows as W
from gyrolith.operators.aggregates import sample_rate
from gyrolith.operators.detect import adaptive_clean, noisy_intervals, optical_alpha, quiet_intervals, severe_intervals
from gyrolith.operators.intervals import calibration_intervals, in_any
from gyrolith.operators.repair import optical_patch, splice_orientation, video_alignment
from gyrolith.plans.container import extract
from gyrolith.session import durable

LEAST_SAMPLES = 100


def orientation_of(telemetry: DataFrame, keys: Sequence[str], time: str, order: str) -> DataFrame:
    """Usable records, once each, as an orientation series."""
    keys = list(keys)
    size = F.greatest(*[F.abs(F.col(c)) for c in "wxyz"])
    rows = telemetry.select(*keys, order, time, *"wxyz").dropna()
    rows = rows.where(~F.isnan(time) & ~F.isnan(F.col("w") + F.col("x") + F.col("y") + F.col("z")) & (size > 0))
    return extract(rows.withColumnRenamed(time, "__t"), keys, F.col("__t"), [order]).drop("__t")


def clean(series: DataFrame, keys: Sequence[str], cfg: Config = Config()) -> DataFrame:
    """Rates of a written orientation series, cleaned and diagnosed; adds each series' own rate ``fs``."""
    keys, long = list(keys), F.col("n") > 2 * filters.SHARD
    told = ["pos", "n", "tm", "dt", "wx", "wy", "wz"]
    rates = lambda rows: W.rates(rows.select(*keys, "pos", "n", "t", *"wxyz"), keys, "t", ["w", "x", "y", "z"], step="dt").select(*keys, *told)
    # a series of one shard tells its rate in the pass; longer ones need it before, to be cut
    far = series.where(long)
    rows = rates(series.where(~long)).withColumn("fs", F.lit(None).cast("double")).unionByName(rates(far).join(sample_rate(far, keys, "t"), keys, "left"))
    return adaptive_clean(rows, keys, cfg, step_time="dt").drop("dt")


@dataclass
class Repair:
    """The chain's tables; the patch and splice are made when ``orientation`` or ``bursts`` is first asked for."""

    series: DataFrame
    diag: DataFrame
    severe: DataFrame
    alignment: DataFrame
    status: DataFrame
    splice: Callable[[], tuple[DataFrame, DataFrame]]

    @cached_property
    def _spliced(self) -> tuple[DataFrame, DataFrame]:
        return self.splice()

    @property
    def orientation(self) -> DataFrame:
        return self._spliced[0]

    @property
    def bursts(self) -> DataFrame:
        return self._spliced[1]


def repair(telemetry: DataFrame, optical: DataFrame, keys: Sequence[str], cfg: Config = Config(), time: str = "t", order: str = "idx", pick: bool = False) -> Repair:
    """telemetry: time (s), order, w, x, y, z; optical: kind ('calib' | 'noisy'), t, ox, oy, oz, quality.

    ``pick`` keeps only calibration readings inside the calibration intervals found here (for a
    stream measured everywhere); otherwise the stream's own kinds decide.
    The severe gate comes first: healthy series are semi-joined away before any optical work.
    """
    keys = list(keys)
    series = durable(orientation_of(telemetry, keys, time, order))
    diag = durable(clean(series, keys, cfg))
    able = F.max(F.col("noise").isNotNull()).alias("able")
    sizes = series.groupBy(*keys).agg(F.max("n").alias("samples")).join(diag.groupBy(*keys).agg(F.max("fs").alias("fs"), able), keys, "left")
    diag = diag.where((F.col("n") >= LEAST_SAMPLES - 1) & F.col("noise").isNotNull())
    severe = durable(severe_intervals(diag, keys, "tm", cfg))
    ill = severe.select(*keys).distinct()
    work = diag.join(ill, keys, "left_semi")
    alpha = "alpha"
    if cfg.optical_noise:
        work, alpha = optical_alpha(work, keys, cfg), "alpha_opt"
    seen = optical.where(F.col("t").isNotNull() & F.col("quality").isNotNull()).join(ill, keys, "left_semi")
    calib = seen.where("kind = 'calib'")
    if pick:
        motion = work.withColumn("__m", F.sqrt(F.col("light_x") ** 2 + F.col("light_y") ** 2 + F.col("light_z") ** 2))
        calib = in_any(seen, calibration_intervals(quiet_intervals(work, keys, "tm"), motion, keys, "tm", "__m"), keys, "t")
    fit = durable(video_alignment(calib, work, keys))
    measured = seen.where("kind = 'noisy'")
    good = fit.where("status = 'ok'").join(measured.select(*keys).distinct(), keys, "left_semi")

    def splice() -> tuple[DataFrame, DataFrame]:
        sound = lambda df: df.join(good.select(*keys), keys, "left_semi")
        noisy = durable(noisy_intervals(sound(work), keys, "tm", cfg, alpha))
        patched = durable(optical_patch(sound(work), measured, fit, noisy, keys, cfg))
        return splice_orientation(series, patched, sound(severe), keys, cfg)

    status = sizes.join(ill.withColumn("__ill", F.lit(True)), keys, "left").join(fit.select(*keys, F.col("status").alias("__fit"), "r2"), keys, "left")
    status = status.join(good.select(*keys, F.lit(True).alias("__ok")), keys, "left")
    verdict = (
        F.when(F.col("samples") < LEAST_SAMPLES, "short")
        .when(F.col("fs").isNull(), "no rate")
        .when(~F.col("able"), "slow")
        .when(F.col("__ill").isNull(), "healthy")
        .when(F.col("__fit").isNull(), "few")
        .when(F.col("__fit") != "ok", F.col("__fit"))
        .when(F.col("__ok").isNull(), "unmeasured")
        .otherwise("repaired")
    )
    return Repair(series, diag, severe, fit, status.select(*keys, "samples", "fs", "r2", verdict.alias("status")), splice)


def dump_stages(done: Repair, folder: str) -> list[str]:
    """Every stage of a repair as a Parquet table under a folder; gives their names."""
    names = ("series", "diag", "severe", "alignment", "orientation", "bursts", "status")
    for name in names:
        getattr(done, name).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
    return list(names)
