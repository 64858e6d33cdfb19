"""Streams: a causal low-pass with state per series, and bursts as sessions under a watermark.

Zero-phase filters look ahead and have no streaming form; these are what a stream can do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gyrolith.functions.design import Filter, steady
from gyrolith.operators.filters import lfilter
from gyrolith.session import ship


def stream_low_pass(df: DataFrame, keys: Sequence[str], order: str, value: str, f: Filter, out: str) -> DataFrame:
    """Filter each series as it arrives; the state starts settled at its first reading.

    Within a micro-batch readings are taken in ``order``; those of later batches follow.  Null
    readings pass through as null and leave the state alone.
    """
    ship(df.sparkSession)
    keys = list(keys)
    types = dict(df.dtypes)
    names = [*keys, order, value]
    schema = ", ".join(f"`{n}` {types[n]}" for n in names) + f", `{out}` double"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        z = np.array(state.get[0]) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")[names]
        x = rows[value].to_numpy(float)
        known = ~np.isnan(x)
        y = np.full(len(x), np.nan)
        if known.any():
            if z is None:
                z = steady(f) * x[known][0]
            y[known], z = lfilter(f, x[known], z)
            state.update((z.tolist(),))
        yield rows.assign(**{out: y})

    grouped = df.select(*names).groupBy(*keys)
    return grouped.applyInPandasWithState(run, schema, "z array<double>", "append", GroupStateTimeout.NoTimeout)


def stream_bursts(df: DataFrame, keys: Sequence[str], time: str, value: str, above: float, gap: str, late: str) -> DataFrame:
    """Sessions of readings above a threshold, closed once the watermark passes their gap.

    Only readings above the threshold move the watermark, so the last session of a stream stays
    open until a later loud reading.  The native session gap joins readings nearer than ``gap``; unlike ``find_intervals`` it neither
    pads nor drops short ones.
    """
    loud = df.withWatermark(time, late).where(F.col(value) > above)
    session = F.session_window(time, gap)
    return loud.groupBy(*keys, session.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("peak")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "peak")


def stream_grid_counts(df: DataFrame, keys: Sequence[str], time: str, period: str, late: str) -> DataFrame:
    """Readings per period of a regular grid, final once the watermark passes the period."""
    w = F.window(time, period)
    return df.withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), "n")
