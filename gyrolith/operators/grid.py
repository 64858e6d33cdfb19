"""Irregular readings onto a regular grid, each time shard filled on its own.

A reading's period is its time div the period's length.  Readings are first reduced to one row per
(entity, period).  Shards of ``shard_bins`` periods tell their last reading; a prefix scan over
those summaries gives each shard the reading it continues from, and every shard is then filled
independently.  A gap is emitted in pieces of bounded length, so one huge gap is no large array.

Nulls: rows with a null entity or time aren't readings.  A null value is a reading without value:
its period counts as read, the value carried on is the last non-null one.  Repeated rows count once
in the grid and in ``n_readings`` as often as they are given.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrolith.operators.shards import place, with_carry

SHARD_BINS = 4096
GAP_PIECE = 8192


def regular_grid(
    df: DataFrame, entity: Sequence[str], time: Column, period: int, value: Column | None = None, shard_bins: int = SHARD_BINS, record: Sequence[str] = ()
) -> DataFrame:
    """One row per entity and period between its first and last reading.

    Columns: entity..., bin_no, n_readings (0 in a missing period), value (the period's last
    reading's; in a missing one the last before it, null if none), is_filled.
    ``time``: bigint ticks, ``period``: ticks.  ``value``: a double column or none.  ``record``: columns that tell
    one record of an entity; its copies then count once.
    """
    ent = list(entity)
    names = [f"__r{k}" for k in range(len(record))]
    rows = df.select(*ent, time.alias("__t"), (F.lit(None).cast("double") if value is None else value.cast("double")).alias("__v"), *[F.col(r).alias(n) for r, n in zip(record, names)])
    rows = rows.dropna(subset=[*ent, "__t"]).withColumn("bin_no", _bin(F.col("__t"), period)).withColumn("__sh", _shard(shard_bins))
    last = F.max(F.when(F.col("__v").isNotNull(), F.struct("__t", "__v")))
    bins = lambda df: df.groupBy(*ent, "__sh", "bin_no").agg(F.count(F.lit(1)).alias("n_readings"), last.getField("__v").alias("value"))
    if record:
        # copies lie in one shard, so one shuffle of the readings serves them, the bins and the carries
        base = place(rows, ent, "__sh")
        of = bins(base.dropDuplicates([*ent, "__sh", "bin_no", *names]))
        held = last.getField("__v")
    else:
        of = base = place(bins(rows), ent, "__sh")  # combined to bins before they move
        held = F.max_by("value", F.when(F.col("value").isNotNull(), F.col("bin_no")))
    aggs = {"__last": F.max("bin_no"), "__val": held}
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    carried = with_carry(of, ent, "__sh", aggs, {"__cbin": lambda w: F.lag("__last").over(w), "__cval": lambda w: F.last("__val", True).over(before(w))}, base)
    local = Window.partitionBy(*ent, "__sh").orderBy("bin_no")
    carried = carried.select(
        *ent,
        "bin_no",
        "n_readings",
        F.coalesce("value", F.last("value", True).over(before(local)), "__cval").alias("value"),
        F.coalesce(F.lag("bin_no").over(local), "__cbin").alias("__prev"),
        F.coalesce(F.last("value", True).over(before(local)), "__cval").alias("__held"),
    )
    # each row stands for itself and for the missing periods before it, those in pieces
    heads = F.when(F.col("bin_no") - F.col("__prev") > 1, _pieces())
    itself = F.array(F.struct(F.col("bin_no").alias("lo"), F.col("bin_no").alias("hi"), F.lit(False).alias("is_filled")))
    parts = carried.select(*ent, "n_readings", "value", "__held", F.explode(F.concat(F.coalesce(heads, F.array().cast("array<struct<lo:bigint,hi:bigint,is_filled:boolean>>")), itself)).alias("x"))
    filled = F.col("x.is_filled")
    parts = parts.select(
        *ent,
        F.when(filled, 0).otherwise(F.col("n_readings")).cast("long").alias("n_readings"),
        F.when(filled, F.col("__held")).otherwise(F.col("value")).alias("value"),
        filled.alias("is_filled"),
        F.explode(F.sequence("x.lo", "x.hi")).alias("bin_no"),
    )
    return parts.select(*ent, "bin_no", "n_readings", "value", "is_filled")


def missing_periods(df: DataFrame, entity: Sequence[str], time: Column, period: int, shard_bins: int = SHARD_BINS) -> DataFrame:
    """The periods of the grid that no reading has: entity..., bin_no."""
    ent = list(entity)
    bins = df.select(*ent, time.alias("__t")).dropna().select(*ent, _bin(F.col("__t"), period).alias("bin_no"))
    bins = bins.withColumn("__sh", _shard(shard_bins)).distinct()
    bins = place(bins, ent, "__sh")
    carried = with_carry(bins, ent, "__sh", {"__last": F.max("bin_no")}, {"__cbin": lambda w: F.lag("__last").over(w)}, base=bins)
    prev = F.coalesce(F.lag("bin_no").over(Window.partitionBy(*ent, "__sh").orderBy("bin_no")), "__cbin")
    gaps = carried.select(*ent, "bin_no", prev.alias("__prev")).where(F.col("bin_no") - F.col("__prev") > 1)
    heads = gaps.select(*ent, F.inline(_pieces()))
    return heads.select(*ent, F.explode(F.sequence("lo", "hi")).alias("bin_no"))


def _bin(t: Column, period: int) -> Column:
    """Integer floor: a double quotient is exact enough only below 2^53, so it is put right here."""
    b = F.floor(t / F.lit(period)).cast("long")
    return b + F.when(b * period > t, -1).when((b + 1) * period <= t, 1).otherwise(0)


def _shard(shard_bins: int) -> Column:
    return F.floor(F.col("bin_no") / F.lit(shard_bins)).cast("long")


def _pieces() -> Column:
    """The missing periods between __prev and bin_no, in ranges of bounded length."""
    lo, hi = F.col("__prev") + 1, F.col("bin_no") - 1
    return F.transform(F.sequence(lo, hi, F.lit(GAP_PIECE).cast("long")), lambda a: F.struct(a.alias("lo"), F.least(a + (GAP_PIECE - 1), hi).alias("hi"), F.lit(True).alias("is_filled")))
