"""Numbered series, neighbours across shards, and windows over blocks of positions.

A *numbered series* is a table with key columns, a dense position ``pos`` and the series' length
``n``.  Window operators work on blocks of positions with a halo as wide as the frame, so a series
of any length is spread over tasks and every frame is still exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from gyrolith.operators.shards import with_carry, with_halo
from gyrolith.session import durable

BLOCK = 4096


def number(df: DataFrame, keys: Sequence[str], order: Sequence[str], shard: Column, keep: bool = False) -> DataFrame:
    """Add pos (0, 1, ... in order) and n.  ``shard`` must be monotone in ``order``; rows whose keys
    or shard are null belong to no series and are left out.

    ``keep`` writes the numbered table once: what reads it several times, as operators with carries
    do, then starts from it instead of from the source.
    """
    keys = list(keys)
    rows = df.withColumn("__sh", shard).dropna(subset=[*keys, "__sh"]).repartition(*keys, "__sh")
    local = Window.partitionBy(*keys, "__sh").orderBy(*order)
    rows = rows.withColumn("pos", (F.row_number().over(local) - 1).cast("long"))
    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carries = {
        "__before": lambda w: F.coalesce(F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "n": lambda w: F.sum("__c").over(whole(w)),
    }
    rows = with_carry(rows, keys, "__sh", {"__c": F.count(F.lit(1))}, carries)
    rows = rows.withColumn("pos", F.col("pos") + F.col("__before")).drop("__before", "__sh")
    return durable(rows) if keep else rows


def blocked(df: DataFrame, keys: Sequence[str], halo: int) -> tuple[DataFrame, WindowSpec]:
    """Rows copied into blocks with a halo, and the window over a block in order of position.

    ``own`` then keeps the originals.
    """
    block = max(BLOCK, halo)
    rows = with_halo(df, "pos", block, halo, "__blk").withColumn("__own", F.floor(F.col("pos") / F.lit(block)).cast("long") == F.col("__blk"))
    return rows, Window.partitionBy(*keys, "__blk").orderBy("pos")


def own(df: DataFrame) -> DataFrame:
    return df.where("__own").drop("__own", "__blk")


def neighbour(df: DataFrame, keys: Sequence[str], shard: str, order: Sequence[str], cols: Sequence[str], out: str, ahead: bool = False) -> DataFrame:
    """Add the struct ``out`` of the columns of the row before (ahead: after), null at an end.

    Exact over shards: a shard's first row gets the last row of the nearest earlier shard.
    """
    keys, order = list(keys), list(order)
    state = F.struct(*cols)
    local = Window.partitionBy(*keys, shard).orderBy(*order)
    by = F.struct(*order)
    rows = df.repartition(*keys, shard)
    if ahead:
        carried = with_carry(rows, keys, shard, {"__s": F.min_by(state, by)}, {"__c": lambda w: F.lead("__s").over(w)})
        return carried.withColumn(out, F.coalesce(F.lead(state).over(local), F.col("__c"))).drop("__c")
    carried = with_carry(rows, keys, shard, {"__s": F.max_by(state, by)}, {"__c": lambda w: F.lag("__s").over(w)})
    return carried.withColumn(out, F.coalesce(F.lag(state).over(local), F.col("__c"))).drop("__c")


def running_sums(df: DataFrame, keys: Sequence[str], values: Sequence[str], outs: Sequence[str]) -> DataFrame:
    """Sums of columns from the series' start up to each row of a numbered series."""
    keys = list(keys)
    rows = df.withColumn("__sh", F.floor(F.col("pos") / F.lit(BLOCK)).cast("long")).repartition(*keys, "__sh")
    local = Window.partitionBy(*keys, "__sh").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    told = [f"__s{k}" for k in range(len(values))]
    past = [f"__b{k}" for k in range(len(values))]
    sums = lambda s: lambda w: F.coalesce(F.sum(s).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = with_carry(rows, keys, "__sh", {s: F.sum(v) for s, v in zip(told, values)}, {b: sums(s) for b, s in zip(past, told)})
    return carried.withColumns({o: F.col(b) + F.coalesce(F.sum(v).over(local), F.lit(0)) for o, b, v in zip(outs, past, values)}).drop(*past, "__sh")


def running_sum(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return running_sums(df, keys, [value], [out])
