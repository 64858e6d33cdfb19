"""Ordered work on groups of any size: shards, boundary carries, dense positions, grouped chunks.

An entity (here mostly a clip) may hold a third of all rows, so no operator of this library gives
one task a whole entity.  Each cuts the entity's order axis into *shards* and works on a shard at a
time; what crosses a shard's edge travels in a summary of one row a shard, over which a prefix scan
(a window over shards, not rows) gives every shard its *carry*.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gyrolith.session import ship

CHUNK_ROWS = 200_000


def place(df: DataFrame, entity: Sequence[str], shard: str) -> DataFrame:
    """Shuffle rows to their shards, for ``with_carry``'s base.  Rows whose keys or shard are null go.

    The test for nulls is said here, before the shuffle, since a join would otherwise infer it on one
    of its sides only and spoil the shared shuffle.
    """
    known = F.lit(True)
    for k in (*entity, shard):
        known = known & F.col(k).isNotNull()
    return df.where(known).repartition(*entity, shard)


def shard_summary(df: DataFrame, entity: Sequence[str], shard: str, aggs: dict[str, Column], tie: Sequence[str] = ()) -> DataFrame:
    """One row a shard.  ``tie``: the columns that left the shuffle (``place``), if all are used later on.

    The summary then reads them all: a column read nowhere would be pruned from one of two shuffles
    of the same rows, which so stay one.
    """
    told = [c.alias(n) for n, c in aggs.items()]
    if not tie:
        return df.groupBy(*entity, shard).agg(*told)
    summary = df.groupBy(*entity, shard).agg(*told, F.bit_xor(F.xxhash64(*tie)).alias("__all"))
    return summary.where(F.col("__all").isNotNull()).drop("__all")


def with_carry(
    df: DataFrame, entity: Sequence[str], shard: str, aggs: dict[str, Column], carries: dict[str, Callable[[Window], Column]], base: DataFrame | None = None, tie: Sequence[str] = ()
) -> DataFrame:
    """Add to each row what the other shards of its entity say.

    aggs: what a shard tells of itself; carries: columns over the window of an entity's shards in
    order (``w``), computed from those.  The joined side has one row a shard.
    Keys must not be null.  base: the rows as they left ``place``, if all of its columns are used
    later on; one shuffle then serves both.  If base was made of those, ``tie`` names their columns.
    """
    w = Window.partitionBy(*entity).orderBy(shard)
    summary = shard_summary(df, entity, shard, aggs) if base is None else shard_summary(base, entity, shard, aggs, tie or base.columns)
    summary = summary.select(*entity, shard, *[f(w).alias(n) for n, f in carries.items()])
    # every shard has its row; an inner join asks the same of both sides, so their shuffles stay alike
    return df.join(summary, [*entity, shard], "left" if base is None else "inner")


def dense_position(df: DataFrame, entity: Sequence[str], shard: str, order: Sequence[str], out: str = "pos", tie: Sequence[str] = ()) -> DataFrame:
    """Number each entity's rows 0, 1, ... in order, without bringing an entity into one task.

    ``shard`` must be monotone in ``order``: rank inside a shard plus the count of earlier shards.
    ``tie``: the columns that left ``place``, if ``df`` comes from there and all are used later on.
    """
    local = Window.partitionBy(*entity, shard).orderBy(*order)
    ranked = (df if tie else df.repartition(*entity, shard)).withColumn(out, (F.row_number().over(local) - 1).cast("long"))
    before = {"__before": lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
    placed = with_carry(ranked, entity, shard, {"__n": F.count(F.lit(1))}, before, base=df if tie else None, tie=tie)
    return placed.withColumn(out, F.col(out) + F.col("__before")).drop("__before")


def with_halo(df: DataFrame, pos: str, block: int, halo: int, out: str = "blk") -> DataFrame:
    """Put each row into the block of its position and, near an edge, also into the neighbour.

    The copy is told from the original by ``pos div block <> blk``.  Needs halo <= block.
    """
    p = F.col(pos)
    blocks = F.array_distinct(F.array(*[F.floor((p + d) / F.lit(block)).cast("long") for d in (-halo, 0, halo)]))
    return df.withColumn(out, F.explode(F.filter(blocks, lambda b: b >= 0)))


def map_group_chunks(df: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table, np.ndarray], pa.Table | None], schema: T.StructType | str, chunk_rows: int = CHUNK_ROWS, local: bool = False) -> DataFrame:
    """Run ``fn(rows, group_number)`` over chunks that hold many whole groups each.

    One shuffle on the keys, then a radix sort on a 64-bit hash of them makes groups contiguous, so
    a partition of any size streams through in chunks; a chunk ends only between two hashes. ``fn``
    gets the rows of a chunk sorted by group and each row's group number (two groups of one hash
    are told apart).  Python's memory is bounded by chunk_rows plus the largest group, so keys must
    include a shard that bounds the group.

    ``local`` leaves out the shuffle: the groups are then those of a partition, for work that
    combines before it moves.
    """
    ship(df.sparkSession)
    names = list(keys)
    shaped = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow_out = to_arrow_schema(shaped)
    hashed = df.withColumn("__h", F.xxhash64(*names))
    hashed = (hashed if local else hashed.repartition(*names)).sortWithinPartitions("__h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def work(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tab = pa.Table.from_batches(parts).combine_chunks()
            tab, group = _group_numbers(tab, names)
            res = fn(tab.drop_columns(["__h"]), group)
            if res is not None and res.num_rows:
                yield from res.select(arrow_out.names).cast(arrow_out).to_batches(max_chunksize=50_000)

        for b in batches:
            if not b.num_rows:
                continue
            if rows >= chunk_rows:
                h = b.column("__h").to_numpy(zero_copy_only=False)
                last = held[-1].column("__h")[-1].as_py()
                cut = int(np.argmax(h != last)) if (h != last).any() else b.num_rows
                held.append(b.slice(0, cut))
                if cut == b.num_rows:
                    rows += cut
                    continue
                yield from work(held)
                held, rows = [], 0
                b = b.slice(cut)
            held.append(b)
            rows += b.num_rows
        if held:
            yield from work(held)

    return hashed.mapInArrow(run, shaped)


def _group_numbers(tab: pa.Table, keys: Sequence[str]) -> tuple[pa.Table, np.ndarray]:
    """Rows arranged by group, and the number of each row's group."""

    def change(col: str, t: pa.Table) -> np.ndarray:
        c = t.column(col).combine_chunks()
        ne = pc.fill_null(pc.not_equal(c[1:], c[:-1]), pc.xor(c[1:].is_null(), c[:-1].is_null()))
        return np.asarray(ne.to_numpy(zero_copy_only=False), dtype=bool)

    if tab.num_rows < 2:
        return tab, np.zeros(tab.num_rows, np.int64)
    ch = change("__h", tab)
    ck = np.zeros_like(ch)
    for k in keys:
        ck |= change(k, tab)
    if (ck & ~ch).any():  # two groups of one hash, interleaved
        tab = tab.sort_by([(k, "ascending") for k in ("__h", *keys)])
        ck = np.zeros(tab.num_rows - 1, bool)
        for k in keys:
            ck |= change(k, tab)
    return tab, np.concatenate([[0], np.cumsum(ck)]).astype(np.int64)


def floats(tab: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return tab.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False) if tab.column(name).null_count == 0 else pc.fill_null(tab.column(name).cast(pa.float64()), float("nan")).to_numpy()
