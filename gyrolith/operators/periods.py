"""Overlapping intervals to continuous periods and the gaps between them, by dyadic blocks.

Intervals are taken as closed ranges of integer ticks.  In half ticks the closed range [a, b] is
the half-open range [2a, 2b + 1): ranges that touch share a half tick, ranges one tick apart don't.
Time is cut into shards of 2^shard_level half ticks, and so is each range: its two ends go to their
shards as they are, one row each; whole shards between them are decomposed into canonical dyadic
blocks (level j, number p: [p 2^j, (p + 1) 2^j)), at most two a level, which skip the shards.
In a shard, ranges become their canonical blocks, blocks an ancestor covers are dropped, siblings
merge upward and neighbours coalesce to pieces.  That is done once before the shuffle, over the rows
of each partition, and once after it.  Only a shard's first and last piece can belong to a period of
other shards: they are joined up over one row a shard, the others are final.

Nulls: rows whose entity columns or bounds are null, or whose end isn't above its start, don't
count.  Equal, nested and repeated intervals change nothing.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrolith.operators.shards import map_group_chunks
from gyrolith.session import durable

#: 2^26 half microseconds, about 33 s.
SHARD_LEVEL = 26


def micros(seconds: Column) -> Column:
    return F.round(seconds * F.lit(1e6)).cast("long")


def _shift(a: Column, j: Column) -> Column:
    return F.call_function("shiftright", a, j.cast("int"))


def dyadic_blocks(a: Column, b: Column) -> Column:
    """Array of struct(lvl, blk) of the canonical blocks of [a, b), for b > a.

    At level j the range has shrunk to [ceil(a / 2^j), floor(b / 2^j)): an odd left end is a block,
    and so is the last one before an odd right end.
    """
    levels = F.sequence(F.lit(0), F.ceil(F.log2((b - a).cast("double"))).cast("int") + 1)

    def at(j: Column) -> Column:
        left, right = -_shift(-a, j), _shift(b, j)
        both = F.array(
            F.when((left < right) & (left.bitwiseAND(F.lit(1)) == 1), F.struct(j.cast("int").alias("lvl"), left.alias("blk"))),
            F.when((left < right) & (right.bitwiseAND(F.lit(1)) == 1), F.struct(j.cast("int").alias("lvl"), (right - 1).alias("blk"))),
        )
        return F.filter(both, lambda x: x.isNotNull())

    return F.flatten(F.transform(levels, at))


def decompose(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical dyadic blocks of many ranges [a, b): (group, level, number)."""
    parts = []
    j = 0
    while len(a):
        for odd, number in (((a & 1) == 1, a), ((b & 1) == 1, b - 1)):
            at = odd & (a < b)
            parts.append((group[at], np.full(int(at.sum()), j, np.int64), number[at]))
        a, b, j = (a + 1) >> 1, b >> 1, j + 1
        left = a < b
        group, a, b = group[left], a[left], b[left]
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def reduce_blocks(group: np.ndarray, level: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks to disjoint, non-adjacent pieces per group: (group, start, end)."""
    start, end = number << level, (number + 1) << level
    order = np.lexsort((-level, start, group))
    group, level, number, start, end = (x[order] for x in (group, level, number, start, end))
    first = np.r_[True, group[1:] != group[:-1]]
    # blocks nest or are disjoint: an earlier block that ends after this one starts is an ancestor
    code = np.cumsum(first) - 1
    span = int(end.max() - start.min()) + 1
    base = start.min()
    reach = np.maximum.accumulate((end - base) + code * span) if code[-1] < 2**62 // max(span, 1) else None
    if reach is None:
        raise OverflowError("chunk spans too many shards for one pass")
    covered = np.r_[False, reach[:-1] >= (end - base + code * span)[1:]]
    keep = ~covered
    code, level, number = code[keep], level[keep], number[keep]
    names = group[keep]
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for j in range(int(level.min()), int(level.max()) + 64):
        at = level == j
        if not at.any():
            if not (level > j).any():
                break
            continue
        c, n = code[at], number[at]
        o = np.lexsort((n, c))
        c, n = c[o], n[o]
        pair = np.r_[(n[:-1] + 1 == n[1:]) & (n[:-1] & 1 == 0) & (c[:-1] == c[1:]), False]
        second = np.r_[False, pair[:-1]]
        single = ~(pair | second)
        done.append((c[single], n[single] << j, (n[single] + 1) << j))
        rest = ~at
        code = np.r_[code[rest], c[pair]]
        number = np.r_[number[rest], n[pair] >> 1]
        level = np.r_[level[rest], np.full(int(pair.sum()), j + 1)]
        if not len(level):
            break
    c, s, e = (np.concatenate(x) for x in zip(*done))
    o = np.lexsort((s, c))
    c, s, e = c[o], s[o], e[o]
    head = np.r_[True, (c[1:] != c[:-1]) | (s[1:] != e[:-1])]
    tail = np.r_[head[1:], True]
    name_of = np.zeros(int(c.max()) + 1, group.dtype)
    name_of[np.cumsum(first)[keep] - 1] = names
    return name_of[c[head]], s[head], e[tail]


def periods_and_gaps(df: DataFrame, entity: Sequence[str], start: Column, end: Column, shard_level: int = SHARD_LEVEL) -> DataFrame:
    """Rows (entity..., what 'period' | 'gap', start_us, end_us) of integer-tick intervals.

    start, end: bigint columns; an interval with end >= start counts (closed ticks), so a caller
    that wants end > start filters first.
    """
    ent = list(entity)
    level = F.lit(shard_level)
    ranges = df.select(*ent, start.alias("__lo"), end.alias("__hi")).dropna().where("__hi >= __lo")
    ranges = ranges.select(*ent, (F.col("__lo") * 2).alias("__a"), (F.col("__hi") * 2 + 1).alias("__b"))
    first, last = _shift(F.col("__a"), level), _shift(F.col("__b") - 1, level)
    edge = lambda sh: F.call_function("shiftleft", sh, level)
    ranges = ranges.select("*", first.alias("__i"), last.alias("__k"))
    # the ends of a range, one row a shard; a range in one shard is one row
    ends = F.array_compact(
        F.array(
            F.struct(F.col("__i").alias("__sh"), F.col("__a").alias("__a"), F.least("__b", edge(F.col("__i") + 1)).alias("__b")),
            F.when(F.col("__k") > F.col("__i"), F.struct(F.col("__k").alias("__sh"), edge(F.col("__k")).alias("__a"), F.col("__b").alias("__b"))),
        )
    )
    cut = ranges.select(*ent, F.inline(ends))
    keys = [*ent, "__sh"]
    types = dict(cut.dtypes)
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def pieces(tab: pa.Table, group: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, group, start and end of each piece, in order."""
        base = tab.column("__sh").to_numpy() << shard_level
        g, s, e = reduce_blocks(*decompose(group, tab.column("__a").to_numpy() - base, tab.column("__b").to_numpy() - base))
        codes, at = np.unique(group, return_index=True)
        rows = at[np.searchsorted(codes, g)]
        return tab.select(keys).take(pa.array(rows)), g, s + base[rows], e + base[rows]

    def combine(tab: pa.Table, group: np.ndarray) -> pa.Table:
        out, _, s, e = pieces(tab, group)
        return out.append_column("__a", pa.array(s)).append_column("__b", pa.array(e))

    def close(tab: pa.Table, group: np.ndarray) -> pa.Table:
        """kind 0: a shard's first and last piece; 1: a period inside; 2: a gap inside."""
        out, g, s, e = pieces(tab, group)
        head = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        tail = np.r_[head[1:], len(g)] - 1
        gap = np.flatnonzero(np.r_[g[1:] == g[:-1], False])
        inner = np.setdiff1d(np.arange(len(g)), np.r_[head, tail])
        rows = np.r_[head, inner, gap]
        kind = np.repeat(np.array([0, 1, 2], np.int32), [len(head), len(inner), len(gap)])
        none = np.full(len(inner) + len(gap), -1)
        out = out.take(pa.array(rows)).append_column("__kind", pa.array(kind))
        out = out.append_column("__s", pa.array(np.r_[s[head], s[inner], e[gap]])).append_column("__e", pa.array(np.r_[e[head], e[inner], s[gap + 1]]))
        mask = np.r_[head == tail, none < 0]
        return out.append_column("__s1", pa.array(np.r_[s[tail], none], mask=mask)).append_column("__e1", pa.array(np.r_[e[tail], none], mask=mask))

    cut = map_group_chunks(cut, keys, combine, f"{named}, __a bigint, __b bigint", local=True)
    told = map_group_chunks(cut, keys, close, f"{named}, __kind int, __s bigint, __e bigint, __s1 bigint, __e1 bigint")
    whole = ranges.where(F.col("__k") > F.col("__i") + 1).select(*ent, F.explode(dyadic_blocks(F.col("__i") + 1, F.col("__k"))).alias("__x"))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__x.lvl"))
    whole = whole.select(*ent, (F.col("__x.blk") * size).alias("__sh"), edge(F.col("__x.blk") * size).alias("__s"), edge((F.col("__x.blk") + 1) * size).alias("__e")).distinct()
    none = F.lit(None).cast("bigint")
    told = told.unionByName(whole.select(*keys, F.lit(0).alias("__kind"), "__s", "__e", none.alias("__s1"), none.alias("__e1")))
    return _join_up(durable(told), ent)  # one row a piece; read for the shards' ends and for what lies inside


def _join_up(told: DataFrame, ent: list[str]) -> DataFrame:
    """Shards' first and last pieces to the entities' periods and gaps, beside what lies inside shards."""
    # of rows alike in start and reach, the one without a hole comes first
    order = Window.partitionBy(*ent).orderBy("__s", F.desc("__until"), F.asc_nulls_first("__s1"))
    shards = told.where("__kind = 0").withColumn("__until", F.coalesce("__e1", "__e"))
    shards = shards.withColumn("__reach", F.max("__until").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    shards = shards.withColumn("__last", F.max("__until").over(Window.partitionBy(*ent)))
    covered = F.coalesce(F.col("__reach") >= F.col("__until"), F.lit(False))
    # where periods start, and what is then known of the one before: where it ended
    starts = F.array_compact(
        F.array(
            F.when(F.col("__reach").isNull() | (F.col("__reach") < F.col("__s")), F.struct(F.col("__s").alias("__s"), F.col("__reach").alias("__close"), F.col("__reach").alias("__gap"))),
            F.when(F.col("__s1").isNotNull(), F.struct(F.col("__s1").alias("__s"), F.col("__e").alias("__close"), F.lit(None).cast("bigint").alias("__gap"))),
        )
    )
    opened = shards.where(~covered).select(*ent, "__last", F.inline(starts))
    ends = F.coalesce(F.lead("__close").over(Window.partitionBy(*ent).orderBy("__s")), F.col("__last"))
    rows = F.array_compact(
        F.array(
            F.struct(F.lit("period").alias("what"), F.col("__s").alias("__a"), ends.alias("__b")),
            F.when(F.col("__gap").isNotNull(), F.struct(F.lit("gap").alias("what"), F.col("__gap").alias("__a"), F.col("__s").alias("__b"))),
        )
    )
    joined = opened.select(*ent, rows.alias("__x")).select(*ent, F.inline("__x"))
    under = shards.where(covered).select(*ent, "__sh").distinct()
    inside = told.where("__kind > 0").join(under, [*ent, "__sh"], "left_anti")
    inside = inside.select(*ent, F.when(F.col("__kind") == 1, "period").otherwise("gap").alias("what"), F.col("__s").alias("__a"), F.col("__e").alias("__b"))
    period = F.col("what") == "period"
    half = lambda c, end: F.floor((F.col(c) - F.when(end, 1).otherwise(0)) / 2).cast("long")
    return joined.unionByName(inside).select(*ent, "what", half("__a", ~period).alias("start_us"), half("__b", period).alias("end_us"))
