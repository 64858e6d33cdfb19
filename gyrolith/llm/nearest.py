"""Matching records by nearest time through x-fast tries.

Two tables are matched per entity: every query row gets the base row nearest in time, if one lies
within the tolerance.  The time axis of an entity is cut into shards; a base row also goes to the
neighbour of a shard it is within the tolerance of, so each query is answered inside its own shard
and no task holds an entity.  A chunk of shards is answered at once:

* times relative to the shard become integer ticks of ``w`` bits; equal ticks share a leaf, leaves
  form a sorted list;
* level L of the trie is a hash table of the L-bit prefixes of all leaves (with the shard number in
  front), each with its first and last leaf;
* a query binary-searches the length of its longest prefix in the trie, which gives predecessor
  and successor leaf; the nearer record of those within the tolerance is taken, by exact doubles.

Ties go to the earlier time, then the smaller key.  Null or NaN entities, times and keys match
nothing and are absent from the result, repeated records count once.  An empty side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.llm.hashing import HashTable
from gyrolith.operators.shards import map_group_chunks

class XFastTrie:
    """Tries of many entities in common tables: keys are (entity << bits) | tick, sorted, distinct."""

    def __init__(self, leaves: np.ndarray, bits: int) -> None:
        self.leaves, self.bits = leaves, bits
        self.levels: list[tuple[HashTable, np.ndarray, np.ndarray]] = []
        for level in range(bits + 1):
            prefix = leaves >> (bits - level)
            first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
            last = np.r_[first[1:], len(leaves)] - 1
            self.levels.append((HashTable(prefix[first]), first, last))

    def neighbours(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf at or before each key and leaf at or after it, in the key's entity; -1 if none."""
        n = len(keys)
        low, high = np.full(n, -1, np.int64), np.full(n, self.bits, np.int64)  # deepest known present; deepest possible
        node = np.full(n, -1, np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_] + 1) >> 1
            for level in np.unique(mid):
                at = open_[mid == level]
                found = self.levels[level][0].find(keys[at] >> (self.bits - level))
                hit = found >= 0
                low[at[hit]], node[at[hit]] = level, found[hit]
                high[at[~hit]] = level - 1
        before, after = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for level in np.unique(low[low >= 0]):
            at = np.flatnonzero(low == level)
            _, first, last = self.levels[level]
            f, l = first[node[at]], last[node[at]]
            if level == self.bits:
                before[at] = after[at] = f
                continue
            up = (keys[at] >> (self.bits - level - 1)) & 1 == 1
            before[at] = np.where(up, l, f - 1)
            after[at] = np.where(up, l + 1, f)
        entity = keys >> self.bits
        size = len(self.leaves)
        for side in (before, after):
            inside = (side >= 0) & (side < size)
            same = np.zeros(n, bool)
            same[inside] = self.leaves[side[inside]] >> self.bits == entity[inside]
            side[~same] = -1
        return before, after


def nearest_in_chunk(group: np.ndarray, time: np.ndarray, key: np.ndarray, is_query: np.ndarray, origin: np.ndarray, tick: float, bits: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the queries that have a match, and the rows of their matches."""
    base = np.flatnonzero(~is_query)
    query = np.flatnonzero(is_query)
    if not len(base) or not len(query):
        return query[:0], base[:0]
    base = base[np.lexsort((key[base], time[base], group[base]))]
    to_key = lambda r: (group[r] << bits) | np.clip(np.floor((time[r] - origin[r]) / tick), 0, (1 << bits) - 1).astype(np.int64)
    code = to_key(base)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    last = np.r_[first[1:], len(code)] - 1
    trie = XFastTrie(code[first], bits)
    before, after = trie.neighbours(to_key(query))
    best = np.full(len(query), -1, np.int64)
    gap = np.full(len(query), np.inf)

    def offer(rows: np.ndarray, cand: np.ndarray) -> None:
        d = np.abs(time[base[cand]] - time[query[rows]])
        better = (d < gap[rows]) | ((d == gap[rows]) & (cand < best[rows]))
        gap[rows[better]], best[rows[better]] = d[better], cand[better]

    for leaf, other in ((before, -1), (after, 1)):
        rows = np.flatnonzero(leaf >= 0)
        if not len(rows):
            continue
        lo, hi = first[leaf[rows]], last[leaf[rows]] + 1
        goal = time[query[rows]]
        while (lo < hi).any():  # first record of the leaf at or after the query's time
            mid = (lo + hi) >> 1
            on = lo < hi
            less = on & (time[base[np.minimum(mid, len(base) - 1)]] < goal)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(on & ~less, mid, hi)
        for at in (lo - 1, lo):
            ok = (at >= 0) & (at < len(base))
            ok[ok] = group[base[at[ok]]] == group[query[rows[ok]]]
            offer(rows[ok], at[ok])
    hit = gap <= tolerance
    return query[hit], base[best[hit]]


def match_nearest(queries: DataFrame, base: DataFrame, entity: Sequence[str], query_time: str, query_key: str, base_time: str, base_key: str, tolerance: float, shard: float = 4.0, bits: int = 13) -> DataFrame:
    """Rows (entity..., query_key, base_key, distance) of the nearest base row within tolerance.

    Times are doubles in one unit; keys are bigints that identify a record within its entity.
    ``shard`` bounds what one task holds of an entity, in units of time; ``bits`` the trie's depth.
    """
    ent = list(entity)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(1e15))
    number = lambda c: F.floor(c / F.lit(shard)).cast("long")
    t = F.col(base_time)
    near = F.array_distinct(F.array(number(t - 1.01 * tolerance), number(t), number(t + 1.01 * tolerance)))
    left = base.where(finite(base_time)).select(*ent, F.explode(near).alias("__sh"), t.alias("__t"), F.col(base_key).alias("__k"), F.lit(False).alias("__q"))
    right = queries.where(finite(query_time)).select(*ent, number(F.col(query_time)).alias("__sh"), F.col(query_time).alias("__t"), F.col(query_key).alias("__k"), F.lit(True).alias("__q"))
    rows = left.unionByName(right).dropna(subset=[*ent, "__k"])
    types = dict(rows.dtypes)

    def run(tab: pa.Table, group: np.ndarray) -> pa.Table:
        time, key = tab.column("__t").to_numpy(), tab.column("__k").to_numpy()
        origin = tab.column("__sh").to_numpy() * shard - 2 * tolerance
        is_query = tab.column("__q").to_numpy(zero_copy_only=False).astype(bool)
        # copies of one query record: keep one
        q = np.flatnonzero(is_query)
        o = q[np.lexsort((time[q], key[q], group[q]))]
        again = np.r_[np.zeros(min(len(o), 1), bool), (group[o][1:] == group[o][:-1]) & (key[o][1:] == key[o][:-1]) & (time[o][1:] == time[o][:-1])]
        keep = np.ones(len(key), bool)
        keep[o[again]] = False
        rows_ = np.flatnonzero(keep)
        tick = (shard + 4 * tolerance) / (1 << bits)
        qr, br = nearest_in_chunk(group[rows_], time[rows_], key[rows_], is_query[rows_], origin[rows_], tick, bits, tolerance)
        qr, br = rows_[qr], rows_[br]
        out = tab.select(ent).take(pa.array(qr))
        out = out.append_column(query_key, pa.array(key[qr])).append_column(base_key, pa.array(key[br]))
        return out.append_column("distance", pc.abs(pa.array(time[br] - time[qr])))

    schema = ", ".join(f"`{k}` {types[k]}" for k in ent) + f", `{query_key}` bigint, `{base_key}` bigint, distance double"
    return map_group_chunks(rows, [*ent, "__sh"], run, schema)
