"""Runs of identical or near-identical consecutive events, each as one event.

Records are ordered by time, then key, inside time shards of an entity; the record before a shard's
first comes from a prefix scan over shard summaries.  Only *boundary* rows are kept: records that
differ from their predecessor.  ``lead`` over those starts then says everything about a run: the
difference of positions is its count, the record before the next start its last, whose time gives
the duration.  The last run of a shard looks at the first start of a later shard, or at the
entity's last record.

Nulls: records with a null entity, time or key are left out, as are those whose vector has a null
or NaN component or is all zero.  Records equal in entity and key are copies and count once.  Ties
in time are ordered by key.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrolith.operators.shards import place, shard_summary


def collapse_runs(df: DataFrame, entity: Sequence[str], time: str, key: str, vector: Sequence[str], within: float = 1e-6, sign_free: bool = True, shard: float | Column = 16.0) -> DataFrame:
    """One row per run: entity..., first_idx, last_idx, n (count), start_t, duration.

    A record repeats the one just before it if no component differs by more than ``within``, for
    the vector or (sign_free) its negative.  ``shard``: length of a time shard in units of time, also
    as a column that is constant in an entity.
    """
    ent, vec = list(entity), list(vector)
    whole = [F.col(c).isNotNull() & ~F.isnan(c) for c in vec]
    rows = df.select(*ent, F.col(time).cast("double").alias("t"), F.col(key).cast("long").alias("idx"), *[F.col(c).cast("double").alias(c) for c in vec])
    length = shard if isinstance(shard, Column) else F.lit(shard)
    rows = rows.dropna(subset=[*ent, "t", "idx"]).where(~F.isnan("t"))
    for ok in whole:
        rows = rows.where(ok)
    rows = rows.where(F.greatest(*[F.abs(F.col(c)) for c in vec]) > 0 if len(vec) > 1 else F.col(vec[0]) != 0)
    placed = place(rows.withColumn("__sh", F.floor(F.col("t") / length).cast("long")), ent, "__sh")
    local = Window.partitionBy(*ent, "__sh").orderBy("t", "idx")
    # copies of a record stand next to each other in this order
    rows = placed.withColumn("__copy", (F.lag("idx").over(local) == F.col("idx")) & (F.lag("t").over(local) == F.col("t")))
    rows = rows.where(~F.coalesce("__copy", F.lit(False))).drop("__copy")
    state = F.struct("t", "idx", *vec)
    rows = rows.withColumn("__prev", F.lag(state).over(local)).withColumn("__pos", F.row_number().over(local).cast("long"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    after = lambda w: w.rowsBetween(1, Window.unboundedFollowing)
    # a shard tells its ends and where its first run after its first record starts
    inside = F.col("__prev").isNotNull() & ~F.coalesce(_repeats(F.col, F.col("__prev"), vec, within, sign_free), F.lit(False))
    inner = F.struct(F.col("__pos").alias("pos"), F.col("__prev.t").alias("pt"), F.col("__prev.idx").alias("pi"))
    aggs = {"__n": F.count(F.lit(1)), "__head": F.min(state), "__last": F.max(state), "__inner": F.min(F.when(inside, inner))}
    shards = shard_summary(rows, ent, "__sh", aggs, placed.columns)
    w = Window.partitionBy(*ent).orderBy("__sh")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shards = shards.withColumns(
        {
            "__cprev": F.lag("__last").over(w),
            "__off": F.coalesce(F.sum("__n").over(before(w)), F.lit(0)),
            "__total": F.sum("__n").over(every),
            "__end": F.last("__last").over(every),
        }
    )
    goes_on = F.coalesce(_repeats(lambda c: F.col("__head").getField(c), F.col("__cprev"), vec, within, sign_free), F.lit(False))
    of = lambda pos, t, i: F.struct((pos + F.col("__off")).alias("pos"), t.alias("pt"), i.alias("pi"))
    later = F.when(F.col("__inner").isNotNull(), of(F.col("__inner.pos"), F.col("__inner.pt"), F.col("__inner.pi")))
    shards = shards.withColumn("__begin", F.when(goes_on, later).otherwise(of(F.lit(1).cast("long"), F.col("__cprev.t"), F.col("__cprev.idx"))))
    shards = shards.withColumn("__next", F.first("__begin", True).over(after(w)))
    rows = rows.join(shards.select(*ent, "__sh", "__cprev", "__off", "__total", "__end", "__next"), [*ent, "__sh"])
    prev = F.coalesce("__prev", "__cprev")
    starts = rows.where(~F.coalesce(_repeats(F.col, prev, vec, within, sign_free), F.lit(False)))
    starts = starts.select(*ent, "__sh", "t", "idx", (F.col("__pos") + F.col("__off")).alias("pos"), prev.getField("t").alias("pt"), prev.getField("idx").alias("pi"), "__total", F.struct("__end.t", "__end.idx").alias("__end"), "__next")
    nxt = F.coalesce(F.lead(F.struct("pos", "pt", "pi")).over(local), F.col("__next"))
    starts = starts.withColumn("__nx", nxt)
    return starts.select(
        *ent,
        F.col("idx").alias("first_idx"),
        F.coalesce("__nx.pi", "__end.idx").alias("last_idx"),
        (F.coalesce(F.col("__nx.pos"), F.col("__total") + 1) - F.col("pos")).alias("n"),
        F.col("t").alias("start_t"),
        (F.coalesce("__nx.pt", "__end.t") - F.col("t")).alias("duration"),
    )


def _repeats(now: Callable[[str], Column], prev: Column, vec: Sequence[str], within: float, sign_free: bool) -> Column:
    def near(sign: int) -> Column:
        out = F.lit(True)
        for c in vec:
            out = out & (F.abs(now(c) - sign * prev.getField(c)) <= within)
        return out

    return near(1) | near(-1) if sign_free else near(1)
