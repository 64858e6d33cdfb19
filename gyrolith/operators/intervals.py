"""Intervals of a mask, joins of readings with intervals, and as-of interpolation.

Runs of a mask are found over shards; what is kept of a series then is one row a boundary, which is
written once (``durable``) because several steps read it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrolith.operators.ordered import BLOCK, neighbour
from gyrolith.operators.shards import with_carry
from gyrolith.session import durable


def find_intervals(df: DataFrame, keys: Sequence[str], time: str, mask: Column, pad: float, merge: float, least: float) -> DataFrame:
    """(keys..., a, b) of the runs where the mask holds, padded, merged and of a least length.

    A run from row s to the first false row e gives [t_s - pad, t_e + pad] (the last row's time
    where it runs to the end).  Intervals whose start is less than ``merge`` after the end before
    become one, then those shorter than ``least`` go.  A null mask is false.
    """
    keys = list(keys)
    rows = df.select(*keys, "pos", "n", F.col(time).alias("t"), F.coalesce(mask, F.lit(False)).alias("m"))
    rows = rows.withColumn("sh", F.floor(F.col("pos") / F.lit(BLOCK)).cast("long"))
    rows = neighbour(rows, keys, "sh", ["pos"], ["m"], "p")
    was = F.coalesce(F.col("p.m"), F.lit(False))
    edge = rows.where((F.col("m") != was) | (F.col("m") & (F.col("pos") == F.col("n") - 1)))
    # a run that reaches the end closes there; a run of the last row alone both opens and closes
    kinds = F.array_compact(F.array(F.when(F.col("m") & ~was, 0), F.when(~F.col("m") & was, 1), F.when(F.col("m") & (F.col("pos") == F.col("n") - 1), 1)))
    edge = durable(edge.select(*keys, "sh", "pos", "t", F.explode(kinds).alias("kind")))
    runs = neighbour(edge, keys, "sh", ["pos", "kind"], ["t"], "e", ahead=True).where("kind = 0")
    runs = runs.select(*keys, "sh", "pos", (F.col("t") - pad).alias("a"), (F.col("e.t") + pad).alias("b"))
    runs = durable(neighbour(runs, keys, "sh", ["pos"], ["b"], "q"))
    heads = runs.where(F.col("q").isNull() | (F.col("a") - F.col("q.b") >= merge))
    heads = neighbour(heads.select(*keys, "sh", "pos", "a", F.col("q.b").alias("qb")), keys, "sh", ["pos"], ["qb"], "nx", ahead=True)
    last = runs.groupBy(*keys).agg(F.max_by("b", "pos").alias("last_b"))
    out = heads.join(last, keys).select(*keys, "a", F.coalesce("nx.qb", "last_b").alias("b"))
    return out.where(F.col("b") - F.col("a") >= least)


#: Slots of one interval emitted at once.
PIECE = 4096


def slot_length(intervals: DataFrame, widen: float = 0.0) -> float:
    """Length of a time slot for a (written) interval table: its median interval, but not so short that
    intervals take more than some ten slots each on average, however long a few of them are."""
    long = F.col("b") - F.col("a") + 2 * widen
    of = intervals.where(long < float("inf")).agg(F.percentile_approx(long, 0.5, 1000).alias("m"), F.avg(long).alias("a")).first()
    return max(of["m"] or 0.0, (of["a"] or 0.0) / 8, 1e-3)


def within(df: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str, widen: float = 0.0, how: str = "inner", slot: float | None = None) -> DataFrame:
    """Range join: readings with the intervals [a - widen, b + widen] that hold them.

    Both sides meet on the keys and a time slot, so a long series is spread over many tasks and a
    reading meets only intervals of its slot; overlapping intervals give several rows.  Without a
    ``slot`` the interval table is written once and its lengths tell it (``slot_length``).  A long
    interval is emitted in pieces of slots, never as one array.
    """
    keys = list(keys)
    if slot is None:
        intervals = durable(intervals)
        slot = slot_length(intervals, widen)
    cut = intervals.select(*keys, *[c for c in intervals.columns if c not in keys], (F.col("a") - widen).alias("__a"), (F.col("b") + widen).alias("__b"))
    number = lambda c: F.floor(c / F.lit(slot)).cast("long")
    last = number(F.col("__b"))
    cut = cut.where("__a <= __b").withColumn("__from", F.explode(F.sequence(number(F.col("__a")), last, F.lit(PIECE).cast("long"))))
    cut = cut.withColumn("__slot", F.explode(F.sequence("__from", F.least(F.col("__from") + (PIECE - 1), last)))).drop("__from")
    cut = cut.select(*keys, "__slot", *[F.col(c).alias(f"__i_{c}") for c in cut.columns if c not in (*keys, "__slot")])
    left = df.withColumn("__slot", number(F.col(time)))
    hit = (F.col(time) >= F.col("__i___a")) & (F.col(time) <= F.col("__i___b"))
    on = [left[k].eqNullSafe(cut[k]) for k in (*keys, "__slot")]
    joined = left.join(cut, on=on + [hit], how=how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("__slot")
    names = [c for c in intervals.columns if c not in keys]
    return joined.select(*[left[c] for c in df.columns], *[F.col(f"__i_{c}").alias(c) for c in names])


def in_any(df: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Readings inside any interval, once each."""
    return within(df, intervals, keys, time, how="left_semi")


def in_none(df: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Readings inside no interval."""
    return within(df, intervals, keys, time, how="left_anti")


def label_windows(df: DataFrame, time: str, windows: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Each reading once per named window that holds it; windows may overlap.  The list is the
    caller's literal, so it travels as an expression and nothing is joined."""
    tests = [F.when((F.col(time) >= a) & (F.col(time) <= b), F.lit(name)) for name, a, b in windows]
    return df.withColumn("label", F.explode(F.array_compact(F.array(*tests))))


def interp_asof(queries: DataFrame, knots: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], shard: float) -> DataFrame:
    """Values of piecewise linear knots at the queries' times, constant beyond the ends.

    Equal knot times: the later row in value order wins, as a search from the right finds it.
    """
    keys, values = list(keys), list(values)
    extra = [c for c in queries.columns if c not in (*keys, time, *values)]
    q = queries.select(*keys, time, *extra, *[F.lit(None).cast("double").alias(v) for v in values], F.lit(1).alias("__side"))
    k = knots.select(*keys, time, *[F.lit(None).cast(dict(queries.dtypes)[c]).alias(c) for c in extra], *values, F.lit(0).alias("__side"))
    rows = k.unionByName(q).withColumn("__sh", F.floor(F.col(time) / F.lit(shard)).cast("long")).repartition(*keys, "__sh")
    knot = F.when(F.col("__side") == 0, F.struct(F.col(time).alias("t"), *values))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    after = lambda w: w.rowsBetween(1, Window.unboundedFollowing)
    aggs = {"__f": F.min(knot), "__l": F.max(knot)}
    rows = with_carry(rows, keys, "__sh", aggs, {"__cl": lambda w: F.last("__l", True).over(before(w)), "__cf": lambda w: F.first("__f", True).over(after(w))})
    local = Window.partitionBy(*keys, "__sh").orderBy(time, "__side", *values)
    lo = F.coalesce(F.last(knot, True).over(local.rowsBetween(Window.unboundedPreceding, 0)), F.col("__cl"))
    hi = F.coalesce(F.first(knot, True).over(local.rowsBetween(0, Window.unboundedFollowing)), F.col("__cf"))
    rows = rows.withColumn("__lo", lo).withColumn("__hi", hi).where("__side = 1")
    f = F.try_divide(F.col(time) - F.col("__lo.t"), F.col("__hi.t") - F.col("__lo.t"))
    new = [F.coalesce(F.col(f"__lo.{v}") + (F.col(f"__hi.{v}") - F.col(f"__lo.{v}")) * f, F.col(f"__lo.{v}"), F.col(f"__hi.{v}")).alias(v) for v in values]
    return rows.select(*keys, time, *extra, *new)


def next_time(rows: DataFrame, times: DataFrame, keys: Sequence[str], at: str, time: str, out: str, shard: float) -> DataFrame:
    """Add the first of ``times`` at or after a row's ``at`` in its series, null if none follows."""
    keys = list(keys)
    a = rows.withColumns({"__at": F.col(at), "__side": F.lit(1)})
    b = times.select(*keys, F.col(time).alias("__at"), F.lit(0).alias("__side")).dropna()
    both = a.unionByName(b, allowMissingColumns=True)
    edge = F.lit(float(1 << 40))  # infinite times go to the outermost shards
    both = both.withColumn("__sh", F.floor(F.greatest(-edge, F.least(edge, F.col("__at"))) / F.lit(shard)).cast("long")).repartition(*keys, "__sh")
    known = F.when(F.col("__side") == 0, F.col("__at"))
    carries = {"__c": lambda w: F.first("__m", True).over(w.rowsBetween(1, Window.unboundedFollowing))}
    both = with_carry(both, keys, "__sh", {"__m": F.min(known)}, carries)
    local = Window.partitionBy(*keys, "__sh").orderBy("__at", F.desc("__side")).rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumn(out, F.coalesce(F.first(known, True).over(local), F.col("__c"))).where("__side = 1")
    return both.drop("__at", "__side", "__sh", "__c")


def edges_to_index(intervals: DataFrame, df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Per interval the first position at or after a and the last at or before b (i0, i1)."""
    rows = within(df.select(*keys, "pos", F.col(time).alias("__t")), intervals, keys, "__t")
    return rows.groupBy(*keys, *[c for c in intervals.columns if c not in keys]).agg(F.min("pos").alias("i0"), F.max("pos").alias("i1"))


def calibration_intervals(quiet: DataFrame, readings: DataFrame, keys: Sequence[str], time: str, motion: str, top: int = 6, clip: float = 4.0) -> DataFrame:
    """The intervals of most motion, at most ``top`` a series, cut to ``clip`` seconds.

    Score: population standard deviation of the motion inside; ties go to the later interval.  Only
    the best ``top`` of each task travel, so a series of many intervals is no burden.
    """
    scored = within(readings, quiet, keys, time).groupBy(*keys, "a", "b").agg(F.stddev_pop(motion).alias("score"))
    scored = scored.withColumn("__salt", F.pmod(F.xxhash64("a", "b"), F.lit(64)))
    best = lambda *part: F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("score"), F.desc("a"), F.desc("b")))
    few = scored.withColumn("__r", best(*keys, "__salt")).where(F.col("__r") <= top)
    few = few.withColumn("rank", best(*keys)).where(F.col("rank") <= top)
    return few.select(*keys, "rank", "a", F.least(F.col("b"), F.col("a") + clip).alias("b"), "score")
