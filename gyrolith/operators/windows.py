"""Window operators over numbered series (key columns, ``pos``, ``n``).

Edges repeat the nearest reading, as in zero-phase processing.  Null readings take no part in a
frame; a frame of nulls gives null.  Each operator adds columns and keeps all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrolith.functions import quat as Qn
from gyrolith.operators.ordered import blocked, neighbour, own, running_sum, running_sums
from gyrolith.operators.shards import with_carry
from gyrolith.session import durable

SHARD = 4096


def _reach(left: int, right: int) -> tuple[Column, Column]:
    """How many frame rows stick out before the series' start and beyond its end."""
    zero = F.lit(0).cast("long")
    return F.greatest(zero, F.lit(left) - F.col("pos")), F.greatest(zero, F.col("pos") + right - (F.col("n") - 1))


def _padded(values: Column, left: int, right: int) -> Column:
    """The frame's values with the edge values repeated for what sticks out."""
    before, after = _reach(left, right)
    head = F.array_repeat(F.get(values, F.lit(0)), before.cast("int"))
    tail = F.array_repeat(F.element_at(values, -1), after.cast("int"))
    return F.when(F.size(values) > 0, F.concat(head, values, tail))


def _middle(s: Column) -> Column:
    """Median of a sorted array."""
    k = F.size(s)
    return (F.get(s, F.floor((k - 1) / 2).cast("int")) + F.get(s, F.floor(k / 2).cast("int"))) / 2


def median_filter(df: DataFrame, keys: Sequence[str], values: Sequence[str], size: int, outs: Sequence[str]) -> DataFrame:
    """Centred rolling median of an odd number of readings."""
    if size % 2 == 0:
        raise ValueError("size must be odd")
    h = size // 2
    rows, w = blocked(df, keys, h)
    # step by step, so that no step's expression is written out more than once in the next
    f, g = ([f"__{p}{k}" for k in range(len(values))] for p in ("f", "g"))
    rows = own(rows.withColumns({a: F.collect_list(v).over(w.rowsBetween(-h, h)) for a, v in zip(f, values)}))
    rows = rows.withColumns({b: F.array_sort(_padded(F.col(a), h, h)) for a, b in zip(f, g)})
    return rows.withColumns({o: _middle(F.col(b)) for o, b in zip(outs, g)}).drop(*f, *g)


def uniform_filter(df: DataFrame, keys: Sequence[str], values: Sequence[str], size: int, outs: Sequence[str]) -> DataFrame:
    """Rolling mean of ``size`` readings from size // 2 before on; an even size leans left."""
    left, right = size // 2, size - 1 - size // 2
    rows, w = blocked(df, keys, max(left, right, 1))
    frame = w.rowsBetween(-left, right)
    before, after = _reach(left, right)
    for v, o in zip(values, outs):
        total = F.sum(v).over(frame) + before * F.first(v).over(frame) + after * F.last(v).over(frame)
        rows = rows.withColumn(o, total / size)
    return own(rows)


def hampel(df: DataFrame, keys: Sequence[str], values: Sequence[str], half: int, nsig: float, outs: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Replace readings further than nsig scaled median deviations from the rolling median by it.

    Two passes for any number of columns: the medians, then the medians of the deviations.
    """
    med, dev, mad = ([f"__{p}{k}" for k in range(len(values))] for p in ("med", "dev", "mad"))
    rows = median_filter(df, keys, values, 2 * half + 1, med)
    rows = rows.withColumns({d: F.abs(F.col(v) - F.col(m)) for d, v, m in zip(dev, values, med)})
    rows = median_filter(rows, keys, dev, 2 * half + 1, mad)
    bad = [F.col(d) > nsig * (1.4826 * F.col(m) + 1e-9) for d, m in zip(dev, mad)]
    rows = rows.withColumns({f: b for f, b in zip(flags, bad)})
    rows = rows.withColumns({o: F.when(F.col(f), F.col(m)).otherwise(F.col(v)) for o, f, m, v in zip(outs, flags, med, values)})
    return rows.drop(*med, *dev, *mad)


def gradient(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Central differences, one-sided at the ends; null for a series of one reading."""
    rows, w = blocked(df, keys, 1)
    x, a, b = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    g = F.when(F.col("n") < 2, None).when(F.col("pos") == 0, b - x).when(F.col("pos") == F.col("n") - 1, x - a).otherwise((b - a) / 2)
    return own(rows.withColumn(out, g))


def difference(df: DataFrame, keys: Sequence[str], values: Sequence[str], outs: Sequence[str]) -> DataFrame:
    """Reading minus the one before; null at the start."""
    rows, w = blocked(df, keys, 1)
    return own(rows.withColumns({o: F.col(v) - F.lag(v).over(w) for v, o in zip(values, outs)}))


def rates(df: DataFrame, keys: Sequence[str], time: str, q: Sequence[str], outs: Sequence[str] = ("tm", "wx", "wy", "wz"), step: str | None = None) -> DataFrame:
    """Angular rates between successive orientations at their mid times; one row less a series.
    ``step`` names a column to keep the time between the two in."""
    rows, w = blocked(df, keys, 1)
    nxt, turn = [f"__n{k}" for k in range(4)], [f"__d{k}" for k in range(4)]
    rows = rows.withColumns({**{n: F.lead(c).over(w) for n, c in zip(nxt, q)}, "__dt": F.lead(time).over(w) - F.col(time)})
    rows = own(rows.where(F.col("pos") < F.col("n") - 1)).withColumn("n", F.col("n") - 1)
    # step by step, so that no step's expression is written out more than once in the next
    product = Qn.mul(Qn.conj(tuple(F.col(c) for c in q)), tuple(F.col(c) for c in nxt))
    rows = rows.withColumns(dict(zip(turn, product)))
    rows = rows.withColumn("__v", Qn.magnitude([F.col(c) for c in turn[1:]]))
    angle = F.when(F.col("__v") > 1e-12, F.try_divide(2 * F.asin(F.least(F.col("__v"), F.lit(1.0))), F.col("__v"))).otherwise(2.0)
    rows = rows.withColumn("__k", F.when(F.col(turn[0]) < 0, -angle).otherwise(angle) / F.greatest(F.col("__dt"), F.lit(1e-9)))
    omega = [F.col(c) * F.col("__k") for c in turn[1:]]
    made = dict(zip(outs, (F.col(time) + F.col("__dt") / 2, *omega))) | ({step: F.col("__dt")} if step else {})
    return rows.withColumns(made).drop(*nxt, *turn, "__dt", "__v", "__k")


def angle_integral(df: DataFrame, keys: Sequence[str], values: Sequence[str], fs: float, outs: Sequence[str]) -> DataFrame:
    """Cumulative sums over the sample rate."""
    rows = running_sums(df, keys, values, outs)
    return rows.withColumns({o: F.col(o) / fs for o in outs})


def _flagged(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    rows = df.withColumn("__sh", F.floor(F.col("pos") / F.lit(SHARD)).cast("long"))
    return neighbour(rows, keys, "__sh", ["pos"], ["pos", *cols], "__prev").drop("__sh")


def dedup_flags(df: DataFrame, keys: Sequence[str], cols: Sequence[str], flag: str = "is_new") -> DataFrame:
    """True on the first row of a series and wherever any column differs from the row before."""
    rows = _flagged(df, keys, cols)
    same = F.col("__prev").isNotNull()
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col("__prev").getField(c))
    return rows.withColumn(flag, ~same).drop("__prev")


def consecutive_dedupe(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Keep the first row of each run of equal rows; pos and n stay those of the full series."""
    return dedup_flags(df, keys, cols, "__new").where("__new").drop("__new")


def dedup_index(df: DataFrame, keys: Sequence[str], cols: Sequence[str], out: str = "dedup_idx") -> DataFrame:
    """Number of the deduplicated row each row belongs to, from 0."""
    rows = dedup_flags(df, keys, cols, "__new").withColumn("__one", F.col("__new").cast("long"))
    return running_sum(rows, keys, "__one", out).withColumn(out, F.col(out) - 1).drop("__new", "__one")


def hemisphere(df: DataFrame, keys: Sequence[str], q: Sequence[str], jump: float | None = None) -> DataFrame:
    """Flip signs so that successive quaternions stay on one side.

    A flip begins where raw neighbours point apart (or, with ``jump``, lie further apart than it);
    an odd number of flips so far negates.  -0.0 is written as 0.0 of the negated value.
    """
    rows = _flagged(df, keys, q)
    prev = [F.col("__prev").getField(c) for c in q]
    if jump is None:
        turn = sum((F.col(c) * p for c, p in zip(q, prev)), F.lit(0.0)) < 0
    else:
        turn = F.sqrt(sum(((F.col(c) - p) * (F.col(c) - p) for c, p in zip(q, prev)), F.lit(0.0))) > jump
    rows = rows.withColumn("__turn", F.coalesce(turn, F.lit(False)).cast("long")).drop("__prev")
    rows = running_sum(rows, keys, "__turn", "__turns")
    odd = F.col("__turns") % 2 == 1
    return rows.withColumns({c: F.when(odd, -F.col(c)).otherwise(F.col(c)) for c in q}).drop("__turn", "__turns")


def sign_pin(df: DataFrame, keys: Sequence[str], q: Sequence[str], changed: str) -> DataFrame:
    """Signs of changed rows follow the row before as written; unchanged rows are never flipped.

    Unchanged rows (and the first) restart the count; so does a product of exactly zero.
    """
    rows = _flagged(df, keys, q)
    prev = [F.col("__prev").getField(c) for c in q]
    d = F.coalesce(sum((F.col(c) * p for c, p in zip(q, prev)), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("__turn", (d < 0).cast("long")).withColumn("__anchor", (~F.col(changed) | (d == 0)).cast("long")).drop("__prev")
    rows = rows.withColumn("__turn", F.when(F.col("__anchor") == 1, 0).otherwise(F.col("__turn")))
    rows = durable(running_sum(rows, keys, "__turn", "__turns"))
    # turns before the segment's anchor: the running count there, which its row carries
    rows = rows.withColumn("__sh", F.floor(F.col("pos") / F.lit(SHARD)).cast("long"))
    at_anchor = F.when(F.col("__anchor") == 1, F.col("__turns"))
    local = Window.partitionBy(*keys, "__sh").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = {"__cb": lambda w: F.last("__la", True).over(w.rowsBetween(Window.unboundedPreceding, -1))}
    rows = with_carry(rows, keys, "__sh", {"__la": F.max_by(at_anchor, F.when(F.col("__anchor") == 1, F.col("pos")))}, before)
    base = F.coalesce(F.last(at_anchor, True).over(local), F.col("__cb"), F.lit(0))
    rows = rows.withColumn("__odd", (F.col("__turns") - base) % 2 == 1)
    out = rows.withColumns({c: F.when(F.col("__odd"), -F.col(c)).otherwise(F.col(c)) for c in q})
    return out.drop("__turn", "__turns", "__anchor", "__sh", "__cb", "__odd")


def fill_flagged(df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], bad: str) -> DataFrame:
    """Readings flagged bad become linear in time between good ones, constant beyond them.

    A series with no good reading is left as it is.
    """
    rows = df.withColumn("__sh", F.floor(F.col("pos") / F.lit(SHARD)).cast("long")).repartition(*keys, "__sh")
    good = F.when(~F.col(bad), F.struct("pos", F.col(time).alias("t"), *values))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    after = lambda w: w.rowsBetween(1, Window.unboundedFollowing)
    aggs = {"__first": F.min(good), "__last": F.max(good)}
    rows = with_carry(rows, keys, "__sh", aggs, {"__cl": lambda w: F.last("__last", True).over(before(w)), "__cf": lambda w: F.first("__first", True).over(after(w))})
    local = Window.partitionBy(*keys, "__sh").orderBy("pos")
    lo = F.coalesce(F.last(good, True).over(local.rowsBetween(Window.unboundedPreceding, 0)), F.col("__cl"))
    hi = F.coalesce(F.first(good, True).over(local.rowsBetween(0, Window.unboundedFollowing)), F.col("__cf"))
    rows = rows.withColumn("__lo", lo).withColumn("__hi", hi)
    f = F.try_divide(F.col(time) - F.col("__lo.t"), F.col("__hi.t") - F.col("__lo.t"))
    new = {
        v: F.when(~F.col(bad), F.col(v)).otherwise(
            F.coalesce(F.col(f"__lo.{v}") + (F.col(f"__hi.{v}") - F.col(f"__lo.{v}")) * f, F.col(f"__lo.{v}"), F.col(f"__hi.{v}"), F.col(v))
        )
        for v in values
    }
    return rows.withColumns(new).drop("__sh", "__cl", "__cf", "__lo", "__hi")
