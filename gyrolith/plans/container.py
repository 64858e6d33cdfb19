"""From container samples to orientation streams and back: slots, the patch plan, its checks.

Series are files: key column ``path``.  Nothing is collected; a file's errors become status rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrolith.functions import quat as Qn
from gyrolith.operators import windows as W
from gyrolith.operators.shards import place, shard_summary
from gyrolith.session import durable

FILE = ["path"]


def slots(samples: DataFrame, sensor_fps: float = 100.0) -> DataFrame:
    """One row per stored orientation: path, slot order (sample, j), offs, f0..f3 (file frame),
    w, x, y, z (output frame), t_ms, whole (no component omitted).

    Times: the frame's since the first frame that has both time and orientations, plus the place
    in the frame.  NaN and all-zero orientations are no slots.
    """
    rows = samples.where(F.size("atts") > 0)
    rows = rows.select("path", "sample", "frame_ts", "att_offset", "start_ts", F.size("atts").alias("__n"), F.posexplode("atts").alias("j", "a"))
    f = tuple(F.col("a.vals")[k].cast("double") for k in range(4))
    t = (F.col("frame_ts") - F.col("start_ts")) / 1000.0 + ((F.col("j") - F.col("att_offset").cast("double")) / F.col("__n")) * (1000.0 / sensor_fps)
    rows = rows.select("path", "sample", "j", "a.offs", *[c.alias(f"f{k}") for k, c in enumerate(f)], t.alias("t_ms"))
    out = Qn.file_to_out(tuple(F.col(f"f{k}") for k in range(4)))
    # told by the stored components: a test of w, x, y, z would have their products written out again for every mention.
    # The turn is a product with zeros among its factors, so that an infinite component, too, makes NaN.
    size = F.greatest(*[F.abs(F.col(f"f{k}")) for k in range(4)])
    rows = rows.where((size > 0) & (size < float("inf"))).withColumns(dict(zip("wxyz", out)))
    return rows.withColumn("whole", ~F.exists("offs", lambda o: o.isNull()))


def extract(stream: DataFrame, keys: Sequence[str], time: Column, order: Sequence[str], shard_s: float = 16.0) -> DataFrame:
    """The orientation series of a stream: sorted by time (ties in order), runs of equal values as
    one, signs continuous, unit length; adds t (s), pos, n.  Columns w, x, y, z.

    Rows of equal time and order are copies of one record and count once.  One shuffle to time
    shards does all of it: a row is kept or turned by the row before it, a shard's first row by the
    last of the shard before, and kept rows and turns are counted over one row a shard.
    """
    keys, q = list(keys), ("w", "x", "y", "z")
    base = place(stream.withColumn("t", time).withColumn("__sh", F.floor(F.col("t") / F.lit(shard_s)).cast("long")), keys, "__sh")
    w = Window.partitionBy(*keys, "__sh").orderBy("t", *order, *q)
    state, by = F.struct(*q), F.struct("t", *order, *q)

    def told(now: Sequence[Column], before: str) -> tuple[Column, Column]:
        """1 where a row differs from the one before, and where it points away from it."""
        past = [F.col(before).getField(c) for c in q]
        differs = F.lit(False)
        for c, p in zip(now, past):
            differs = differs | ~c.eqNullSafe(p)
        return differs.cast("long"), F.coalesce(Qn.dot(now, past) < 0, F.lit(False)).cast("long")

    rows = base.withColumn("__p", F.lag(F.struct("t", *order, *q)).over(w))
    same = F.lit(True)
    for c in ("t", *order):
        same = same & F.col(c).eqNullSafe(F.col("__p").getField(c))
    rows = rows.where(F.col("__p").isNull() | ~same)
    new, turn = told([F.col(c) for c in q], "__p")
    inner = F.col("__p").isNotNull()
    rows = rows.withColumns({"__new": F.when(inner, new), "__turn": F.when(inner, turn)}).drop("__p")
    shards = shard_summary(rows, keys, "__sh", {"__f": F.min_by(state, by), "__l": F.max_by(state, by), "__a": F.sum("__new"), "__b": F.sum("__turn")}, base.columns)
    ws = Window.partitionBy(*keys).orderBy("__sh")
    shards = shards.withColumn("__p", F.lag("__l").over(ws))
    new, turn = told([F.col("__f").getField(c) for c in q], "__p")
    none = F.col("__p").isNull()
    shards = shards.withColumns({"__fn": F.when(none, 1).otherwise(new), "__ft": F.when(none, 0).otherwise(turn)})
    shards = shards.withColumns({"__a": F.coalesce("__a", F.lit(0)) + F.col("__fn"), "__b": F.coalesce("__b", F.lit(0)) + F.col("__ft")})
    past = lambda c: F.coalesce(F.sum(c).over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select(*keys, "__sh", "__fn", "__ft", past("__a").alias("__kept"), past("__b").alias("__turns"), F.sum("__a").over(Window.partitionBy(*keys)).alias("n"))
    rows = rows.join(shards, [*keys, "__sh"])
    rows = rows.withColumns({"__new": F.coalesce("__new", "__fn"), "__turn": F.coalesce("__turn", "__ft")})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"pos": F.col("__kept") + F.sum("__new").over(upto) - 1, "__odd": (F.col("__turns") + F.sum("__turn").over(upto)) % 2 == 1}).where("__new = 1")
    unit = Qn.normalise([F.when(F.col("__odd"), -F.col(c)).otherwise(F.col(c)) for c in q])
    return rows.withColumns(dict(zip(q, unit))).drop("__sh", "__new", "__turn", "__fn", "__ft", "__kept", "__turns", "__odd")


def compare_positions(left: DataFrame, right: DataFrame, keys: Sequence[str], idx: str, cols: Sequence[str]) -> DataFrame:
    """Per key: rows on both sides, on one only, and the largest difference folding the sign."""
    keys = list(keys)
    a = left.select(*keys, idx, F.lit(True).alias("__in_a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = right.select(*keys, idx, F.lit(True).alias("__in_b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    both = a.join(b, [*keys, idx], "full")
    plus = F.greatest(*[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in cols])
    minus = F.greatest(*[F.abs(F.col(f"a_{c}") + F.col(f"b_{c}")) for c in cols])
    known = F.lit(True)
    for c in cols:
        for s in ("a_", "b_"):
            known = known & F.col(s + c).isNotNull() & ~F.isnan(s + c)
    return both.groupBy(*keys).agg(
        F.count_if(F.col("__in_a") & F.col("__in_b")).alias("n_both"),
        F.count_if(F.col("__in_b").isNull()).alias("n_left"),
        F.count_if(F.col("__in_a").isNull()).alias("n_right"),
        F.max(F.when(known, F.least(plus, minus))).alias("max_diff"),
    )


def numbered_slots(rows: DataFrame) -> DataFrame:
    """Slots in order of time (pos, n) with the number of the deduplicated orientation each belongs to; written once.

    One shuffle to time shards does both: a shard's first row is held against the last of the shard before.
    """
    q, order = ("w", "x", "y", "z"), ("t_ms", "sample", "j")
    state, by = F.struct(*q), F.struct(*order)

    def differs(now: Sequence[Column], before: str) -> Column:
        told = F.lit(False)
        for name, c in zip(q, now):
            told = told | ~c.eqNullSafe(F.col(before).getField(name))
        return told.cast("long")

    # written once, since files would be read again by each side of the join below
    base = place(durable(rows).withColumn("__sh", F.floor(F.col("t_ms") / 16000.0).cast("long")), FILE, "__sh")
    w = Window.partitionBy(*FILE, "__sh").orderBy(*order)
    x = base.withColumns({"__r": F.row_number().over(w), "__p": F.lag(state).over(w)})
    x = x.withColumn("__new", F.when(F.col("__p").isNotNull(), differs([F.col(c) for c in q], "__p"))).drop("__p")
    told = {"__c": F.count(F.lit(1)), "__f": F.min_by(state, by), "__l": F.max_by(state, by), "__a": F.coalesce(F.sum("__new"), F.lit(0))}
    shards = shard_summary(x, FILE, "__sh", told, base.columns)
    ws = Window.partitionBy(*FILE).orderBy("__sh")
    shards = shards.withColumn("__p", F.lag("__l").over(ws))
    shards = shards.withColumn("__fn", F.when(F.col("__p").isNull(), 1).otherwise(differs([F.col("__f").getField(c) for c in q], "__p")))
    past = lambda c: F.coalesce(F.sum(c).over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select(*FILE, "__sh", "__fn", past("__c").alias("__before"), past(F.col("__a") + F.col("__fn")).alias("__kept"), F.sum("__c").over(Window.partitionBy(*FILE)).alias("n"))
    x = x.join(shards, [*FILE, "__sh"])
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    number = F.col("__kept") + F.sum(F.coalesce("__new", "__fn")).over(upto) - 1
    x = x.withColumns({"pos": F.col("__before") + F.col("__r") - 1, "dedup_idx": number})
    return durable(x.drop("__sh", "__r", "__new", "__fn", "__before", "__kept"))


def patch_plan(rows: DataFrame, target: DataFrame | None) -> DataFrame:
    """What to write where: path, off, value, of ``numbered_slots`` and target orientations
    (path, dedup_idx, w, x, y, z in the output frame), or of no target: every stored value again.

    Orientations equal to the file's own keep their bytes.  Others are normalised, turned to the
    file's frame, and take the sign that follows the orientation written before.
    """
    if target is None:
        return _components(rows)
    first = F.min_by(F.struct("f0", "f1", "f2", "f3"), F.struct("sample", "j"))
    own = rows.groupBy("path", "dedup_idx").agg(first.alias("own"), F.first(F.struct("w", "x", "y", "z")).alias("out"))
    own = own.select("path", "dedup_idx", "own", *[F.col(f"out.{c}").alias(c) for c in "wxyz"])
    own = durable(own.withColumn("pos", F.col("dedup_idx")))  # one row a number, from 0: numbered as it is
    seen = W.hemisphere(own, FILE, ["w", "x", "y", "z"])
    seen = seen.withColumns({f"s{k}": c for k, c in enumerate(Qn.normalise(Qn.q_of()))})
    goal = target.select("path", "dedup_idx", *[F.col(c).alias(f"g{k}") for k, c in enumerate("wxyz")])
    both = seen.join(goal, ["path", "dedup_idx"])
    equal = F.lit(True)
    for k in range(4):
        equal = equal & (F.col(f"s{k}") == F.col(f"g{k}"))
    new = Qn.out_to_file(Qn.normalise(tuple(F.col(f"g{k}") for k in range(4))))
    both = both.withColumn("changed", ~F.coalesce(equal, F.lit(False)))
    both = both.withColumns({f"m{k}": F.when(F.col("changed"), c).otherwise(F.col(f"own.f{k}")) for k, c in enumerate(new)})
    both = durable(both.select("path", "dedup_idx", "pos", "changed", "m0", "m1", "m2", "m3"))
    pinned = W.sign_pin(both, FILE, ["m0", "m1", "m2", "m3"], "changed").select("path", "dedup_idx", "changed", "m0", "m1", "m2", "m3")
    merged = rows.join(pinned, ["path", "dedup_idx"])
    # unchanged slots keep their own stored value, not that of their run's first
    return _components(merged.withColumns({f"f{k}": F.when(F.col("changed"), F.col(f"m{k}")).otherwise(F.col(f"f{k}")) for k in range(4)}))


def _components(rows: DataFrame) -> DataFrame:
    parts = F.arrays_zip("offs", F.array(*[F.col(f"f{k}").cast("float") for k in range(4)]).alias("vals"))
    return rows.select("path", F.explode(parts).alias("c")).select("path", F.col("c.offs").alias("off"), F.col("c.vals").alias("value"))


def plan_problems(rows: DataFrame, plan: DataFrame, target: DataFrame | None) -> DataFrame:
    """(path, problem) of files that must not be written."""
    omitted = rows.where(~F.col("whole")).select("path", F.lit("omitted component").alias("problem")).distinct()
    bad = plan.where(F.isnan("value") | F.col("value").isNull()).select("path", F.lit("NaN").alias("problem")).distinct()
    out = omitted.unionByName(bad)
    if target is not None:
        have = rows.groupBy("path").agg((F.max("dedup_idx") + 1).alias("have"))
        want = target.groupBy("path").agg(F.count(F.lit(1)).alias("want"))
        off = have.join(want, FILE, "full").where(~F.col("have").eqNullSafe(F.col("want")))
        out = out.unionByName(off.select("path", F.lit("row count").alias("problem")))
    return out


def round_trip(plan: DataFrame, written: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Per file the components that don't read back as planned: (path, n, n_wrong), and with ``before``, the
    slots of the old file, also the slots whose time isn't the very same: n_slots, n_time_wrong.

    written: slots of the new file under the old path name."""
    again = _components(written).select("path", "off", F.col("value").alias("back"))
    both = plan.join(again, ["path", "off"], "full")
    values = both.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("value").eqNullSafe(F.col("back"))).alias("n_wrong"))
    if before is None:
        return values
    slot = ["path", "sample", "j"]
    times = before.select(*slot, F.lit(True).alias("__a"), F.col("t_ms").alias("t0")).join(written.select(*slot, F.lit(True).alias("__b"), F.col("t_ms").alias("t1")), slot, "full")
    same = F.col("__a").isNotNull() & F.col("__b").isNotNull() & F.col("t0").eqNullSafe(F.col("t1"))
    return values.join(times.groupBy("path").agg(F.count(F.lit(1)).alias("n_slots"), F.count_if(~same).alias("n_time_wrong")), "path", "left")


def decode_check(left: DataFrame, right: DataFrame, keys: Sequence[str], most_s: float = 1e-6, most_q: float = 1e-9) -> DataFrame:
    """Two orientation series (pos, t, w, x, y, z) of the same stream: (keys..., n_left, n_right, max_dt, max_dq, ok).

    Signs may differ for a series as a whole, not from row to row.  A row on one side only makes it not ok.
    """
    keys = list(keys)
    a = left.select(*keys, "pos", F.lit(1).alias("__a"), *[F.col(c).alias(f"a_{c}") for c in ("t", *"wxyz")])
    b = right.select(*keys, "pos", F.lit(1).alias("__b"), *[F.col(c).alias(f"b_{c}") for c in ("t", *"wxyz")])
    apart = lambda sign: F.max(F.greatest(*[F.abs(F.col(f"a_{c}") - sign * F.col(f"b_{c}")) for c in "wxyz"]))
    told = a.join(b, [*keys, "pos"], "full").groupBy(*keys).agg(
        F.count("__a").alias("n_left"), F.count("__b").alias("n_right"), F.max(F.abs(F.col("a_t") - F.col("b_t"))).alias("max_dt"), apart(1).alias("__p"), apart(-1).alias("__m")
    )
    told = told.withColumn("max_dq", F.least("__p", "__m")).drop("__p", "__m")
    return told.withColumn("ok", (F.col("n_left") == F.col("n_right")) & (F.col("max_dt") < most_s) & (F.col("max_dq") < most_q))


def probe(samples: DataFrame) -> DataFrame:
    """Number and sizes of samples per file, and how many carry orientations."""
    return samples.groupBy("path").agg(
        F.count("sample").alias("n"), F.min("sample_bytes").alias("least"), F.max("sample_bytes").alias("most"), F.count_if(F.size("atts") > 0).alias("n_with"), F.max("error").alias("error")
    )


def first_of_each(samples: DataFrame, n: int = 4) -> DataFrame:
    """The first samples of each file, for a look."""
    return samples.withColumn("__r", F.row_number().over(Window.partitionBy("path").orderBy("sample"))).where(F.col("__r") <= n).drop("__r")
