"""Implausible readings: physical bounds, stuck runs, and spikes by a Hampel filter per source.

A series is numbered densely per source (no source sits in one task) and cut into blocks of
positions with a halo, in which numpy computes, for every reading,

* ``dev``: its distance from the rolling median around it,
* ``lift``: how far the one or two readings leave the straight course between their neighbours,
  where that is more than the course itself moves (a turn or a step isn't an excursion) and more
  than twice what the slopes on both sides already bend it (nor is the top of a turn),
* whether it belongs to a run of at least ``stuck_run`` equal readings.

What is usual for a source comes from all its readings: the median change from reading to reading
and the median absolute deviation from the rolling median, both exact at every length.  A block that
is its source's only one tells them itself; the blocks of a longer source tell their values, from
which ``exact_medians`` selects.  A reading is a spike if ``dev`` and ``lift`` both exceed multiples
of that scale.

Nulls and NaN are never flagged and don't interrupt a run.  Repeated records count once.  Sources
of fewer than ``MIN_READINGS`` readings get no spike flags.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrolith.operators.aggregates import exact_medians
from gyrolith.operators.shards import dense_position, floats, map_group_chunks, place, with_halo
from gyrolith.session import durable

BLOCK, HALO, MIN_READINGS = 4096, 64, 8


@dataclass(frozen=True)
class Rule:
    """How one field of readings is judged.

    columns: one for a scalar, several for a vector; sign_free: v and -v are one reading;
    equal_within: largest difference of components in a stuck run; hampel, lift: multiples of the
    source's scale; half_window: of the rolling median.
    """

    field: str
    columns: tuple[str, ...]
    sign_free: bool = False
    equal_within: float = 0.0
    hampel: float = 2.0
    lift: float = 5.0
    half_window: int = 3
    stuck_run: int = 15


def _aligned(ref: np.ndarray, v: np.ndarray, sign_free: bool) -> np.ndarray:
    if not sign_free:
        return v
    s = np.where(np.einsum("ij,ij->i", ref, v) < 0, -1.0, 1.0)
    return v * s[:, None]


def _gap(a: np.ndarray, b: np.ndarray, sign_free: bool) -> np.ndarray:
    return np.linalg.norm(a - _aligned(a, b, sign_free), axis=1)


def rolling_dev(v: np.ndarray, group: np.ndarray, half: int, sign_free: bool) -> np.ndarray:
    """Distance of each row from the rolling median of its window (nearest rows at a group's ends)."""
    n = len(v)
    first = np.r_[True, group[1:] != group[:-1]]
    starts = np.flatnonzero(first)
    lo = starts[np.cumsum(first) - 1]
    hi = np.r_[starts[1:], n][np.cumsum(first) - 1] - 1
    i = np.arange(n)
    window = np.stack([_aligned(v, v[np.clip(i + o, lo, hi)], sign_free) for o in range(-half, half + 1)])
    return np.linalg.norm(v - np.median(window, axis=0), axis=1)


def excursion(v: np.ndarray, group: np.ndarray, sign_free: bool) -> np.ndarray:
    """Per row the largest excursion of length one or two it belongs to, 0 if none."""
    n = len(v)
    out = np.zeros(n)
    for length in (1, 2):
        i = np.arange(1, n - length)
        if not len(i):
            continue
        inside = group[i - 1] == group[i + length]
        a, b = v[i - 1], _aligned(v[i - 1], v[i + length], sign_free)
        course = np.linalg.norm(b - a, axis=1)
        # the next readings outward; at an end of the series the other side stands for both
        before, after = np.maximum(i - 2, 0), np.minimum(i + length + 1, n - 1)
        has_before = (i >= 2) & (group[before] == group[i])
        has_after = (i + length + 1 < n) & (group[after] == group[i])
        rise, fall = a - _aligned(a, v[before], sign_free), b - _aligned(a, v[after], sign_free)
        lift = np.full(len(i), np.inf)
        for o in range(length):
            f = (o + 1) / (length + 1)
            line = a * (1 - f) + b * f
            away = _aligned(line, v[i + o], sign_free) - line
            gap = np.linalg.norm(away, axis=1)
            # a parabola with these slopes leaves the line by a third (one reading) or half (two) of
            # them; a slope on one side only, as at a step, doesn't count
            toward = [np.where(has, np.einsum("ij,ij->i", x, away) / np.maximum(gap, 1e-300), np.inf) for has, x in ((has_before, rise), (has_after, fall))]
            bend = np.minimum(*toward) * (1 / 3 if length == 1 else 1 / 2)
            lift = np.minimum(lift, np.where(gap > 2 * bend, gap, 0.0))
        lift = np.where(inside & (lift > course), lift, 0.0)
        for o in range(length):
            np.maximum.at(out, i + o, lift)
    return out


def stuck(v: np.ndarray, group: np.ndarray, within: float, sign_free: bool, least: int) -> np.ndarray:
    """Rows in a run of at least ``least`` rows of which each equals the one before."""
    n = len(v)
    if n < 2:
        return np.zeros(n, bool)
    with np.errstate(over="ignore", invalid="ignore"):
        same = (np.abs(v[1:] - v[:-1]) <= within).all(axis=1)
        if sign_free:
            same |= (np.abs(v[1:] + v[:-1]) <= within).all(axis=1)
    same &= group[1:] == group[:-1]
    run = np.cumsum(np.r_[True, ~same]) - 1
    return np.bincount(run)[run] >= least


def _medians(x: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    o = np.lexsort((x, code))
    x, code = x[o], code[o]
    count = np.bincount(code, minlength=n)
    start = np.r_[0, np.cumsum(count)[:-1]]
    out = np.full(n, np.nan)
    has = count > 0
    mid = start[has] + (count[has] - 1) // 2
    mid2 = start[has] + count[has] // 2
    out[has] = (x[mid] + x[mid2]) / 2
    return out


def judge(df: DataFrame, entity: Sequence[str], pos: str, key: str, rules: Sequence[Rule], impossible: dict[str, Column]) -> DataFrame:
    """Rows (entity..., key, field, reason) of the readings of numbered series that can't be right.

    df: entity..., ``pos`` (dense position in the source), ``key`` (bigint), the rules' columns.
    impossible: per rule field a boolean column; those readings are flagged 'bound' and take no
    part in the course or scale of their source.
    """
    ent = list(entity)
    cols = list(dict.fromkeys(c for r in rules for c in r.columns))
    flags = [F.coalesce(impossible[r.field], F.lit(False)).alias(f"__bad{n}") for n, r in enumerate(rules)]
    base = df.select(*ent, pos, key, *[F.col(c).cast("double").alias(c) for c in cols], *flags)
    base = with_halo(base, pos, BLOCK, HALO, "__blk")
    types = dict(base.dtypes)

    def run(tab: pa.Table, group: np.ndarray) -> pa.Table:
        p = tab.column(pos).to_numpy()
        o = np.lexsort((p, group))
        tab, group, p = tab.take(pa.array(o)), group[o], p[o]
        blk = tab.column("__blk").to_numpy()
        own = p // BLOCK == blk
        parts = []
        for n, rule in enumerate(rules):
            v = np.stack([floats(tab, c) for c in rule.columns], axis=1)
            bad = tab.column(f"__bad{n}").to_numpy(zero_copy_only=False).astype(bool)
            known = np.flatnonzero(np.isfinite(v).all(axis=1))
            if not len(known):
                continue
            is_stuck = np.zeros(len(v), bool)
            is_stuck[known] = stuck(v[known], group[known], rule.equal_within, rule.sign_free, rule.stuck_run)
            good = known[~bad[known]]
            dev, lift = np.zeros(len(v)), np.zeros(len(v))
            gg = group[good]
            if len(good):
                dev[good] = rolling_dev(v[good], gg, rule.half_window, rule.sign_free)
                lift[good] = excursion(v[good], gg, rule.sign_free)
            # what is usual: one row a block that is the source's only one, else two with its values
            mine = own[good]
            codes = np.unique(group)
            step = np.full(len(good), np.nan)
            if len(good) > 1:
                step[1:] = np.where(gg[1:] == gg[:-1], _gap(v[good][:-1], v[good][1:], rule.sign_free), np.nan)
            c = np.searchsorted(codes, gg)
            ok = mine & ~np.isnan(step)
            change = _medians(step[ok], c[ok], len(codes))
            scatter = _medians(dev[good][mine], c[mine], len(codes))
            count = np.bincount(c[mine], minlength=len(codes)).astype(float)
            rows, ends = np.searchsorted(group, codes), np.searchsorted(group, codes, "right")
            lone = (blk[rows] == 0) & (p[ends - 1] < BLOCK)
            parts.append((rows[lone], n, np.zeros(lone.sum(), np.int8), change[lone], scatter[lone], count[lone]))
            for k in np.flatnonzero(~lone).tolist():
                for code, x in ((4, step[ok & (c == k)]), (5, dev[good][mine & (c == k)])):
                    parts.append((rows[k : k + 1], n, np.full(1, code, np.int8), np.zeros(1), np.zeros(1), np.zeros(1), [x]))
            pick = np.flatnonzero(own & (lift > 0))
            parts.append((pick, n, np.full(len(pick), 1, np.int8), dev[pick], lift[pick], np.zeros(len(pick))))
            for code, what in ((2, is_stuck & own), (3, bad & own)):
                pick = np.flatnonzero(what)
                parts.append((pick, n, np.full(len(pick), code, np.int8), np.zeros(len(pick)), np.zeros(len(pick)), np.zeros(len(pick))))
        if not parts:
            return None
        rows = np.concatenate([x[0] for x in parts])
        out = tab.select([*ent, key]).take(pa.array(rows))
        rule_no = np.concatenate([np.full(len(x[0]), x[1], np.int32) for x in parts])
        out = out.append_column("rule", pa.array(rule_no)).append_column("kind", pa.array(np.concatenate([x[2] for x in parts]).astype(np.int32)))
        for k, name in enumerate(("a", "b", "n")):
            out = out.append_column(name, pa.array(np.concatenate([x[3 + k] for x in parts]), from_pandas=True))
        values = [v for x in parts for v in (x[6] if len(x) > 6 else [None] * len(x[0]))]
        return out.append_column("values", pa.array(values, pa.list_(pa.float64())))

    schema = ", ".join(f"`{k}` {types[k]}" for k in (*ent, key)) + ", rule int, kind int, a double, b double, n double, values array<double>"
    # candidates and block summaries only; read several times below, so it is written once
    told = durable(map_group_chunks(base, [*ent, "__blk"], run, schema))
    usual = told.where("kind = 0").select(*ent, "rule", F.col("a").alias("change"), F.col("b").alias("scatter"), F.col("n").alias("total"))
    spread_out = exact_medians(told.where("kind >= 4").select(*ent, "rule", "kind", F.explode("values").alias("v")), [*ent, "rule", "kind"], "v")
    of = lambda kind, x: F.max(F.when(F.col("kind") == kind, F.col(x)))
    usual = usual.unionByName(spread_out.groupBy(*ent, "rule").agg(of(4, "median").alias("change"), of(5, "median").alias("scatter"), of(5, "total").cast("double").alias("total")))
    limits = F.array(*[F.struct(F.lit(r.hampel).alias("hampel"), F.lit(r.lift).alias("lift"), F.lit(r.field).alias("field")) for r in rules])
    limit = lambda f: limits[F.col("rule")].getField(f)
    # a source that never changes has scale 0: then any excursion stands out, unless it is rounding
    scale = F.greatest(F.col("change"), F.lit(1e-9))
    spread = F.greatest(F.col("change"), F.col("scatter") * 1.4826, F.lit(1e-9))
    spikes = told.where("kind = 1").join(usual, [*ent, "rule"])
    spikes = spikes.where((F.col("total") >= MIN_READINGS) & (F.col("b") > limit("lift") * scale) & (F.col("a") > limit("hampel") * spread))
    spikes = spikes.select(*ent, key, "rule", F.lit("spike").alias("reason"))
    rest = told.where("kind in (2, 3)").select(*ent, key, "rule", F.when(F.col("kind") == 2, "stuck").otherwise("bound").alias("reason"))
    return spikes.unionByName(rest).select(*ent, key, limit("field").alias("field"), "reason")


#: Fixed values of the telemetry tables: largest deviation of a quaternion's length from 1, largest
#: plausible rate of a light axis in degrees a second.
MAX_NORM_ERROR, MAX_LIGHT = 0.05, 2000.0


def telemetry_outliers(telemetry: DataFrame, shard_s: float = 16.0) -> DataFrame:
    """(series_id, clip_no, idx, field 'q', reason) over one row per record of ``telemetry``."""
    ent = ["series_id", "clip_no"]
    rows = telemetry.select(*ent, "idx", "t", "w", "x", "y", "z").dropna(subset=[*ent, "idx"])
    norm = F.sqrt(sum(F.col(c) * F.col(c) for c in "wxyz"))
    finite = ~F.isnan(norm) & norm.isNotNull()
    known = rows.where(finite & F.col("t").isNotNull() & ~F.isnan("t") & (norm > 0))
    placed = place(known.withColumn("__sh", F.floor(F.col("t") / F.lit(shard_s)).cast("long")), ent, "__sh")
    known = dense_position(placed.dropDuplicates([*ent, "__sh", "idx"]), ent, "__sh", ["t", "idx"], "pos", tie=placed.columns)
    bad = F.abs(norm - 1) > MAX_NORM_ERROR
    rule = Rule("q", ("w", "x", "y", "z"), sign_free=True, equal_within=1e-6, lift=3.0)
    judged = judge(known, ent, "pos", "idx", [rule], {"q": bad}).where("reason <> 'bound'")
    bound = rows.where(finite & bad).select(*ent, "idx", F.lit("q").alias("field"), F.lit("bound").alias("reason")).distinct()
    return judged.unionByName(bound)


def clean_outliers(clean: DataFrame, shard_rows: int = 8192) -> DataFrame:
    """(series_id, clip_no, idx, field 'noise' | 'light', reason) over one row per record."""
    ent, axes = ["series_id", "clip_no"], ("light_x", "light_y", "light_z")
    rows = clean.select(*ent, "idx", "noise", *axes).dropna(subset=[*ent, "idx"])
    placed = place(rows.withColumn("__sh", F.floor(F.col("idx") / F.lit(shard_rows)).cast("long")), ent, "__sh")
    rows = placed.dropDuplicates([*ent, "__sh", "idx"])
    # each field is numbered without its nulls, so that a halo holds as many readings of it
    fields = ("noise", *axes)
    each = F.array(*[F.struct(F.lit(c).alias("__field"), F.col(c).cast("double").alias("__v")) for c in fields])
    rows = rows.select(*ent, "idx", "__sh", *fields, F.inline(each)).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    rows = dense_position(rows, [*ent, "__field"], "__sh", ["idx"], "pos", tie=placed.columns)
    rows = rows.select(*ent, "__field", "idx", "pos", *[F.when(F.col("__field") == c, F.col("__v")).alias(c) for c in fields])
    rules = [Rule("noise", ("noise",), lift=8.0), *[Rule(a, (a,), lift=5.0) for a in axes]]
    impossible = {"noise": F.col("noise") < 0} | {a: F.abs(F.col(a)) > MAX_LIGHT for a in axes}
    impossible = {k: v & ~F.isnan(k) for k, v in impossible.items()}
    found = judge(rows, [*ent, "__field"], "pos", "idx", rules, impossible).drop("__field")
    return found.withColumn("field", F.when(F.col("field").startswith("light"), "light").otherwise(F.col("field"))).distinct()
