"""Aggregations over series and segments; all combine map-side, none collects a group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyrolith.operators.windows import difference


def exact_medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., median, total) of a column per key.

    Counts by bins of about one percent tell which bins hold the middle; only their values are
    counted one by one, so no task and no aggregation buffer holds a key's values.  Values must be 0
    or more, no null or NaN.  ``df`` is read twice.
    """
    key = list(keys)
    bins = df.groupBy(*key, F.floor(F.log2(F.greatest(value, F.lit(1e-300))) * 64).alias("__bin"))
    w = Window.partitionBy(*key)
    bins = bins.agg(F.count(F.lit(1)).alias("__n"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    bins = bins.withColumn("__upto", F.sum("__n").over(w.orderBy("__bin"))).withColumn("total", F.sum("__n").over(w))
    first, second = F.expr("(total - 1) div 2"), F.expr("total div 2")  # ranks of the middle from 0
    before = F.col("__upto") - F.col("__n")
    middle = bins.where((F.col("__upto") > first) & (before <= second)).select(*key, "__bin", "__lo", "__hi", before.alias("__before"), "total")
    near = df.select(*key, value).join(middle, key).where((F.col(value) >= F.col("__lo")) & (F.col(value) <= F.col("__hi")))
    near = near.groupBy(*key, "__bin", "__before", "total", value).agg(F.count(F.lit(1)).alias("__n"))
    near = near.withColumn("__upto", F.col("__before") + F.sum("__n").over(Window.partitionBy(*key, "__bin").orderBy(value)))
    at = lambda k: F.min(F.when(F.col("__upto") > k, F.col(value)))
    return near.groupBy(*key, "total").agg(((at(first) + at(second)) / 2).alias("median"))


def sample_rate(df: DataFrame, keys: Sequence[str], time: str, out: str = "fs") -> DataFrame:
    """1 / median step per series in order of time; no row for a series of fewer than two times."""
    steps = difference(df.select(*keys, "pos", "n", time), keys, [time], ["__d"]).where(F.col("__d").isNotNull() & ~F.isnan("__d"))
    return exact_medians(steps.select(*keys, "__d"), keys, "__d").select(*keys, F.try_divide(F.lit(1.0), F.col("median")).alias(out))


def local_rate(df: DataFrame, keys: Sequence[str], time: str, first: int = 100, default: float = 100.0, out: str = "fps") -> DataFrame:
    """Rate from the first readings only; the default for a single reading."""
    steps = difference(df.where(F.col("pos") < first), keys, [time], ["__d"])
    mid = F.percentile("__d", 0.5)  # of at most ``first`` values
    return steps.groupBy(*keys).agg(F.coalesce(F.try_divide(F.lit(1.0), mid), F.lit(default)).alias(out))


def segment_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, mean, population deviation, extremes per segment."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"))


def share(flag: Column) -> Column:
    """Fraction of rows where the flag is true; null flags count as false."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("double"))


def rms(values: Sequence[Column]) -> Column:
    total = values[0] * values[0]
    for v in values[1:]:
        total = total + v * v
    return F.sqrt(F.avg(total))


def nan_count(value: Column) -> Column:
    return F.count_if(F.isnan(value))


def first_of(value: Sequence[str], order: str, out: str = "first") -> Column:
    """The columns of the first row in order (lowest wins)."""
    return F.min_by(F.struct(*value), F.col(order)).alias(out)


def best_of(df: DataFrame, keys: Sequence[str], score: str, candidate: str, values: Sequence[str]) -> DataFrame:
    """The row of the highest score per key; of equals the smallest candidate.  Null and NaN never win."""
    rank = F.struct(F.col(score), -F.col(candidate))
    ok = F.col(score).isNotNull() & ~F.isnan(score)
    best = df.where(ok).groupBy(*keys).agg(F.max_by(F.struct(candidate, score, *[v for v in values if v not in (candidate, score)]), rank).alias("b"))
    return best.select(*keys, "b.*")


def mean_correlation(pairs: Sequence[tuple[str, str]]) -> Column:
    """Mean Pearson correlation of column pairs; null where one doesn't vary."""
    parts = [F.corr(a, b) for a, b in pairs]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / len(parts)


def r_squared(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], out: str = "r2") -> DataFrame:
    """1 - residual over total sum of squares, axes pooled, each about its own mean.

    One pass: sums of squares about the mean from ``var_pop`` and the count.
    """
    res = tot = F.lit(0.0)
    for seen, made in pairs:
        d = F.col(seen) - F.col(made)
        res = res + F.sum(d * d)
        tot = tot + F.var_pop(seen) * F.count(seen)
    return df.groupBy(*keys).agg((1 - F.try_divide(res, tot)).alias(out))


def cross_moments(df: DataFrame, keys: Sequence[str], b: Sequence[str], a: Sequence[str]) -> DataFrame:
    """The nine sums of b_i a_j as an array of rows ``m``."""
    m = F.array(*[F.array(*[F.sum(F.col(x) * F.col(y)) for y in a]) for x in b])
    return df.groupBy(*keys).agg(m.alias("m"))


MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))


@F.pandas_udf(MATRIX)
def nearest_rotation(m: pd.Series) -> pd.Series:
    """Orthogonal matrix (reflections allowed) closest to each 3x3; null for null or non-finite ones."""

    def one(x: object) -> list | None:
        if x is None:
            return None
        a = np.array([list(r) for r in x], float)
        if not np.isfinite(a).all():
            return None
        u, _, vt = np.linalg.svd(a)
        return (u @ vt).tolist()

    return m.map(one)


def procrustes(df: DataFrame, keys: Sequence[str], b: Sequence[str], a: Sequence[str]) -> DataFrame:
    """Per key the orthogonal map N that takes b nearest to a (b N ~ a)."""
    return cross_moments(df, keys, b, a).withColumn("n", nearest_rotation("m")).drop("m")


def least_squares(df: DataFrame, keys: Sequence[str], x: Sequence[str], y: Sequence[str]) -> DataFrame:
    """Per key the 3x3 map M with x M ~ y, by normal equations in closed form (Cramer).

    Null where x doesn't span three directions.
    """
    s = {(p, q): F.sum(F.col(p) * F.col(q)) for p in x for q in (*x, *y)}
    names = {k: f"s{i}" for i, k in enumerate(s)}
    sums = df.groupBy(*keys).agg(*[c.alias(names[k]) for k, c in s.items()])
    A = [[F.col(names[(p, q)]) for q in x] for p in x]
    B = [[F.col(names[(p, q)]) for q in y] for p in x]
    det = lambda m: (
        m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    )
    whole = det(A)
    swap = lambda col, j: [[B[r][j] if c == col else A[r][c] for c in range(3)] for r in range(3)]
    m = F.array(*[F.array(*[F.try_divide(det(swap(i, j)), whole) for j in range(3)]) for i in range(3)])
    return sums.select(*keys, m.alias("m"))


def total_length(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    return intervals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b") - F.col("a")).alias("seconds"))
