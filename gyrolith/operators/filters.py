"""Recursive filters over numbered series, spread over shards of positions.

Within a task a filter runs as a block scan: a block of L readings is one matrix product, and only
the state is carried from block to block.  The same affine step spreads a long series: its shards
are filtered independently once each knows the states it begins with.  A zero-phase filter needs two
of them, the forward state at the shard's left end and the backward state at its right end.  Both
follow from what every shard tells of itself from rest, in one pass over the data:

    forward:   z' = A^n z + e                      e: end state from rest
    backward:  w' = A^n w + g + M z                g: end state over the forward output from rest
                                                   M: what the forward state adds to it

M depends on lengths only, so a chain over one row a shard gives all states (``_chain``).  A series of
one shard knows its states itself and tells nothing.

A ``Pass`` is a numpy step over such shards: it prepares columns from rows around, filters them, and
finishes from filtered rows around, so that whole chains of series operators take one shuffle.  The
rate of a series is a column, ``fs``: filters and windows may differ from series to series.

Nulls count as NaN and spread, as in any recursion.  A series not longer than the padding can't be
filtered forward and backward: its output is null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.functions.design import Filter, states, steady
from gyrolith.operators.shards import floats, map_group_chunks
from gyrolith.session import durable

SHARD, LENGTH = 1 << 14, 32


@lru_cache(maxsize=64)
def _block(f: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matrices of LENGTH steps: outputs by inputs and by state, state by inputs and by state."""
    A, B, C, D = states(f)
    powers = [np.eye(len(B))]
    for _ in range(LENGTH):
        powers.append(A @ powers[-1])
    response = np.array([D, *[C @ powers[k] @ B for k in range(LENGTH - 1)]])
    T = np.zeros((LENGTH, LENGTH))
    for k in range(LENGTH):
        T[k:, k] = response[: LENGTH - k]
    return T, np.stack([C @ p for p in powers[:LENGTH]]), np.stack([powers[LENGTH - 1 - k] @ B for k in range(LENGTH)], axis=1), powers[LENGTH]


def lfilter(f: Filter, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered readings and the end state."""
    if not len(x):
        return x, z
    T, O, K, P = _block(f)
    whole = len(x) // LENGTH * LENGTH
    y = np.empty(len(x))
    if whole:
        parts = x[:whole].reshape(-1, LENGTH)
        push = parts @ K.T
        begin = np.empty_like(push)
        for k in range(len(parts)):
            begin[k] = z
            z = P @ z + push[k]
        y[:whole] = (parts @ T.T + begin @ O.T).ravel()
    n = len(x) - whole
    if n:
        tail = x[whole:]
        y[whole:] = T[:n, :n] @ tail + O[:n] @ z
        z = _power(f, n) @ z + K[:, LENGTH - n :] @ tail
    return y, z


def filtfilt(f: Filter, x: np.ndarray, padlen: int | None = None) -> np.ndarray:
    """Forward and backward over the readings continued by odd reflection at both ends."""
    p, n = f.padlen if padlen is None else padlen, len(x)
    if n <= p:
        return np.full(n, np.nan)
    ext = np.concatenate([2 * x[0] - x[p:0:-1], x, 2 * x[-1] - x[-2 : -p - 2 : -1]])
    zi = steady(f)
    y, _ = lfilter(f, ext, zi * ext[0])
    y, _ = lfilter(f, y[::-1], zi * y[-1])
    return y[::-1][p : p + n]


@lru_cache(maxsize=4096)
def _power(f: Filter, n: int) -> np.ndarray:
    return np.linalg.matrix_power(states(f)[0], n)


@lru_cache(maxsize=4096)
def _mixed(f: Filter, n: int) -> np.ndarray:
    """Backward end state over the n outputs that a forward state gives without input: sum A^t B C A^t, by doubling."""
    A, B, C, _ = states(f)
    if n == 0:
        return np.zeros_like(A)
    if n == 1:
        return np.outer(B, C)
    h = n // 2
    m = _mixed(f, h)
    m = m + _power(f, h) @ m @ _power(f, h)
    return m if n == 2 * h else m + _power(f, 2 * h) @ np.outer(B, C) @ _power(f, 2 * h)


#: A filter, the prepared columns it runs on, and how: 'both' ways, causal 'settled' (as if the first
#: reading had always been) or causal from 'rest'.
Job = tuple[Filter, Sequence[int], str]


@dataclass(frozen=True)
class Pass:
    """inputs: columns; outs: double columns added; around: rows ``prepare`` needs on each side;
    after_rows + after_s * fs: rows ``finish`` needs on each side; prepare(columns, fs) -> columns;
    jobs(fs) -> filters of those (None: this rate can't be filtered, outs are null); finish(columns,
    prepared, filtered, fs) -> outs, all of the same rows.  At a series' ends the rows just end there.
    tally(prepared) -> a sum over rows, whose mean over the whole series is the last of the outs.
    rate(columns) -> the rate of a series of one shard that comes without one; then ``fs`` is filled in."""

    inputs: Sequence[str]
    outs: Sequence[str]
    jobs: Callable[[float], list[Job] | None]
    prepare: Callable[[list[np.ndarray], float], list[np.ndarray]] = lambda x, fs: x
    finish: Callable[[list[np.ndarray], list[np.ndarray], list[np.ndarray], float], list[np.ndarray]] = lambda x, p, y, fs: y
    tally: Callable[[list[np.ndarray]], float] | None = None
    rate: Callable[[list[np.ndarray]], float] | None = None
    around: int = 0
    after_rows: int = 0
    after_s: float = 0.0

    def reach(self, fs: float) -> int:
        return self.after_rows + (int(np.ceil(self.after_s * fs)) if np.isfinite(fs) and fs > 0 else 0)


@dataclass(frozen=True)
class _Shard:
    """Where a shard begins and ends, where its filters run (u to v), and where the next ones' do."""

    number: int
    last: bool
    c0: int
    c1: int
    u: int
    v: int
    next_u: int
    prior_v: int


def _shard_at(k: int, n: int, size: int, h: int) -> _Shard:
    last = k == max(1, n // size) - 1
    c0, c1 = k * size, n if last else (k + 1) * size
    u = c0 - h if k else 0
    v = n if last else c1 + h
    return _Shard(k, last, c0, c1, u, v, n if last else c1 - h, c0 + h if k else 0)


def _ends(f: Filter, mode: str, x: np.ndarray, s: _Shard) -> tuple[np.ndarray, np.ndarray]:
    """What a shard tells of itself from rest; x: prepared readings u to v."""
    p = f.padlen
    zi = steady(f)
    z = np.zeros(len(zi))
    if mode != "both":
        if s.number == 0 and mode == "settled":
            z = zi * x[0]
        return lfilter(f, x[: s.next_u - s.u], z)[1], np.zeros(len(zi))
    head = 2 * x[0] - x[p:0:-1] if s.number == 0 else x[:0]
    tail = 2 * x[-1] - x[-2 : -p - 2 : -1] if s.last else x[:0]
    ext = np.concatenate([head, x, tail])
    if s.number == 0:
        z = zi * ext[0]
    cut = len(head) + s.next_u - s.u
    y0, end = lfilter(f, ext[:cut], z)
    y1, _ = lfilter(f, ext[cut:], end)
    y = np.concatenate([y0, y1])
    back = y[len(head) + s.prior_v - s.u if s.number else 0 :]
    w = zi * y[-1] if s.last else np.zeros(len(zi))
    return end, lfilter(f, back[::-1], w)[1]


def _run(f: Filter, mode: str, x: np.ndarray, s: _Shard, z: np.ndarray | None, w: np.ndarray | None) -> np.ndarray:
    """Filtered readings u to v, from the states the shard begins with."""
    zi = steady(f)
    if mode != "both":
        begin = z if z is not None else zi * x[0] if mode == "settled" and len(x) else np.zeros(len(zi))
        return lfilter(f, x, begin)[0]
    p = f.padlen
    if s.number == 0 and s.last:
        return filtfilt(f, x)
    head = 2 * x[0] - x[p:0:-1] if s.number == 0 else x[:0]
    tail = 2 * x[-1] - x[-2 : -p - 2 : -1] if s.last else x[:0]
    ext = np.concatenate([head, x, tail])
    y, _ = lfilter(f, ext, zi * ext[0] if z is None else z)
    y, _ = lfilter(f, y[::-1], zi * y[-1] if w is None else w)
    return y[::-1][len(head) : len(head) + len(x)]


def _chain(jobs: list[Job], told: list[tuple[_Shard, np.ndarray]]) -> list[np.ndarray]:
    """Begin states (forward, backward) of all jobs, one row a shard, from what the shards told."""
    out = [[] for _ in told]
    at = 0
    for f, columns, mode in jobs:
        order, p = len(steady(f)), f.padlen
        zi, C = steady(f), states(f)[2]
        for _ in columns:
            e = [row[at : at + order] for _, row in told]
            g = [row[at + order : at + 2 * order] for _, row in told]
            at += 2 * order
            z = [np.zeros(order)]
            for k, (s, _) in enumerate(told[:-1]):
                z.append(e[k] if k == 0 else _power(f, s.next_u - s.u) @ z[k] + e[k])
            w = [np.zeros(order)] * len(told)
            for k in range(len(told) - 1, 0, -1) if mode == "both" else ():
                s = told[k][0]
                skip = s.prior_v - s.u
                pads = p if s.last else 0
                length = s.v - s.prior_v + pads
                effect = _mixed(f, length) @ _power(f, skip)
                if s.last:  # the state the backward way begins with follows the last output
                    effect = effect + _power(f, length) @ np.outer(zi, C @ _power(f, skip + length - 1))
                w[k - 1] = g[k] + effect @ z[k] + (0.0 if s.last else _power(f, length) @ w[k])
            for k in range(len(told)):
                out[k].append(np.concatenate([z[k], w[k]]))
    return [np.concatenate(x) if x else np.zeros(0) for x in out]


def run_pass(df: DataFrame, keys: Sequence[str], step: Pass, fs: float | None = None, shard: int | None = None, written: bool = False) -> DataFrame:
    """Add a pass's columns to a numbered series (keys, pos, n; ``fs`` a column unless given).

    One shuffle; series of two and more shards take part in a second one before it, for the states.
    ``df`` is read for both, so it is written first unless it says to be ``written``.
    """
    keys, shard = list(keys), shard or SHARD
    df = df if written else durable(df)
    rows = df if fs is None else df.withColumn("fs", F.lit(float(fs)))
    known = F.col("fs").isNotNull() & ~F.isnan("fs") & (F.col("fs") > 0) & (F.col("fs") < float("inf"))
    far = F.lit(step.after_rows) + F.when(known, F.ceil(F.col("fs") * step.after_s)).otherwise(0) + step.around
    far = far.cast("long")
    size = F.greatest(F.lit(shard).cast("long"), far)
    count = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / size).cast("long"))
    of = lambda p: F.least(F.floor(p / size).cast("long"), count - 1)
    lo, hi = of(F.greatest(F.col("pos") - far, F.lit(0))), of(F.least(F.col("pos") + far, F.col("n") - 1))
    rows = rows.withColumns({"__of": of(F.col("pos")), "__size": size, "__sh": F.explode(F.sequence(lo, hi))})
    part = [*keys, "__sh"]
    types = dict(rows.dtypes)
    named = ", ".join(f"`{k}` {types[k]}" for k in part)

    def series(tab: pa.Table, group: np.ndarray):
        pos = tab.column("pos").to_numpy()
        order = np.lexsort((pos, group))
        g = group[order]
        cut = np.flatnonzero(g[1:] != g[:-1]) + 1
        return tab.take(pa.array(order)), list(zip([0, *cut.tolist()], [*cut.tolist(), len(g)]))

    def prepared(cols: list[np.ndarray], a: int, b: int, pos: np.ndarray, s: _Shard, rate: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
        given = [c[a:b] for c in cols]
        made = step.prepare(given, rate)
        lo, hi = s.u - int(pos[a]), s.v - int(pos[a])
        return [c[lo:hi] for c in given], [c[lo:hi] for c in made]

    def counted(x: list[np.ndarray], s: _Shard) -> float:
        return float(step.tally([c[s.c0 - s.u : s.c1 - s.u] for c in x])) if step.tally else 0.0

    def where(tab: pa.Table, a: int, rate: float) -> _Shard:
        return _shard_at(*(int(tab.column(c)[a].as_py()) for c in ("__sh", "n", "__size")), step.reach(rate))

    def ends(tab: pa.Table, group: np.ndarray) -> pa.Table | None:
        tab, spans = series(tab, group)
        pos, rates, cols = tab.column("pos").to_numpy(), floats(tab, "fs"), [floats(tab, c) for c in step.inputs]
        told, rows = [], []
        for a, b in spans:
            jobs = step.jobs(float(rates[a]))
            if jobs is None:
                continue
            s = where(tab, a, float(rates[a]))
            _, x = prepared(cols, a, b, pos, s, float(rates[a]))
            told.append(np.concatenate([[counted(x, s)], *[np.concatenate(_ends(f, mode, x[i], s)) for f, which, mode in jobs for i in which]]).tolist())
            rows.append(a)
        if not rows:
            return None
        out = tab.select([*part, "n", "__size", "fs"]).take(pa.array(rows))
        return out.append_column("__z", pa.array(told, pa.list_(pa.float64())))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:  # one row a shard
        pdf = pdf.sort_values("__sh")
        rate = float(pdf["fs"].iloc[0])
        total = sum(z[0] for z in pdf["__z"])
        told = [(_shard_at(int(k), int(n), int(size), step.reach(rate)), np.asarray(z[1:], float)) for k, n, size, z in zip(pdf["__sh"], pdf["n"], pdf["__size"], pdf["__z"])]
        return pdf[part].assign(__z=[[total, *z.tolist()] for z in _chain(step.jobs(rate), told)])

    long = rows.where((F.col("n") >= 2 * shard) & (F.col("n") >= 2 * F.col("__size"))).select(*part, "pos", "n", "fs", "__size", *[c for c in dict.fromkeys(step.inputs) if c not in ("pos", "n", "fs")])
    long = map_group_chunks(long, part, ends, f"{named}, n bigint, __size bigint, fs double, __z array<double>")
    begin = long.groupBy(*keys).applyInPandas(chain, f"{named}, __z array<double>")
    both = rows.unionByName(begin, allowMissingColumns=True)  # a shard meets its states in its shuffle
    kept = df.columns

    def run(tab: pa.Table, group: np.ndarray) -> pa.Table | None:
        tab, spans = series(tab, group)
        pos, rates, cols = floats(tab, "pos"), floats(tab, "fs"), [floats(tab, c) for c in step.inputs]
        own = np.asarray(tab.column("__of").to_numpy(zero_copy_only=False) == tab.column("__sh").to_numpy())
        pick, made, told = [], [], []
        for a, b in spans:
            z = None
            if np.isnan(pos[b - 1]):  # the row of the states sorts last
                b -= 1
                z = np.asarray(tab.column("__z")[b].as_py(), float)
            at = np.flatnonzero(own[a:b])
            pick.append(a + at)
            rate = float(rates[a])
            if step.rate and np.isnan(rate) and z is None:
                rate = step.rate([c[a:b] for c in cols])
            told.append(np.full(len(at), rate))
            jobs = step.jobs(rate)
            if jobs is None or not len(at):
                made.append([np.full(len(at), np.nan)] * len(step.outs))
                continue
            s = where(tab, a, rate)
            given, x = prepared(cols, a, b, pos, s, rate)
            total = counted(x, s) if z is None else z[0]
            z = None if z is None else z[1:]
            y, i = [], 0
            for f, which, mode in jobs:
                order = len(steady(f))
                for c in which:
                    begin_z = z[i : i + order] if z is not None and s.number else None
                    begin_w = z[i + order : i + 2 * order] if z is not None and not s.last else None
                    i += 2 * order
                    y.append(_run(f, mode, x[c], s, begin_z, begin_w))
            outs = [o[s.c0 - s.u : s.c1 - s.u] for o in step.finish(given, x, y, rate)]
            made.append([*outs, np.full(len(at), total / tab.column("n")[a].as_py())] if step.tally else outs)
        rows = np.concatenate(pick)
        out = tab.select(kept).take(pa.array(rows))
        if step.rate:
            out = out.set_column(kept.index("fs"), "fs", pa.array(np.concatenate(told), from_pandas=True))
        for k, name in enumerate(step.outs):
            out = out.append_column(name, pa.array(np.concatenate([m[k] for m in made]), from_pandas=True))
        return out

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in kept], *[f"`{o}` double" for o in step.outs]])
    return map_group_chunks(both, part, run, schema)


def _fixed(values: Sequence[str], jobs: Sequence[tuple[Sequence[str], Filter, Sequence[str]]], mode: str) -> Pass:
    at = {v: k for k, v in enumerate(values)}
    run = [(f, [at[v] for v in names], mode) for names, f, _ in jobs]
    return Pass(values, [o for _, _, names in jobs for o in names], lambda fs: run)


def apply_filters(df: DataFrame, keys: Sequence[str], jobs: Sequence[tuple[Sequence[str], Filter, Sequence[str]]], shard: int | None = None) -> DataFrame:
    """Zero-phase filters of columns of a numbered series, several in one pass: (values, filter, outs)."""
    values = list(dict.fromkeys(v for names, _, _ in jobs for v in names))
    return run_pass(df, keys, _fixed(values, jobs, "both"), 1.0, shard)


def apply_filtfilt(df: DataFrame, keys: Sequence[str], values: Sequence[str], f: Filter, outs: Sequence[str], shard: int | None = None) -> DataFrame:
    """Zero-phase filter of columns of a numbered series."""
    return apply_filters(df, keys, [(values, f, outs)], shard)


def apply_lfilter(df: DataFrame, keys: Sequence[str], values: Sequence[str], f: Filter, outs: Sequence[str], settled: bool = True, shard: int | None = None) -> DataFrame:
    """Causal filter; ``settled`` starts it as if the first reading had always been."""
    return run_pass(df, keys, _fixed(list(values), [(values, f, outs)], "settled" if settled else "rest"), 1.0, shard)
