from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gyrolith.functions.design import band_pass, low_pass, steady
from gyrolith.operators import aggregates, detect, filters, grid, intervals, ordered, outliers, periods, shards
from gyrolith.operators import windows as W


def plain_lfilter(f, x, z):
    y, z = [], list(z)
    for v in x:
        o = f.b[0] * v + z[0]
        z = [(z[k + 1] if k + 1 < len(z) else 0) + f.b[k + 1] * v - f.a[k + 1] * o for k in range(len(z))]
        y.append(o)
    return np.array(y), np.array(z)


@pytest.mark.parametrize("f", [low_pass(2, w) for w in (0.05, 0.005, 0.016, 0.032, 0.1)] + [band_pass(2, 0.06, 0.36)])
def test_filter_block_scan_equals_plain_loop(f):
    x = np.random.default_rng(1).normal(size=700)
    y, z = filters.lfilter(f, x, steady(f) * x[0])
    y2, z2 = plain_lfilter(f, x, steady(f) * x[0])
    assert np.abs(y - y2).max() < 1e-11 and np.abs(z - z2).max() < 1e-11


def test_filtfilt_keeps_a_constant_and_refuses_short_series():
    f = low_pass(2, 0.05)
    assert np.abs(filters.filtfilt(f, np.full(50, 3.0)) - 3).max() < 1e-9
    assert np.isnan(filters.filtfilt(f, np.arange(9.0))).all()


def test_known_design():
    # published values of the second-order low-pass at 0.05
    f = low_pass(2, 0.05)
    assert np.allclose(f.b, [0.00554272, 0.01108543, 0.00554272], atol=1e-8)
    assert np.allclose(f.a, [1, -1.77863178, 0.80080265], atol=1e-8)


def series(spark, n=500, keys=("a", "b"), seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.concat([pd.DataFrame({"g": k, "i": np.arange(n), "t": np.arange(n) * 0.01, "v": rng.normal(size=n), "n": n}) for k in keys])
    return spark.createDataFrame(pdf.sample(frac=1, random_state=1)), pdf


def test_sharded_filter_equals_whole(spark):
    df, pdf = series(spark)
    df = df.withColumn("pos", F.col("i"))
    f = band_pass(2, 0.06, 0.36)
    whole = {g: filters.filtfilt(f, p.sort_values("i").v.to_numpy()) for g, p in pdf.groupby("g")}
    for shard in (64, 100, 1 << 14):
        got = filters.apply_filtfilt(df, ["g"], ["v"], f, ["y"], shard).toPandas().sort_values(["g", "pos"])
        assert len(got) == len(pdf)
        for g, p in got.groupby("g"):
            assert np.abs(p.y.to_numpy() - whole[g]).max() < 1e-9
        causal = filters.apply_lfilter(df, ["g"], ["v"], f, ["y"], shard=shard).toPandas().sort_values(["g", "pos"])
        one = pdf[pdf.g == "a"].v.to_numpy()
        assert np.abs(causal[causal.g == "a"].y.to_numpy() - plain_lfilter(f, one, steady(f) * one[0])[0]).max() < 1e-9


def plain_clean(t, w, fs, cfg):
    """Cleaning of a whole series by plain loops over readings, as its definition says."""
    roll = lambda x, k, f: np.array([f([x[min(max(j, 0), len(x) - 1)] for j in range(i - k // 2, i - k // 2 + k)]) for i in range(len(x))])
    both = lambda f, x: filters.filtfilt(f, x)
    axes = []
    for x in np.degrees(w).T:
        med = roll(x, 15, np.median)
        dev = np.abs(x - med)
        axes.append(np.where(dev > 6 * (1.4826 * roll(dev, 15, np.median) + 1e-9), med, x))
    band = band_pass(2, 30 / (fs / 2), min(180, 0.475 * fs) / (fs / 2))
    noise = np.max([np.sqrt(roll(both(band, x) ** 2, max(3, int(0.1 * fs + 0.5)), np.mean)) for x in axes], axis=0)
    alpha = roll(np.clip((noise - 1.5) / 3.5, 0, 1), max(3, int(0.2 * fs)), np.mean)
    cut = lambda hz: low_pass(2, hz / (fs / 2))
    return np.radians([both(cut(25.0), x) * (1 - alpha) + both(cut(2.5), x) * alpha for x in axes]).T, noise, alpha


def test_cleaning_in_shards_equals_plain_loops_at_each_rate(spark, monkeypatch):
    """Series of several rates in one pass, one of them holding nearly all rows, cut into shards."""
    rng = np.random.default_rng(8)
    parts, want = [], {}
    for g, n, fs in (("big", 1500, 200.0), ("small", 90, 100.0), ("slow", 60, 50.0)):
        t = np.arange(n) / fs
        w = np.stack([np.sin(t), np.cos(2 * t), 0.2 * t], axis=1) + rng.normal(0, 0.02 + 0.3 * (np.abs(t - 3) < 0.5)[:, None], (n, 3))
        w[n // 2] += 5
        parts.append(pd.DataFrame(w, columns=["wx", "wy", "wz"]).assign(g=g, pos=np.arange(n), n=n, tm=t, fs=fs))
        want[g] = None if g == "slow" else plain_clean(t, w, fs, None)
    df = spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=2))
    for shard in (filters.SHARD, 256):
        monkeypatch.setattr(filters, "SHARD", shard)
        got = detect.adaptive_clean(df, ["g"]).toPandas().sort_values(["g", "pos"])
        assert len(got) == sum(map(len, parts))
        for g, p in got.groupby("g"):
            if want[g] is None:
                assert p[["cx", "noise", "alpha"]].isna().all().all()
                continue
            c, noise, alpha = want[g]
            assert np.abs(p[["cx", "cy", "cz"]].to_numpy() - c).max() < 1e-8
            assert np.abs(p.noise.to_numpy() - noise).max() < 1e-6 and np.abs(p.alpha.to_numpy() - alpha).max() < 1e-6
            assert p.spike_frac.iloc[0] > 0


def test_numbering_is_dense_over_shards_and_windows_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 32)
    df, pdf = series(spark, n=200)
    num = ordered.number(df.drop("n"), ["g"], ["t", "i"], F.floor(F.col("t") / 0.3).cast("long"))
    got = num.toPandas()
    assert (got.pos == got.i).all() and (got.n == 200).all()
    med = W.median_filter(num, ["g"], ["v"], 5, ["m"]).toPandas()
    x = pdf[pdf.g == "b"].v.to_numpy()
    p = np.pad(x, 2, mode="edge")
    want = np.median(np.stack([p[k : k + 200] for k in range(5)]), axis=0)
    assert np.allclose(med[med.g == "b"].sort_values("pos").m.to_numpy(), want)
    mean = W.uniform_filter(num, ["g"], ["v"], 10, ["m"]).toPandas()
    p = np.concatenate([np.repeat(x[0], 5), x, np.repeat(x[-1], 4)])
    want = np.array([p[k : k + 10].mean() for k in range(200)])
    assert np.allclose(mean[mean.g == "b"].sort_values("pos").m.to_numpy(), want)
    total = ordered.running_sum(num, ["g"], "v", "c").toPandas()
    assert np.allclose(total[total.g == "b"].sort_values("pos").c.to_numpy(), np.cumsum(x))


def test_group_chunks_keep_groups_whole(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))

    def fn(tab, group):
        pdf = tab.to_pandas()
        pdf["grp"] = group
        assert pdf.groupby("k").grp.nunique().max() == 1
        out = pdf.groupby("k").v.agg(["count", "sum"]).reset_index()
        import pyarrow as pa

        return pa.Table.from_pandas(out, preserve_index=False)

    got = shards.map_group_chunks(df, ["k"], fn, "k bigint, count bigint, sum bigint", chunk_rows=100).toPandas()
    assert sorted(got.k) == list(range(7)) and got["count"].sum() == 5000


def brute_periods(rows):
    out = []
    for key in sorted({r[0] for r in rows}):
        iv = sorted((a, b) for k, a, b in rows if k == key)
        cur = list(iv[0])
        done = []
        for a, b in iv[1:]:
            if a > cur[1]:
                done.append(tuple(cur))
                cur = [a, b]
            else:
                cur[1] = max(cur[1], b)
        done.append(tuple(cur))
        out += [(key, "period", a, b) for a, b in done]
        out += [(key, "gap", p[1], q[0]) for p, q in zip(done, done[1:])]
    return sorted(out)


@pytest.mark.parametrize("level", [2, 5, 26])
def test_periods_against_brute_force(spark, level):
    rng = np.random.default_rng(level)
    rows = [("s", int(a), int(a + b)) for a, b in zip(rng.integers(-400, 2000, 120), rng.integers(0, 40, 120))]
    rows += [("h", 0, 10**9), ("h", 5, 6), ("h", 10**9 + 1, 10**9 + 2), ("z", 7, 7), ("z", 7, 7), ("t", 0, 5), ("t", 5, 9), ("t", 10, 11)]
    df = spark.createDataFrame(rows, "k string, a bigint, b bigint")
    got = periods.periods_and_gaps(df, ["k"], F.col("a"), F.col("b"), shard_level=level)
    assert sorted(map(tuple, got.collect())) == brute_periods(rows)


def test_periods_of_nothing_and_nulls(spark):
    df = spark.createDataFrame([(None, 1, 2), ("a", None, 2), ("a", 3, None), ("a", 5, 4)], "k string, a bigint, b bigint")
    assert periods.periods_and_gaps(df, ["k"], F.col("a"), F.col("b")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(1, 60)), min_size=1, max_size=30))
def test_block_reduction(spans):
    """Canonical blocks of intervals come back as their union, whatever the order."""
    level, number = [], []
    covered = set()
    for a, n in spans:
        b = a + n
        covered |= set(range(a, b))
        j, lo, hi = 0, a, b
        while lo < hi:
            if lo & 1:
                level.append(j), number.append(lo)
                lo += 1
            if hi & 1:
                hi -= 1
                level.append(j), number.append(hi)
            j, lo, hi = j + 1, lo >> 1, hi >> 1
    _, s, e = periods.reduce_blocks(np.zeros(len(level), np.int64), np.array(level), np.array(number))
    assert set().union(*[set(range(x, y)) for x, y in zip(s.tolist(), e.tolist())]) == covered
    assert (s[1:] > e[:-1]).all()


def test_grid_fills_and_marks(spark):
    rows = [("a", 0, 1.0), ("a", 50, 2.0), ("a", 1000, None), ("a", 1001, 9.0), ("b", -250, 4.0), ("b", -250, 4.0), (None, 3, 1.0), ("c", None, 1.0), ("a", 2600, 5.0)]
    df = spark.createDataFrame(rows, "k string, t bigint, v double")
    for size in (2, 4096):
        g = grid.regular_grid(df, ["k"], F.col("t"), 100, F.col("v"), shard_bins=size).toPandas().sort_values(["k", "bin_no"])
        a = g[g.k == "a"]
        assert a.bin_no.tolist() == list(range(27))
        assert a.is_filled.sum() == 24 and a.n_readings.tolist()[0] == 2
        assert a.value.tolist()[:11] == [2.0] * 10 + [9.0] and a.value.tolist()[-2:] == [9.0, 5.0]
        b = g[g.k == "b"]
        assert b.bin_no.tolist() == [-3] and b.n_readings.tolist() == [2]
    assert set(g.k) == {"a", "b"}


def test_huge_gap_is_no_large_array(spark):
    df = spark.createDataFrame([("a", 0), ("a", 3_000_000)], "k string, t bigint")
    assert grid.missing_periods(df, ["k"], F.col("t"), 100).count() == 29_999


def test_outliers_spike_stuck_bound(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 400
    x = np.cumsum(rng.normal(0, 0.3, n)) + 20
    x[100] += 30  # one reading
    x[200:202] += 25  # two readings
    x[300:316] = x[300]  # stuck
    x[350:] += 40  # a step is none
    x[50] = np.nan
    x[60] = -1
    pdf = pd.DataFrame({"series_id": "s", "clip_no": 1, "idx": np.arange(n), "noise": x, "light_x": 0.0, "light_y": rng.normal(size=n), "light_z": rng.normal(size=n)})
    pdf["light_x"] = rng.normal(size=n)
    pdf.loc[10, "light_z"] = 5000.0
    df = spark.createDataFrame(pd.concat([pdf, pdf.iloc[90:110]]).sample(frac=1, random_state=2))
    for block in (64, 4096):
        monkeypatch.setattr(outliers, "BLOCK", block)
        got = outliers.clean_outliers(df).toPandas()
        say = {(r.idx, r.field, r.reason) for r in got.itertuples()}
        assert {i for i, f, w in say if f == "noise" and w == "spike"} == {100, 200, 201}
        assert {i for i, f, w in say if w == "stuck"} == set(range(300, 316))
        assert {(i, f) for i, f, w in say if w == "bound"} == {(60, "noise"), (10, "light")}
    assert outliers.clean_outliers(df.limit(0)).count() == 0


def clip(noise):
    return pd.DataFrame({"series_id": "s", "clip_no": 1, "idx": np.arange(len(noise)), "noise": noise, "light_x": None, "light_y": None, "light_z": None}).astype({f"light_{a}": float for a in "xyz"})


def test_outliers_of_a_source_with_a_quiet_last_block(spark):
    x = np.random.default_rng(4).normal(50, 1, outliers.BLOCK + 1)
    x[1000] += 40
    x[-1] = x[-2] = x[-3] = 50.0  # the last block's only change is 0
    got = outliers.clean_outliers(spark.createDataFrame(clip(x))).toPandas()
    assert {(r.idx, r.reason) for r in got.itertuples()} == {(1000, "spike")}


def test_stuck_run_among_nulls_across_blocks(spark):
    x = np.random.default_rng(9).normal(50, 1, outliers.BLOCK + 300)
    run = outliers.BLOCK - 96 + 12 * np.arange(16)
    x[run[0] : run[-1] + 1] = np.nan
    x[run] = 50.0
    df = spark.createDataFrame(clip(x)).withColumn("noise", F.nanvl("noise", F.lit(None)))
    got = outliers.clean_outliers(df).toPandas()
    assert {(r.idx, r.field, r.reason) for r in got.itertuples()} == {(k, "noise", "stuck") for k in run.tolist()}


def test_top_of_a_quick_turn_is_no_spike(spark):
    x = np.random.default_rng(8).normal(0, 0.2, 300)
    turn = 386 * np.sin(np.linspace(0, np.pi, 28))
    x[50:78] += turn
    x[149:177] -= turn
    x[200:228] += turn
    x[214] += 40  # on a top
    x[262:] += 30  # a step next but one to a spike against it
    x[260] -= 6
    x[1] += 8
    got = outliers.clean_outliers(spark.createDataFrame(clip(x + 1000))).toPandas()
    assert {(r.idx, r.reason) for r in got.itertuples()} == {(214, "spike"), (260, "spike"), (1, "spike")}


def test_medians_over_blocks_are_exact(spark):
    rng = np.random.default_rng(6)
    parts = [("a", rng.exponential(size=n)) for n in (1, 4096, 977)] + [("b", np.zeros(70)), ("b", np.r_[0.0, 3.0, 1e-9]), ("c", np.array([1.0, 3.0])), ("d", np.zeros(0)), ("d", np.r_[2.0])]
    df = spark.createDataFrame([(k, float(x)) for k, v in parts for x in v], "k string, v double")
    got = {r.k: (r.median, r.total) for r in aggregates.exact_medians(df, ["k"], "v").collect()}
    whole = {k: np.concatenate([v for j, v in parts if j == k]) for k in "abcd"}
    assert got == {k: (np.median(v), len(v)) for k, v in whole.items()}


def test_telemetry_signs_and_null_times_are_no_outliers(spark):
    n = 200
    a = np.linspace(0, 1, n)
    q = np.stack([np.cos(a / 2), np.sin(a / 2), 0 * a, 0 * a], axis=1)
    q[50:] *= -1
    q[120] = [0, 0, 0, 1]
    q[10] *= 1.2
    pdf = pd.DataFrame(q, columns=list("wxyz")).assign(series_id="s", clip_no=1, idx=np.arange(n), t=np.arange(n) * 0.01)
    pdf.loc[10, "t"] = None
    got = outliers.telemetry_outliers(spark.createDataFrame(pdf)).toPandas()
    assert {(r.idx, r.reason) for r in got.itertuples()} == {(120, "spike"), (10, "bound")}


def brute_intervals(t, m, pad, merge, least):
    out, n, i = [], len(t), 0
    while i < n:
        if not m[i]:
            i += 1
            continue
        e = i
        while e < n and m[e]:
            e += 1
        a, b = t[i] - pad, t[min(e, n - 1)] + pad
        if out and a - out[-1][1] < merge:
            out[-1][1] = b
        else:
            out.append([a, b])
        i = e
    return [(a, b) for a, b in out if b - a >= least]


def test_find_intervals_against_loop(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BLOCK", 16)
    rng = np.random.default_rng(5)
    frames, want = [], set()
    for k in range(12):
        n = int(rng.integers(1, 120))
        t = np.cumsum(rng.uniform(0.1, 1, n))
        m = rng.random(n) < rng.choice([0.1, 0.5, 0.95])
        frames.append(pd.DataFrame({"g": k, "pos": np.arange(n), "n": n, "t": t, "m": m}))
        want |= {(k, round(a, 9), round(b, 9)) for a, b in brute_intervals(t, m, 0.2, 0.5, 0.6)}
    df = spark.createDataFrame(pd.concat(frames))
    got = intervals.find_intervals(df, ["g"], "t", F.col("m"), 0.2, 0.5, 0.6).collect()
    assert {(r.g, round(r.a, 9), round(r.b, 9)) for r in got} == want


def test_operators_on_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, t double, v double")
    num = ordered.number(df, ["g"], ["t"], F.floor("t").cast("long"))
    assert W.median_filter(num, ["g"], ["v"], 3, ["m"]).count() == 0
    assert intervals.find_intervals(num, ["g"], "t", F.col("v") > 0, 0.1, 0.1, 0.1).count() == 0
    assert filters.apply_filtfilt(num, ["g"], ["v"], low_pass(2, 0.1), ["y"]).count() == 0


def test_extra_columns_with_clashing_names_survive(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0, 7, "x"), ("a", 1.0, 2.0, 8, "y")], "g string, t double, v double, sh int, e string")
    num = ordered.number(df, ["g"], ["t"], F.floor("t").cast("long"))
    out = W.gradient(num, ["g"], "v", "d").toPandas().sort_values("t")
    assert out.sh.tolist() == [7, 8] and out.d.tolist() == [1.0, 1.0]
