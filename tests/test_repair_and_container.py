from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gyrolith import session
from gyrolith.config import Config, Settings, load_settings, output_path, save_settings
from gyrolith.operators import intervals, metrics
from gyrolith.operators import repair as R
from gyrolith.plans import container as C
from gyrolith.plans import pipeline as P
from gyrolith.sources import container as S
from gyrolith.sources import frames
from gyrolith.sources.gcsv import read_gcsv, write_flat, write_gcsv
from gyrolith.sources.lens import lens_columns, read_camera_path


# ---- config
def test_settings_round_trip(tmp_path):
    path = tmp_path / "a" / "s.json"
    s = Settings(profile="custom", config=Config(severe=9.0, optical_noise=(1.0, 2.0)), concurrent_files=9)
    save_settings(s, path)
    assert load_settings(path) == s and s.workers() == 3
    assert load_settings(tmp_path / "none.json") == Settings()
    (tmp_path / "bad.json").write_text("{")
    assert load_settings(tmp_path / "bad.json") == Settings()
    (tmp_path / "part.json").write_text('{"config": {"severe": 5}}')
    assert load_settings(tmp_path / "part.json").config == Config(severe=5)
    assert Config().m4().fast_wide_cutoff == 16 and Config(fast_handback=(2.0, 1.0)).problems()


def test_output_names():
    assert output_path("/v/a.b.MP4") == "/v/a.b_fixed.MP4"
    assert output_path("/v/clip") == "/v/clip_fixed"
    assert output_path("/v/clip.mov", "/o") == "/o/clip_fixed.mov"


# ---- container
def box(name, payload):
    return struct.pack(">I4s", 8 + len(payload), name) + payload


def vint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(no, kind, payload):
    return vint(no << 3 | kind) + (vint(len(payload)) if kind == 2 else b"") + payload


def sample(stamp, quats, shift=0.0):
    atts = b"".join(field(3, 2, b"".join(field(k + 1, 5, struct.pack("<f", v)) for k, v in enumerate(q) if v is not None)) for q in quats)
    fusion = field(1, 0, vint(5)) + atts + field(4, 5, struct.pack("<f", shift))
    return field(1, 2, b"junk") + field(3, 2, field(1, 2, field(2, 0, vint(stamp))) + field(3, 2, field(2, 2, fusion)))


def container(samples, wide=False, per_chunk=2):
    ftyp = box(b"ftyp", b"isom0000")
    data, offs, at = b"", [], len(ftyp) + 8
    for s in samples:
        offs.append(at + len(data))
        data += s
    chunks = offs[::per_chunk]
    n_last = len(samples) - per_chunk * (len(chunks) - 1)
    runs = [(1, per_chunk, 1)] + ([(len(chunks), n_last, 1)] if n_last != per_chunk and len(chunks) > 1 else [])
    full = lambda p: b"\0\0\0\0" + p
    stbl = box(b"stsz", full(struct.pack(">II", 0, len(samples)) + b"".join(struct.pack(">I", len(s)) for s in samples)))
    stbl += box(b"stsc", full(struct.pack(">I", len(runs)) + b"".join(struct.pack(">III", *r) for r in runs)))
    stbl += box(b"co64" if wide else b"stco", full(struct.pack(">I", len(chunks)) + b"".join(struct.pack(">Q" if wide else ">I", c) for c in chunks)))
    trak = lambda kind, table: box(b"trak", box(b"mdia", box(b"hdlr", full(b"\0\0\0\0" + kind)) + box(b"minf", box(b"stbl", table))))
    return ftyp + box(b"mdat", data) + box(b"moov", trak(b"vide", b"") + trak(b"meta", stbl))


def quat_run(n, seed=0):
    rng = np.random.default_rng(seed)
    a = np.cumsum(rng.normal(0, 0.05, n))
    return np.stack([np.cos(a), np.sin(a), 0.1 * np.cos(a), 0.05 * np.ones(n)], axis=1)


@pytest.fixture
def clip(tmp_path):
    q = np.repeat(quat_run(10), 2, axis=0)  # every value stored twice
    parts = [sample(1_000_000 + 10_000 * k, q[4 * k : 4 * k + 4].tolist(), 0.5) for k in range(5)]
    path = tmp_path / "clip.mp4"
    path.write_bytes(container(parts, wide=True))
    return path


@pytest.mark.parametrize("parts", [1, 3])
def test_reading_a_container(spark, clip, parts):
    (clip.parent / "bad.mp4").write_bytes(b"not a film")
    rows = S.read_containers(spark, str(clip.parent / "*.mp4"), parts).toPandas()
    good = rows[rows.error.isna()].sort_values("sample")
    assert good["sample"].tolist() == [0, 1, 2, 3, 4] and good.frame_ts.tolist() == [1_000_000 + 10_000 * k for k in range(5)]
    assert rows.error.notna().sum() == 1
    raw = clip.read_bytes()
    first = good.iloc[0].atts[0]
    assert struct.unpack_from("<f", raw, first["offs"][1])[0] == pytest.approx(first["vals"][1])


def write_back(spark, clip, target):
    samples = S.read_containers(spark, str(clip))
    rows = C.numbered_slots(C.slots(samples))
    plan = C.patch_plan(rows, target)
    out = clip.parent / "out.mp4"
    done = S.write_slots(plan.withColumn("out_path", F.lit(str(out)))).collect()
    assert [d.error for d in done] == [None]
    again = C.slots(S.read_containers(spark, str(out))).withColumn("path", F.lit(str(clip)))
    check = C.round_trip(plan, again).collect()
    assert [(r.n, r.n_wrong) for r in check] == [(80, 0)]
    return rows, out


def test_null_patch_is_identity(spark, clip):
    _, out = write_back(spark, clip, None)
    assert hashlib.sha256(out.read_bytes()).digest() == hashlib.sha256(clip.read_bytes()).digest()


def test_patch_changes_only_changed_rows(spark, clip):
    rows = C.numbered_slots(C.slots(S.read_containers(spark, str(clip))))
    stream = C.extract(rows.drop("pos", "n", "t"), ["path"], F.col("t_ms") / 1000, ["sample", "j"])
    target = stream.select("path", "dedup_idx", "w", "x", "y", "z")
    _, out = write_back(spark, clip, target)
    assert out.read_bytes() == clip.read_bytes()
    turned = target.withColumn("x", F.when(F.col("dedup_idx") == 4, F.col("x") + 0.2).otherwise(F.col("x")))
    _, out = write_back(spark, clip, turned)
    a, b = np.frombuffer(clip.read_bytes(), np.uint8), np.frombuffer(out.read_bytes(), np.uint8)
    changed = np.flatnonzero(a != b)
    offs = rows.where("dedup_idx = 4").select(F.explode("offs")).toPandas().iloc[:, 0].to_numpy()
    assert len(changed) and all(any(o <= c < o + 4 for o in offs) for c in changed)
    assert C.plan_problems(rows, C.patch_plan(rows, None), target.where("dedup_idx < 3")).collect()[0].problem == "row count"


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    q = quat_run(8).tolist()
    for k in range(60):
        (tmp_path / f"c{k}.mp4").write_bytes(container([sample(5_000 + k, q[:4]), sample(15_000 + k, q[4:])]))
    tasks = S.ContainerReader({"path": f"{tmp_path}/*.mp4", "parts": "2"}).partitions()
    assert len(tasks) == 1 and len({p for p, _, _ in tasks[0].spans}) == 60
    rows = S.read_containers(spark, f"{tmp_path}/*.mp4", 2).toPandas()
    assert len(rows) == 120 and rows.path.nunique() == 60 and rows.atts.map(len).tolist() == [4] * 120


def test_parts_of_a_file_give_the_same_rows(spark, tmp_path):
    q = quat_run(40).tolist()
    q[9][2] = None  # an omitted component
    path = tmp_path / "c.mp4"
    path.write_bytes(container([sample(0, [])] + [sample(1_000_000 + 10_000 * k, q[4 * k : 4 * k + 4], 0.5) for k in range(10)]))
    assert len(S.ContainerReader({"path": str(path), "parts": "3", "block": "0"}).partitions()) == 3
    told = [C.slots(S.read_containers(spark, str(path), parts, block=0)).orderBy("sample", "j").collect() for parts in (1, 3)]
    assert told[0] == told[1] and len(told[0]) == 40 and told[0][0].t_ms == pytest.approx(-0.5 / 4 * 10)
    assert [r.whole for r in told[0]].count(False) == 1 and told[0][9].offs[2] is None


def test_only_finite_orientations_other_than_zero_are_slots(spark, tmp_path):
    path = tmp_path / "c.mp4"
    bad = [[float("nan"), 1.0, 0.0, 0.0], [0.0] * 4, [0.0, float("inf"), 0.0, 0.0], [0.0, 0.0, -float("inf"), 1.0]]
    path.write_bytes(container([sample(0, [*bad, [1e-45, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]])]))
    assert [r.j for r in C.slots(S.read_containers(spark, str(path))).orderBy("j").collect()] == [4, 5]


def test_slots_are_numbered_over_shards_as_by_a_loop(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for path, n in (("/a", 90), ("/b", 1), ("/c", 40)):
        t = np.sort(rng.uniform(0, 100_000, n))  # shards are 16 s; runs of equal values cross them
        w = np.repeat(rng.normal(size=n), rng.integers(1, 6, n))[:n]
        at = -1
        for k in range(n):
            at += k == 0 or w[k] != w[k - 1]
            want[path, k] = (k, n, at)
            rows.append((path, k, 0, float(w[k]), 0.0, 1.0, 2.0, float(t[k])))
    df = spark.createDataFrame(rows, "path string, sample bigint, j int, w double, x double, y double, z double, t_ms double").repartition(5)
    made = C.numbered_slots(df)
    assert {(r.path, r.sample): (r.pos, r.n, r.dedup_idx) for r in made.collect()} == want
    assert made.columns == [*df.columns, "n", "pos", "dedup_idx"]


def test_components_are_put_into_a_file_wherever_they_lie(spark, tmp_path):
    old = bytes(range(256)) * 80
    (tmp_path / "a.mp4").write_bytes(old)
    rng = np.random.default_rng(1)
    offs = sorted({*(5 * np.arange(100) + 7).tolist(), *(4 * rng.choice(4000, 50, replace=False) + 2000).tolist(), len(old) - 4})
    plan = spark.createDataFrame([(str(tmp_path / "a.mp4"), str(tmp_path / "b.mp4"), o, float(k)) for k, o in enumerate(offs)], "path string, out_path string, off bigint, value float").repartition(3)
    assert [(r.n_written, r.error) for r in S.write_slots(plan).collect()] == [(len(offs), None)]
    want = bytearray(old)
    for k, o in enumerate(offs):
        want[o : o + 4] = struct.pack("<f", k)
    assert (tmp_path / "b.mp4").read_bytes() == bytes(want)


# ---- repair
def spin(n, dt, seed=0):
    t = np.arange(n) * dt
    w = np.stack([np.sin(0.7 * t) + 0.3 * np.sin(2.1 * t), 0.8 * np.cos(0.5 * t), 0.5 * np.sin(1.3 * t + 1)], axis=1)
    q = R.prefix_rotations(np.array([1.0, 0, 0, 0]), R._qexp(w[:-1] * dt))
    return t, w, q


def test_prefix_product_equals_loop():
    _, w, q = spin(300, 0.01)
    cur = np.array([[1.0, 0, 0, 0]])
    for k, row in enumerate(R._qexp(w[:-1] * 0.01)):
        cur = R._qmul(cur, row[None])
        assert np.abs(cur[0] - q[k + 1]).max() < 1e-12


def test_splice_of_exact_rates_has_no_drift_and_keeps_the_rest(spark):
    t, w, q = spin(400, 0.01)
    tele = spark.createDataFrame(pd.DataFrame(q, columns=list("wxyz")).assign(g="a", pos=np.arange(400), n=400, t=t))
    rates = spark.createDataFrame(pd.DataFrame(w[:-1], columns=["rx", "ry", "rz"]).assign(g="a", pos=np.arange(399)))
    severe = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.05)], "g string, a double, b double")
    out, bursts = R.splice_orientation(tele, rates, severe, ["g"])
    b = bursts.toPandas()
    assert len(b) == 1 and b.drift_deg[0] < 1e-6
    got = out.toPandas().sort_values("pos")[list("wxyz")].to_numpy()
    outside = (t < 1) | (t > 2)
    assert (got[outside] == q[outside]).all()
    assert np.abs(got - q).max() < 1e-6


def test_alignment_finds_shift_and_axes(spark):
    rng = np.random.default_rng(4)
    t = np.arange(4000) * 0.005
    w = np.stack([np.sin(3 * t) + 0.5 * np.sin(7 * t), np.cos(2 * t), np.sin(4 * t + 1)], axis=1)
    u, _, vt = np.linalg.svd(rng.normal(size=(3, 3)))
    n = u @ vt
    tv = np.arange(100, 900) * 0.02 + 0.003
    at = np.stack([np.interp(tv + 0.024, t, w[:, k]) for k in range(3)], axis=1) @ n.T
    opt = spark.createDataFrame(pd.DataFrame(at, columns=["ox", "oy", "oz"]).assign(g="a", t=tv, quality=0.9))
    few = spark.createDataFrame(pd.DataFrame(at[:50], columns=["ox", "oy", "oz"]).assign(g="b", t=tv[:50], quality=0.9))
    gyro = spark.createDataFrame(pd.concat([pd.DataFrame(w, columns=["cx", "cy", "cz"]).assign(g=g, tm=t, pos=np.arange(4000), n=4000, fs=200.0) for g in "ab"]))
    rows = {r.g: r for r in R.video_alignment(opt.unionByName(few), gyro, ["g"]).collect()}
    assert rows["b"].status == "few" and rows["a"].status == "ok"
    assert abs(rows["a"].shift - 0.024) < 0.003 and rows["a"].r2 > 0.98
    assert np.abs(np.array(rows["a"].n) - n).max() < 0.05


def test_rows_beside_readings_are_all_that_interpolation_asks_for(spark):
    """A series with holes holds most rows; only those near its few readings go to the alignment, and nothing is lost."""
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(0, 400, 6000))
    t = t[(t < 100) | (t > 130)]
    v = np.cumsum(rng.normal(size=len(t)))
    gyro = spark.createDataFrame(pd.DataFrame({"g": "a", "pos": np.arange(len(t)), "n": len(t), "tm": t, "v": v}))
    at = np.r_[np.arange(50, 52, 0.02), 115.0, 129.9, -3.0]
    opt = spark.createDataFrame(pd.DataFrame({"g": "a", "t": at}))
    got = R.beside(gyro, opt, ["g"], "tm", "t", 0.2).toPandas().sort_values("tm")
    assert len(got) < 60
    for shift in np.linspace(-0.2, 0.2, 41):
        assert np.abs(np.interp(at + shift, got.tm, got.v) - np.interp(at + shift, t, v)).max() < 1e-12


def test_repair_end_to_end(spark):
    """A burst is found, measured motion replaces it, the rest stays as it was; a clean series is healthy."""
    fs, n = 200.0, 6000
    t, w, q = spin(n, 1 / fs)
    rng = np.random.default_rng(6)
    shaken = q.copy()
    burst = (t > 12) & (t < 14)
    wobble = 0.02 * np.sin(2 * np.pi * 20 * t)[:, None] * rng.normal(1, 0.2, (n, 3))
    shaken[burst] = R._qmul(q, R._qexp(wobble))[burst]
    tele = pd.concat([pd.DataFrame(x, columns=list("wxyz")).assign(g=g, idx=np.arange(n), t=t) for g, x in (("ill", shaken), ("well", q))])
    tv = np.arange(50, 1450) * 0.02
    opt = pd.DataFrame(np.stack([np.interp(tv, t, w[:, k]) for k in range(3)], axis=1), columns=["ox", "oy", "oz"]).assign(g="ill", t=tv, quality=0.9)
    opt["kind"] = np.where((tv > 11) & (tv < 15), "noisy", "calib")
    res = P.repair(spark.createDataFrame(tele), spark.createDataFrame(opt), ["g"])
    status = {r.g: r.status for r in res.status.collect()}
    assert status == {"ill": "repaired", "well": "healthy"}
    got = res.orientation.where("g = 'ill'").toPandas().sort_values("pos")
    new, tt = got[list("wxyz")].to_numpy(), got.t.to_numpy()
    sign = np.sign((new * q[: len(new)]).sum(axis=1))[:, None]
    err = lambda x: 2 * np.degrees(np.arccos(np.clip(np.abs((x * q[: len(x)]).sum(axis=1)), 0, 1)))
    inside = (tt > 12.2) & (tt < 13.8)
    assert err(new)[inside].mean() < 0.6 * err(shaken[: len(new)])[inside].mean()
    far = (tt < 11) | (tt > 15)
    assert np.abs(new * sign - q[: len(new)])[far].max() < 1e-9


def test_every_clip_has_a_status_whatever_its_rate(spark):
    """Eighty clips of as many rates, one of equal times, one too slow for the noise band, one too short."""
    n = 120
    _, _, q = spin(n, 0.01)
    clips = [pd.DataFrame(q, columns=list("wxyz")).assign(g=c, idx=np.arange(n), t=np.arange(n) / (100.0 + c)) for c in range(80)]
    clips.append(clips[0].assign(g=80, t=1.0))
    clips.append(clips[0].assign(g=81, t=np.arange(n) / 40.0))
    clips.append(clips[0][:50].assign(g=82))
    none = spark.createDataFrame([], "g bigint, kind string, t double, ox double, oy double, oz double, quality double")
    tele = spark.createDataFrame(pd.concat(clips))
    got = {r.g: (r.samples, r.status) for r in P.repair(tele, none, ["g"]).status.collect()}
    assert got == {c: (n, "healthy") for c in range(80)} | {80: (n, "no rate"), 81: (n, "slow"), 82: (50, "short")}
    fs = {r.g: r.fs for r in P.clean(P.durable(P.orientation_of(tele, ["g"], "t", "idx")), ["g"]).groupBy("g").agg(F.max("fs").alias("fs")).collect()}
    assert all(abs(fs[c] - (100 + c)) < 1e-6 for c in range(80))


# ---- text formats
def test_gcsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0.0, 1.5, -2.0, 0.25), (0.001, 90.0, 0.0, -1.0)], "t double, gx double, gy double, gz double")
    path = str(tmp_path / "log")
    write_gcsv(df, path, "t", ["gx", "gy", "gz"], readout_ms=5.09, id="test")
    text = spark.read.text(path).toPandas().value.tolist()
    assert text[0] == "GYROFLOW IMU LOG" and "frame_readout_time,5.090000" in text and text[-2].startswith("0.000,0.026180")
    back = read_gcsv(spark, path).toPandas().sort_values("t")
    assert np.abs(back[["gx", "gy", "gz"]].to_numpy() - [[1.5, -2, 0.25], [90, 0, -1]]).max() < 1e-3


def test_lens_tags_of_wrong_shape_are_null(spark):
    tags = ['{"fisheye_params": {"camera_matrix": [[1,2,3],[4,5,6],[7,8,9]], "distortion_coeffs": [1,2,3,4,5]}, "calib_dimension": {"w": 8, "h": 6}}', '{"fisheye_params": {"camera_matrix": [[1,2]], "distortion_coeffs": [1]}}', "nonsense", None]
    rows = lens_columns(spark.createDataFrame([(t,) for t in tags], "tag string"), "tag").collect()
    assert rows[0].distortion == [1, 2, 3, 4] and rows[0].calib_w == 8 and len(rows[0].camera_matrix) == 3
    assert all(r.camera_matrix is None and r.distortion is None for r in rows[1:])


def test_logs_of_many_series_and_camera_paths_of_many_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.5, 2.0), ("a", 0.1, 3.0)], "s string, t double, g double")
    write_gcsv(df, str(tmp_path / "logs"), "t", ["g", "g", "g"], keys=["s"])
    for s, n in (("a", 2), ("b", 1)):
        lines = [f.read_text().splitlines() for f in sorted((tmp_path / "logs" / f"s={s}").glob("part-*"))]
        assert len(lines) == 1 and lines[0][0] == "GYROFLOW IMU LOG" and len(lines[0]) == 6 + n
    for k in range(3):
        (tmp_path / f"p{k}.json").write_text('[{"stab_quat": [1, 0, 0, %d], "fov_scale": 1.5}, {"stab_quat": [0, 1, 0, 0]}]' % k)
    (tmp_path / "p9.json").write_text("nothing")
    got = read_camera_path(spark, str(tmp_path / "p*.json")).collect()
    assert sorted((r.path[-7:], r.frame, r.z) for r in got) == [(f"p{k}.json", i, float(k) if i == 0 else 0.0) for k in range(3) for i in (0, 1)]


def test_long_intervals_make_few_slots(spark):
    """One interval of ten years among short ones: each takes a few slots, and all readings are found."""
    iv = [("a", float(k), k + 0.5) for k in range(0, 2000, 2)] + [("a", -1e8, 2e8), ("a", 5.0, 5.0), ("a", 9.0, 8.0)]
    rows = [("a", k * 0.25) for k in range(200)] + [("a", 1e8), ("a", 3e8), ("b", 1.0)]
    df, cut = spark.createDataFrame(rows, "k string, t double"), spark.createDataFrame(iv, "k string, a double, b double")
    got = sorted((r.t, r.a) for r in intervals.within(df, cut, ["k"], "t").collect())
    assert got == sorted((t, a) for k, t in rows for _, a, b in iv if k == "a" and a <= t <= b)
    assert (3e8 + 1) / intervals.slot_length(cut) < 20 * len(iv)
    assert {r.t for r in intervals.in_none(df, cut, ["k"], "t").collect()} == {3e8, 1.0}


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Context:
        def __init__(self, master):
            self.master, self._jsc = master, self

        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

        def getConf(self):
            return {}

    class Session:
        def __init__(self, master):
            self.sparkContext, self.conf = Context(master), {}

    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            session.shared_folder(Session(master))
    assert session.shared_folder(Session("local[4]"))


# ---- frames
class Film:
    """Points of a turning camera, seen through a fisheye."""

    fps = 50.0
    camera = np.array([[500.0, 0, 320], [0, 500, 240], [0, 0, 1]])
    distortion = np.array([0.05, -0.01, 0.002, 0.0])
    rate = np.array([0.4, -0.8, 0.6])

    def seen(self, frame):
        rng = np.random.default_rng(1)
        x = rng.uniform([-3, -2, 4], [3, 2, 9], (300, 3))
        angle = np.linalg.norm(self.rate) * frame / self.fps
        k = self.rate / np.linalg.norm(self.rate)
        cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        turn = np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * cross @ cross
        x = x @ turn.T + np.array([0.02, 0.01, 0.015]) * frame
        p = x[:, :2] / x[:, 2:]
        r = np.linalg.norm(p, axis=1)
        t = np.arctan(r)
        d = t * (1 + t**2 * (0.05 + t**2 * (-0.01 + t**2 * 0.002)))
        return p * (d / r)[:, None] * 500 + [320, 240]

    def open(self, path):
        return self

    def matches(self, first, last):
        for f in range(first + 1, last + 1):
            a, b = self.seen(f - 1), self.seen(f)
            b[:30] += 40  # wrong matches
            yield f, a, b


def test_rates_from_matched_points(spark):
    iv = spark.createDataFrame([("x", 0.0, 0.1), ("y", 0.2, 0.26)], "path string, a double, b double")
    rows = frames.video_rates(iv, Film()).toPandas()
    assert sorted(rows[rows.path == "x"].frame) == [1, 2, 3, 4, 5, 6] and (rows.quality == 1).all()
    assert np.abs(rows[["ox", "oy", "oz"]].to_numpy() - Film.rate).max() < 0.05
    assert np.allclose(rows.t, (rows.frame - 0.5) / 50)
    few = frames.pair_rotation(np.zeros((20, 2)), np.zeros((20, 2)), Film.camera, Film.distortion, 1)
    assert few[1] == 0 and not few[0].any()


def test_similarity_of_points():
    rng = np.random.default_rng(2)
    p = rng.normal(size=(50, 2))
    c, s = np.cos(0.1), np.sin(0.1)
    shift, roll, scale = frames.similarity(p, 1.05 * p @ np.array([[c, s], [-s, c]]) + [3, -1])
    assert abs(roll - 0.1) < 1e-12 and abs(scale - np.log(1.05)) < 1e-12
    assert np.allclose(shift, (1.05 * p @ np.array([[c, s], [-s, c]]) + [3, -1] - p).mean(axis=0))
    assert frames.track_video.__doc__


# ---- dumps, caches, differences
def test_stages_flat_dump_and_cache(spark, tmp_path):
    n = 200
    t, w, q = spin(n, 0.01)
    tele = spark.createDataFrame(pd.DataFrame(q, columns=list("wxyz")).assign(g="a", idx=np.arange(n), t=t))
    none = spark.createDataFrame([], "g string, kind string, t double, ox double, oy double, oz double, quality double")
    done = P.repair(tele, none, ["g"])
    for name in P.dump_stages(done, str(tmp_path / "stages")):
        assert spark.read.parquet(str(tmp_path / "stages" / name)).columns
    write_flat(done.series, str(tmp_path / "flat"), ["pos"], ["t", *"wxyz"], keys=["g"])
    lines = next((tmp_path / "flat" / "g=a").glob("part-*")).read_text().splitlines()
    back = np.array([[float(x) for x in line.split(",")] for line in lines])
    assert back.shape == (n, 5) and np.abs(np.abs(back[:, 1:]) - np.abs(q)).max() < 1e-12 and (back[:, 0] == t).all()
    cache = metrics.rate_cache(done.series, ["g"], track=spark.createDataFrame([("a", 0.2), ("a", 0.6), ("a", None)], "g string, quality double")).toPandas()
    assert len(cache) == n - 1 and (cache.quality == 0.4).all()
    assert np.abs(cache.sort_values("pos")[["wx", "wy", "wz"]].to_numpy() - np.degrees(w[:-1])).max() < 1e-6


def test_shifted_track_differs_by_nothing(spark):
    n = 400
    t = np.arange(n) / 50.0
    v = np.sin(3 * t) + 0.5 * np.sin(20 * t)
    a = pd.DataFrame({"g": "a", "pos": np.arange(n), "n": n, "t": t, "v": v, "label": np.where(t < 4, "clean", "severe")})
    b = a.assign(t=t + 0.008)[["g", "pos", "n", "t", "v"]]
    got = metrics.render_difference(spark.createDataFrame(a), spark.createDataFrame(b), ["g"], ["v"], 50.0, 0.03, [(2.0, 8.0), (8.0, 25.0)]).toPandas()
    assert len(got) == 4 and (np.abs(got["shift"] - 0.008) < 1e-9).all() and got.rms.max() < 0.02


def test_rates_of_long_and_short_series_are_told_alike(spark, monkeypatch):
    """A series tells its rate in its one shard, a longer one beforehand; both give the same results."""
    _, _, q = spin(700, 0.01)
    t = np.cumsum(np.random.default_rng(3).uniform(0.004, 0.016, 700))
    tele = spark.createDataFrame(pd.concat([pd.DataFrame(q[:n], columns=list("wxyz")).assign(g=g, idx=np.arange(n), t=t[:n]) for g, n in (("a", 700), ("b", 240))]))
    series = P.durable(P.orientation_of(tele, ["g"], "t", "idx"))
    whole = P.clean(series, ["g"]).toPandas().sort_values(["g", "pos"]).reset_index(drop=True)
    monkeypatch.setattr("gyrolith.operators.filters.SHARD", 128)
    cut = P.clean(series, ["g"]).toPandas().sort_values(["g", "pos"]).reset_index(drop=True)
    assert len(whole) == 938 and whole.fs.nunique() == 2
    assert abs(whole.fs[0] - 1 / np.median(np.diff(t))) == 0
    pd.testing.assert_frame_equal(whole, cut[whole.columns], atol=1e-8, rtol=1e-8)
