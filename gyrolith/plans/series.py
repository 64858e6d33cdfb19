"""Registered queries of the series operators over whole tables, and their SQL.

Sources: ``events`` as one series a user, in order of (ts, event_id); ``embeddings`` as sixteen
quaternions a vector; the clip tables where the operator is about clips.  Doubles are rounded to
six digits on both sides; ``+ 0.0`` turns -0.0 into 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrolith.config import Config
from gyrolith.functions import quat as Qn
from gyrolith.functions.design import low_pass
from gyrolith.operators import aggregates as A
from gyrolith.operators import intervals as I
from gyrolith.operators import windows as W
from gyrolith.operators import metrics as M
from gyrolith.operators.detect import noise_classes, noise_envelope, ramp_smoothed, severe_intervals
from gyrolith.operators.filters import apply_filtfilt, apply_lfilter
from gyrolith.operators.ordered import blocked, number, own
from gyrolith.plans import bank
from gyrolith.plans.container import compare_positions
from gyrolith.plans.pipeline import clean, orientation_of, repair
from gyrolith.session import durable, table
from gyrolith.sources.gcsv import rate_lines
from gyrolith.sources.lens import lens_columns

USER, CLIP = ["user_id"], ["series_id", "clip_no"]
DAY = 86400.0
LOW = low_pass(2, 0.1)
#: An event's value above this is a reading of interest.
LOUD = 60.0


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, event_type, value, k (from props), t, pos, n."""
    e = table(spark, sf_dir, "events")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")
    k = F.get_json_object("props", "$.k").cast("double").alias("k")
    e = e.select("user_id", "event_id", "event_type", "value", k, t)
    return number(e, USER, ["t", "event_id"], F.floor(F.col("t") / DAY).cast("long"))


EVENTS = """
e as (
  select user_id, event_id, event_type, value, cast(json_extract_string(props, '$.k') as double) k, epoch_us(ts) / 1e6 t,
    row_number() over (partition by user_id order by ts, event_id) - 1 pos, count(*) over (partition by user_id) n
  from events)"""


def quats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, k, aw..az, bw..bz (the next of the vector's sixteen, round the end), f = k / 15."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    at = lambda base, i: F.get("embedding", (base * 4 + i).cast("int")).cast("double")
    nxt = F.pmod(F.col("k") + 1, F.lit(16))
    a = [at(F.col("k"), i).alias(f"a{c}") for i, c in enumerate("wxyz")]
    b = [at(nxt, i).alias(f"b{c}") for i, c in enumerate("wxyz")]
    return e.select("vec_id", F.col("k").cast("long").alias("k"), *a, *b, (F.col("k") / 15.0).alias("f"))


QUATS = """
v as (select vec_id, embedding, unnest(range(16)) k from embeddings),
q as (
  select vec_id, k, embedding[4*k+1]::double aw, embedding[4*k+2]::double ax, embedding[4*k+3]::double ay, embedding[4*k+4]::double az,
    embedding[4*((k+1)%16)+1]::double bw, embedding[4*((k+1)%16)+2]::double bx, embedding[4*((k+1)%16)+3]::double b_y, embedding[4*((k+1)%16)+4]::double bz, k / 15.0::double f
  from v),
u as (
  select vec_id, k, f, aw/na aw, ax/na ax, ay/na ay, az/na az, bw/nb bw, bx/nb bx, b_y/nb b_y, bz/nb bz
  from (select *, sqrt(aw*aw+ax*ax+ay*ay+az*az) na, sqrt(bw*bw+bx*bx+b_y*b_y+bz*bz) nb from q))"""


def _r(*exprs: str) -> str:
    return ", ".join(f"round({x.rpartition(' ')[0]}, 6) + 0.0 as {x.rpartition(' ')[2]}" for x in exprs)


def _unit(df: DataFrame) -> tuple[Qn.Q, Qn.Q]:
    return Qn.normalise(Qn.q_of("a")), Qn.normalise(Qn.q_of("b"))  # type: ignore[return-value]


def _out(df: DataFrame, cols: tuple[Column, ...], names: str = "wxyz") -> DataFrame:
    return df.select("vec_id", "k", *[r6(c).alias(n) for c, n in zip(cols, names)])


def quat_mul(s, d):
    return _out(x := quats(s, d), Qn.mul(*_unit(x)))


def quat_conj(s, d):
    return _out(x := quats(s, d), Qn.conj(Qn.q_of("a")))


def quat_norm(s, d):
    return _out(x := quats(s, d), _unit(x)[0])


def quat_exp(s, d):
    return _out(quats(s, d), Qn.exp((F.col("ax"), F.col("ay"), F.col("az"))))


def quat_log(s, d):
    return _out(x := quats(s, d), Qn.log(_unit(x)[0]), "xyz")


def quat_slerp(s, d):
    return _out(x := quats(s, d), Qn.slerp(*_unit(x), F.col("f")))


def quat_smoothstep(s, d):
    return quats(s, d).select("vec_id", "k", r6(Qn.smoothstep(F.col("aw") * 4 + 0.5)).alias("s"), r6(Qn.ramp(F.col("ax"), -0.1, 0.1)).alias("r"))


def file_to_out(s, d):
    x = quats(s, d)
    out = Qn.file_to_out(Qn.q_of("a"))
    return _out(x, (*out, *Qn.out_to_file(out)), ["w", "x", "y", "z", "bw", "bx", "by", "bz"])


MUL = _r(
    "aw*bw-ax*bx-ay*b_y-az*bz w", "aw*bx+ax*bw+ay*bz-az*b_y x", "aw*b_y-ax*bz+ay*bw+az*bx y", "aw*bz+ax*b_y-ay*bx+az*bw z"
)
_SLERP = """
, d as (select *, aw*bw+ax*bx+ay*b_y+az*bz dd from u),
g as (select *, acos(least(abs(dd), 1.0)) th, case when dd < 0 then -1.0 else 1.0 end sg from d),
h as (select *, case when sin(th) < 1e-6 then 1 - f else sin((1-f)*th)/sin(th) end wa, case when sin(th) < 1e-6 then f else sin(f*th)/sin(th) end wb from g),
m as (select vec_id, k, aw*wa+bw*sg*wb w, ax*wa+bx*sg*wb x, ay*wa+b_y*sg*wb y, az*wa+bz*sg*wb z from h),
mm as (select *, sqrt(w*w+x*x+y*y+z*z) nn from m)
"""


def _quat_series(s, d) -> DataFrame:
    """The unit quaternions of a vector as a series of 100 readings a second."""
    x = quats(s, d)
    a = Qn.normalise(Qn.q_of("a"))
    x = x.select("vec_id", "k", (F.col("k") / 100.0).alias("t"), *[c.alias(n) for c, n in zip(a, "wxyz")])
    return number(x, ["vec_id"], ["k"], F.floor(F.col("k") / 8).cast("long"))


def quats_to_rates(s, d):
    x = W.rates(_quat_series(s, d), ["vec_id"], "t", "wxyz")
    return rounded(x.select("vec_id", "k", "tm", "wx", "wy", "wz"), "tm", "wx", "wy", "wz")


RATES_SQL = f"""with {QUATS},
p as (select vec_id, k, aw*bw+ax*bx+ay*b_y+az*bz w, aw*bx-ax*bw-ay*bz+az*b_y x, aw*b_y+ax*bz-ay*bw-az*bx y, aw*bz-ax*b_y+ay*bx-az*bw z from u where k < 15),
s as (select vec_id, k, case when w < 0 then -x else x end x, case when w < 0 then -y else y end y, case when w < 0 then -z else z end z from p),
n as (select *, sqrt(x*x+y*y+z*z) nn from s),
o as (select *, (case when nn > 1e-12 then 2*asin(least(nn, 1.0))/nn else 2.0 end) / greatest((k+1)/100.0::double - k/100.0::double, 1e-9) c from n)
select vec_id, k, {_r('(k/100.0::double+((k+1)/100.0::double-k/100.0::double)/2) tm', 'x*c wx', 'y*c wy', 'z*c wz')} from o"""


def hemisphere(s, d):
    x = W.hemisphere(_quat_series(s, d), ["vec_id"], ["w", "x", "y", "z"])
    return rounded(x.select("vec_id", "k", "w", "x", "y", "z"), "w", "x", "y", "z")


HEMI_SQL = f"""with {QUATS},
l as (select vec_id, k, aw, ax, ay, az, lag(aw) over o pw, lag(ax) over o px, lag(ay) over o py, lag(az) over o pz from u window o as (partition by vec_id order by k)),
c as (select *, sum(case when aw*pw+ax*px+ay*py+az*pz < 0 then 1 else 0 end) over (partition by vec_id order by k) turns from l),
g as (select *, case when turns % 2 = 1 then -1.0 else 1.0 end sg from c)
select vec_id, k, {_r('aw*sg w', 'ax*sg x', 'ay*sg y', 'az*sg z')} from g"""


def sign_pin(s, d):
    x = _quat_series(s, d).withColumn("changed", F.col("k") % 5 != 0)
    x = W.sign_pin(x, ["vec_id"], ["w", "x", "y", "z"], "changed")
    return rounded(x.select("vec_id", "k", "w", "x", "y", "z"), "w", "x", "y", "z")


PIN_SQL = f"""with recursive {QUATS},
f as (
  select vec_id, k, aw w, ax x, ay y, az z from u where k = 0
  union all
  select u.vec_id, u.k, aw*sg, ax*sg, ay*sg, az*sg from f join (select * from u) u on u.vec_id = f.vec_id and u.k = f.k + 1,
    lateral (select case when u.k % 5 <> 0 and aw*f.w+ax*f.x+ay*f.y+az*f.z < 0 then -1.0 else 1.0 end sg))
select vec_id, k, {_r('w w', 'x x', 'y y', 'z z')} from f"""


def norm_jump(s, d):
    x = W.hemisphere(_quat_series(s, d), ["vec_id"], ["w", "x", "y", "z"], jump=1.5)
    return rounded(x.select("vec_id", "k", "w", "x", "y", "z"), "w", "x", "y", "z")


JUMP_SQL = HEMI_SQL.replace("aw*pw+ax*px+ay*py+az*pz < 0", "sqrt((aw-pw)*(aw-pw)+(ax-px)*(ax-px)+(ay-py)*(ay-py)+(az-pz)*(az-pz)) > 1.5")


def consecutive_dedupe(s, d):
    return W.consecutive_dedupe(events(s, d), USER, ["event_type"]).select("user_id", "pos", "event_id", "event_type")


def dedup_index(s, d):
    return W.dedup_index(events(s, d), USER, ["event_type"]).select("user_id", "pos", "dedup_idx")


_FLAG = f"with {EVENTS}, g as (select *, case when event_type is distinct from lag(event_type) over (partition by user_id order by pos) or pos = 0 then 1 else 0 end nw from e)"


def median_filter(s, d):
    return rounded(W.median_filter(events(s, d), USER, ["value"], 5, ["med"]).select("user_id", "pos", "med"), "med")


def _padded_sql(col: str, h: int) -> str:
    """Windows of 2h + 1 readings with repeated edges, as lists, from table e."""
    return f"""p as (select user_id, pos, n, {col} v from e union all select user_id, -i, n, {col} from e, range(1, {h} + 1) r(i) where pos = 0
  union all select user_id, n - 1 + i, n, {col} from e, range(1, {h} + 1) r(i) where pos = n - 1)"""


MEDIAN_SQL = f"""with {EVENTS}, {_padded_sql('value', 2)},
m as (select user_id, pos, n, median(v) over (partition by user_id order by pos rows between 2 preceding and 2 following) med from p)
select user_id, pos, round(med, 6) + 0.0 as med from m where pos between 0 and n - 1"""


def hampel(s, d):
    x = W.hampel(events(s, d), USER, ["value"], 3, 3.0, ["clean"], ["is_spike"])
    return rounded(x.select("user_id", "pos", "clean", "is_spike"), "clean")


HAMPEL_SQL = f"""with {EVENTS}, {_padded_sql('value', 3)},
m as (select user_id, pos, n, v, median(v) over (partition by user_id order by pos rows between 3 preceding and 3 following) med from p),
d as (select *, abs(v - med) dev from m where pos between 0 and n - 1),
dp as (select user_id, pos, n, dev from d union all select user_id, -i, n, dev from d, range(1, 4) r(i) where pos = 0
  union all select user_id, n - 1 + i, n, dev from d, range(1, 4) r(i) where pos = n - 1),
s as (select user_id, pos, median(dev) over (partition by user_id order by pos rows between 3 preceding and 3 following) mad from dp)
select d.user_id, d.pos, round(case when dev > 3.0 * (1.4826 * mad + 1e-9) then med else v end, 6) + 0.0 as clean, dev > 3.0 * (1.4826 * mad + 1e-9) as is_spike
from d join s using (user_id, pos)"""


def uniform_filter(s, d):
    x = W.uniform_filter(events(s, d), USER, ["value", "k"], 4, ["mean_value", "mean_k"])
    return rounded(x.select("user_id", "pos", "mean_value", "mean_k"), "mean_value", "mean_k")


_MEAN = """sum({v}) over (partition by user_id order by pos rows between {l} preceding and {r} following)"""
UNIFORM_SQL = f"""with {EVENTS}, {_padded_sql('value', 4)}, pk as (select user_id, pos, n, k v from e union all select user_id, -i, n, k from e, range(1, 5) r(i) where pos = 0
  union all select user_id, n - 1 + i, n, k from e, range(1, 5) r(i) where pos = n - 1),
a as (select user_id, pos, n, avg(v) over (partition by user_id order by pos rows between 2 preceding and 1 following) x from p),
b as (select user_id, pos, avg(v) over (partition by user_id order by pos rows between 2 preceding and 1 following) y from pk)
select user_id, pos, round(x, 6) + 0.0 as mean_value, round(y, 6) + 0.0 as mean_k from a join b using (user_id, pos) where pos between 0 and n - 1"""


def gradient(s, d):
    x = W.difference(W.gradient(events(s, d), USER, "value", "grad"), USER, ["value"], ["diff"])
    return rounded(x.select("user_id", "pos", "grad", "diff"), "grad", "diff")


GRADIENT_SQL = f"""with {EVENTS}, g as (select *, lag(value) over o a, lead(value) over o b from e window o as (partition by user_id order by pos))
select user_id, pos, round(case when n < 2 then null when pos = 0 then b - value when pos = n - 1 then value - a else (b - a) / 2 end, 6) + 0.0 as grad,
  round(value - a, 6) + 0.0 as diff from g"""


def cumsum(s, d):
    return rounded(W.angle_integral(events(s, d), USER, ["value"], 100.0, ["angle"]).select("user_id", "pos", "angle"), "angle")


def fill_flagged(s, d):
    x = events(s, d).withColumn("bad", F.col("value") > LOUD)
    return rounded(W.fill_flagged(x, USER, "t", ["value"], "bad").select("user_id", "pos", "value"), "value")


FILL_SQL = f"""with {EVENTS},
g as (select *, last_value(case when value <= {LOUD} then t end ignore nulls) over b lt, last_value(case when value <= {LOUD} then value end ignore nulls) over b lv,
  first_value(case when value <= {LOUD} then t end ignore nulls) over a ft, first_value(case when value <= {LOUD} then value end ignore nulls) over a fv from e
  window b as (partition by user_id order by pos rows between unbounded preceding and current row), a as (partition by user_id order by pos rows between current row and unbounded following))
select user_id, pos, round(case when value <= {LOUD} then value when lv is null and fv is null then value when lv is null then fv when fv is null then lv
  else lv + (fv - lv) * ((t - lt) / (ft - lt)) end, 6) + 0.0 as value from g"""


def noise_alpha(s, d):
    x = ramp_smoothed(events(s, d), USER, "value", 20.0, 80.0, 25.0, 0.2, "alpha")
    return rounded(x.select("user_id", "pos", "alpha"), "alpha")


ALPHA_SQL = f"""with {EVENTS.replace(', value,', ', greatest(0.0, least(1.0, (value - 20.0) / 60.0)) as value,')}, {_padded_sql('value', 5)},
a as (select user_id, pos, n, avg(v) over (partition by user_id order by pos rows between 2 preceding and 2 following) x from p)
select user_id, pos, round(x, 6) + 0.0 as alpha from a where pos between 0 and n - 1"""


def _loud(s, d) -> DataFrame:
    return I.find_intervals(events(s, d), USER, "t", F.col("value") > LOUD, 3600.0, 7200.0, 3600.0)


def find_intervals(s, d):
    return rounded(_loud(s, d), "a", "b")


def _intervals_sql(mask: str, pad: float, merge: float, least: float, table: str = "e") -> str:
    return f"""mk as (select *, coalesce({mask}, false) m from {table}),
l as (select *, lag(m) over (partition by user_id order by pos) pm from mk),
g as (select *, sum(case when m is distinct from pm then 1 else 0 end) over (partition by user_id order by pos) run from l),
rn as (select user_id, run, min(t) s, max(pos) last_pos, max(n) n from g where m group by user_id, run),
iv as (select rn.user_id, s - {pad} a, x.t + {pad} b, last_pos from rn join {table} x on x.user_id = rn.user_id and x.pos = least(last_pos + 1, rn.n - 1)),
i2 as (select *, sum(case when a - pb >= {merge} or pb is null then 1 else 0 end) over (partition by user_id order by last_pos) isl
  from (select *, lag(b) over (partition by user_id order by last_pos) pb from iv)),
ivl as (select user_id, min(a) a, arg_max(b, last_pos) b from i2 group by user_id, isl having arg_max(b, last_pos) - min(a) >= {least})"""


INTERVALS_SQL = f"with {EVENTS}, {_intervals_sql(f'value > {LOUD}', 3600.0, 7200.0, 3600.0)} select user_id, {_r('a a', 'b b')} from ivl"


def interval_totals(s, d):
    return rounded(A.total_length(_loud(s, d), USER), "seconds")


def range_mask(s, d):
    return I.in_any(events(s, d), _loud(s, d), USER, "t").select("user_id", "event_id")


def anti_mask(s, d):
    return I.in_none(events(s, d), _loud(s, d), USER, "t").select("user_id", "event_id")


def range_join(s, d):
    """Widened intervals overlap, so a reading may come out several times."""
    x = I.within(events(s, d).select("user_id", "event_id", "t"), _loud(s, d), USER, "t", widen=5400.0, slot=43200.0)
    return rounded(x.select("user_id", "event_id", "a", "b"), "a", "b")


def searchsorted(s, d):
    x = I.edges_to_index(_loud(s, d), events(s, d), USER, "t")
    return rounded(x.select("user_id", "a", "b", "i0", "i1"), "a", "b")


_IV = f"with {EVENTS}, {_intervals_sql(f'value > {LOUD}', 3600.0, 7200.0, 3600.0)}"
WINDOWS = [("start", 1704067200.0, 1704672000.0), ("middle", 1704585600.0, 1705881600.0), ("end", 1705276800.0, 1706745600.0)]


def named_windows(s, d):
    x = I.label_windows(events(s, d), "t", WINDOWS)
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(A.rms([F.col("value"), F.col("k")])).alias("rms"), r6(A.share(F.col("value") > LOUD)).alias("share"))


_LABELS = " union all ".join(f"select *, '{n}' as label from e where t between {a} and {b}" for n, a, b in WINDOWS)
LABEL_SQL = f"""with {EVENTS}, x as ({_LABELS})
select label, count(*) n, round(sqrt(avg(value*value + k*k)), 6) + 0.0 as rms, round(avg(case when value > {LOUD} then 1.0::double else 0.0::double end), 6) + 0.0 as share from x group by label"""


def _masks(s, d) -> DataFrame:
    """Readings with the class their noise gives them: 'clean' outside the noisy stretches, in them 'severe' or 'mild'."""
    x = events(s, d).select("user_id", "pos", "n", "t", "event_type", "value", "k")
    x = noise_envelope(x, USER, ["value"], 1000.0, Config(noise_window_ms=9.0))
    x = durable(ramp_smoothed(x, USER, "noise", 10.0, 30.0, 25.0, 0.2, "alpha"))
    noisy = I.find_intervals(x, USER, "t", F.col("alpha") > 0.6, 3600.0, 7200.0, 3600.0)
    return noise_classes(x, USER, "t", noisy, 25.0)


def masked_rms(s, d):
    """RMS of two axes by noise class."""
    return _masks(s, d).groupBy("label").agg(r6(A.rms([F.col("value")])).alias("rms_value"), r6(A.rms([F.col("k")])).alias("rms_k"), F.count(F.lit(1)).alias("n"))


def ranking_pivot(s, d):
    """The ranking table: a row a kind, its RMS in each noise class as columns."""
    p = _masks(s, d).groupBy("event_type").pivot("label", ["clean", "mild", "severe"]).agg(A.rms([F.col("value")]))
    return p.select("event_type", *[r6(c).alias(c) for c in ("clean", "mild", "severe")])


def asof_interp(s, d):
    """Loud readings' values from the line through the quiet ones."""
    e = events(s, d)
    q, k = e.where(F.col("value") > LOUD).select("user_id", "event_id", "t"), e.where(F.col("value") <= LOUD).select("user_id", "t", "k")
    return rounded(I.interp_asof(q, k, USER, "t", ["k"], DAY).select("user_id", "event_id", "k"), "k")


ASOF_SQL = f"""with {EVENTS}, q as (select user_id, event_id, t from e where value > {LOUD}), kn as (select user_id, t, k from e where value <= {LOUD}),
b as (select q.*, kn.t lt, kn.k lk from q asof left join kn on q.user_id = kn.user_id and q.t >= kn.t),
f as (select b.*, kn.t ft, kn.k fk from b asof left join kn on b.user_id = kn.user_id and b.t <= kn.t)
select user_id, event_id, round(case when lk is null then fk when fk is null or ft = lt then lk else lk + (fk - lk) * ((t - lt) / (ft - lt)) end, 6) + 0.0 as k from f"""


def sample_rate(s, d):
    e = events(s, d)
    x = A.sample_rate(e, USER, "t").join(A.local_rate(e, USER, "t", first=20), USER)
    # rates are some ten thousandths of a hertz: a million times for the six digits to mean something
    return x.select("user_id", r6(F.col("fs") * 1e6).alias("fs_uhz"), r6(F.col("fps") * 1e6).alias("fps_uhz"))


RATE_SQL = f"""with {EVENTS}, s as (select user_id, pos, t - lag(t) over (partition by user_id order by pos) d from e)
select user_id, round(1e6 / median(d), 6) + 0.0 as fs_uhz, round(1e6 / median(d) filter (where pos < 20), 6) + 0.0 as fps_uhz from s group by user_id"""


def segment_stats(s, d):
    x = A.segment_stats(I.within(events(s, d), _loud(s, d), USER, "t"), [*USER, "a", "b"], "value")
    return rounded(x, "a", "b", "mean", "std", "least", "most")


def first_occurrence(s, d):
    x = events(s, d).groupBy("user_id", "event_type").agg(A.first_of(["event_id", "value"], "pos"))
    return x.select("user_id", "event_type", "first.event_id", r6("first.value").alias("value"))


def corr_scan(s, d):
    """Best lag of k behind value among seven, per user: the candidate grid travels with the row."""
    rows, w = blocked(events(s, d), USER, 3)
    cands = F.array(*[F.struct(F.lit(c).alias("shift"), F.lead("k", c).over(w).alias("g") if c >= 0 else F.lag("k", -c).over(w).alias("g")) for c in range(-3, 4)])
    rows = own(rows.withColumn("__c", cands)).select("user_id", "value", F.explode("__c").alias("c")).select("user_id", "value", "c.*").where("g is not null")
    score = rows.groupBy("user_id", "shift").agg(A.mean_correlation([("value", "g")]).alias("score"))
    best = A.best_of(score.withColumn("score", F.round("score", 9)), USER, "score", "shift", [])
    return best.select("user_id", "shift", r6("score").alias("score"))


CORR_SQL = f"""with {EVENTS}, c as (select x.user_id, s.shift, round(corr(x.value, y.k), 9) score from e x, (select unnest(range(-3, 4)) shift) s, e y
  where y.user_id = x.user_id and y.pos = x.pos + s.shift group by x.user_id, s.shift),
r as (select *, row_number() over (partition by user_id order by score desc, shift) rk from c where score is not null and not {bank.nan('score')})
select user_id, cast(shift as int) as shift, round(score, 6) + 0.0 as score from r where rk = 1"""


def r_squared(s, d):
    x = events(s, d).withColumn("made", F.col("k") * 0.5 + 20)
    return rounded(A.r_squared(x, USER, [("value", "made"), ("k", "value")]), "r2")


R2_SQL = f"""with {EVENTS}, m as (select *, k * 0.5 + 20 made, avg(value) over (partition by user_id) mv, avg(k) over (partition by user_id) mk from e)
select user_id, round(1 - sum((value-made)*(value-made) + (k-value)*(k-value)) / sum((value-mv)*(value-mv) + (k-mk)*(k-mk)), 6) + 0.0 as r2 from m group by user_id"""


def _three(s, d) -> DataFrame:
    return events(s, d).select("event_type", (F.col("value") / 50).alias("x1"), (F.col("k") / 50).alias("x2"), F.lit(1.0).alias("x3"), *[((F.col("k") * c + F.col("value")) / 100 + F.sin(F.col("event_id") * c)).alias(f"y{c}") for c in (1, 2, 3)])


def _entries(df: DataFrame, key: str, m: str) -> DataFrame:
    flat = F.explode(F.flatten(F.transform(m, lambda row, i: F.transform(row, lambda v, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), v.alias("v"))))))
    return df.select(key, flat.alias("e")).select(key, "e.i", "e.j", r6("e.v").alias("v"))


def cross_moment(s, d):
    return _entries(A.cross_moments(_three(s, d), ["event_type"], ["x1", "x2", "x3"], ["y1", "y2", "y3"]), "event_type", "m")


def lstsq(s, d):
    return _entries(A.least_squares(_three(s, d), ["event_type"], ["x1", "x2", "x3"], ["y1", "y2", "y3"]), "event_type", "m")


def procrustes(s, d):
    return _entries(A.procrustes(_three(s, d), ["event_type"], ["x1", "x2", "x3"], ["y1", "y2", "y3"]), "event_type", "n")


_THREE = f"with {EVENTS}, x as (select event_type, value / 50 x1, k / 50 x2, 1.0::double x3, " + ", ".join(f"(k * {c} + value) / 100 + sin(event_id * {c}) y{c}" for c in (1, 2, 3)) + " from e)"
MOMENT_SQL = _THREE + " union all ".join(
    f" select event_type, {i}::int as i, {j}::int as j, round(sum(x{i + 1} * y{j + 1}), 6) + 0.0 as v from x group by event_type" for i in range(3) for j in range(3)
)


def _fit_sql(name: str, source: str, key: str, x: str, y: str) -> str:
    """CTEs up to name(key, m00 .. m22): least squares of three columns by three, solved by elimination."""
    x, y = x.split(), y.split()
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = [f"sum({x[i]} * {x[j]}) s{i}{j}" for i, j in pairs] + [f"sum({x[i]} * {c}) r{i}{j}" for i in range(3) for j, c in enumerate(y)]
    cols = []
    for j in range(3):
        cols += [f"{e} m{i}{j}" for i, e in enumerate(bank.solve3("s00 s01 s02 s11 s12 s22", f"r0{j} r1{j} r2{j}").split("|"))]
    return f"{name}_s as (select {key}, {', '.join(sums)} from {source} group by {key}), {name} as (select {key}, {', '.join(cols)} from {name}_s)"


LSTSQ_SQL = f"{_THREE}, {_fit_sql('ft', 'x', 'event_type', 'x1 x2 x3', 'y1 y2 y3')}" + " union all ".join(
    f" select event_type, {i}::int as i, {j}::int as j, round(m{i}{j}, 6) + 0.0 as v from ft" for i in range(3) for j in range(3)
)


def _polar_sql() -> str:
    """The orthogonal factor of the moments by Newton's iteration, X to the mean of X and its inverse transposed, until it stands."""
    at = lambda i, j: f"m{i % 3}{j % 3}"
    cof = {(i, j): f"({at(i + 1, j + 1)} * {at(i + 2, j + 2)} - {at(i + 1, j + 2)} * {at(i + 2, j + 1)})" for i in range(3) for j in range(3)}
    det = " + ".join(f"m0{j} * {cof[0, j]}" for j in range(3))
    step = ", ".join(f"(m{i}{j} + {cof[i, j]} / ({det})) / 2 m{i}{j}" for i in range(3) for j in range(3))
    first = ", ".join(f"sum(x{i + 1} * y{j + 1}) m{i}{j}" for i in range(3) for j in range(3))
    rows = " union all ".join(f"select event_type, {i}::int as i, {j}::int as j, round(m{i}{j}, 6) + 0.0 as v from po where r = 80" for i in range(3) for j in range(3))
    return _THREE.replace("with ", "with recursive ", 1) + f", po as (select 0 r, event_type, {first} from x group by event_type union all select r + 1, event_type, {step} from po where r < 80) {rows}"


POLAR_SQL = _polar_sql()


def calib_topk(s, d):
    """The three intervals of the most varied readings per user, cut to four hours."""
    e = events(s, d)
    x = I.calibration_intervals(_loud(s, d), e, USER, "t", "value", top=3, clip=14400.0)
    return rounded(x.select("user_id", F.col("rank").cast("int").alias("rank"), "a", "b", "score"), "a", "b", "score")


CALIB_SQL = f"""{_IV}, sc as (select ivl.user_id, a, b, stddev_pop(value) score from ivl join e on e.user_id = ivl.user_id and t between a and b group by all),
r as (select *, row_number() over (partition by user_id order by score desc, a desc, b desc) rk from sc)
select user_id, cast(rk as int) as rank, round(a, 6) + 0.0 as a, round(least(b, a + 14400.0), 6) + 0.0 as b, round(score, 6) + 0.0 as score from r where rk <= 3"""


def lowpass_lfilter(s, d):
    return rounded(apply_lfilter(events(s, d).select("user_id", "pos", "n", "value"), USER, ["value"], LOW, ["low"]).select("user_id", "pos", "low"), "low")


def filtfilt(s, d):
    return rounded(apply_filtfilt(events(s, d).select("user_id", "pos", "n", "value"), USER, ["value"], LOW, ["low"]).select("user_id", "pos", "low"), "low")


def bandpass_noise(s, d):
    """Rolling RMS of the band 30 to 180 at 1,000 readings a second, as the noise envelope takes it."""
    cfg = Config(noise_window_ms=9.0)
    x = noise_envelope(events(s, d).select("user_id", "pos", "n", "value"), USER, ["value"], 1000.0, cfg)
    return rounded(x.select("user_id", "pos", "noise"), "noise")


_VALUES = "src as (select user_id id, pos, n, value v from e)"
# edges as shares of half the rate, so the rate is 2
_LOW, _BAND = f"co as (select distinct user_id id, {bank.low('0.1', '2.0')} from e)", f"co as (select distinct user_id id, {bank.band('30.0', '180.0', '1000.0')} from e)"
LFILTER_SQL = f"with recursive {EVENTS}, {_VALUES}, {_LOW}, {bank.settled('co', 'cs')}, {bank.causal('f1', 'src', 'cs')} select id user_id, pos, round(y, 6) + 0.0 as low from f1"
FILTFILT_SQL = f"with recursive {EVENTS}, {_VALUES}, {_LOW}, {bank.zero_phase()} select id user_id, pos, round(y, 6) + 0.0 as low from ff"
NOISE_SQL = f"""with recursive {EVENTS}, {_VALUES}, {_BAND}, {bank.zero_phase()}, sq as (select id, pos, n, y * y v from ff), {bank.padded('sq', 'p', 'v', '5')},
m as (select id, pos, n, avg(v) over (partition by id order by pos rows between 4 preceding and 4 following) x from p)
select id user_id, pos, round(sqrt(greatest(x, 0.0)), 6) + 0.0 as noise from m where pos between 0 and n - 1"""


_NOISY = NOISE_SQL[: NOISE_SQL.index("select id user_id")]
_MASKED = f"""{_NOISY}, nz as (select id user_id, pos, n, sqrt(greatest(x, 0.0)) noise from m where pos between 0 and n - 1),
rq as (select user_id id, pos, n, greatest(0.0, least(1.0, (noise - 10.0) / 20.0)) r from nz), {bank.padded('rq', 'rp', 'r', '3')},
ra as (select id user_id, pos, avg(v) over (partition by id order by pos rows between 2 preceding and 2 following) alpha from rp),
e3 as (select e.*, noise, alpha from e join nz using (user_id, pos) join ra using (user_id, pos)), {_intervals_sql('alpha > 0.6', 3600.0, 7200.0, 3600.0, 'e3')},
la as (select *, case when not exists (select 1 from ivl where ivl.user_id = e3.user_id and e3.t between a and b) then 'clean' when noise > 25.0 then 'severe' else 'mild' end as label from e3)"""
MASKED_SQL = f"{_MASKED} select label, round(sqrt(avg(value*value)), 6) + 0.0 as rms_value, round(sqrt(avg(k*k)), 6) + 0.0 as rms_k, count(*) n from la group by 1"
RANKING_SQL = f"{_MASKED} select event_type, " + ", ".join(f"round(sqrt(avg(value*value) filter (where label = '{x}')), 6) + 0.0 as {x}" for x in ("clean", "mild", "severe")) + " from la group by 1"


def gcsv_lines(s, d):
    e = events(s, d).select("user_id", "pos", "t", (F.col("value") / 10).alias("gx"), (F.col("k") / 10).alias("gy"), F.lit(0.5).alias("gz"))
    return rate_lines(e, ["user_id", "pos"], "t", ["gx", "gy", "gz"])


GCSV_SQL = f"with {EVENTS} select user_id, pos, printf('%.3f,%.6f,%.6f,%.6f', t * 1000, radians(value / 10), radians(k / 10), radians(0.5)) as line from e"


def camera_matrix(s, d):
    """Camera matrix of each clip at half size, the default where none is known."""
    m = table(s, d, "clip_meta").select("series_id", "clip_no", "camera_matrix", F.col("calib_w").cast("double").alias("cw"), F.col("calib_h").cast("double").alias("ch")).distinct()
    k = Qn.camera_matrix_for(F.lit(720.0), F.lit(540.0), F.col("camera_matrix"), F.col("cw"), F.col("ch"))
    at = lambda i, j: r6(F.get(F.get(k, F.lit(i)), F.lit(j)))
    return m.select("series_id", "clip_no", at(0, 0).alias("fx"), at(1, 1).alias("fy"), at(0, 2).alias("cx"), at(1, 2).alias("cy"))


CAMERA_SQL = f"""with m as (select distinct series_id, clip_no, camera_matrix m, coalesce(720.0::double / calib_w, 1.0) sx, coalesce(540.0::double / calib_h, 1.0) sy from clip_meta)
select series_id, clip_no, {_r('(case when m is null then 546.4027 else m[1][1]*sx end)::double fx', '(case when m is null then 546.4027 else m[2][2]*sy end)::double fy',
 '(case when m is null then 360.0 else m[1][3]*sx end)::double cx', '(case when m is null then 270.0 else m[2][3]*sy end)::double cy')} from m"""


def lens_metadata(s, d):
    """Camera data of each unit's lens tag: wrong shapes are null, of several tags the first with a matrix wins."""
    m = table(s, d, "clip_meta")
    tag = F.to_json(F.struct(F.struct("camera_matrix", "distortion_coeffs").alias("fisheye_params"), F.struct(F.col("calib_w").alias("w"), F.col("calib_h").alias("h")).alias("calib_dimension")))
    x = lens_columns(m.select("series_id", "clip_no", tag.alias("tag")), "tag").where("camera_matrix is not null")
    x = x.groupBy("series_id").agg(A.first_of(["camera_matrix", "distortion", "calib_w", "calib_h"], "clip_no"))
    at = lambda i, j: F.get(F.get("first.camera_matrix", F.lit(i)), F.lit(j))
    each = {"fx": at(0, 0), "cx": at(0, 2), "cy": at(1, 2), **{f"k{k}": F.get("first.distortion", F.lit(k)) for k in range(4)}, "calib_w": F.col("first.calib_w"), "calib_h": F.col("first.calib_h")}
    return x.select("series_id", *[r6(c).alias(n) for n, c in each.items()])


LENS_SQL = f"""with o as (select *, row_number() over (partition by series_id order by clip_no) rn from clip_meta where camera_matrix is not null)
select series_id, {_r('camera_matrix[1][1] fx', 'camera_matrix[1][3] cx', 'camera_matrix[2][3] cy', *[f'distortion_coeffs[{k + 1}] k{k}' for k in range(4)], 'calib_w::double calib_w', 'calib_h::double calib_h')} from o where rn = 1"""


def scan_probe(s, d):
    """What a look at the samples tells per clip: number, sizes, records without time."""
    x = table(s, d, "scan_sample").dropDuplicates(["series_id", "clip_no", "idx"])
    return x.groupBy("series_id", "clip_no").agg(
        F.count(F.lit(1)).alias("n"), F.min("sample_bytes").alias("least"), F.max("sample_bytes").alias("most"), F.count_if(F.coalesce("frame_ts", F.lit(0)) == 0).alias("no_time")
    )


PROBE_SQL = """with s as (select distinct series_id, clip_no, idx, sample_bytes, frame_ts from scan_sample)
select series_id, clip_no, count(*) n, min(sample_bytes) least, max(sample_bytes) most, count(*) filter (where coalesce(frame_ts, 0) = 0) no_time from s group by all"""


def slot_alignment(s, d):
    """Slots against telemetry, positionally: matched, missing on either side, largest difference."""
    tele = table(s, d, "telemetry").dropDuplicates(["series_id", "clip_no", "idx"])
    slot = table(s, d, "slot_table").dropDuplicates(["series_id", "clip_no", "idx"])
    slot = slot.select("series_id", "clip_no", "idx", *[F.get("q_ref", F.lit(k)).alias(c) for k, c in enumerate("wxyz")])
    x = compare_positions(tele, slot, ["series_id", "clip_no"], "idx", ["w", "x", "y", "z"])
    return rounded(x, "max_diff")


SLOT_SQL = f"""with a as (select distinct series_id, clip_no, idx, w, x, y, z from telemetry), b as (select distinct series_id, clip_no, idx, q_ref from slot_table),
j as (select coalesce(a.series_id, b.series_id) series_id, coalesce(a.clip_no, b.clip_no) clip_no, a.idx ai, b.idx bi,
  greatest(abs(w-q_ref[1]), abs(x-q_ref[2]), abs(y-q_ref[3]), abs(z-q_ref[4])) p, greatest(abs(w+q_ref[1]), abs(x+q_ref[2]), abs(y+q_ref[3]), abs(z+q_ref[4])) m,
  (w+x+y+z+q_ref[1]+q_ref[2]+q_ref[3]+q_ref[4]) is not null and not {bank.nan('w+x+y+z+q_ref[1]+q_ref[2]+q_ref[3]+q_ref[4]')} ok
  from a full join b on a.series_id = b.series_id and a.clip_no = b.clip_no and a.idx = b.idx)
select series_id, clip_no, count(*) filter (where ai is not null and bi is not null) n_both, count(*) filter (where bi is null) n_left, count(*) filter (where ai is null) n_right,
  round(max(least(p, m)) filter (where ok), 6) + 0.0 as max_diff from j group by all"""


def fast_events(s, d):
    """Twelve strongest readings per user, each more than a day from the stronger ones."""
    x = M.greedy_peaks(events(s, d), USER, "t", "value", apart=DAY, most=12)
    return rounded(x.select("user_id", F.col("rank").cast("int").alias("rank"), "t", "value"), "t", "value")


FAST_SQL = f"""with recursive {EVENTS},
pk as (
  select user_id, 1 r, [arg_max(t, (abs(value), -t))] ts, [arg_max(value, (abs(value), -t))] vs from e group by user_id
  union all
  select user_id, r + 1, list_append(any_value(ts), arg_max(t, (abs(value), -t))), list_append(any_value(vs), arg_max(value, (abs(value), -t)))
  from pk join e using (user_id) where r < 12 and list_min(list_transform(ts, lambda x: abs(x - e.t))) > {DAY} group by user_id, r),
al as (select user_id, arg_max(ts, r) ts, arg_max(vs, r) vs from pk group by user_id)
select user_id, cast(i as int) as rank, round(ts[i], 6) + 0.0 as t, round(vs[i], 6) + 0.0 as value from (select *, unnest(range(1, len(ts) + 1)) i from al)"""


def telemetry_extract(s, d):
    """Orientation series of every clip: sorted, deduplicated, signs continuous, unit length."""
    x = orientation_of(table(s, d, "telemetry"), CLIP, "t", "idx")
    return rounded(x.select(*CLIP, "idx", "pos", "t", "w", "x", "y", "z"), "t", "w", "x", "y", "z")


EXTRACTED = f"""xr as (select distinct series_id, clip_no, idx, t, w, x, y, z from telemetry where t is not null and not {bank.nan('t')} and w+x+y+z is not null and not {bank.nan('w+x+y+z')} and not (w=0 and x=0 and y=0 and z=0)),
xc as (select *, row_number() over o rn, lag(w) over o pw, lag(x) over o px, lag(y) over o py, lag(z) over o pz from xr window o as (partition by series_id, clip_no order by t, idx)),
xk as (select series_id, clip_no, idx, t, w, x, y, z, row_number() over (partition by series_id, clip_no order by rn) - 1 pos from xc where rn = 1 or not (w = pw and x = px and y = py and z = pz)),
xh as (select *, case when w*lag(w) over o + x*lag(x) over o + y*lag(y) over o + z*lag(z) over o < 0 then 1 else 0 end f from xk window o as (partition by series_id, clip_no order by pos)),
xg as (select *, case when sum(f) over (partition by series_id, clip_no order by pos) % 2 = 1 then -1.0 else 1.0 end / sqrt(w*w+x*x+y*y+z*z) sg from xh),
ex as (select series_id, clip_no, idx, pos, t, w*sg w, x*sg x, y*sg y, z*sg z from xg)"""
EXTRACT_SQL = f"with {EXTRACTED} select series_id, clip_no, idx, pos, {_r('t t', 'w w', 'x x', 'y y', 'z z')} from ex"


def clean_telemetry(s, d):
    """Cleaned rates of every clip, by the filters of its own rate; null where that is too low for them."""
    x = clean(durable(orientation_of(table(s, d, "telemetry"), CLIP, "t", "idx")), CLIP)
    x = x.withColumn("tm", F.round("tm", 7))  # times are whole microseconds, so mid times have a seventh digit
    return rounded(x.select(*CLIP, "pos", "fs", "tm", "cx", "cy", "cz", "noise", "alpha", "spike_frac"), "fs", "cx", "cy", "cz", "noise", "alpha", "spike_frac")


#: CTEs of the cleaning of orientation series ek(k, pos, t, w, x, y, z): fsk rates, om mid times, no noise, al alpha, fl filtered axes (light xl yl zl, strong xs ys zs).
CLEANED = f"""pr as (select *, lead(t) over o nt, lead(w) over o nw, lead(x) over o nx, lead(y) over o ny, lead(z) over o nz from ek window o as (partition by k order by pos)),
fsk as (select k, 1 / median(nt - t) fs from pr where nt is not null group by k),
tw as (select k, pos, t, nt, w*nw+x*nx+y*ny+z*nz a, w*nx-x*nw-y*nz+z*ny b, w*ny+x*nz-y*nw-z*nx c, w*nz-x*ny+y*nx-z*nw d from pr where nt is not null),
tv as (select *, sqrt(b*b+c*c+d*d) v from tw),
om as (select *, case when a < 0 then -1 else 1 end * (case when v > 1e-12 then 2 * asin(least(v, 1.0)) / v else 2.0 end) / greatest(nt - t, 1e-9) m, count(*) over (partition by k) n from tv),
deg as (select k || '|x' id, pos, n, degrees(b * m) v from om union all select k || '|y', pos, n, degrees(c * m) from om union all select k || '|z', pos, n, degrees(d * m) from om),
{bank.padded('deg', 'p1', 'v', '7')},
me as (select id, pos, n, v, median(v) over (partition by id order by pos rows between 7 preceding and 7 following) md from p1),
de as (select id, pos, n, v, md, abs(v - md) dev from me where pos between 0 and n - 1),
{bank.padded('de', 'p2', 'dev', '7')},
ma as (select id, pos, median(v) over (partition by id order by pos rows between 7 preceding and 7 following) mad from p2),
hx as (select de.id, split_part(de.id, '|', 1) k, de.pos, n, case when dev > 6.0 * (1.4826 * mad + 1e-9) then md else v end v, dev > 6.0 * (1.4826 * mad + 1e-9) bad from de join ma using (id, pos)),
sp as (select k, avg(bad::int::double) spike_frac from hx group by k),
able as (select * from fsk where 30.0 < least(180.0, 0.475 * fs) and 25.0 < fs / 2),
ids as (select distinct id, k, fs from hx join able using (k)),
co as (select id || '|band' id, {bank.band('30.0', 'least(180.0, 0.475 * fs)', 'fs')} from ids union all select id || '|light', {bank.low('25.0', 'fs')} from ids union all select id || '|strong', {bank.low('2.5', 'fs')} from ids),
src as (select id || '|' || j id, pos, n, v from hx join able using (k), (values ('band'), ('light'), ('strong')) jobs(j)),
{bank.zero_phase()},
sq as (select split_part(id, '|', 1) k, id, pos, n, y * y v from ff where id like '%|band'),
{bank.padded('sq', 'p3', 'v', '128')},
ro as (select split_part(id, '|', 1) k, id, pos, n, v, greatest(3, floor(0.1 * fs + 0.5))::bigint size from p3 join fsk on fsk.k = split_part(id, '|', 1)),
rm as (select k, id, pos, n, sqrt(avg(v) over (partition by id order by pos rows between size // 2 preceding and size - 1 - size // 2 following)) x from ro),
no as (select k id, pos, n, max(x) noise from rm where pos between 0 and n - 1 group by all),
ra as (select *, greatest(0.0, least(1.0, (noise - 1.5) / 3.5)) r from no),
{bank.padded('ra', 'p4', 'r', '128')},
rs as (select p4.*, greatest(3, floor(0.2 * fs))::bigint size from p4 join fsk on fsk.k = id),
al as (select id k, pos, n, avg(v) over (partition by id order by pos rows between size // 2 preceding and size - 1 - size // 2 following) alpha from rs),
fl as (select split_part(id, '|', 1) k, pos, {', '.join(f"max(y) filter (where id like '%|{a}|{j}') {a}{j[0]}" for a in 'xyz' for j in ('light', 'strong'))} from ff group by 1, 2)"""
CLEAN_SQL = f"""with recursive {EXTRACTED}, ek as (select series_id || '/' || clip_no k, pos, t, w, x, y, z from ex), {CLEANED}
select split_part(om.k, '/', 1) as series_id, cast(split_part(om.k, '/', 2) as bigint) as clip_no, om.pos, round(om.t+(om.nt-om.t)/2, 7) as tm, {_r('fs fs', *[f'radians({a}l*(1-alpha)+{a}s*alpha) c{a}' for a in 'xyz'], 'noise noise', 'alpha alpha', '(case when noise is null then null else spike_frac end) spike_frac')}
from om left join fsk using (k) left join sp using (k) left join no on no.id = om.k and no.pos = om.pos left join al on al.k = om.k and al.pos = om.pos left join fl on fl.k = om.k and fl.pos = om.pos"""


def severe_bursts(s, d):
    """Bursts of the diagnosed rates whose noise passes the severe level."""
    x = table(s, d, "clean_diag").where(F.col("noise").isNotNull() & F.col("tm").isNotNull()).select(*CLIP, "idx", "tm", "noise").dropDuplicates([*CLIP, "idx"])
    x = number(x, CLIP, ["tm", "idx"], F.floor(F.col("tm") / 16).cast("long"))
    return rounded(severe_intervals(x, CLIP, "tm"), "a", "b")


SEVERE_SQL = f"""with r as (select distinct series_id || '/' || clip_no user_id, idx, tm t, noise value from clean_diag where noise is not null and tm is not null),
e as (select *, row_number() over (partition by user_id order by t, idx) - 1 pos, count(*) over (partition by user_id) n from r), {_intervals_sql('value > 8.0', 0.2, 0.2, 0.2)}
select split_part(user_id, '/', 1) as series_id, cast(split_part(user_id, '/', 2) as bigint) as clip_no, {_r('a a', 'b b')} from ivl"""


def _repaired(s, d):
    optical = table(s, d, "optical_rates").dropDuplicates([*CLIP, "idx"])
    return repair(table(s, d, "telemetry"), optical, CLIP)


def repair_status(s, d):
    """What the repair chain makes of every clip."""
    return rounded(_repaired(s, d).status.select(*CLIP, "samples", "fs", "r2", "status"), "fs", "r2")


#: No clip of the tables has the 200 good calibration readings an alignment needs; one that had would be 'measured' here and fail.
REPAIR_SQL = f"""with recursive {EXTRACTED}, ek as (select series_id || '/' || clip_no k, pos, t, w, x, y, z from ex), {CLEANED},
e as (select om.k user_id, om.pos, om.n, om.t + (om.nt - om.t) / 2 t, noise value from om join no on no.id = om.k and no.pos = om.pos where om.n >= 99), {_intervals_sql('value > 8.0', 0.2, 0.2, 0.2)},
sz as (select k, count(*) samples from ek group by k),
gd as (select series_id || '/' || clip_no k, count(distinct idx) good from optical_rates where kind = 'calib' and t is not null and quality > 0.5 and ox + oy + oz is not null group by 1)
select split_part(sz.k, '/', 1) as series_id, cast(split_part(sz.k, '/', 2) as bigint) as clip_no, samples, round(fs, 6) + 0.0 as fs, null::double as r2,
  case when samples < 100 then 'short' when fs is null then 'no rate' when sz.k not in (select k from able) then 'slow' when sz.k not in (select user_id from ivl) then 'healthy'
    when coalesce(good, 0) < 200 then 'few' else 'measured' end as status from sz left join fsk using (k) left join gd using (k)"""


#: Bursts of clips that can be aligned; the tables have none (``plans.motion`` has series that can).
BURSTS_SQL = REPAIR_SQL[: REPAIR_SQL.index("select split_part(sz.k")] + """select split_part(user_id, '/', 1) as series_id, cast(split_part(user_id, '/', 2) as bigint) as clip_no, a, b, null::double as drift_deg
from ivl join gd on gd.k = user_id where good >= 200"""


def repaired_bursts(s, d):
    """Drift closed in each repaired burst."""
    return rounded(_repaired(s, d).bursts.select(*CLIP, "a", "b", "drift_deg"), "a", "b", "drift_deg")


def _track(s, d) -> DataFrame:
    return events(s, d).select(*USER, "pos", "n", "t", F.col("value").alias("wx"), F.col("k").alias("wy"), (F.col("value") - F.col("k")).alias("wroll"), (F.col("k") / 1000).alias("dlogs"), (F.col("k") / 100).alias("quality"))


def render_metrics(s, d):
    return rounded(M.render_metrics(_track(s, d), USER, 20.0), "pan", "wobble", "shake", "zoom")


_TRACK = f"{EVENTS}, tr as (select user_id, pos, n, value wx, k wy, value - k wroll, k / 1000 dlogs, k / 100 quality from e)"
_CUM = "sum({c}) over (partition by user_id order by pos) / 20.0"
_RENDER_JOBS = [("pan", c, _CUM.format(c=c), bank.band("0.05", "1.0", "20.0")) for c in ("wx", "wy", "wroll", "dlogs")]
_RENDER_JOBS += [(n, c, c, bank.band(lo, hi, "20.0")) for n, lo, hi in (("wob", "2.0", "8.0"), ("shk", "8.0", "9.0")) for c in ("wx", "wy", "wroll")]


def _filtered_sql(jobs: list[tuple[str, str, str, str]], table: str = "tr", tag: str = "") -> str:
    """CTEs up to fy(user_id, pos, job_column...): each job (job, column, expression, coefficients) filtered both ways.  ``tag``: for the names of a second bank."""
    src = " union all ".join(f"select user_id || '|{j}|{c}' id, pos, n, {e} v from {table}" for j, c, e, _ in jobs)
    co = " union all ".join(f"select distinct user_id || '|{j}|{c}' id, {k} from {table}" for j, c, _, k in jobs)
    cols = ", ".join(f"max(y) filter (where split_part(id, '|', 2) = '{j}' and split_part(id, '|', 3) = '{c}') {j}_{c}" for j, c, _, _ in jobs)
    return f"src{tag} as ({src}), co{tag} as ({co}), {bank.zero_phase(f'src{tag}', f'co{tag}', f'ff{tag}')}, fy as (select cast(split_part(id, '|', 1) as bigint) user_id, pos, {cols} from ff{tag} group by 1, 2)"


_RMS = lambda p, cs: "sqrt(avg(" + " + ".join(f"{p}_{c} * {p}_{c}" for c in cs.split()) + "))"
RENDER_SQL = f"""with recursive {_TRACK}, {_filtered_sql(_RENDER_JOBS)}
select user_id, {', '.join(f"round(case when count(*) >= 40 then {x} end, 6) + 0.0 as {n}" for n, x in (('pan', _RMS('pan', 'wx wy wroll')), ('wobble', _RMS('wob', 'wx wy wroll')), ('shake', _RMS('shk', 'wx wy wroll')), ('zoom', _RMS('pan', 'dlogs') + ' * 100')))} from fy group by user_id"""
_RATIO = [("a", "0.5", "3.0"), ("b", "3.0", "6.0")]
RATIO_SQL = f"with recursive {_TRACK}, {_filtered_sql([(j, c, c, bank.band(lo, hi, '20.0')) for j, lo, hi in _RATIO for c in ('wx', 'wy')])}" + " union all ".join(
    f" select user_id, {lo}::double as lo, {hi}::double as hi, {_r(f'sqrt(avg({j}_wx*{j}_wx)) rms_raw', f'sqrt(avg({j}_wy*{j}_wy)) rms_out', f'corr({j}_wx,{j}_wy) corr')} from fy group by user_id" for j, lo, hi in _RATIO
)
SHIFT_SQL = f"""with {EVENTS}, q as (select user_id, pos, value, t + (-3600.0 + 240.0 * i) t, (-3600.0 + 240.0 * i)::double shift from e, range(31) r(i)), kn as (select user_id, t, k from e),
b as (select q.*, kn.t lt, kn.k lk from q asof left join kn on q.user_id = kn.user_id and q.t >= kn.t),
f as (select b.*, kn.t ft, kn.k fk from b asof left join kn on b.user_id = kn.user_id and b.t <= kn.t),
a as (select user_id, shift, median(abs(case when lk is null then fk when fk is null or ft = lt then lk else lk + (fk - lk) * ((t - lt) / (ft - lt)) end - value)) score from f group by all),
r as (select *, row_number() over (partition by user_id order by score, shift) rk from a)
select user_id, round(shift, 6) + 0.0 as shift, round(score, 6) + 0.0 as score from r where rk = 1"""
RESIDUAL_SQL = f"""with {_TRACK}, a0 as (select user_id, pos, value / 100 x, k / 100 y, sin(pos) / 10 z from e), a1 as (select *, sqrt(x*x+y*y+z*z) th from a0),
a2 as (select user_id, pos, cos(th/2) w, x * c x, y * c y, z * c z from (select *, case when th > 1e-12 then sin(th/2)/th else 0.5 end c from a1)),
a3 as (select *, lead(w) over o nw, lead(x) over o nx, lead(y) over o ny, lead(z) over o nz, lead(pos) over o np from a2 window o as (partition by user_id order by pos)),
a4 as (select user_id, pos, w*nw+x*nx+y*ny+z*nz a, w*nx-x*nw-y*nz+z*ny b, w*ny+x*nz-y*nw-z*nx c, w*nz-x*ny+y*nx-z*nw d from a3 where np is not null),
a5 as (select *, sqrt(b*b+c*c+d*d) v from a4),
a6 as (select user_id, pos, degrees(b*m) px, degrees(c*m) py, degrees(d*m) pz from (select *, case when a < 0 then -1 else 1 end * (case when v > 1e-12 then 2*asin(least(v, 1.0))/v else 2.0 end) * 20 m from a5)),
bo as (select * from tr join a6 using (user_id, pos)), gd as (select * from bo where quality > 0.4), {_fit_sql('ft', 'gd', 'user_id', 'px py pz', 'wx wy wroll')},
rs as (select user_id, wx - (px*m00+py*m10+pz*m20) x, wy - (px*m01+py*m11+pz*m21) y, wroll - (px*m02+py*m12+pz*m22) z from bo join ft using (user_id))
select user_id, {_r('sqrt(avg(x*x)) rms_x', 'sqrt(avg(y*y)) rms_y', 'sqrt(avg(z*z)) rms_z')} from rs group by user_id"""


def continuity(s, d):
    return rounded(M.continuity(events(s, d), USER, ["value", "k"]), "largest", "jump")


CONTINUITY_SQL = f"""with {EVENTS}, g as (select *, abs(value - lag(value) over o) dv, abs(k - lag(k) over o) dk from e window o as (partition by user_id order by pos))
select user_id, round(greatest(max(abs(value)), max(abs(k))), 6) + 0.0 as largest, round(greatest(max(dv), max(dk)), 6) + 0.0 as jump, count(*) filter (where {bank.nan('value')}) + count(*) filter (where {bank.nan('k')}) as n_nan from g group by user_id"""


def band_ratio(s, d):
    x = M.band_ratio(_track(s, d).select(*USER, "pos", "n", "wx", "wy"), USER, ["wx"], ["wy"], 20.0, [(0.5, 3.0), (3.0, 6.0)])
    return rounded(x, "rms_raw", "rms_out", "corr")


def shift_search(s, d):
    """Shift among 31 that brings a user's k closest to the value, by median difference."""
    e = events(s, d)
    x = M.best_shift(e.select(*USER, "t", F.col("value").alias("v")), e.select(*USER, "t", F.col("k").alias("v")), USER, "v", 3600.0, 31, shard=DAY)
    return rounded(x, "shift", "score")


def residual_motion(s, d):
    """Track minus intended path, mapped by least squares; RMS per user."""
    e = events(s, d)
    q = Qn.exp((F.col("value") / 100, F.col("k") / 100, F.sin("pos") / 10))
    path = e.select(*USER, "pos", "n", *Qn.named(q, "wxyz"))
    x = M.residual_rates(_track(s, d), path, USER, 20.0)
    return x.groupBy(*USER).agg(*[r6(A.rms([F.col(f"res_{a}")])).alias(f"rms_{a}") for a in "xyz"])


def event_ratios(s, d):
    """How much of the strongest slow turns of one axis is left in another, per user."""
    x = M.event_ratios(events(s, d).select(*USER, "pos", "n", "t", F.col("value").alias("raw"), (F.col("value") * 0.5 + F.col("k") * 0.1).alias("out")), USER, "t", "raw", "out", 20.0, apart=DAY, most=5)
    return rounded(x.select("user_id", F.col("rank").cast("int").alias("rank"), "t", "ratio"), "t", "ratio")


_LOW3 = _filtered_sql([("a", "raw", "value", bank.low("3.0", "20.0")), ("a", "out", "value * 0.5 + k * 0.1", bank.low("3.0", "20.0"))], "e")
RATIOS_SQL = f"""with recursive {EVENTS}, {_LOW3}, lo as (select user_id, t, a_raw v, a_out o from fy join e using (user_id, pos)),
pk as (
  select user_id, 1 r, [arg_max(t, (abs(v), -t))] ts from lo group by user_id
  union all
  select user_id, r + 1, list_append(any_value(ts), arg_max(t, (abs(v), -t))) from pk join lo using (user_id)
  where r < 5 and list_min(list_transform(ts, lambda x: abs(x - lo.t))) > {DAY} group by user_id, r),
al as (select user_id, arg_max(ts, r) ts from pk group by user_id), un as (select user_id, unnest(range(1, len(ts) + 1)) i, ts from al)
select un.user_id, cast(i as int) as rank, round(ts[i], 6) + 0.0 as t, round(o / v, 6) + 0.0 as ratio from un join lo on lo.user_id = un.user_id and lo.t = ts[i]"""


def zone_difference(s, d):
    """Banded difference of two axes by noise class, per user."""
    x = _masks(s, d).select(*USER, "pos", "n", "label", F.col("value").alias("v"))
    y = events(s, d).where("pos < n - 3").select(*USER, "pos", F.col("k").alias("v"))
    z = M.zone_difference(x, y, USER, ["v"], 20.0, [(2.0, 8.0), (8.0, 25.0)])
    return rounded(z, "rms")


_ZONES = [("p", "2.0", "8.0", "8.0"), ("q", "8.0", "25.0", "9.0")]
ZONE_SQL = f"""{_MASKED},
di as (select user_id, pos, n - 3 n, value - k v from e where pos < n - 3), {_filtered_sql([(j, 'v', 'v', bank.band(lo, edge, '20.0')) for j, lo, _, edge in _ZONES], 'di', 'z')}""" + " union all ".join(
    f" select user_id, {lo}::double as lo, {hi}::double as hi, label, {_r(f'sqrt(avg({j}_v*{j}_v)) rms')} from fy join la using (user_id, pos) group by user_id, label" for j, lo, hi, _ in _ZONES
)


def changed_rows(s, d):
    """Delta of a rewrite: rows that differ from the stored ones in any component, with the signs they are written with.

    The target turns every fifth row's sign and puts another fifth halfway to the next; the rest are equal and anchor the signs.
    """
    x = quats(s, d)
    a, b = _unit(x)
    half = Qn.normalise(tuple(p + q for p, q in zip(a, b)))
    of = F.col("k") % 5
    goal = [F.when(of == 2, -p).when(of == 3, h).otherwise(p) for p, h in zip(a, half)]
    x = x.select("vec_id", "k", *[c.alias(f"r{n}") for c, n in zip(a, "wxyz")], *[c.alias(n) for c, n in zip(goal, "wxyz")])
    equal = F.lit(True)
    for n in "wxyz":
        equal = equal & (F.col(n) == F.col(f"r{n}"))
    x = number(x.withColumn("changed", ~equal), ["vec_id"], ["k"], F.floor(F.col("k") / 8).cast("long"))
    x = W.sign_pin(x, ["vec_id"], ["w", "x", "y", "z"], "changed").where("changed")
    return rounded(x.select("vec_id", "k", "w", "x", "y", "z"), "w", "x", "y", "z")


CHANGED_SQL = f"""with recursive {QUATS},
hf as (select *, sqrt((aw+bw)*(aw+bw)+(ax+bx)*(ax+bx)+(ay+b_y)*(ay+b_y)+(az+bz)*(az+bz)) nn from u),
tg as (select vec_id, k, aw, ax, ay, az, {', '.join(f"case when k % 5 = 2 then -a{c} when k % 5 = 3 then (a{c} + {b})/nn else a{c} end {c}" for c, b in zip('wxyz', ('bw', 'bx', 'b_y', 'bz')))} from hf),
ch as (select *, not (w = aw and x = ax and y = ay and z = az) c from tg),
f as (
  select vec_id, k, c, w, x, y, z from ch where k = 0
  union all
  select ch.vec_id, ch.k, ch.c, ch.w*sg, ch.x*sg, ch.y*sg, ch.z*sg from f join ch on ch.vec_id = f.vec_id and ch.k = f.k + 1,
    lateral (select case when ch.c and ch.w*f.w+ch.x*f.x+ch.y*f.y+ch.z*f.z < 0 then -1.0 else 1.0 end sg))
select vec_id, k, {_r('w w', 'x x', 'y y', 'z z')} from f where c"""

QUERIES = {
    f.__name__: f
    for f in (
        quat_mul, quat_conj, quat_norm, quat_exp, quat_log, quat_slerp, quat_smoothstep, file_to_out, quats_to_rates, hemisphere, norm_jump, sign_pin,
        consecutive_dedupe, dedup_index, median_filter, hampel, uniform_filter, gradient, cumsum, fill_flagged, noise_alpha, find_intervals, interval_totals,
        range_mask, anti_mask, range_join, searchsorted, named_windows, masked_rms, ranking_pivot, asof_interp, sample_rate, segment_stats, first_occurrence,
        corr_scan, r_squared, cross_moment, lstsq, procrustes, calib_topk, lowpass_lfilter, filtfilt, bandpass_noise, gcsv_lines, camera_matrix, lens_metadata,
        scan_probe, slot_alignment, fast_events, telemetry_extract, clean_telemetry, severe_bursts, repair_status, repaired_bursts, render_metrics,
        continuity, band_ratio, event_ratios, zone_difference, shift_search, residual_motion, changed_rows,
    )
}

ORACLE = {
    "quat_mul": f"with {QUATS} select vec_id, k, {MUL} from u",
    "quat_conj": f"with {QUATS} select vec_id, k, {_r('aw w', '-ax x', '-ay y', '-az z')} from q",
    "quat_norm": f"with {QUATS} select vec_id, k, {_r('aw w', 'ax x', 'ay y', 'az z')} from u",
    "quat_exp": f"with {QUATS}, t as (select *, sqrt(ax*ax+ay*ay+az*az) th from q), h as (select *, case when th > 1e-12 then sin(th/2)/th else 0.5 end c from t) select vec_id, k, {_r('cos(th/2) w', 'ax*c x', 'ay*c y', 'az*c z')} from h",
    "quat_log": f"with {QUATS}, s as (select *, case when aw < 0 then -1.0 else 1.0 end sg, sqrt(ax*ax+ay*ay+az*az) nn from u), h as (select *, case when nn > 1e-12 then 2*asin(least(nn, 1.0))/nn else 2.0 end c from s) select vec_id, k, {_r('ax*sg*c x', 'ay*sg*c y', 'az*sg*c z')} from h",
    "quat_slerp": f"with {QUATS}{_SLERP} select vec_id, k, {_r('w/nn w', 'x/nn x', 'y/nn y', 'z/nn z')} from mm",
    "quat_smoothstep": f"with {QUATS}, c as (select *, greatest(0.0, least(1.0, aw*4+0.5)) g from q) select vec_id, k, {_r('g*g*(3-2*g) s', 'greatest(0.0,least(1.0,(ax+0.1)/0.2)) r')} from c",
    "file_to_out": f"with {QUATS}, h as (select vec_id, k, aw, ax, ay, az, -ay hw, az hx, aw hy, -ax hz from q), o as (select *, hw*0.5+hx*0.5+hy*0.5-hz*0.5 w, -hw*0.5+hx*0.5+hy*0.5+hz*0.5 x, -hw*0.5-hx*0.5+hy*0.5-hz*0.5 y, hw*0.5-hx*0.5+hy*0.5+hz*0.5 z from h) select vec_id, k, {_r('w w', 'x x', 'y y', 'z z', 'aw bw', 'ax bx', 'ay by', 'az bz')} from o",
    "quats_to_rates": RATES_SQL,
    "hemisphere": HEMI_SQL,
    "norm_jump": JUMP_SQL,
    "sign_pin": PIN_SQL,
    "consecutive_dedupe": _FLAG + " select user_id, pos, event_id, event_type from g where nw = 1",
    "dedup_index": _FLAG + " select user_id, pos, cast(sum(nw) over (partition by user_id order by pos) - 1 as bigint) as dedup_idx from g",
    "median_filter": MEDIAN_SQL,
    "hampel": HAMPEL_SQL,
    "uniform_filter": UNIFORM_SQL,
    "gradient": GRADIENT_SQL,
    "cumsum": f"with {EVENTS} select user_id, pos, round(sum(value) over (partition by user_id order by pos) / 100.0, 6) + 0.0 as angle from e",
    "fill_flagged": FILL_SQL,
    "noise_alpha": ALPHA_SQL,
    "find_intervals": INTERVALS_SQL,
    "interval_totals": f"{_IV} select user_id, count(*) n, round(sum(b - a), 6) + 0.0 as seconds from ivl group by user_id",
    "range_mask": f"{_IV} select user_id, event_id from e where exists (select 1 from ivl where ivl.user_id = e.user_id and e.t between a and b)",
    "anti_mask": f"{_IV} select user_id, event_id from e where not exists (select 1 from ivl where ivl.user_id = e.user_id and e.t between a and b)",
    "range_join": f"{_IV} select e.user_id, event_id, {_r('a a', 'b b')} from e join ivl on ivl.user_id = e.user_id and e.t between a - 5400.0 and b + 5400.0",
    "searchsorted": f"{_IV} select e.user_id, {_r('a a', 'b b')}, min(pos) i0, max(pos) i1 from e join ivl on ivl.user_id = e.user_id and e.t between a and b group by e.user_id, a, b",
    "named_windows": LABEL_SQL,
    "masked_rms": MASKED_SQL,
    "ranking_pivot": RANKING_SQL,
    "asof_interp": ASOF_SQL,
    "sample_rate": RATE_SQL,
    "segment_stats": f"{_IV} select e.user_id, {_r('a a', 'b b')}, count(*) n, {_r('avg(value) mean', 'stddev_pop(value) std', 'min(value) least', 'max(value) most')} from e join ivl on ivl.user_id = e.user_id and e.t between a and b group by e.user_id, a, b",
    "first_occurrence": f"with {EVENTS} select user_id, event_type, arg_min(event_id, pos) event_id, round(arg_min(value, pos), 6) + 0.0 as value from e group by 1, 2",
    "corr_scan": CORR_SQL,
    "r_squared": R2_SQL,
    "cross_moment": MOMENT_SQL,
    "lstsq": LSTSQ_SQL,
    "procrustes": POLAR_SQL,
    "calib_topk": CALIB_SQL,
    "lowpass_lfilter": LFILTER_SQL,
    "filtfilt": FILTFILT_SQL,
    "bandpass_noise": NOISE_SQL,
    "gcsv_lines": GCSV_SQL,
    "camera_matrix": CAMERA_SQL,
    "lens_metadata": LENS_SQL,
    "scan_probe": PROBE_SQL,
    "slot_alignment": SLOT_SQL,
    "telemetry_extract": EXTRACT_SQL,
    "clean_telemetry": CLEAN_SQL,
    "repair_status": REPAIR_SQL,
    "repaired_bursts": BURSTS_SQL,
    "severe_bursts": SEVERE_SQL,
    "continuity": CONTINUITY_SQL,
    "changed_rows": CHANGED_SQL,
    "fast_events": FAST_SQL,
    "render_metrics": RENDER_SQL,
    "band_ratio": RATIO_SQL,
    "event_ratios": RATIOS_SQL,
    "zone_difference": ZONE_SQL,
    "shift_search": SHIFT_SQL,
    "residual_motion": RESIDUAL_SQL,
}
