"""Registered queries of alignment, patch and splice, on long series built from whole tables, and their SQL.

``events`` of one type in order are the rows of one sensor stream of 100 readings a second: a smooth
turning (known in closed form) that shakes for one second in ten.  The measured motion is the smooth
one at 50 readings a second, turned by a known matrix and shifted by a known time.  ``embeddings``
are sixteen orientations a vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.config import Config
from gyrolith.functions import quat as Qn
from gyrolith.operators import windows as W
from gyrolith.operators.detect import noisy_intervals, severe_intervals
from gyrolith.operators.ordered import number
from gyrolith.operators.repair import optical_patch, splice_orientation, video_alignment
from gyrolith.plans import bank
from gyrolith.plans.pipeline import clean, repair
from gyrolith.plans.series import CLEANED, HEMI_SQL, QUATS, _intervals_sql, _quat_series, _r, r6, rounded
from gyrolith.session import durable, table

KIND = ["event_type"]
SHIFT = 0.024
#: Measured motion times this matrix is the sensor's.
TURN = ((0.0, 1.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 0.0, 1.0))
DEMO = Config(ramp=0.03)


def _stream(s, d) -> DataFrame:
    """event_type, pos, n, t, g (of each reading's own value), written once."""
    e = table(s, d, "events").select("event_type", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = number(e, KIND, ["us", "event_id"], F.floor(F.col("us") / F.lit(86_400_000_000)).cast("long"))
    return durable(e.select("event_type", "pos", "n", (F.col("pos") / 100.0).alias("t"), (F.col("value") / 50.0).alias("g")))


def _turned(rows: DataFrame, vector: list, prefix: str) -> DataFrame:
    """Add the unit quaternion of a rotation vector, step by step, so that no expression is written out twice."""
    v, q = [f"__v{k}" for k in range(3)], [f"{prefix}{c}" for c in "wxyz"]
    rows = rows.withColumns(dict(zip(v, vector)))
    rows = rows.withColumn("__th", Qn.magnitude([F.col(c) for c in v]))
    rows = rows.withColumn("__k", F.when(F.col("__th") > 1e-12, F.try_divide(F.sin(F.col("__th") / 2), F.col("__th"))).otherwise(0.5))
    rows = rows.withColumns({q[0]: F.cos(F.col("__th") / 2), **{n: F.col(c) * F.col("__k") for n, c in zip(q[1:], v)}})
    return rows.drop(*v, "__th", "__k")


def _course(stream: DataFrame, prefix: str) -> DataFrame:
    """Add the smooth orientation."""
    t = F.col("t")
    return _turned(stream, [0.9 * F.sin(0.7 * t) + 0.2 * F.sin(2.1 * t), 0.7 * F.cos(0.5 * t), 0.6 * F.sin(1.3 * t + 1.0)], prefix)


def _orientation(stream: DataFrame) -> DataFrame:
    """The stream's orientation, shaken from the sixth to the seventh second of every ten."""
    at = F.col("pos") % 1000
    rows = _course(stream, "a").withColumn("__h", F.when((at >= 600) & (at < 700), 0.004 * F.col("g") * F.sin(220.0 * F.col("t"))).otherwise(0.0))
    rows = _turned(rows, [F.col("__h"), -F.col("__h"), F.col("__h") * 0.5], "b")
    return rows.select("event_type", "pos", "n", "t", *Qn.named(Qn.mul(Qn.q_of("a"), Qn.q_of("b")), "wxyz"))


def _measured(stream: DataFrame) -> DataFrame:
    """kind, t, ox, oy, oz, quality of every second reading; written, since filters on what is computed here would write it out again."""
    true = _course(stream.select("event_type", "pos", "n", "t"), "")
    true = W.rates(true, KIND, "t", "wxyz").where("pos % 2 = 0")
    back = [sum((F.col(f"w{c}") * TURN[i][j] for j, c in enumerate("xyz")), F.lit(0.0)) for i in range(3)]
    at = F.col("pos") % 1000
    seen = true.select(
        "event_type", F.when((at >= 500) & (at < 800), "noisy").otherwise("calib").alias("kind"), F.col("pos").alias("idx"),
        (F.col("tm") - SHIFT).alias("t"), *[c.alias(f"o{a}") for a, c in zip("xyz", back)], F.when(F.col("pos") % 37 == 0, 0.2).otherwise(0.9).alias("quality"),
    )
    return durable(seen)


def motion_alignment(s, d):
    """Shift and map of the measured stream, found from its calibration readings."""
    stream = _stream(s, d)
    diag = clean(durable(_orientation(stream)), KIND)
    x = video_alignment(_measured(stream).where("kind = 'calib'"), diag, KIND)
    entry = {f"n{i}{j}": F.round(F.get(F.get("n", F.lit(i)), F.lit(j)), 1) + 0.0 for i in range(3) for j in range(3)}
    return x.select("event_type", "status", (F.abs(F.col("shift") - SHIFT) < 0.003).alias("shift_found"), (F.col("r2") > 0.98).alias("good"), *[c.alias(k) for k, c in entry.items()])


def motion_patch(s, d):
    """Rates inside the noisy stretches after measured motion took their place, by the known alignment."""
    stream = _stream(s, d)
    diag = durable(clean(durable(_orientation(stream)), KIND))
    n = F.array(*[F.array(*[F.lit(v) for v in row]) for row in TURN])
    align = stream.select("event_type").distinct().select("event_type", F.lit(SHIFT).alias("shift"), n.alias("n"), F.lit("ok").alias("status"))
    noisy = durable(noisy_intervals(diag, KIND, "tm"))
    x = optical_patch(diag, _measured(stream).where("kind = 'noisy'"), align, noisy, KIND)
    x = x.where(F.abs(F.col("rx") - F.col("cx")) + F.abs(F.col("ry") - F.col("cy")) > 0)
    return rounded(x.select("event_type", "pos", "rx", "ry", "rz"), "rx", "ry", "rz")


def motion_status(s, d):
    """The whole chain: what became of each stream, and how many bursts were rebuilt."""
    stream = _stream(s, d)
    done = repair(durable(_orientation(stream)), _measured(stream), KIND, order="pos")
    bursts = done.bursts.groupBy("event_type").agg(F.count(F.lit(1)).alias("bursts"), (F.max("drift_deg") < 60).alias("small_drift"))
    return done.status.join(bursts, KIND, "left").select("event_type", "samples", "status", F.coalesce("bursts", F.lit(0)).cast("long").alias("bursts"), "small_drift")


def motion_severe(s, d):
    """Severe bursts of the streams, from their orientations on."""
    diag = clean(durable(_orientation(_stream(s, d))), KIND)
    return rounded(severe_intervals(diag, KIND, "tm"), "a", "b")


def _spliced(s, d) -> tuple[DataFrame, DataFrame]:
    """Vectors' orientations from the third to the fourteenth rebuilt from rates that are a little off."""
    q = durable(W.hemisphere(_quat_series(s, d), ["vec_id"], ["w", "x", "y", "z"]))
    rates = W.rates(q, ["vec_id"], "t", "wxyz")
    off = {f"r{a}": F.col(f"w{a}") + F.sin(F.col("k") * (i + 1.0)) for i, a in enumerate("xyz")}
    rates = rates.select("vec_id", "pos", *[c.alias(n) for n, c in off.items()])
    severe = q.select("vec_id").distinct().select("vec_id", F.lit(0.02).alias("a"), F.lit(0.13).alias("b"))
    return splice_orientation(q, rates, severe, ["vec_id"], DEMO)


def integrate_splice(s, d):
    return rounded(_spliced(s, d)[0].select("vec_id", "k", "w", "x", "y", "z"), "w", "x", "y", "z")


def splice_drift(s, d):
    return rounded(_spliced(s, d)[1].select("vec_id", "a", "b", "drift_deg"), "a", "b", "drift_deg")


_MUL = lambda a, b: [
    f"{a}w*{b}w-{a}x*{b}x-{a}y*{b}y-{a}z*{b}z", f"{a}w*{b}x+{a}x*{b}w+{a}y*{b}z-{a}z*{b}y", f"{a}w*{b}y-{a}x*{b}z+{a}y*{b}w+{a}z*{b}x", f"{a}w*{b}z+{a}x*{b}y-{a}y*{b}x+{a}z*{b}w"
]


def _exp(v: list[str], p: str) -> str:
    """Columns pw, px, py, pz of the quaternion of a rotation vector."""
    th = f"sqrt({' + '.join(f'({c})*({c})' for c in v)})"
    k = f"(case when {th} > 1e-12 then sin({th}/2)/{th} else 0.5 end)"
    return f"cos({th}/2) {p}w, " + ", ".join(f"({c})*{k} {p}{a}" for c, a in zip(v, "xyz"))


def _rates(source: str, key: str, out: str, names: str = "ox oy oz") -> str:
    """CTEs up to out(key, pos, n, t, tm, rates) of orientations source(key, pos, t, w, x, y, z)."""
    o = names.split()
    return f"""{out}_l as (select *, lead(t) over o nt, lead(w) over o nw, lead(x) over o nx, lead(y) over o ny, lead(z) over o nz from {source} window o as (partition by {key} order by pos)),
{out}_d as (select {key}, pos, t, nt, w*nw+x*nx+y*ny+z*nz a, w*nx-x*nw-y*nz+z*ny b, w*ny+x*nz-y*nw-z*nx c, w*nz-x*ny+y*nx-z*nw d from {out}_l where nt is not null),
{out}_v as (select *, sqrt(b*b+c*c+d*d) v from {out}_d),
{out}_m as (select *, case when a < 0 then -1 else 1 end * (case when v > 1e-12 then 2*asin(least(v, 1.0))/v else 2.0 end) / greatest(nt - t, 1e-9) m from {out}_v),
{out} as (select {key}, pos, count(*) over (partition by {key}) n, t, t + (nt - t) / 2 tm, b*m {o[0]}, c*m {o[1]}, d*m {o[2]} from {out}_m)"""


_T = "(pos / 100.0::double)"
_COURSE = [f"0.9*sin(0.7*{_T})+0.2*sin(2.1*{_T})", f"0.7*cos(0.5*{_T})", f"0.6*sin(1.3*{_T}+1.0)"]
_STREAM = f"""ev as (select event_type, row_number() over (partition by event_type order by ts, event_id) - 1 pos, value / 50.0 g from events),
sk as (select *, case when pos % 1000 >= 600 and pos % 1000 < 700 then 0.004 * g * sin(220.0 * {_T}) else 0.0 end h from ev),
qq as (select event_type, pos, {_T} t, {_exp(_COURSE, 'a')}, {_exp(['h', '-h', 'h*0.5'], 'e')} from sk),
ek as (select event_type k, pos, t, {', '.join(f'{e} {c}' for e, c in zip(_MUL('a', 'e'), 'wxyz'))} from qq)"""
_SERIES = _STREAM + ", " + CLEANED
_SEEN = f"""tr as (select event_type, pos, t, aw w, ax x, ay y, az z from qq), {_rates('tr', 'event_type', 'sm')},
op as (select event_type k, pos, case when pos % 1000 >= 500 and pos % 1000 < 800 then 'noisy' else 'calib' end kind, tm - {SHIFT} t, oy ox, -ox oy, oz, case when pos % 37 = 0 then 0.2 else 0.9 end quality from sm where pos % 2 = 0)"""
SEVERE_SQL = f"""with recursive {_SERIES}, e as (select om.k user_id, om.pos, om.n, om.t + (om.nt - om.t) / 2 t, noise value from om join no on no.id = om.k and no.pos = om.pos), {_intervals_sql('value > 8.0', 0.2, 0.2, 0.2)}
select user_id as event_type, {_r('a a', 'b b')} from ivl"""
ALIGN_SQL = f"""with {_STREAM}, {_SEEN}, c as (select k, count(*) filter (where kind = 'calib' and quality > 0.5) good from op group by k)
select k as event_type, case when good >= 200 then 'ok' else 'few' end as status, case when good >= 200 then true end as shift_found, case when good >= 200 then true end as good,
  {', '.join(f"case when good >= 200 then {TURN[i][j]}::double end as n{i}{j}" for i in range(3) for j in range(3))} from c"""
STATUS_SQL = f"""with recursive {_SERIES}, {_SEEN}, c as (select k, count(*) filter (where kind = 'calib' and quality > 0.5) good from op group by k),
e as (select om.k user_id, om.pos, om.n, om.t + (om.nt - om.t) / 2 t, noise value from om join no on no.id = om.k and no.pos = om.pos), {_intervals_sql('value > 8.0', 0.2, 0.2, 0.2)},
bc as (select user_id, a, b, count(*) m from ivl join ek on ek.k = user_id and ek.t between a and b group by all having count(*) >= 9), bn as (select user_id, count(*) bursts from bc group by 1),
sz as (select k, count(*) samples from ek group by k)
select k as event_type, samples, case when samples < 100 then 'short' when k not in (select user_id from ivl) then 'healthy' when good < 200 then 'few' else 'repaired' end as status,
  case when good >= 200 and samples >= 100 then coalesce(bursts, 0) else 0 end as bursts, case when good >= 200 and bursts > 0 then true end as small_drift
from sz join c using (k) left join bn on bn.user_id = sz.k"""
_PRE = "b.k || '|' || b.no"
PATCH_SQL = f"""with recursive {_SERIES}, {_SEEN},
e as (select om.k user_id, om.pos, om.n, om.t + (om.nt - om.t) / 2 t, alpha value from om join al on al.k = om.k and al.pos = om.pos), {_intervals_sql('value > 0.15', 0.5, 1.0, 0.2)},
bu as (select user_id k, a, b, row_number() over (partition by user_id order by a)::varchar no from ivl),
lt as (select fl.k || '|' || j id, fl.pos, n, case j when 'x' then xl when 'y' then yl else zl end v from fl join om using (k, pos), (values ('x'), ('y'), ('z')) jobs(j)),
lc as (select distinct lt.id, {bank.low('8.0', 'fs')} from lt join fsk on fsk.k = split_part(lt.id, '|', 1)),
{bank.zero_phase('lt', 'lc', 'mz')},
md as (select split_part(id, '|', 1) k, pos, any_value(n) n, {', '.join(f"max(y) filter (where id like '%|{a}') m{a}" for a in 'xyz')} from mz group by 1, 2),
mg as (select k id, pos, n, sqrt(mx*mx+my*my+mz*mz) v from md), {bank.padded('mg', 'mp', 'v', '64')},
ms as (select mp.*, greatest(3, floor(0.1 * fs))::bigint size from mp join fsk on fsk.k = mp.id),
mr as (select id k, pos, avg(v) over (partition by id order by pos rows between size // 2 preceding and size - 1 - size // 2 following) rate from ms),
gy as (select b.k, {_PRE} bk, om.pos, om.t + (om.nt - om.t) / 2 t, rate, noise, mx, my, mz from bu b join om on om.k = b.k and om.t + (om.nt - om.t) / 2 between b.a and b.b
  join mr on mr.k = om.k and mr.pos = om.pos join md on md.k = om.k and md.pos = om.pos join no on no.id = om.k and no.pos = om.pos),
tn as (select k, pos, t + {SHIFT} t, degrees(-oy) px, degrees(ox) py, degrees(oz) pz, quality from op where kind = 'noisy'),
fr as (select k, coalesce(1 / median(d), 100.0) fps from (select k, t - lag(t) over (partition by k order by t) d, row_number() over (partition by k order by t) rn from tn) where rn <= 100 group by k),
vi as (select {_PRE} bk, b.k, row_number() over (partition by b.k, b.no order by tn.t) - 1 pos, count(*) over (partition by b.k, b.no) n, tn.t, px, py, pz, quality from bu b join tn on tn.k = b.k and tn.t between b.a - 0.3 and b.b + 0.3),
us as (select bk from vi group by bk having count(*) >= 30 and avg((quality < 0.3)::int) <= 0.3),
vg as (select * from vi join us using (bk)),
vf as (select *, last_value(case when quality >= 0.3 then {{'t': t, 'x': px, 'y': py, 'z': pz}} end ignore nulls) over (partition by bk order by pos rows between unbounded preceding and current row) lo,
  first_value(case when quality >= 0.3 then {{'t': t, 'x': px, 'y': py, 'z': pz}} end ignore nulls) over (partition by bk order by pos rows between current row and unbounded following) hi from vg),
vj as (select bk || '|' || j id, pos, n, t, case when lo is null then hi[j] when hi is null or hi['t'] = lo['t'] then lo[j] else lo[j] + (hi[j] - lo[j]) * ((t - lo['t']) / (hi['t'] - lo['t'])) end v
  from (select bk, pos, n, t, map {{'t': lo.t, 'x': lo.x, 'y': lo.y, 'z': lo.z}} lo, map {{'t': hi.t, 'x': hi.x, 'y': hi.y, 'z': hi.z}} hi from vf), (values ('x'), ('y'), ('z')) jobs(j)),
vc as (select distinct vj.id, {bank.low('least(8.0, 0.45 * fps)', 'fps')} from vj join fr on fr.k = split_part(vj.id, '|', 1)),
{bank.zero_phase('vj', 'vc', 'vo')},
kn as (select vj.id, vj.t, y from vo join vj using (id, pos)),
gq as (select bk || '|' || j id, bk, j, pos, t from gy join us using (bk), (values ('x'), ('y'), ('z')) jobs(j)),
g1 as (select gq.*, kn.t lt, kn.y ly from gq asof left join kn on kn.id = gq.id and gq.t >= kn.t),
g2 as (select g1.*, kn.t ft, kn.y fy from g1 asof left join kn on kn.id = g1.id and g1.t <= kn.t),
g3 as (select bk, pos, j, case when ly is null then fy when fy is null or ft = lt then ly else ly + (fy - ly) * ((t - lt) / (ft - lt)) end v from g2),
vd as (select bk, pos, {', '.join(f"max(v) filter (where j = '{a}') v{a}" for a in 'xyz')} from g3 group by 1, 2),
bb as (select bk id, k, gy.pos orig, row_number() over (partition by bk order by gy.pos) - 1 pos, count(*) over (partition by bk) n, rate, 1 - greatest(0.0, least(1.0, (max(noise) over (partition by bk) - 200) / 100)) trust, mx, my, mz, vx, vy, vz,
  sqrt(vx*vx+vy*vy+vz*vz) vn from gy join vd using (bk, pos)),
{bank.padded('bb', 'b1', 'vn', '64')},
b2 as (select b1.*, greatest(3, floor(0.1 * fs))::bigint size from b1 join fsk on fsk.k = split_part(id, '|', 1)),
b3 as (select id, pos, avg(v) over (partition by id order by pos rows between size // 2 preceding and size - 1 - size // 2 following) vr from b2),
b4 as (select bb.*, trust * greatest(0.0, least(1.0, (rate - 100) / 150)) + (1 - trust) * greatest(0.0, least(1.0, (least(rate, vr) - 100) / 150)) wf from bb join b3 using (id, pos)),
{bank.padded('b4', 'b5', 'wf', '64')},
b6 as (select b5.*, greatest(3, floor(0.15 * fs))::bigint size from b5 join fsk on fsk.k = split_part(id, '|', 1)),
b7 as (select id, pos, avg(v) over (partition by id order by pos rows between size // 2 preceding and size - 1 - size // 2 following) wf from b6),
pt as (select k, orig pos, {', '.join(f'(1 - b7.wf) * v{a} + b7.wf * m{a} p{a}' for a in 'xyz')} from b4 join b7 using (id, pos)),
fi as (select pt.k, pt.pos, greatest(0.0, least(1.0, alpha / 0.35)) w, alpha, px, py, pz, {', '.join(f'{a}l, {a}s' for a in 'xyz')} from pt join al on al.k = pt.k and al.pos = pt.pos join fl on fl.k = pt.k and fl.pos = pt.pos),
rz as (select k, pos, {', '.join(f'radians((1 - w) * {a}l + w * p{a}) r{a}, radians({a}l * (1 - alpha) + {a}s * alpha) c{a}' for a in 'xyz')} from fi)
select k as event_type, pos, {_r('rx rx', 'ry ry', 'rz rz')} from rz where abs(rx - cx) + abs(ry - cy) > 0"""
_HEMI = HEMI_SQL[HEMI_SQL.index(QUATS) + len(QUATS) : HEMI_SQL.index("select vec_id, k, round")].lstrip(",\n")
_SPLICE = f"""with recursive {QUATS}, {_HEMI},
hq as (select vec_id, k, k pos, k / 100.0::double t, aw*sg w, ax*sg x, ay*sg y, az*sg z from g), {_rates('hq', 'vec_id', 'hr')},
ho as (select vec_id, pos, {', '.join(f'o{a} + sin(pos * {i + 1}.0) o{a}' for i, a in enumerate('xyz'))} from hr),
st as (select ho.vec_id, ho.pos, {_exp([f'o{a} * ((ho.pos+1)/100.0::double - ho.pos/100.0::double)' for a in 'xyz'], 'e')} from ho),
ig as (
  select vec_id, pos, w aw, x ax, y ay, z az from hq where pos = 2
  union all
  select ig.vec_id, ig.pos + 1, {', '.join(_MUL('a', 'e'))} from ig join st on st.vec_id = ig.vec_id and st.pos = ig.pos where ig.pos < 13),
nm as (select vec_id, pos, aw/nn aw, ax/nn ax, ay/nn ay, az/nn az from (select *, sqrt(aw*aw+ax*ax+ay*ay+az*az) nn from ig)),
e1 as (select nm.vec_id, aw*w+ax*x+ay*y+az*z a, aw*x-ax*w-ay*z+az*y b, aw*y+ax*z-ay*w-az*x c, aw*z-ax*y+ay*x-az*w d from nm join hq using (vec_id, pos) where pos = 13),
e2 as (select *, sqrt(b*b+c*c+d*d) v from e1),
dr as (select vec_id, b*m dx, c*m dy, d*m dz from (select *, case when a < 0 then -1 else 1 end * case when v > 1e-12 then 2*asin(least(v, 1.0))/v else 2.0 end m from e2))"""
_SM = lambda x: f"(greatest(0.0, least(1.0, {x})) * greatest(0.0, least(1.0, {x})) * (3 - 2 * greatest(0.0, least(1.0, {x}))))"
_S = _SM("(t - 2/100.0::double) / (13/100.0::double - 2/100.0::double)")
SPLICE_SQL = f"""{_SPLICE},
f1 as (select nm.*, t, w, x, y, z, {_S} s, least({_SM('(t - 2/100.0::double) / 0.03')}, {_SM('(13/100.0::double - t) / 0.03')}) r, dx, dy, dz from nm join hq using (vec_id, pos) join dr using (vec_id)),
f2 as (select vec_id, pos, w, x, y, z, r, aw, ax, ay, az, {_exp(['s*dx', 's*dy', 's*dz'], 'e')} from f1),
f3 as (select vec_id, pos, w, x, y, z, r, {', '.join(f'{e} c{c}' for e, c in zip(_MUL('a', 'e'), 'wxyz'))} from f2),
f4 as (select *, case when w*cw+x*cx+y*cy+z*cz < 0 then -1.0 else 1.0 end sg, acos(least(abs(w*cw+x*cx+y*cy+z*cz), 1.0)) th from f3),
f5 as (select *, case when sin(th) < 1e-6 then 1 - r else sin((1-r)*th)/sin(th) end wa, case when sin(th) < 1e-6 then r else sin(r*th)/sin(th) end wb from f4),
f6 as (select vec_id, pos, w*wa+cw*sg*wb w, x*wa+cx*sg*wb x, y*wa+cy*sg*wb y, z*wa+cz*sg*wb z from f5),
f7 as (select vec_id, pos, w/nn w, x/nn x, y/nn y, z/nn z from (select *, sqrt(w*w+x*x+y*y+z*z) nn from f6))
select hq.vec_id, hq.pos k, {_r('coalesce(f7.w,hq.w) w', 'coalesce(f7.x,hq.x) x', 'coalesce(f7.y,hq.y) y', 'coalesce(f7.z,hq.z) z')} from hq left join f7 using (vec_id, pos)"""
DRIFT_SQL = f"{_SPLICE} select vec_id, 0.02::double as a, 0.13::double as b, round(degrees(sqrt(dx*dx+dy*dy+dz*dz)), 6) + 0.0 as drift_deg from dr"

QUERIES = {f.__name__: f for f in (motion_alignment, motion_patch, motion_status, motion_severe, integrate_splice, splice_drift)}
ORACLE = {"motion_alignment": ALIGN_SQL, "motion_patch": PATCH_SQL, "motion_status": STATUS_SQL, "motion_severe": SEVERE_SQL, "integrate_splice": SPLICE_SQL, "splice_drift": DRIFT_SQL}
