"""Zero-phase and causal filters in SQL, with coefficients from textbook closed forms.

The SQL shares nothing with ``functions.design``: second-order Butterworth sections come from the
bilinear transform written out, s = (1 - z) / (1 + z) with tan-warped edges.
"""

from __future__ import annotations


def nan(x: str) -> str:
    """NaN, told by its text: over files whose statistics name no NaN, DuckDB 2.0 folds isnan() to false (sf0.001 has one such row)."""
    return f"(({x})::double::varchar = 'nan')"


def low(cut: str, fs: str) -> str:
    """Columns b0..b4, a1..a4, p of a low-pass of order two; cut and fs: SQL expressions in hertz."""
    w = f"tan(pi() * ({cut}) / ({fs}))"
    d = f"(1 + sqrt(2.0) * {w} + {w} * {w})"
    b = f"{w} * {w} / {d}"
    return f"{b} b0, 2 * {b} b1, {b} b2, 0.0::double b3, 0.0::double b4, 2 * ({w} * {w} - 1) / {d} a1, (1 - sqrt(2.0) * {w} + {w} * {w}) / {d} a2, 0.0::double a3, 0.0::double a4, 9 p"


def band(lo: str, hi: str, fs: str) -> str:
    """The same of a band-pass made of a low-pass of order two: (s^2 + W) / (B s) in place of s."""
    w1, w2 = (f"tan(pi() * ({x}) / ({fs}))" for x in (lo, hi))
    B, W = f"({w2} - {w1})", f"({w1} * {w2})"
    c3, c2, c1, c0 = f"(sqrt(2.0) * {B})", f"(2 * {W} + {B} * {B})", f"(sqrt(2.0) * {B} * {W})", f"({W} * {W})"
    d = f"(1 + {c3} + {c2} + {c1} + {c0})"
    b = f"{B} * {B} / {d}"
    return (
        f"{b} b0, 0.0::double b1, -2 * {b} b2, 0.0::double b3, {b} b4, (-4 - 2 * {c3} + 2 * {c1} + 4 * {c0}) / {d} a1, (6 - 2 * {c2} + 6 * {c0}) / {d} a2, "
        f"(-4 + 2 * {c3} - 2 * {c1} + 4 * {c0}) / {d} a3, (1 - {c3} + {c2} - {c1} + {c0}) / {d} a4, 15 p"
    )


def settled(table: str, out: str) -> str:
    """Coefficients (id, b0.., a1.., p) with the state z0..z3 that a constant input of 1 leaves unchanged."""
    return f"""{out} as (select *, b1 - a1 * g + z1 z0 from (select *, b2 - a2 * g + z2 z1 from (select *, b3 - a3 * g + z3 z2 from
  (select *, b4 - a4 * g z3 from (select *, (b0 + b1 + b2 + b3 + b4) / (1 + a1 + a2 + a3 + a4) g from {table})))))"""


def causal(name: str, source: str, co: str) -> str:
    """name(id, pos, y, s0..s3): the filter over source(id, pos from 0, v), begun as if v at 0 had always been."""
    step = lambda x, z: (
        f"{z[0]} + c.b0 * {x} y, {z[1]} + c.b1 * {x} - c.a1 * ({z[0]} + c.b0 * {x}) s0, {z[2]} + c.b2 * {x} - c.a2 * ({z[0]} + c.b0 * {x}) s1, "
        f"{z[3]} + c.b3 * {x} - c.a3 * ({z[0]} + c.b0 * {x}) s2, c.b4 * {x} - c.a4 * ({z[0]} + c.b0 * {x}) s3"
    )
    first = step("x.v", [f"c.z{k} * x.v" for k in range(4)])
    after = step("x.v", [f"f.s{k}" for k in range(4)])
    return f"""{name} as (
  select x.id, x.pos, {first} from {source} x join {co} c on c.id = x.id where x.pos = 0
  union all select x.id, x.pos, {after} from {name} f join {source} x on x.id = f.id and x.pos = f.pos + 1 join {co} c on c.id = x.id)"""


def zero_phase(src: str = "src", co: str = "co", out: str = "ff") -> str:
    """CTEs up to out(id, pos, n, y) of src(id, pos, n, v); null for series not longer than the padding.

    Needs ``with recursive`` and co(id, b0.., a1.., p).
    """
    return f"""{settled(co, out + '_co')},
{out}_ends as (select s.id, s.n, p, arg_min(v, pos) v0, arg_max(v, pos) v1 from {src} s join {co} using (id) group by s.id, s.n, p having s.n > p),
{out}_ext as (select s.id, s.pos + p pos, v from {src} s join {out}_ends using (id)
  union all select s.id, p - s.pos, 2 * v0 - v from {src} s join {out}_ends using (id) where s.pos between 1 and p
  union all select s.id, 2 * (s.n - 1) - s.pos + p, 2 * v1 - v from {src} s join {out}_ends using (id) where s.pos between s.n - 1 - p and s.n - 2),
{causal(out + '_a', out + '_ext', out + '_co')},
{out}_turned as (select a.id, n + 2 * p - 1 - a.pos pos, a.y v from {out}_a a join {out}_ends using (id)),
{causal(out + '_b', out + '_turned', out + '_co')},
{out} as (select s.id, s.pos, s.n, b.y from {src} s left join {out}_ends e using (id) left join {out}_b b on b.id = s.id and b.pos = e.n + e.p - 1 - s.pos)"""


def padded(source: str, out: str, value: str, h: str) -> str:
    """out(id, pos, n, v): a series with its edge values repeated h times."""
    return f"""{out} as (select id, pos, n, {value} v from {source} union all select id, -i, n, {value} from {source}, range(1, {h} + 1) r(i) where pos = 0
  union all select id, n - 1 + i, n, {value} from {source}, range(1, {h} + 1) r(i) where pos = n - 1)"""


def solve3(s: str, rhs: str) -> str:
    """A scalar subquery's columns x0, x1, x2 of a symmetric 3x3 system by elimination; s: names s00 s01 s02 s11 s12 s22, rhs: names of three sums."""
    r0, r1, r2 = rhs.split()
    s00, s01, s02, s11, s12, s22 = s.split()
    m1, m2 = f"({s01} / {s00})", f"({s02} / {s00})"
    e11, e12, e22 = f"({s11} - {m1} * {s01})", f"({s12} - {m1} * {s02})", f"({s22} - {m2} * {s02})"
    f1, f2 = f"({r1} - {m1} * {r0})", f"({r2} - {m2} * {r0})"
    x2 = f"(({f2} - {e12} / {e11} * {f1}) / ({e22} - {e12} / {e11} * {e12}))"
    x1 = f"(({f1} - {e12} * {x2}) / {e11})"
    return f"({r0} - {s01} * {x1} - {s02} * {x2}) / {s00}|{x1}|{x2}"
