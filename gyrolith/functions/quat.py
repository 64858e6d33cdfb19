"""Quaternion and vector algebra as column expressions (w, x, y, z; Hamilton).

A quaternion is a tuple of four columns, a vector one of three.  Everything stays in codegen; null
components give null, NaN gives NaN.  Divisions by zero give null (``try_divide``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Q = tuple[Column, Column, Column, Column]
V = tuple[Column, Column, Column]


def q_of(prefix: str = "", names: str = "wxyz") -> Q:
    return tuple(F.col(prefix + c) for c in names)  # type: ignore[return-value]


def named(q: Sequence[Column], names: Sequence[str]) -> list[Column]:
    return [c.alias(n) for c, n in zip(q, names)]


def mul(a: Q, b: Q) -> Q:
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return (
        aw * bw - ax * bx - ay * by - az * bz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
    )


def conj(q: Q) -> Q:
    return q[0], -q[1], -q[2], -q[3]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        total = total + x * y
    return total


def magnitude(v: Sequence[Column]) -> Column:
    return F.sqrt(dot(v, v))


def normalise(q: Sequence[Column]) -> tuple[Column, ...]:
    n = magnitude(q)
    return tuple(F.try_divide(c, n) for c in q)


def exp(v: V) -> Q:
    """Rotation vector to unit quaternion."""
    angle = magnitude(v)
    k = F.when(angle > 1e-12, F.try_divide(F.sin(angle / 2), angle)).otherwise(F.lit(0.5))
    return normalise((F.cos(angle / 2), *[c * k for c in v]))  # type: ignore[return-value]


def log(q: Q) -> V:
    """Unit quaternion to rotation vector, the short way round."""
    s = F.when(q[0] < 0, -1.0).otherwise(1.0)
    v = tuple(c * s for c in q[1:])
    n = magnitude(v)
    angle = 2 * F.asin(F.least(F.greatest(n, F.lit(0.0)), F.lit(1.0)))
    k = F.when(n > 1e-12, F.try_divide(angle, n)).otherwise(F.lit(2.0))
    return tuple(c * k for c in v)  # type: ignore[return-value]


def slerp(a: Q, b: Q, w: Column) -> Q:
    d = dot(a, b)
    s = F.when(d < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.abs(d), F.lit(1.0)))
    sine = F.sin(angle)
    flat = sine < 1e-6
    wa = F.when(flat, 1 - w).otherwise(F.try_divide(F.sin((1 - w) * angle), sine))
    wb = F.when(flat, w).otherwise(F.try_divide(F.sin(w * angle), sine))
    return normalise(tuple(x * wa + y * s * wb for x, y in zip(a, b)))  # type: ignore[return-value]


def ramp(v: Column, lo: float | Column, hi: float | Column) -> Column:
    """0 below lo, 1 above hi, linear between."""
    lo, hi = F.lit(lo), F.lit(hi)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(v - lo, hi - lo)))


def smoothstep(x: Column) -> Column:
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return c * c * (3 - 2 * c)


def blend(a: Sequence[Column], b: Sequence[Column], w: Column) -> tuple[Column, ...]:
    return tuple(x * (1 - w) + y * w for x, y in zip(a, b))


def rate_between(q0: Q, q1: Q, dt: Column) -> V:
    """Angular rate that turns q0 into q1 in dt (rad/s)."""
    turn = log(mul(conj(q0), q1))
    span = F.greatest(dt, F.lit(1e-9))
    return tuple(c / span for c in turn)  # type: ignore[return-value]


# fixed values: the frame change of the container, a half turn about y and a cyclic change of axes
HALF_TURN = (0.0, 0.0, 1.0, 0.0)
AXES = (0.5, -0.5, -0.5, 0.5)


def _lits(q: Sequence[float]) -> Q:
    return tuple(F.lit(float(c)) for c in q)  # type: ignore[return-value]


def file_to_out(q: Q) -> Q:
    return mul(mul(_lits(HALF_TURN), q), _lits(AXES))


def out_to_file(q: Q) -> Q:
    return mul(mul(conj(_lits(HALF_TURN)), q), conj(_lits(AXES)))


def times_matrix(v: V, m: Column) -> V:
    """Row vector times a 3x3 matrix held as an array of rows."""
    at = lambda i, j: F.get(F.get(m, F.lit(i)), F.lit(j))
    return tuple(v[0] * at(0, j) + v[1] * at(1, j) + v[2] * at(2, j) for j in range(3))  # type: ignore[return-value]


def camera_matrix_for(width: Column, height: Column, matrix: Column, calib_w: Column, calib_h: Column, focal: float = 546.4027) -> Column:
    """3x3 camera matrix at a frame size: the calibrated one scaled, or a default about the centre."""
    at = lambda i, j: F.get(F.get(matrix, F.lit(i)), F.lit(j))
    sx, sy = F.coalesce(F.try_divide(width, calib_w), F.lit(1.0)), F.coalesce(F.try_divide(height, calib_h), F.lit(1.0))
    scaled = F.array(F.array(*[at(0, j) * sx for j in range(3)]), F.array(*[at(1, j) * sy for j in range(3)]), F.array(*[at(2, j) for j in range(3)]))
    zero, one = F.lit(0.0), F.lit(1.0)
    plain = F.array(F.array(F.lit(focal), zero, width / 2), F.array(zero, F.lit(focal), height / 2), F.array(zero, zero, one))
    return F.when(matrix.isNotNull(), scaled).otherwise(plain)


def rotvec_degrees(q: Q) -> V:
    return tuple(F.degrees(c) for c in log(q))  # type: ignore[return-value]
