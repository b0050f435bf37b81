"""3-vector algebra on triples of columns.

Every helper takes and returns plain column expressions, so a whole chain of
geometry stays inside one generated-code stage.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column


def columns(x="x", y="y", z="z") -> Vec:
    return Vec(F.col(x), F.col(y), F.col(z))


def literal(v) -> Vec:
    return Vec(*(F.lit(float(c)) for c in v))


def add(a: Vec, b: Vec) -> Vec:
    return Vec(a.x + b.x, a.y + b.y, a.z + b.z)


def sub(a: Vec, b: Vec) -> Vec:
    return Vec(a.x - b.x, a.y - b.y, a.z - b.z)


def scale(k, a: Vec) -> Vec:
    return Vec(a.x * k, a.y * k, a.z * k)


def dot(a: Vec, b: Vec) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def cross(a: Vec, b: Vec) -> Vec:
    return Vec(
        a.y * b.z - a.z * b.y,
        a.z * b.x - a.x * b.z,
        a.x * b.y - a.y * b.x,
    )


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    """The direction of ``a``; the zero vector stays zero."""
    n = length(a)
    return Vec(*(F.when(n != 0, c / n).otherwise(F.lit(0.0)) for c in a))


def _azimuth(x: Column, y: Column) -> Column:
    """Angle of (x, y) in [0, 2*pi)."""
    phi = F.atan2(y, x)
    return F.when((x == 0) & (y == 0), F.lit(0.0)).otherwise(
        F.when(phi < 0, phi + 2 * math.pi).otherwise(phi)
    )


def to_cylinder(v: Vec) -> tuple[Column, Column, Column]:
    """(r, phi, z) with phi in [0, 2*pi)."""
    return F.sqrt(v.x * v.x + v.y * v.y), _azimuth(v.x, v.y), v.z


def to_sphere(v: Vec) -> tuple[Column, Column, Column]:
    """(r, phi, theta) with phi in [0, 2*pi) and theta in [0, pi]; all 0 at the origin."""
    r = length(v)
    theta = F.when(r == 0, F.lit(0.0)).otherwise(F.acos(v.z / r))
    return r, _azimuth(v.x, v.y), theta


def from_cylinder(r: Column, phi: Column, z: Column) -> Vec:
    return Vec(r * F.cos(phi), r * F.sin(phi), z)


def from_sphere(r: Column, phi: Column, theta: Column) -> Vec:
    return Vec(
        r * F.sin(theta) * F.cos(phi),
        r * F.sin(theta) * F.sin(phi),
        r * F.cos(theta),
    )


def rotate(v: Vec, axis: str, rad) -> Vec:
    """Right-handed rotation about a coordinate axis."""
    c, s = F.cos(F.lit(rad)), F.sin(F.lit(rad))
    if axis == "x":
        return Vec(v.x, c * v.y - s * v.z, s * v.y + c * v.z)
    if axis == "y":
        return Vec(c * v.x + s * v.z, v.y, c * v.z - s * v.x)
    if axis == "z":
        return Vec(c * v.x - s * v.y, s * v.x + c * v.y, v.z)
    raise ValueError(f"axis must be x, y or z, not {axis!r}")


# -- orthonormal bases: three numbers on the driver, literals in the plan -------


def _norm(v):
    n = math.sqrt(sum(c * c for c in v))
    if n == 0:
        raise ValueError("an axis must not be the zero vector")
    return tuple(c / n for c in v)


def _cross(a, b):
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def axis_base(axis) -> tuple:
    """Orthonormal base (e_r, e_phi, e_z) with e_z along ``axis``.

    e_r is perpendicular to both z and the axis; for an axis along z it is x.
    """
    ez = _norm(tuple(float(c) for c in axis))
    er = _cross((0.0, 0.0, 1.0), ez)
    if er == (0.0, 0.0, 0.0):
        er = _cross((0.0, 1.0, 0.0), ez)
    er = _norm(er)
    return er, _norm(_cross(ez, er)), ez


def project(v: Vec, base) -> Vec:
    return Vec(*(dot(v, literal(b)) for b in base))


def frame_onto_xy(axis1, axis2) -> tuple:
    """Rows of the rotation that takes ``axis1`` to x and puts ``axis2`` in the xy plane, y > 0."""
    e1 = _norm(tuple(float(c) for c in axis1))
    along = sum(a * b for a, b in zip(axis2, e1))
    e2 = _norm(tuple(b - along * a for a, b in zip(e1, axis2)))
    return e1, e2, _cross(e1, e2)
