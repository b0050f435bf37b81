"""Element-constant functions: volume, exclusion factor, scattering factor.

Each takes the type code and the parameter array of an element and returns one
column expression. An unknown type code fails the query when it is evaluated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SLATER_SHELLS = 5
GAUSSIANS = 4


def _unknown(what: str, code: Column) -> Column:
    return F.raise_error(
        F.concat(F.lit(f"{what} type not known: "), F.coalesce(code.cast("string"), F.lit("NULL")))
    ).cast("double")


def volume(kind: Column, params: Column) -> Column:
    """0: given directly; 1: hard sphere of radius p0; 2: Gaussian sphere of radius p0."""
    p0 = params.getItem(0)
    return (
        F.when(kind == 0, p0)
        .when(kind == 1, F.lit(4.0 / 3.0 * math.pi) * F.pow(p0, F.lit(3.0)))
        .when(kind == 2, F.lit(math.pi**1.5) * F.pow(p0, F.lit(3.0)))
        .otherwise(_unknown("volume", kind))
    )


def exclusion(kind: Column, params: Column, v: Column, q: Column) -> Column:
    """0: constant; 1: linear in the effective volume ``v``; 2: Gaussian in q."""
    p0 = params.getItem(0)
    damped = F.exp(-F.pow(v, F.lit(2.0 / 3.0)) * q * q / (4 * math.pi))
    return (
        F.when(kind == 0, p0)
        .when(kind == 1, v * p0)
        .when(kind == 2, v * damped * p0)
        .otherwise(_unknown("exclusion factor", kind))
    )


def slater(params: Column, q: Column) -> Column:
    """Sum over five Slater shells; params hold exponents, occupations, principal numbers."""
    total = F.lit(0.0)
    for shell in range(SLATER_SHELLS):
        zeta = params.getItem(shell)
        occupied = params.getItem(SLATER_SHELLS + shell)
        n = params.getItem(2 * SLATER_SHELLS + shell)
        norm = F.pow(2.0 * zeta / n, n + 0.5) / F.sqrt(
            F.factorial((2.0 * n).cast("int")).cast("double")
        )
        radial = norm * F.pow(q, n - 1.0) * F.exp(-zeta * q / n)
        total = total + F.when(zeta != 0, occupied * radial * radial).otherwise(F.lit(0.0))
    return total / (4 * math.pi)


def gaussians(params: Column, q: Column) -> Column:
    """Four Gaussians in q and a constant."""
    total = params.getItem(2 * GAUSSIANS)
    for i in range(GAUSSIANS):
        total = total + params.getItem(2 * i) * F.exp(-params.getItem(2 * i + 1) * q * q)
    return total


def scattering_factor(kind: Column, params: Column, q: Column) -> Column:
    """0: constant; 1: Slater shells; 2: Gaussians."""
    return (
        F.when(kind == 0, params.getItem(0))
        .when(kind == 1, slater(params, q))
        .when(kind == 2, gaussians(params, q))
        .otherwise(_unknown("scattering factor", kind))
    )
