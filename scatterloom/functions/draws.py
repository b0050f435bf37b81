"""Random draws that depend only on (seed, stream, index).

The draw for a row is a hash of its own identity, never of its position in a
partition, so a retried task or another partitioning gives the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 13  # hexadecimal digits taken from the digest: 52 bits


def uniform(index: Column, seed: int, stream: int) -> Column:
    """Uniform in (0, 1)."""
    digest = F.md5(
        F.concat_ws(":", F.lit(str(seed)), F.lit(str(stream)), index.cast("string")).cast("binary")
    )
    number = F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double")
    return (number + 0.5) / float(16**_DIGITS)


def normal(index: Column, seed: int, stream: int) -> Column:
    """Standard normal by the polar form of two uniforms."""
    u1 = uniform(index, seed, 2 * stream)
    u2 = uniform(index, seed, 2 * stream + 1)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * math.pi * u2)


def on_sphere(index: Column, seed: int, stream: int) -> tuple[Column, Column, Column]:
    """Uniform direction in space."""
    z = 2.0 * uniform(index, seed, 2 * stream) - 1.0
    phi = 2 * math.pi * uniform(index, seed, 2 * stream + 1)
    r = F.sqrt(1.0 - z * z)
    return r * F.cos(phi), r * F.sin(phi), z


def on_circle(index: Column, seed: int, stream: int) -> tuple[Column, Column, Column]:
    """Uniform direction in the xy plane."""
    phi = 2 * math.pi * uniform(index, seed, 2 * stream)
    return F.cos(phi), F.sin(phi), F.lit(0.0)
