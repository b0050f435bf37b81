"""Scattering vectors, orientations and multipole moments.

Scans are rows of a specification table, so one query can unfold any number of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterloom.functions import draws, vec
from scatterloom.operators.params import fan_out, local_table
from scatterloom.schema import QVECTORS

MAX_SCANS = 3
PARALLEL = 1e-12  # part of |q| across the axis below which q counts as parallel to it


def _with_length(df: DataFrame) -> DataFrame:
    return df.withColumn("ql", vec.length(vec.columns("qx", "qy", "qz")))


def _count(spark: SparkSession, n: int) -> DataFrame:
    """0..n-1, in one task unless there are many."""
    return spark.range(0, n, 1, max(1, n // 100_000))


def q_single(spark: SparkSession, x: float = 1.0, y: float = 0.0, z: float = 0.0) -> DataFrame:
    length = math.sqrt(x * x + y * y + z * z)
    row = (0, float(x), float(y), float(z), length)
    return local_table(spark, [row], QVECTORS)


def scan(base=(1.0, 0.0, 0.0), lo=0.0, hi=1.0, points=100, exponent=1.0) -> Column:
    """One scan as a struct column, for the ``scans`` array of :func:`q_grid`."""
    values = [*base, lo, hi, points, exponent]
    names = ["bx", "by", "bz", "lo", "hi", "points", "exponent"]
    return F.struct(
        *((v if isinstance(v, Column) else F.lit(v)).cast("int" if n == "points" else "double").alias(n)
          for v, n in zip(values, names))
    )


def _step(s: Column, j: Column) -> Column:
    """Value of scan ``s`` at step ``j``: both ends exact, the middle for a single point."""
    span = s["hi"] - s["lo"]
    part = F.pow(j.cast("double") / (s["points"] - 1), s["exponent"])
    return (
        F.when(s["points"] == 1, (s["lo"] + s["hi"]) / 2)
        .when(j == 0, s["lo"])
        .when(j == s["points"] - 1, s["hi"])
        .otherwise(s["lo"] + part * span)
    )


def q_grid(specs: DataFrame, keys=(), most: int = MAX_SCANS) -> DataFrame:
    """Unfold ``specs(*keys, scans ARRAY<scan>)``: all sums of one vector from each scan.

    Up to three scans per row; a row with more fails the query, and a scan with no
    points gives no vectors. ``q_id`` counts the vectors of a row from 0. ``most`` is the
    largest number of scans in a row where the caller knows it.
    """
    keys = list(keys)
    most = min(most, MAX_SCANS)
    limited = F.when(F.size("scans") <= most, F.col("scans")).otherwise(
        F.raise_error(F.lit(f"more than {most} scans cannot be combined"))
    )
    df = specs.select(*keys, limited.alias("scans")).where(F.size("scans") > 0)
    nothing = F.array().cast("array<int>")
    total, index = vec.literal((0, 0, 0)), F.lit(0).cast("bigint")
    for k in range(most):
        s, j = F.get("scans", F.lit(k)), f"__j{k}"
        steps = (
            F.when(s.isNull(), F.array(F.lit(0)))
            .when(s["points"] > 0, F.sequence(F.lit(0), s["points"] - 1))
            .otherwise(nothing)
        )
        df = df.withColumn(j, F.explode(steps))
    for k in range(most):
        s, j = F.get("scans", F.lit(k)), F.col(f"__j{k}")
        here = _step(s, j)
        shift = vec.Vec(*(F.coalesce(s[b] * here, F.lit(0.0)) for b in ("bx", "by", "bz")))
        total = vec.add(total, shift)
        index = index * F.coalesce(s["points"], F.lit(1)) + j
    return _with_length(
        df.select(
            *keys, index.alias("q_id"), total.x.alias("qx"), total.y.alias("qy"), total.z.alias("qz")
        )
    )


def q_from_scans(spark: SparkSession, scans: list) -> DataFrame:
    """The vectors of 1-3 scans given on the driver."""
    if len(scans) > MAX_SCANS:
        raise ValueError("more than 3 scans cannot be combined")
    return q_grid(_count(spark, 1).select(F.array(*scans).alias("scans")), most=len(scans))


# -- orientations -----------------------------------------------------------------


def _directions(spark: SparkSession, n: int, direction) -> DataFrame:
    x, y, z = direction(F.col("id"))
    return _count(spark, n).select(
        F.col("id").alias("m_id"), x.alias("ux"), y.alias("uy"), z.alias("uz")
    )


def orient_sphere(spark: SparkSession, n: int = 100, seed: int = 0) -> DataFrame:
    """``n`` random unit vectors."""
    return _directions(spark, n, lambda i: draws.on_sphere(i, seed, 0))


def orient_circle(spark: SparkSession, n: int = 100, seed: int = 0) -> DataFrame:
    """``n`` random unit vectors in the plane across the axis."""
    return _directions(spark, n, lambda i: draws.on_circle(i, seed, 0))


def orient_raster(spark: SparkSession, resolution: int = 1) -> DataFrame:
    """The circle in ``360 * resolution`` equal steps."""
    n = 360 * resolution

    def direction(i):
        phi = i * (2 * math.pi / n)
        return F.cos(phi), F.sin(phi), F.lit(0.0)

    return _directions(spark, n, direction)


def orient_given(vectors: DataFrame) -> DataFrame:
    """Orientations ``(m_id, x, y, z)`` scaled to length 1; a zero vector stays zero."""
    u = vec.unit(vec.columns())
    return vectors.select("m_id", u.x.alias("ux"), u.y.alias("uy"), u.z.alias("uz"))


# -- vectors to average over --------------------------------------------------------


def subvectors_none(qvectors: DataFrame) -> DataFrame:
    """No averaging: each q once."""
    return qvectors.select("q_id", F.lit(0).cast("bigint").alias("m_id"), "qx", "qy", "qz")


def subvectors_sphere(qvectors: DataFrame, orientations: DataFrame) -> DataFrame:
    """Every orientation with the length of q."""
    return fan_out(qvectors.select("q_id", "ql"), orientations, ["m_id"]).select(
        "q_id", "m_id", *((F.col("ql") * F.col(f"u{c}")).alias(f"q{c}") for c in "xyz")
    )


def subvectors_cylinder(qvectors: DataFrame, orientations: DataFrame, axis=(0.0, 0.0, 1.0)) -> DataFrame:
    """q turned about ``axis``; a q along the axis needs no averaging and is kept once."""
    base = vec.axis_base(axis)
    er, ephi, ez = (vec.literal(b) for b in base)
    p = vec.project(vec.columns("qx", "qy", "qz"), base)
    across, _, along = vec.to_cylinder(p)
    split = qvectors.select("q_id", "ql", across.alias("qr"), along.alias("qa"))
    parallel = F.col("qr") <= PARALLEL * F.col("ql")
    qr, qa = F.col("qr"), F.col("qa")

    fixed = vec.scale(qa, ez)
    kept = split.where(parallel).select(
        "q_id", F.lit(0).cast("bigint").alias("m_id"),
        fixed.x.alias("qx"), fixed.y.alias("qy"), fixed.z.alias("qz"),
    )
    turned = vec.add(
        fixed,
        vec.add(vec.scale(qr * F.col("ux"), er), vec.scale(qr * F.col("uy"), ephi)),
    )
    spun = fan_out(split.where(~parallel), orientations, ["m_id"]).select(
        "q_id", "m_id", turned.x.alias("qx"), turned.y.alias("qy"), turned.z.alias("qz")
    )
    return kept.unionByName(spun)


# -- moments --------------------------------------------------------------------------


def moments_sphere(spark: SparkSession, order: int = 20) -> DataFrame:
    """All (l, m) with l <= ``order`` and |m| <= l."""
    pairs = _count(spark, order + 1).select(
        F.col("id").alias("l"), F.explode(F.sequence(-F.col("id"), F.col("id"))).alias("m")
    )
    return pairs.select((F.col("l") * F.col("l") + F.col("l") + F.col("m")).alias("m_id"), "l", "m")


def moments_cylinder(spark: SparkSession, order: int = 20) -> DataFrame:
    """(0, 0) and (l, 0..3) for 1 <= l <= ``order``."""
    top = F.when(F.col("id") == 0, 0).otherwise(3).cast("bigint")
    pairs = _count(spark, order + 1).select(
        F.col("id").alias("l"), F.explode(F.sequence(F.lit(0).cast("bigint"), top)).alias("m")
    )
    number = F.when(F.col("l") == 0, 0).otherwise(4 * F.col("l") - 3 + F.col("m")).cast("bigint")
    return pairs.select(number.alias("m_id"), "l", "m")


def validate_moments(moments: DataFrame, kind: str) -> DataFrame:
    """``moments`` that are not allowed for the expansion, with the reason; empty when fine."""
    l, m = F.col("l"), F.col("m")
    problem = F.when(l < 0, "l is below 0")
    if kind == "sphere":
        problem = problem.when(F.abs(m) > l, "m is outside -l to l")
    elif kind == "cylinder":
        problem = problem.when((m < 0) | (m > 3), "m is not one of the four kinds 0 to 3").when(
            (l == 0) & (m != 0), "l = 0 has m = 0 only"
        )
    else:
        raise ValueError(f"no multipole expansion of kind {kind!r}")
    return moments.withColumn("problem", problem).where(F.col("problem").isNotNull())


# -- resuming -------------------------------------------------------------------------


def pending_vectors(qvectors: DataFrame, result: DataFrame) -> DataFrame:
    """Vectors with no row in ``result``, compared exactly; repeated requests are kept."""
    done = result.select("qx", "qy", "qz").distinct()
    return qvectors.join(done, ["qx", "qy", "qz"], "left_anti").select(*qvectors.columns)

