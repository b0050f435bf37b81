"""Scattering amplitudes.

Inputs: coordinates ``(frame, species, x, y, z)``, factors ``(q_id, species, f)`` and the
vectors to evaluate. Two engines give the same numbers: ``kernel`` (Arrow batches, the
one to use) and ``sql`` (expressions only).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterloom import schema
from scatterloom.functions import special, vec
from scatterloom.functions.waves import PlaneWaves
from scatterloom.operators.params import bounded_parts, localize, union_all
from scatterloom.plans import kernel


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema.AMPLITUDES)


def _phase():
    return vec.dot(vec.columns(), vec.columns("qx", "qy", "qz"))


def with_factors(coords: DataFrame, factors: DataFrame, subvectors: DataFrame) -> DataFrame:
    """Coordinates with every vector and the factor that belongs to both.

    Vectors and factors make one table keyed by species, shipped in bounded parts; the
    join is by species and does not move the coordinates.
    """
    missing = F.raise_error(F.concat(F.lit("no factors for species "), F.col("species")))
    wide = []
    for part in kernel.vector_parts(subvectors):
        table = part.join(factors.select("q_id", "species", "f"), "q_id")
        wide.append(coords.join(F.broadcast(table), "species", "left"))
    return union_all(wide).withColumn("f", F.coalesce(F.col("f"), missing.cast("double")))


def amplitude_all(coords: DataFrame, factors: DataFrame, subvectors: DataFrame, engine="kernel") -> DataFrame:
    """Coherent amplitude: sum over atoms of f * exp(i q.r) for each vector and frame."""
    if engine == "sql":
        wide = with_factors(coords, factors, subvectors)
        return wide.groupBy("q_id", "m_id", "frame").agg(
            F.sum(F.col("f") * F.cos(_phase())).alias("re"),
            F.sum(F.col("f") * F.sin(_phase())).alias("im"),
        )
    if engine != "kernel":
        raise ValueError("engine is 'kernel' or 'sql'")
    passes = []
    for part in kernel.vector_parts(subvectors, kernel.pass_rows(factors)):
        table, f = kernel.to_driver(part, factors)
        if f is None:
            continue
        q, q_id, m_id = table[["qx", "qy", "qz"]].to_numpy(), table["q_id"].to_numpy(), table["m_id"].to_numpy()
        tiles = []
        for rows in kernel.row_slices(m_id, kernel.VECTOR_ROWS):
            waves = PlaneWaves(q[rows], m_id[rows])
            at = rows[waves.rows]
            tiles.append(kernel.Tile(q_id[at], m_id[at], f.reordered(at), waves))
        passes.append(kernel.partial_sums(coords, ["x", "y", "z"], tiles))
    return kernel.add_up(union_all(passes)) if passes else _empty(coords)


def amplitude_self(coords: DataFrame, factors: DataFrame, subvectors: DataFrame) -> DataFrame:
    """Amplitude of every single atom, ``(q_id, m_id, atom_id, frame, re, im)``."""
    wide = with_factors(coords, factors, subvectors)
    return wide.select(
        "q_id", "m_id", "atom_id", "frame",
        (F.col("f") * F.cos(_phase())).alias("re"),
        (F.col("f") * F.sin(_phase())).alias("im"),
    )


class Blocks(NamedTuple):
    """Waves given as a function that yields them in blocks of ``width`` columns."""

    blocks: Callable
    width: int


def _moment_passes(coords, factors, qvectors, moments, columns, make_waves) -> DataFrame:
    passes = []
    for some in bounded_parts(moments, ["m_id"], kernel.VECTOR_ROWS):
        lm = kernel.rows_of(some).sort_values("m_id", ignore_index=True)
        if lm.empty:
            continue
        for part in bounded_parts(qvectors, ["q_id"], max(1, kernel.pass_rows(factors) // len(lm))):
            table, found = kernel.to_driver(part, factors)
            if found is None:
                continue
            tiles, width = [], max(1, kernel.VECTOR_ROWS // len(lm))
            for lo in range(0, len(table), width):
                some_q = table.iloc[lo : lo + width]
                at = np.repeat(np.arange(lo, lo + len(some_q)), len(lm))
                tiles.append(
                    kernel.Tile(
                        table["q_id"].to_numpy()[at], np.tile(lm["m_id"].to_numpy(), len(some_q)),
                        found.reordered(at), make_waves(some_q, lm),
                    )
                )
            passes.append(kernel.partial_sums(coords, columns, tiles))
    return kernel.add_up(union_all(passes)) if passes else _empty(coords)


def amplitude_multipole_sphere(coords, factors, qvectors, moments) -> DataFrame:
    """A_lm = 4 pi i^l * sum of f * j_l(q r) * conj(Y_lm) on coordinates (r, phi, theta).

    The sums are evaluated for m >= 0. Those for -m are their conjugates up to a sign,
    since f and j_l are real, and come with the factor 4 pi i^l from a join with the moments.
    """
    moments = localize(moments)
    half = (F.expr("l * (l + 1) div 2") + F.abs("m")).alias("half")
    needed = moments.select(half.alias("m_id"), "l", F.abs("m").alias("m")).distinct()

    def make_waves(table, lm):
        ql = table["ql"].to_numpy()
        pairs = [(int(l), int(m)) for l, m in zip(lm["l"], lm["m"])]
        lmax, mmax = max(l for l, _ in pairs), max(m for _, m in pairs)
        order = np.array([l for l, _ in pairs])

        def waves(r, phi, theta):
            legendre = special.legendre_normalised(lmax, np.cos(theta))
            turns = special.powers(mmax, -phi)
            y = np.stack([special.harmonic(legendre, turns, l, m) for l, m in pairs], axis=1)
            bessel = special.spherical_bessel(lmax, np.outer(ql, r).ravel())
            bessel = bessel.reshape(lmax + 1, len(ql), len(r))
            for i in range(len(ql)):
                yield slice(i * len(pairs), (i + 1) * len(pairs)), bessel[order, i].T * y

        return Blocks(waves, len(pairs))

    sums = _moment_passes(coords, factors, qvectors, needed, ["r", "phi", "theta"], make_waves)
    full = sums.withColumnRenamed("m_id", "half").join(
        moments.select("m_id", "l", "m", half), "half"
    )
    odd_minus = (F.col("m") < 0) & (F.col("m") % 2 != 0)
    k = F.when(odd_minus, -4 * math.pi).otherwise(4 * math.pi)
    re = k * F.col("re")
    im = k * F.when(F.col("m") < 0, -F.col("im")).otherwise(F.col("im"))
    quarter = F.col("l") % 4
    return full.select(
        "q_id", "m_id", "frame",
        F.when(quarter == 0, re).when(quarter == 1, -im).when(quarter == 2, -re).otherwise(im).alias("re"),
        F.when(quarter == 0, im).when(quarter == 1, re).when(quarter == 2, -im).otherwise(-re).alias("im"),
    )


def amplitude_multipole_cylinder(
    coords, factors, qvectors, moments, axis=(0.0, 0.0, 1.0), legacy_parallel=False
) -> DataFrame:
    """Cylinder expansion about ``axis`` on coordinates (r, phi, z) in the base of the axis.

    ``legacy_parallel`` uses exp(i |q_z z|) along the axis in place of exp(i q_z z).
    """
    base = np.array(vec.axis_base(axis))

    def make_waves(table, lm):
        q = table[["qx", "qy", "qz"]].to_numpy() @ base.T
        across, angle, along = np.hypot(q[:, 0], q[:, 1]), np.arctan2(q[:, 1], q[:, 0]), q[:, 2]
        pairs = [(int(l), int(m)) for l, m in zip(lm["l"], lm["m"])]
        # order of the Bessel function: 2l for the even pair of minors, 2l - 1 for the odd pair
        orders = [0 if l == 0 else 2 * l - (m >= 2) for l, m in pairs]
        distinct = sorted(set(orders))
        where = {n: i for i, n in enumerate(distinct)}

        def waves(r, phi, z):
            every = special.cylinder_bessel(distinct, np.outer(across, r).ravel())
            every = every.reshape(len(distinct), len(across), len(r))
            for i in range(len(across)):
                out = np.empty((len(r), len(pairs)), dtype=np.complex128)
                bessel = every[:, i]
                psi = phi - angle[i]
                height = along[i] * z
                plane = np.exp(1j * (np.abs(height) if legacy_parallel else height))
                plane *= math.sqrt(2 * math.pi)
                for k, ((l, m), n) in enumerate(zip(pairs, orders)):
                    wave = plane * bessel[where[n]]
                    if l > 0:
                        turn = np.cos(n * psi) if m % 2 == 0 else np.sin(n * psi)
                        sign = (-1) ** l if m < 2 else 1j * (-1) ** (l - 1)
                        wave = math.sqrt(2.0) * sign * wave * turn
                    out[:, k] = wave
                yield slice(i * len(pairs), (i + 1) * len(pairs)), out

        return Blocks(waves, len(pairs))

    return _moment_passes(coords, factors, qvectors, moments, ["r", "phi", "z"], make_waves)
