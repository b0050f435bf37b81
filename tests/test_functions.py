"""Special functions, waves and draws against their definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterloom.functions import draws, special, vec
from scatterloom.functions.waves import PlaneWaves

X = np.array([1e-9, 1e-4, 0.3, 1.0, 5.5, 31.0, 400.0])


def test_spherical_bessel_closed_forms():
    j = special.spherical_bessel(3, X)
    x = X[2:]
    s, c = np.sin(x), np.cos(x)
    assert np.allclose(j[0, 2:], s / x, atol=1e-15)
    assert np.allclose(j[1, 2:], s / x**2 - c / x, atol=1e-14)
    assert np.allclose(j[2, 2:], (3 / x**2 - 1) * s / x - 3 * c / x**2, atol=1e-13)
    assert np.allclose(j[:, 0], [1.0, X[0] / 3, 0, 0], atol=1e-15)


def test_spherical_bessel_sum_rule():
    x = np.linspace(0, 25, 300)
    j = special.spherical_bessel(60, x)
    assert np.allclose(((2 * np.arange(61)[:, None] + 1) * j**2).sum(0), 1.0, atol=1e-12)


def test_cylinder_bessel_is_the_trapezoid_integral():
    orders = [0, 1, 2, 7, 40]
    tau = 2 * math.pi * np.arange(2000) / 2000
    want = [[np.mean(np.cos(n * tau - x * np.sin(tau))) for x in X] for n in orders]
    assert np.allclose(special.cylinder_bessel(orders, X), want, atol=1e-12)


def test_harmonics_are_orthonormal():
    lmax = 6
    nodes, weights = np.polynomial.legendre.leggauss(20)
    phi = 2 * math.pi * np.arange(40) / 40
    cos_t, p = np.repeat(nodes, 40), np.tile(phi, 20)
    w = np.repeat(weights, 40) * 2 * math.pi / 40
    table, turns = special.legendre_normalised(lmax, cos_t), special.powers(lmax, p)
    y = np.array([special.harmonic(table, turns, l, m) for l in range(lmax + 1) for m in range(-l, l + 1)])
    assert np.allclose((y * w) @ y.conj().T, np.eye(len(y)), atol=1e-12)


@pytest.mark.parametrize("steps", [1, 3, 20, 130])
def test_plane_waves(steps):
    rng = np.random.default_rng(1)
    xyz = rng.normal(size=(3, 40)) * 50
    u = rng.normal(size=(7, 3))
    q = ((0.1 + 0.05 * np.arange(steps))[:, None, None] * u).reshape(-1, 3)
    waves = PlaneWaves(q, np.tile(np.arange(7), steps))
    assert sorted(waves.rows) == list(range(len(q)))
    assert (waves.spacing is not None) == (steps >= 4)
    assert np.allclose(waves(*xyz), np.exp(1j * xyz.T @ q[waves.rows].T), atol=1e-11)


def test_uneven_vectors_are_not_a_ladder():
    q = np.outer(np.arange(10.0) ** 2, [1.0, 0, 0])
    assert PlaneWaves(q, np.zeros(10, dtype=int)).spacing is None


def test_draws_do_not_depend_on_partitions(spark):
    def values(parts):
        df = spark.range(500).repartition(parts)
        return {r[0]: tuple(r)[1:] for r in df.select("id", *draws.on_sphere(F.col("id"), 3, 0)).collect()}

    one, many = values(1), values(7)
    assert one == many
    v = np.array(list(one.values()))
    assert np.allclose((v**2).sum(1), 1.0)
    assert np.abs(v.mean(0)).max() < 0.1


def test_normal_draws(spark):
    v = np.array([r[0] for r in spark.range(4000).select(draws.normal(F.col("id"), 1, 0)).collect()])
    assert abs(v.mean()) < 0.06 and abs(v.std() - 1) < 0.05


def test_axis_base_is_right_handed():
    for axis in [(0, 0, 2.0), (0, 0, -1.0), (1.0, 2.0, 2.0), (3.0, 0, 0)]:
        b = np.array(vec.axis_base(axis))
        assert np.allclose(b @ b.T, np.eye(3)) and np.isclose(np.linalg.det(b), 1.0)
        assert np.allclose(b[2], np.array(axis) / np.linalg.norm(axis))


def test_frame_onto_xy():
    r = np.array(vec.frame_onto_xy((1.0, 2.0, 2.0), (0.0, 1.0, -5.0)))
    assert np.allclose(r @ r.T, np.eye(3)) and np.isclose(np.linalg.det(r), 1.0)
    a, b = r @ [1.0, 2.0, 2.0], r @ [0.0, 1.0, -5.0]
    assert np.allclose(a[1:], 0) and a[0] > 0
    assert np.isclose(b[2], 0) and b[1] > 0
