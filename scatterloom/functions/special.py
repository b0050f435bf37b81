"""Special functions for the multipole expansions, vectorised with NumPy."""

from __future__ import annotations

import math

import numpy as np


def spherical_bessel(lmax: int, x: np.ndarray) -> np.ndarray:
    """j_0..j_lmax of x >= 0, shape (lmax + 1, len(x)).

    Downward recurrence from an order well above max(lmax, x), scaled by whichever
    of j_0 and j_1 is larger in magnitude.
    """
    x = np.asarray(x, dtype=np.float64)
    out = np.zeros((lmax + 1, x.size))
    if x.size == 0:
        return out
    small = x < 1e-6
    out[0, small] = 1.0 - x[small] ** 2 / 6.0
    if lmax >= 1:
        out[1, small] = x[small] / 3.0
    if lmax >= 2:
        out[2, small] = x[small] ** 2 / 15.0
    big = ~small
    # group arguments of similar size, so that a huge one does not lengthen all recurrences
    edges = 2.0 ** np.arange(4, 64)
    band = np.searchsorted(edges, x)
    for b in np.unique(band[big]):
        pick = big & (band == b)
        out[:, pick] = _downward(lmax, x[pick])
    return out


def _downward(lmax: int, x: np.ndarray) -> np.ndarray:
    top = int(max(lmax, math.ceil(x.max()))) + 30 + int(8 * math.sqrt(max(lmax, x.max())))
    keep = np.zeros((lmax + 1, x.size))
    above = np.zeros_like(x)
    here = np.full_like(x, 1e-290)
    f1 = np.zeros_like(x)
    for n in range(top, 0, -1):
        if n <= lmax:
            keep[n] = here
        if n == 1:
            f1 = here
        below = (2 * n + 1) / x * here - above
        huge = np.abs(below) > 1e250
        if huge.any():
            s = np.where(huge, 1e-250, 1.0)
            below, here = below * s, here * s
            keep[n : lmax + 1] *= s
            if n == 1:
                f1 = here
        above, here = here, below
    keep[0] = here
    j0 = np.sin(x) / x
    j1 = (np.sin(x) / x - np.cos(x)) / x
    use0 = np.abs(j0) >= np.abs(j1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(use0, j0 / keep[0], j1 / f1)
    return keep * ratio


def legendre_normalised(lmax: int, cos_t: np.ndarray) -> np.ndarray:
    """Orthonormal associated Legendre functions, m >= 0, shape (lmax+1, lmax+1, n).

    Entry [l, m] times exp(i m phi) is the spherical harmonic with the
    (-1)^m phase; entries with m > l are zero.
    """
    cos_t = np.asarray(cos_t, dtype=np.float64)
    sin_t = np.sqrt(np.clip(1.0 - cos_t * cos_t, 0.0, None))
    p = np.zeros((lmax + 1, lmax + 1, cos_t.size))
    p[0, 0] = math.sqrt(1.0 / (4.0 * math.pi))
    for m in range(1, lmax + 1):
        p[m, m] = -math.sqrt((2 * m + 1) / (2.0 * m)) * sin_t * p[m - 1, m - 1]
    for m in range(lmax):
        p[m + 1, m] = math.sqrt(2 * m + 3) * cos_t * p[m, m]
    for m in range(lmax + 1):
        for l in range(m + 2, lmax + 1):
            a = math.sqrt((4.0 * l * l - 1.0) / (l * l - m * m))
            b = math.sqrt(((l - 1.0) ** 2 - m * m) / (4.0 * (l - 1.0) ** 2 - 1.0))
            p[l, m] = a * (cos_t * p[l - 1, m] - b * p[l - 2, m])
    return p


def powers(kmax: int, phi: np.ndarray) -> np.ndarray:
    """exp(i k phi) for k = 0..kmax, shape (kmax + 1, n)."""
    out = np.empty((kmax + 1, phi.size), dtype=np.complex128)
    out[0] = 1.0
    if kmax:
        out[1] = np.exp(1j * phi)
    for k in range(2, kmax + 1):
        # doubling keeps the rounding of a high power small
        np.multiply(out[k // 2], out[k - k // 2], out=out[k])
    return out


def harmonic(p: np.ndarray, turns: np.ndarray, l: int, m: int) -> np.ndarray:
    """Y_lm from the tables of :func:`legendre_normalised` and :func:`powers`."""
    k = abs(m)
    y = p[l, k] * turns[k]
    return y if m >= 0 else (-1) ** k * np.conj(y)


def cylinder_bessel(orders, x: np.ndarray) -> np.ndarray:
    """J_n(x) for each order n >= 0 and x >= 0, shape (len(orders), len(x)).

    Downward recurrence from an order well above max(n, x), scaled by the sum
    J_0 + 2 J_2 + 2 J_4 + ... = 1.
    """
    x = np.asarray(x, dtype=np.float64)
    orders = [int(n) for n in orders]
    out = np.zeros((len(orders), x.size))
    if x.size == 0 or not orders:
        return out
    small = x < 1e-9
    for i, n in enumerate(orders):
        out[i, small] = 1.0 if n == 0 else x[small] / 2 if n == 1 else 0.0
    edges = 2.0 ** np.arange(4, 64)
    band = np.searchsorted(edges, x)
    for b in np.unique(band[~small]):
        pick = ~small & (band == b)
        out[:, pick] = _cylinder_downward(orders, x[pick])
    return out


def _cylinder_downward(orders, x: np.ndarray) -> np.ndarray:
    high = max(max(orders), math.ceil(x.max()))
    top = 2 * ((high + 30 + int(8 * math.sqrt(high))) // 2)
    place = {n: i for i, n in enumerate(orders)}
    keep = np.zeros((len(orders), x.size))
    above, here, total = np.zeros_like(x), np.full_like(x, 1e-290), np.zeros_like(x)
    for n in range(top, -1, -1):
        if n in place:
            keep[place[n]] = here
        if n % 2 == 0:
            total += here if n == 0 else 2 * here
        if n == 0:
            break
        below = (2 * n) / x * here - above
        huge = np.abs(below) > 1e250
        if huge.any():
            s = np.where(huge, 1e-250, 1.0)
            below, here, total = below * s, here * s, total * s
            keep *= s
        above, here = here, below
    return keep / total
