"""Plane waves exp(i q.r) for many vectors at once, vectorised with NumPy."""

from __future__ import annotations

import math

import numpy as np

CIRCLE = 2048  # points of the unit circle kept in a table; 32 KB
_POINTS = np.exp(2j * np.pi * np.arange(CIRCLE) / CIRCLE)
_STEP = 2 * math.pi / CIRCLE
BLOCK = 256  # directions evaluated at once
RESEED = 64  # steps of a ladder after which the product is started anew


def unit_circle(turns: np.ndarray, out: np.ndarray) -> np.ndarray:
    """exp(2 pi i t / CIRCLE) into ``out``; ``turns`` is overwritten.

    The nearest point of the table times a short series in the remainder, which is at
    most half a step: good to the rounding of the argument.
    """
    whole = np.rint(turns)
    turns -= whole
    at = whole.astype(np.int64)
    at &= CIRCLE - 1
    square = np.multiply(turns, turns, out=whole)
    c = square * (_STEP**4 / 24)
    c -= _STEP**2 / 2
    c *= square
    c += 1.0
    out.real = c
    np.multiply(square, -(_STEP**3) / 6, out=c)
    c += _STEP
    c *= turns
    out.imag = c
    out *= _POINTS.take(at)
    return out


class PlaneWaves:
    """Waves of a table of vectors (rows of ``q``), as a function of positions.

    ``groups`` numbers the rows that belong to one direction; if within every group the
    vectors, in row order, are equally spaced, each wave is the one before times a
    constant factor of the atom, and only two waves per group need a sine and a cosine.

    Columns follow ``self.rows`` of the table and come in blocks of at most ``width``.
    """

    def __init__(self, q: np.ndarray, groups: np.ndarray):
        q = np.asarray(q, dtype=np.float64)
        ladder = self._ladder(q, groups)
        if ladder is None:
            self.rows, self.first, self.spacing = np.arange(len(q)), self._in_turns(q), None
        else:
            self.rows = ladder[0]
            self.first, self.spacing = self._in_turns(ladder[1]), self._in_turns(ladder[2])
        self.size = len(q)
        self.width = min(self.first.shape[1], BLOCK)

    @staticmethod
    def _in_turns(q):
        return np.ascontiguousarray(q.T) * (CIRCLE / (2 * math.pi))

    @staticmethod
    def _ladder(q, groups):
        order = np.argsort(groups, kind="stable")
        _, counts = np.unique(groups, return_counts=True)
        steps = counts[0]
        if steps < 4 or (counts != steps).any():
            return None
        by_group = order.reshape(-1, steps)
        v = q[by_group]
        spacing = (v[:, -1] - v[:, 0]) / (steps - 1)
        straight = v[:, :1] + np.arange(steps)[None, :, None] * spacing[:, None, :]
        if np.abs(straight - v).max() > 8 * np.finfo(float).eps * np.abs(v).max():
            return None
        return by_group.T.ravel(), v[:, 0], spacing

    def blocks(self, x, y, z):
        """Yield (columns, complex values); the values are overwritten by the next block."""
        xyz = np.stack([x, y, z], axis=1)
        groups = self.first.shape[1]
        for lo in range(0, groups, BLOCK):
            part = slice(lo, min(lo + BLOCK, groups))
            wave = np.empty((len(xyz), part.stop - lo), dtype=np.complex128)
            if self.spacing is None:
                yield part, unit_circle(xyz @ self.first[:, part], wave)
                continue
            factor = unit_circle(xyz @ self.spacing[:, part], np.empty_like(wave))
            for k in range(self.size // groups):
                if k % RESEED == 0:
                    unit_circle(xyz @ (self.first[:, part] + k * self.spacing[:, part]), wave)
                else:
                    wave *= factor
                yield slice(part.start + k * groups, part.stop + k * groups), wave

    def __call__(self, x, y, z) -> np.ndarray:
        """All columns at once."""
        out = np.empty((len(x), self.size), dtype=np.complex128)
        for columns, values in self.blocks(x, y, z):
            out[:, columns] = values
        return out
