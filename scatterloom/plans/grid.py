"""Coherent amplitudes on a regular grid of scattering vectors, by a nonuniform Fourier transform.

Atoms are spread on to a finer periodic grid with a window of WIDTH points along each axis, one fast transform
per frame and species gives all vectors at once, and the window's own transform is divided out. So a frame costs some
thousand additions per atom and a transform, whatever the number of vectors; a sum over atoms and vectors costs their product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterloom.functions import vec
from scatterloom.operators.params import localize, union_all
from scatterloom.operators.staging import split_frames
from scatterloom.plans import kernel

WIDTH = 10  # points that an atom is spread over along an axis: errors of about 1e-9 of the sum of factors
BETA = 2.3 * WIDTH
QUADRATURE = 80


@dataclass(frozen=True)
class Grid:
    """Vectors ``origin + i a + j b + k c`` for ``i, j, k`` from 0 to ``counts`` - 1; the step vectors ``a, b, c`` need not be at right angles."""

    steps: tuple[tuple[float, float, float], ...]
    counts: tuple[int, int, int]
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def __post_init__(self):
        if len(self.steps) != 3 or any(len(s) != 3 for s in self.steps) or len(self.counts) != 3 or min(self.counts) < 1:
            raise ValueError("a grid has three step vectors and three counts of 1 or more")


def grid_vectors(spark: SparkSession, grid: Grid) -> DataFrame:
    """``q_id, qx, qy, qz`` and the length ``ql``; the last axis runs fastest."""
    n1, n2, n3 = grid.counts
    at = [F.expr(f"id div {n2 * n3}"), F.expr(f"id div {n3} % {n2}"), F.expr(f"id % {n3}")]
    components = (
        (F.lit(float(o)) + sum((i * F.lit(float(s[d])) for i, s in zip(at, grid.steps)), start=F.lit(0.0))).alias(c)
        for d, (c, o) in enumerate(zip(("qx", "qy", "qz"), grid.origin))
    )
    vectors = spark.range(n1 * n2 * n3).select(F.col("id").alias("q_id"), *components)
    return vectors.withColumn("ql", vec.length(vec.columns("qx", "qy", "qz")))


def _slabs(grid: Grid, most: int):
    """(first q_id, grid) of parts along the first axis that hold at most ``most`` vectors, or one plane."""
    n1, n2, n3 = grid.counts
    step = max(1, most // (n2 * n3))
    for lo in range(0, n1, step):
        origin = tuple(o + lo * a for o, a in zip(grid.origin, grid.steps[0]))
        yield lo * n2 * n3, Grid(grid.steps, (min(step, n1 - lo), n2, n3), origin)


def _window(z: np.ndarray) -> np.ndarray:
    inside = np.abs(z) < 1
    return np.where(inside, np.exp(BETA * (np.sqrt(np.where(inside, 1 - z * z, 0.0)) - 1)), 0.0)


class Transform:
    """Amplitudes of one frame's atoms on a grid, species by species."""

    def __init__(self, grid: Grid):
        self.steps = np.array(grid.steps, dtype=np.float64)
        self.counts = np.array(grid.counts)
        self.fine = np.maximum(2 * self.counts + self.counts % 2, 2 * WIDTH + 2)
        low = self.counts // 2  # places are counted from the middle
        self.middle = np.array(grid.origin) + low @ self.steps
        nodes, weights = np.polynomial.legendre.leggauss(QUADRATURE)
        self.places, own = [], []
        for n, m, at in zip(self.counts, self.fine, low):
            k = np.arange(n) - at
            self.places.append(k % m)
            own.append(WIDTH / 2 * np.cos(np.pi * WIDTH / m * np.outer(k, nodes)) @ (weights * _window(nodes)))
        self.correction = np.prod(self.fine) / (own[0][:, None, None] * own[1][:, None] * own[2])
        self.at_once = max(1 << 10, int(np.prod(self.fine)) // WIDTH**3)

    def spread(self, xyz: np.ndarray) -> np.ndarray:
        """The fine grid that the atoms at ``xyz`` (3, atoms) make."""
        out = np.zeros(int(np.prod(self.fine)), dtype=np.complex128)
        for lo in range(0, xyz.shape[1], self.at_once):
            r = xyz[:, lo : lo + self.at_once]
            x = (self.steps @ r) * (self.fine / (2 * np.pi))[:, None]
            first = np.ceil(x - WIDTH / 2)
            near = first[:, :, None] + np.arange(WIDTH)
            value = _window((near - x[:, :, None]) * (2 / WIDTH))
            place = (near % self.fine[:, None, None]).astype(np.int64)
            flat = (place[0][:, :, None, None] * self.fine[1] + place[1][:, None, :, None]) * self.fine[2] + place[2][:, None, None, :]
            share = (value[0][:, :, None, None] * value[1][:, None, :, None] * value[2][:, None, None, :]).reshape(r.shape[1], -1)
            phase = np.exp(1j * (self.middle @ r))[:, None]
            flat = flat.ravel()
            out += np.bincount(flat, (share * phase.real).ravel(), len(out)) + 1j * np.bincount(flat, (share * phase.imag).ravel(), len(out))
        return out.reshape(self.fine)

    def __call__(self, xyz: np.ndarray) -> np.ndarray:
        """Sum of exp(i q r) over the atoms for every vector of the grid, in the order of ``q_id``."""
        found = np.fft.ifftn(self.spread(xyz))
        return (found[np.ix_(*self.places)] * self.correction).ravel()


def _frames_of(batches):
    """Whole frames (frame, species, positions) from rows sorted by frame, as far as a task holds them."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        frame = batch.column("frame").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(frame[1:] != frame[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(frame)]):
            if held and current != frame[lo]:
                yield current, pa.Table.from_batches(held)
                held = []
            current = frame[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield current, pa.Table.from_batches(held)


def amplitude_grid(coords: DataFrame, factors: DataFrame, grid: Grid) -> DataFrame:
    """``q_id, m_id, frame, re, im`` with ``m_id`` 0: the same as `amplitude.amplitude_all` for the vectors of `grid_vectors`.

    Rows of a frame are brought together first, so its amplitudes leave the task whole and are not shuffled; a very large frame is dealt
    to several tasks, and only its parts are shuffled and added up. Grids of more than ``kernel.PASS_ROWS`` vectors are worked off in slabs.
    """
    spark = coords.sparkSession
    every = grid_vectors(spark, grid)
    needed = coords.select(F.col("frame").cast("bigint").alias("frame"), "species", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    whole, dealt = split_frames(needed)
    whole, dealt = whole.sortWithinPartitions("frame"), None if dealt is None else dealt.sortWithinPartitions("frame")
    passes, parts = [], []
    for first, part in _slabs(grid, kernel.pass_rows(factors)):
        n = int(np.prod(part.counts))
        vectors = localize(every.where(F.col("q_id").between(first, first + n - 1)), n)
        table, f = kernel.to_driver(vectors, factors)
        if f is not None:
            work = _pass(part, table["q_id"].to_numpy(), f)
            passes.append(whole.mapInArrow(work, kernel.PARTIAL))
            if dealt is not None:
                parts.append(dealt.mapInArrow(work, kernel.PARTIAL))
    return union_all([*passes, kernel.add_up(union_all(parts))] if parts else passes)


def _pass(grid: Grid, q_id: np.ndarray, factors: kernel.Factors):
    """What a task does for the vectors of one slab."""

    def run(batches):
        transform = Transform(grid)
        sums = kernel.FrameSums(q_id, np.zeros(len(q_id), dtype=np.int64))
        for frame, rows in _frames_of(batches):
            code = factors.codes(rows.column("species").combine_chunks())
            xyz = np.stack([rows.column(c).to_numpy() for c in "xyz"])
            amplitude = np.zeros(len(q_id), dtype=np.complex128)
            for s in np.unique(code):
                amplitude += factors.values[s] * transform(xyz[:, code == s])
            sums.add(np.array([frame]), amplitude[None])
            if sums.full():
                yield from sums.flush()
        if sums.sums:
            yield from sums.flush()

    return run
