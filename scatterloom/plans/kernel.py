"""Partial sums over atoms, computed on Arrow batches.

A task reads its rows once, evaluates all waves of a bounded table of vectors on a
bounded slice of rows at a time, and adds the slices up per frame. What leaves the
task is one partial sum per (vector, frame) seen there; a Spark aggregation adds the
partial sums of different tasks. Nothing is shuffled by atom.
"""

from __future__ import annotations

from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterloom.operators.params import bounded_parts, localize, on_driver

SLICE_CELLS = 1 << 15  # rows x vectors evaluated at once: 512 KB of complex values
HELD_CELLS = 1 << 22  # frames x vectors held before partial sums are passed on: 64 MB
VECTOR_ROWS = 1 << 14  # vectors of a tile: a task works off one after another on the batch it has read
PASS_ROWS = 1 << 18  # vectors per pass over the data, shipped to every task
FACTOR_CELLS = 1 << 23  # species x vectors per pass: 64 MB of factors
OUT_ROWS = 1 << 16

PARTIAL = "q_id BIGINT, m_id BIGINT, frame BIGINT, re DOUBLE, im DOUBLE"
_ARROW = pa.schema(
    [("q_id", pa.int64()), ("m_id", pa.int64()), ("frame", pa.int64()), ("re", pa.float64()), ("im", pa.float64())]
)


class FrameSums:
    """Sums per frame of a task, passed on whenever they reach the bound."""

    def __init__(self, q_id: np.ndarray, m_id: np.ndarray):
        self.q_id, self.m_id = q_id, m_id
        self.sums: dict[int, np.ndarray] = {}

    def add(self, frames: np.ndarray, values: np.ndarray) -> None:
        for frame, row in zip(frames.tolist(), values):
            held = self.sums.get(frame)
            if held is None:
                self.sums[frame] = row.copy()
            else:
                held += row

    def full(self, tiles: int = 1) -> bool:
        """Whether this one of ``tiles`` holds its share."""
        return tiles * len(self.sums) * len(self.q_id) >= HELD_CELLS

    def flush(self):
        width = len(self.q_id)
        frames = np.fromiter(self.sums, dtype=np.int64, count=len(self.sums))
        rows = list(self.sums.values())
        self.sums = {}
        per_batch = max(1, OUT_ROWS // max(1, width))
        for lo in range(0, len(frames), per_batch):
            part = np.stack(rows[lo : lo + per_batch])
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(self.q_id, n)),
                    pa.array(np.tile(self.m_id, n)),
                    pa.array(np.repeat(frames[lo : lo + n], width)),
                    pa.array(np.ascontiguousarray(part.real).ravel()),
                    pa.array(np.ascontiguousarray(part.imag).ravel()),
                ],
                schema=_ARROW,
            )


class Factors:
    """Factor of each species (row) for each vector (column)."""

    def __init__(self, table: pd.DataFrame, q_id: np.ndarray):
        self.species = sorted(table["species"].unique())
        wide = table.pivot(index="species", columns="q_id", values="f")
        self.values = wide.reindex(index=self.species, columns=q_id).to_numpy()
        missing = np.isnan(self.values).any(axis=1)
        if missing.any():
            names = [s for s, m in zip(self.species, missing) if m]
            raise ValueError(f"no factors for species {names[:5]} and some of the vectors")

    def reordered(self, rows: np.ndarray) -> "Factors":
        """The same with the vectors in another order."""
        out = Factors.__new__(Factors)
        out.species, out.values = self.species, np.ascontiguousarray(self.values[:, rows])
        return out

    def codes(self, column: pa.Array) -> np.ndarray:
        code = pc.index_in(column, value_set=pa.array(self.species, type=column.type))
        if code.null_count:
            missing = column.filter(pc.is_null(code)).unique().to_pylist()[:5]
            raise ValueError(f"no factors for species {missing}")
        return code.to_numpy(zero_copy_only=False)


class Tile(NamedTuple):
    """Some of the vectors, with their factors and waves, all in the same order."""

    q_id: np.ndarray
    m_id: np.ndarray
    factors: Factors
    waves: Any


def batch_sums(batch, columns, factors: Factors, waves, sums: FrameSums, tiles: int = 1):
    """Add the rows of one batch to ``sums``; yields what has to be passed on before the bound is reached.

    ``waves.blocks(*columns)`` yields complex values (rows, some vectors) without factors.
    Rows are ordered by (frame, species), so that factors are applied to sums, not to rows.
    """
    frame = batch.column("frame").to_numpy(zero_copy_only=False)
    code = factors.codes(batch.column("species"))
    order = np.lexsort((code, frame))
    frame, code = frame[order], code[order]
    data = [batch.column(c).to_numpy(zero_copy_only=False)[order] for c in columns]
    step = max(1, SLICE_CELLS // waves.width)
    for lo in range(0, len(frame), step):
        hi = min(lo + step, len(frame))
        f, s = frame[lo:hi], code[lo:hi]
        new_frame = np.empty(hi - lo, dtype=bool)
        new_frame[0] = True
        np.not_equal(f[1:], f[:-1], out=new_frame[1:])
        new_group = new_frame.copy()
        new_group[1:] |= s[1:] != s[:-1]
        at = np.flatnonzero(new_group)
        grouped = np.empty((len(at), len(sums.q_id)), dtype=np.complex128)
        for part, values in waves.blocks(*(d[lo:hi] for d in data)):
            grouped[:, part] = np.add.reduceat(values, at, axis=0)
        grouped *= factors.values[s[at]]
        first = np.flatnonzero(new_frame[at])
        sums.add(f[at][first], np.add.reduceat(grouped, first, axis=0))
        if sums.full(tiles):
            yield from sums.flush()


def partial_sums(coords: DataFrame, columns, tiles: list[Tile]) -> DataFrame:
    """``(q_id, m_id, frame, re, im)`` partial sums of all tiles from one pass, to be added up by the caller."""

    def run(batches):
        held = [FrameSums(np.asarray(t.q_id, dtype=np.int64), np.asarray(t.m_id, dtype=np.int64)) for t in tiles]
        for batch in batches:
            if batch.num_rows:
                for t, sums in zip(tiles, held):
                    yield from batch_sums(batch, columns, t.factors, t.waves, sums, len(tiles))
        for sums in held:
            yield from sums.flush()

    needed = coords.select(
        F.col("frame").cast("bigint").alias("frame"),
        "species",
        *(F.col(c).cast("double").alias(c) for c in columns),
    )
    return needed.mapInArrow(run, PARTIAL)


def add_up(partial: DataFrame) -> DataFrame:
    return partial.groupBy("q_id", "m_id", "frame").agg(
        F.sum("re").alias("re"), F.sum("im").alias("im")
    )


def vector_parts(subvectors: DataFrame, limit: int | None = None) -> list[DataFrame]:
    """Vectors for one pass each; the vectors of an orientation stay together if they can."""
    limit = limit or PASS_ROWS
    small = localize(subvectors, limit)
    if on_driver(small) is not None:
        return [small]
    rows, directions = subvectors.agg(F.count("*"), F.count_distinct("m_id")).first()
    together = directions >= 8 * rows / limit
    return bounded_parts(subvectors, ["m_id"] if together else ["q_id", "m_id"], limit)


def pass_rows(factors: DataFrame) -> int:
    """Vectors of a pass, so that their factors stay within the bound for any number of species."""
    table = on_driver(factors)
    if table is None:
        species = factors.agg(F.count_distinct("species")).first()[0]
    else:
        species = len(table.column("species").unique())
    return max(1, min(PASS_ROWS, FACTOR_CELLS // max(1, species)))


def row_slices(groups: np.ndarray, width: int):
    """Rows of a table in slices of at most ``width``, whole groups together if they fit."""
    order = np.argsort(groups, kind="stable")
    _, starts, counts = np.unique(groups[order], return_index=True, return_counts=True)
    held = []
    for start, count in zip(starts, counts):
        if held and len(held) + count > width:
            yield np.array(held)
            held = []
        if count > width:
            for lo in range(start, start + count, width):
                yield order[lo : min(lo + width, start + count)]
        else:
            held.extend(order[start : start + count])
    if held:
        yield np.array(held)


def to_driver(params: DataFrame, factors: DataFrame) -> tuple[pd.DataFrame, Factors | None]:
    """One bounded part of the vectors with the factors that belong to it."""
    table = rows_of(params).sort_values(
        [c for c in ("q_id", "m_id") if c in params.columns], ignore_index=True
    )
    if table.empty:
        return table, None
    if on_driver(factors) is None:
        factors = factors.join(params.select("q_id").distinct(), "q_id", "left_semi")
    return table, Factors(rows_of(factors), table["q_id"].to_numpy())


def rows_of(params: DataFrame) -> pd.DataFrame:
    """Rows of a parameter table whose size has been checked."""
    table = on_driver(params)
    return params.toPandas() if table is None else table.to_pandas()
