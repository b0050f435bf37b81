"""Self (incoherent) signal, summed over atoms inside the task that holds them.

Coordinates are moved by atom and sorted in time, once per tile of vectors whose sums a task
can hold (one tile for short series). A task runs through the vectors of a tile for one atom after another and adds the
transformed series up, so what is shuffled afterwards is one series per vector and task, not one per atom.

Series too long for a task are cut into blocks of frames. A task holds pairs of blocks, the same pair of one atom after another, and adds
up their cross spectra; what leaves it are the lags around the distance of the two blocks, summed over its atoms. So neither the work of a task
nor what is shuffled grows with the length of a series beyond a block, other than by the number of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterloom.functions.waves import PlaneWaves
from scatterloom.operators.frames import explode_range
from scatterloom.operators.params import local_table, union_all
from scatterloom.plans import kernel, series

SERIES_CELLS = 1 << 18  # frames x vectors transformed at once: 4 MB of complex values
MEAN, MEAN_SQUARED = -1, -2  # rows beside the lags 0..n-1

_OUT = "q_id BIGINT, tau BIGINT, re DOUBLE, im DOUBLE"
_ARROW = pa.schema([("q_id", pa.int64()), ("tau", pa.int64()), ("re", pa.float64()), ("im", pa.float64())])


def _dsp(a: np.ndarray, dsp: str, method: str) -> np.ndarray:
    """Transform along axis 0."""
    if dsp == "plain":
        return a
    if dsp == "square":
        return (a.real**2 + a.imag**2).astype(np.complex128)
    if dsp != "autocorrelate":
        raise ValueError(f"no transform called {dsp!r}")
    if method == "direct":
        return series._correlate_direct(a)
    return series._correlate_fft(a)


def _atoms(batches, factors, part: str):
    """Yield (part of the work, atom, species code, frames, positions) from rows sorted by the column ``part`` and atom."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        tile, atom, frame = (batch.column(c).to_numpy(zero_copy_only=False) for c in (part, "atom_id", "frame"))
        code = factors.codes(batch.column("species"))
        xyz = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], axis=1)
        cuts = np.flatnonzero((atom[1:] != atom[:-1]) | (tile[1:] != tile[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(atom)]):
            if held and current != (tile[lo], atom[lo]):
                yield *current, *_joined(held)
                held = []
            current = tile[lo], atom[lo]
            held.append((code[lo], frame[lo:hi], xyz[lo:hi]))
    if held:
        yield *current, *_joined(held)


def _joined(parts):
    return (
        parts[0][0],
        np.concatenate([p[1] for p in parts]),
        np.concatenate([p[2] for p in parts]),
    )


def _one_pass(coords: DataFrame, table, factors, n_frames: int, dsp: str, method: str) -> DataFrame:
    """Sums for one table of vectors: every atom goes to a task once per tile of vectors, whose sums a task can hold."""
    q, groups, ids = table[["qx", "qy", "qz"]].to_numpy(), table["m_id"].to_numpy(), table["q_id"].to_numpy()
    width = max(1, min(kernel.VECTOR_ROWS, kernel.HELD_CELLS // n_frames))
    tiles = list(kernel.row_slices(groups, width))

    def waves_of(rows):
        for some in kernel.row_slices(groups[rows], max(1, SERIES_CELLS // n_frames)):
            waves = PlaneWaves(q[rows[some]], groups[rows[some]])
            yield rows[some][waves.rows], waves

    def run(batches):
        at = None
        for tile, _, code, frame, xyz in _atoms(batches, factors, "tile"):
            if tile != at:
                if at is not None:
                    yield from told(q_ids, lags, mean, mean2)
                at = tile
                slices = list(waves_of(tiles[tile]))
                q_ids = np.unique(ids[tiles[tile]])
                lags = np.zeros((len(q_ids), n_frames), dtype=np.complex128)
                mean, mean2 = np.zeros(len(q_ids), dtype=np.complex128), np.zeros(len(q_ids))
            series.once_each(frame)
            for rows, waves in slices:
                a = np.zeros((n_frames, len(rows)), dtype=np.complex128)
                a[frame] = waves(*xyz.T) * factors.values[code, rows]
                a = _dsp(a, dsp, method)
                m = a.sum(axis=0) / n_frames
                q_of = np.searchsorted(q_ids, ids[rows])
                for k, i in enumerate(q_of):
                    lags[i] += a[:, k]
                np.add.at(mean, q_of, m)
                np.add.at(mean2, q_of, m.real**2 + m.imag**2)
        if at is not None:
            yield from told(q_ids, lags, mean, mean2)

    def told(q_ids, lags, mean, mean2):
        tau = np.concatenate([np.arange(n_frames), [MEAN, MEAN_SQUARED]])
        for i, qid in enumerate(q_ids):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(tau), qid, dtype=np.int64)),
                    pa.array(tau.astype(np.int64)),
                    pa.array(np.concatenate([lags[i].real, [mean[i].real, mean2[i]]])),
                    pa.array(np.concatenate([lags[i].imag, [mean[i].imag, 0.0]])),
                ],
                schema=_ARROW,
            )

    every = F.explode(F.sequence(F.lit(0), F.lit(len(tiles) - 1))) if len(tiles) > 1 else F.lit(0)
    keys = ["tile", "atom_id"]
    staged = coords.withColumn("tile", every).repartition(*keys).sortWithinPartitions(*keys, "frame")
    return staged.mapInArrow(run, _OUT)


_BLOCKS_OUT = "q_id BIGINT, tau BIGINT, atom_id BIGINT, vector BIGINT, re DOUBLE, im DOUBLE"


def _spectra_of_pairs(n_frames: int, block: int, dsp: str, method: str):
    """How a pair of blocks is worked off: ``(size, first, last)`` with

    ``first(i, j, a, b)``: arrays (size, vectors) of two blocks that may be added over atoms, and each vector's part of its series' mean in time;
    ``last(i, j, sums)``: the lags (or frames) that the sums stand for, and their values.
    """
    if dsp != "autocorrelate":

        def first(i, j, a, b):
            a = _dsp(a, dsp, method)
            return a, a.sum(axis=0) / n_frames

        def last(i, j, sums):
            keep = i * block + np.arange(block) < n_frames
            return (i * block + np.arange(block))[keep], sums[keep]

        return block, first, last
    fft = method == "fft"
    size = 2 * block if fft else 2 * block - 1

    def lags(i, j):
        """The lag of each place, and its share of the lag's mean (0 for places that are no lags)."""
        r = np.arange(size)
        r = np.where(r < block, r, r - size) if fft else r - block + 1
        tau = (j - i) * block + r
        real = (tau >= 0) & (tau < n_frames)
        return tau, np.where(real, 1.0 / np.maximum(n_frames - tau, 1), 0.0)

    def first(i, j, a, b):
        share = lags(i, j)[1] / n_frames
        if not fft:
            y = np.stack([series.lagged(x, z) for x, z in zip(a.T, b.T)], axis=1)
            return y, share @ y
        x = np.fft.fft(a, size, axis=0)
        y = x.real**2 + x.imag**2 + 0j if i == j else np.conj(x) * np.fft.fft(b, size, axis=0)
        return y, np.fft.ifft(share) @ y

    def last(i, j, sums):
        tau, share = lags(i, j)
        found = np.fft.ifft(sums, axis=0) if fft else sums
        return tau[share > 0], found[share > 0] * share[share > 0, None]

    return size, first, last


def _by_blocks(coords: DataFrame, table, factors, n_frames: int, dsp: str, method: str, block: int) -> DataFrame:
    """Sums for one table of vectors of series longer than a block.

    Every pair of blocks (every block, where frames don't meet) and tile of vectors is dealt to as many tasks as keep the cluster busy, by
    atoms; sums are kept as spectra until a pair's last atom in the task. ``tau MEAN`` has a row per atom, vector and pair: a part of the
    mean of the atom's series.
    """
    q, groups, ids = table[["qx", "qy", "qz"]].to_numpy(), table["m_id"].to_numpy(), table["q_id"].to_numpy()
    size, first, last = _spectra_of_pairs(n_frames, block, dsp, method)
    width = max(1, min(kernel.VECTOR_ROWS, kernel.HELD_CELLS // size))
    tiles = list(kernel.row_slices(groups, width))
    n_blocks = -(-n_frames // block)
    paired = dsp == "autocorrelate"
    n_works = len(tiles) * (n_blocks * (n_blocks + 1) // 2 if paired else n_blocks)
    partitions = int(coords.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deals = max(1, -(-partitions // n_works))  # tasks that the atoms of a pair are dealt to
    schema = pa.schema([(f, pa.float64() if f in ("re", "im") else pa.int64()) for f in ("q_id", "tau", "atom_id", "vector", "re", "im")])

    def table_of(q_id, tau, atom, vector, value):
        n = len(value)
        whole = lambda v: pa.nulls(n, pa.int64()) if v is None else pa.array(np.broadcast_to(np.asarray(v, np.int64), n))
        return pa.RecordBatch.from_arrays([whole(q_id), whole(tau), whole(atom), whole(vector), pa.array(value.real.copy()), pa.array(value.imag.copy())], schema=schema)

    def run(batches):
        at, sums = None, None
        for work, atom, code, frame, xyz in _atoms(batches, factors, "work"):
            if work != at:
                if at is not None:
                    yield from told(i, j, q_ids, sums)
                at = work
                tile, i, j = int(work) // n_blocks**2, int(work) // n_blocks % n_blocks, int(work) % n_blocks
                rows = tiles[tile]
                parts = [(rows[s], PlaneWaves(q[rows[s]], groups[rows[s]])) for s in kernel.row_slices(groups[rows], max(1, SERIES_CELLS // size))]
                q_ids = np.unique(ids[rows])
                sums = np.zeros((size, len(q_ids)), dtype=np.complex128)
            series.once_each(frame)
            for some, waves in parts:
                some = some[waves.rows]
                value = waves(*xyz.T) * factors.values[code, some]
                blocks = []
                for k in (i,) if i == j else (i, j):
                    a = np.zeros((block, len(some)), dtype=np.complex128)
                    inside = frame // block == k
                    a[frame[inside] - k * block] = value[inside]
                    blocks.append(a)
                y, mean = first(i, j, blocks[0], blocks[-1])
                q_of = np.searchsorted(q_ids, ids[some])
                for n, to in enumerate(q_of):
                    sums[:, to] += y[:, n]
                yield table_of(ids[some], MEAN, atom, some, mean)
        if at is not None:
            yield from told(i, j, q_ids, sums)

    def told(i, j, q_ids, sums):
        for n, q_id in enumerate(q_ids):
            tau, value = last(i, j, sums[:, [n]])
            yield table_of(q_id, tau, None, None, value[:, 0])

    own = F.expr(f"frame div {block}")
    pairs = series.block_pairs("frame", n_frames, block) if paired else F.array(F.struct(own.alias("i"), own.alias("j")))
    tile = F.explode(F.sequence(F.lit(0), F.lit(len(tiles) - 1))) if len(tiles) > 1 else F.lit(0)
    dealt = coords.select("*", F.inline(pairs)).withColumn("tile", tile)
    work = ((F.col("tile") * n_blocks + F.col("i")) * n_blocks + F.col("j")).cast("bigint")
    staged = dealt.select(work.alias("work"), "frame", "atom_id", "species", "x", "y", "z").repartition("work", F.pmod(F.xxhash64("atom_id"), F.lit(deals)))
    return staged.sortWithinPartitions("work", "atom_id", "frame").mapInArrow(run, _BLOCKS_OUT)


def _joined_blocks(parts: DataFrame, q_ids, n_frames: int) -> DataFrame:
    """``q_id, tau, re, im`` of what `_by_blocks` passes on: an atom's parts of a mean are added before they are squared. Lags of
    blocks without any row count as zero."""
    spark = parts.sparkSession
    every = explode_range(local_table(spark, [(int(i),) for i in q_ids], "q_id bigint"), F.lit(0), F.lit(n_frames - 1), "tau")
    none = F.lit(None).cast("bigint")
    parts = parts.unionByName(every.select("q_id", "tau", none.alias("atom_id"), none.alias("vector"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im")))
    whole = parts.groupBy("q_id", "tau", "atom_id", "vector").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    square = F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    sums = whole.groupBy("q_id", "tau").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), square.alias("square"))
    row = lambda tau, re, im: F.struct(tau.cast("bigint").alias("tau"), re.alias("re"), im.alias("im"))
    both = F.array(row(F.lit(MEAN), F.col("re"), F.col("im")), row(F.lit(MEAN_SQUARED), F.col("square"), F.lit(0.0)))
    rows = F.when(F.col("tau") == MEAN, both).otherwise(F.array(row(F.col("tau"), F.col("re"), F.col("im"))))
    return sums.select("q_id", F.inline(rows))


def self_sums(
    coords: DataFrame, factors: DataFrame, subvectors: DataFrame, n_frames: int,
    dsp: str = "autocorrelate", method: str = "fft", in_task: int = series.SERIES_IN_TASK,
) -> DataFrame:
    """``(q_id, tau, re, im)`` summed over atoms and orientations.

    Rows with tau ``MEAN`` and ``MEAN_SQUARED`` hold the sums of the time means and of
    their squared magnitudes. Series too long for a task are worked off by pairs of blocks of
    ``in_task`` frames. Frames outside 0..n_frames-1 and a frame that an atom has twice raise.
    """
    coords = series.in_range(coords, n_frames)
    limit = min(in_task, series.DIRECT_BLOCK) if (dsp, method) == ("autocorrelate", "direct") else in_task
    block = series.block_of(limit, n_frames)
    needed = coords.select(
        F.col("frame").cast("bigint").alias("frame"), "atom_id", "species",
        *(F.col(c).cast("double").alias(c) for c in "xyz"),
    )
    passes = []
    for part in kernel.vector_parts(subvectors, kernel.pass_rows(factors)):
        table, f = kernel.to_driver(part, factors)
        if f is not None:
            if n_frames > limit:
                passes.append(_joined_blocks(_by_blocks(needed, table, f, n_frames, dsp, method, block), table["q_id"].unique(), n_frames))
            else:
                passes.append(_one_pass(needed, table, f, n_frames, dsp, method))
    if not passes:
        return coords.sparkSession.createDataFrame([], _OUT)
    return union_all(passes).groupBy("q_id", "tau").agg(
        F.sum("re").alias("re"), F.sum("im").alias("im")
    )
