"""Time-series transforms of amplitudes and their averages.

A series is the rows of one key (vector, orientation, perhaps atom) with ``frame`` in
0..n_frames-1; frames without a row count as zero.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterloom.operators.frames import explode_range

SERIES_IN_TASK = 1 << 18  # longest series transformed inside one task: 4 MB of values
DIRECT_BLOCK = 1 << 16  # frames of a block of the direct sum: a pair of blocks takes 2^32 products
TILE = 64


def square(df: DataFrame) -> DataFrame:
    """Squared magnitude, imaginary part 0."""
    return df.withColumns(
        {"re": F.col("re") * F.col("re") + F.col("im") * F.col("im"), "im": F.lit(0.0)}
    )


def scale(df: DataFrame, k) -> DataFrame:
    """Both parts times a real factor."""
    return df.withColumns({"re": F.col("re") * k, "im": F.col("im") * k})


def add(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Element-wise sum of two series tables; a missing element counts as zero."""
    both = a.select(*keys, "re", "im").unionByName(b.select(*keys, "re", "im"))
    return both.groupBy(*keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def total(df: DataFrame, keys) -> DataFrame:
    """Sum of each series over time."""
    return df.groupBy(*keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def in_range(df: DataFrame, n_frames: int) -> DataFrame:
    """The same rows; one whose frame is not one of 0..n_frames-1 raises when it is read."""
    frame = F.col("frame")
    told = F.concat(F.lit("frame "), frame.cast("string"), F.lit(f" in a series of {n_frames}"))
    sound = (frame >= 0) & (frame < n_frames)
    return df.withColumn("frame", F.when(sound, frame.cast("bigint")).otherwise(F.raise_error(told).cast("bigint")))


def once_each(places: np.ndarray) -> None:
    """Raise if a place of a series has more than one value."""
    if len(np.unique(places)) != len(places):
        raise ValueError("a series has two values for a frame")


def _correlate_fft(a: np.ndarray) -> np.ndarray:
    """Along axis 0: mean over k of conj(a[k]) * a[k + tau]."""
    n = len(a)
    power = np.abs(np.fft.fft(a, 2 * n, axis=0)) ** 2
    lags = np.fft.ifft(power, axis=0)[:n]
    return lags / (n - np.arange(n)).reshape(-1, *([1] * (a.ndim - 1)))


def _correlate_direct(a: np.ndarray) -> np.ndarray:
    n = len(a)
    sums = [np.correlate(c, c, "full")[n - 1 :] for c in a.T]
    return np.stack(sums, axis=1) / (n - np.arange(n))[:, None]


def _schema(df: DataFrame, keys, *extra: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([f"{k} {types[k]}" for k in keys] + list(extra))


def _whole_series(batches, keys):
    """Cut batches sorted by key into tables that hold whole series only."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = 0
        for k in keys:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            change = np.flatnonzero(column[1:] != column[:-1])
            cut = max(cut, change[-1] + 1 if len(change) else 0)
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def _in_task(df: DataFrame, keys, n_frames: int, correlate) -> DataFrame:
    """Series by series in the tasks that hold them, several at a time."""
    out = _schema(df, keys, "frame bigint", "re double", "im double")
    at_once = max(1, SERIES_IN_TASK // n_frames)

    def run(batches):
        for table in _whole_series(batches, keys):
            new = np.zeros(table.num_rows, dtype=bool)
            new[0] = True
            for k in keys:
                column = table.column(k).to_numpy()
                new[1:] |= column[1:] != column[:-1]
            starts = np.append(np.flatnonzero(new), len(new))
            frame, re, im = (table.column(c).to_numpy() for c in ("frame", "re", "im"))
            for lo in range(0, len(starts) - 1, at_once):
                cuts = starts[lo : lo + at_once + 1]
                rows = slice(cuts[0], cuts[-1])
                series = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                a = np.zeros((n_frames, len(cuts) - 1), dtype=np.complex128)
                once_each(frame[rows] * (len(cuts) - 1) + series)
                a[frame[rows], series] = re[rows] + 1j * im[rows]
                c = np.ascontiguousarray(correlate(a).T)
                each = pa.array(np.repeat(cuts[:-1], n_frames))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(table.column(k).combine_chunks().take(each) for k in keys),
                        pa.array(np.tile(np.arange(n_frames), len(cuts) - 1)),
                        pa.array(c.real.ravel()),
                        pa.array(c.imag.ravel()),
                    ],
                    [*keys, "frame", "re", "im"],
                )

    staged = df.select(*keys, "frame", "re", "im").repartition(*keys).sortWithinPartitions(*keys)
    return staged.mapInArrow(run, out)


def _across_tasks(df: DataFrame, keys, n_frames: int, tile: int = TILE) -> DataFrame:
    """The same by a transform spread over tasks, for series too long for one.

    A length N = N1 * N2 transform is done as N2 short ones of length N1 over
    n = n1 * N2 + n2, a twist, and N1 short ones of length N2. The power spectrum is
    taken where the second set ends and the way back starts from there, so three
    groupings by (series, tile of n2 or k1) do the whole correlation, each with at
    most ``tile * max(N1, N2)`` values.
    """
    bits = max(2, math.ceil(math.log2(2 * n_frames)))
    n1 = 1 << (bits // 2)
    n2 = 1 << (bits - bits // 2)
    n = n1 * n2
    tile = min(tile, n1, n2)
    blocks = _schema(
        df, keys, "k_tile bigint", "n_tile bigint", "re array<double>", "im array<double>"
    )
    final = _schema(df, keys, "frame bigint", "re double", "im double")

    def twist(k, m):
        return np.exp(-2j * np.pi * (np.outer(k, m) % n) / n)

    def pack(key, rows, k_tile, n_tile, values):
        rows.append((*key, k_tile, n_tile, values.real.ravel(), values.imag.ravel()))

    def frame_of(rows, names):
        return pd.DataFrame(rows, columns=names)

    names = [*keys, "k_tile", "n_tile", "re", "im"]

    def forward(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        *series, n_tile = key
        a = np.zeros((n1, tile), dtype=np.complex128)
        t = pdf["frame"].to_numpy()
        once_each(t)
        a[t // n2, t % n2 - n_tile * tile] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        a = np.fft.fft(a, axis=0)
        a *= twist(np.arange(n1), n_tile * tile + np.arange(tile))
        rows = []
        for k_tile in range(n1 // tile):
            pack(series, rows, k_tile, n_tile, a[k_tile * tile : (k_tile + 1) * tile])
        return frame_of(rows, names)

    def gather(pdf, which):
        out = {}
        for at, re, im in zip(pdf[which], pdf["re"], pdf["im"]):
            out[at] = (np.asarray(re) + 1j * np.asarray(im)).reshape(tile, tile)
        return out

    def middle(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        *series, k_tile = key
        a = np.zeros((tile, n2), dtype=np.complex128)
        for at, part in gather(pdf, "n_tile").items():
            a[:, at * tile : (at + 1) * tile] = part
        power = np.abs(np.fft.fft(a, axis=1)) ** 2
        b = np.fft.ifft(power, axis=1)
        b *= np.conj(twist(k_tile * tile + np.arange(tile), np.arange(n2)))
        rows = []
        for n_tile in range(n2 // tile):
            pack(series, rows, k_tile, n_tile, b[:, n_tile * tile : (n_tile + 1) * tile])
        return frame_of(rows, names)

    def backward(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        *series, n_tile = key
        a = np.zeros((n1, tile), dtype=np.complex128)
        for at, part in gather(pdf, "k_tile").items():
            a[at * tile : (at + 1) * tile] = part
        c = np.fft.ifft(a, axis=0)
        tau = np.arange(n1)[:, None] * n2 + n_tile * tile + np.arange(tile)[None, :]
        keep = tau < n_frames
        tau, c = tau[keep], c[keep] / (n_frames - tau[keep])
        return pd.DataFrame({**dict(zip(keys, series)), "frame": tau, "re": c.real, "im": c.imag})

    n_tile = F.expr(f"(frame % {n2}) div {tile}")
    step = df.select(*keys, "frame", "re", "im").groupBy(*keys, n_tile.alias("n_tile"))
    step = step.applyInPandas(forward, blocks).groupBy(*keys, "k_tile")
    step = step.applyInPandas(middle, blocks).groupBy(*keys, "n_tile")
    return step.applyInPandas(backward, final)


def block_of(wanted: int, n_frames: int) -> int:
    """Frames of a block; four blocks where a task may hold nothing at all."""
    return wanted if wanted > 0 else -(-n_frames // 4)


def block_pairs(frame, n_frames: int, block: int):
    """Columns ``i, j`` (i <= j) of all pairs of blocks that a frame's block is part of, as one array column of structs."""
    own, last = F.expr(f"{frame} div {block}"), -(-n_frames // block) - 1
    others = F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))
    return F.transform(others, lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))


def lagged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums over k of conj(a[k]) * b[k + r] for r = -(L-1)..L-1, of two blocks of L values."""
    return np.correlate(b, a, "full")


def _by_pairs(df: DataFrame, keys, n_frames: int, block: int) -> DataFrame:
    """The direct sum of series too long for one task: every pair of blocks is a task of its own.

    A pair of blocks d apart gives the lags around d * block, 2 * block - 1 of them; these are added up by lag. Rows travel once for each
    block of their series, and no task does more than ``block ** 2`` products.
    """
    out = _schema(df, keys, "frame bigint", "re double", "im double")

    def pair(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        *series_key, i, j = key
        frame, value = pdf["frame"].to_numpy(), pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        once_each(frame)
        parts = []
        for k in (i, j):
            a = np.zeros(block, dtype=np.complex128)
            inside = frame // block == k
            a[frame[inside] - k * block] = value[inside]
            parts.append(a)
        tau = (j - i) * block + np.arange(1 - block, block)
        keep = (tau >= 0) & (tau < n_frames)
        tau, sums = tau[keep], lagged(*parts)[keep]
        return pd.DataFrame({**dict(zip(keys, series_key)), "frame": tau, "re": sums.real, "im": sums.imag})

    dealt = df.select(*keys, "frame", "re", "im", F.inline(block_pairs("frame", n_frames, block)))
    sums = dealt.groupBy(*keys, "i", "j").applyInPandas(pair, out).groupBy(*keys, "frame")
    share = F.lit(n_frames) - F.col("frame")
    return dense(sums.agg((F.sum("re") / share).alias("re"), (F.sum("im") / share).alias("im")), keys, n_frames)


def autocorrelate(
    df: DataFrame, keys, n_frames: int, method: str = "fft", in_task: int = SERIES_IN_TASK
) -> DataFrame:
    """C(tau) = 1/(n-tau) * sum over k of conj(A[k]) * A[k+tau]; the lag is in ``frame``.

    ``direct`` is the quadratic sum, ``fft`` pads to twice the length. Series that are longer than a task may hold
    (``DIRECT_BLOCK`` frames of a direct sum) are spread over tasks.
    Frames outside 0..n_frames-1 and a frame that a series has twice raise.
    """
    keys = list(keys)
    if method not in ("fft", "direct"):
        raise ValueError("method is 'fft' or 'direct'")
    df = in_range(df, n_frames)
    if method == "direct":
        block = min(in_task, DIRECT_BLOCK)
        if n_frames > block:
            return _by_pairs(df, keys, n_frames, block_of(block, n_frames))
        return _in_task(df, keys, n_frames, _correlate_direct)
    if n_frames <= in_task:
        return _in_task(df, keys, n_frames, _correlate_fft)
    return _across_tasks(df, keys, n_frames)


def transform(
    df: DataFrame, keys, n_frames: int, dsp: str = "plain", method: str = "fft", in_task: int = SERIES_IN_TASK
) -> DataFrame:
    """Apply ``plain``, ``square`` or ``autocorrelate``."""
    if dsp == "plain":
        return df
    if dsp == "square":
        return square(df)
    if dsp == "autocorrelate":
        return autocorrelate(df, keys, n_frames, method, in_task)
    raise ValueError(f"no transform called {dsp!r}")


def dense(df: DataFrame, keys, n_frames: int) -> DataFrame:
    """Add zero rows for the frames a series has no value for."""
    grid = explode_range(df.select(*keys).distinct(), F.lit(0), F.lit(n_frames - 1), "frame")
    grid = grid.select(*keys, "frame", F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    both = df.select(*keys, "frame", "re", "im").unionByName(grid)
    return both.groupBy(*keys, "frame").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def reduce_time(df: DataFrame, keys, n_frames: int) -> DataFrame:
    """``(q_id, fq0_re, fq0_im, fq_re, fq_im, fq2_re, fq2_im)``: per series the value at 0, the
    time mean and its squared magnitude, all summed over the series of a vector."""
    n = float(n_frames)
    start = F.col("frame") == 0
    means = df.groupBy(*keys).agg(
        F.sum(F.when(start, F.col("re"))).alias("sr"), F.sum(F.when(start, F.col("im"))).alias("si"),
        (F.sum("re") / n).alias("mr"), (F.sum("im") / n).alias("mi"),
    )
    return means.groupBy("q_id").agg(
        F.coalesce(F.sum("sr"), F.lit(0.0)).alias("fq0_re"),
        F.coalesce(F.sum("si"), F.lit(0.0)).alias("fq0_im"),
        F.sum("mr").alias("fq_re"),
        F.sum("mi").alias("fq_im"),
        F.sum(F.col("mr") * F.col("mr") + F.col("mi") * F.col("mi")).alias("fq2_re"),
        F.lit(0.0).alias("fq2_im"),
    )


def reduce_series(df: DataFrame) -> DataFrame:
    """``(q_id, tau, re, im)``: sum over the series of a vector."""
    return df.groupBy("q_id", F.col("frame").alias("tau")).agg(
        F.sum("re").alias("re"), F.sum("im").alias("im")
    )
