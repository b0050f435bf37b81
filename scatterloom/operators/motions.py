"""Artificial motions added to a selection, keyed by frame number.

A motion is a table ``(frame, tx, ty, tz)`` or ``(frame, r00..r22)``. Motions that are
a function of the frame number alone need no table and become column expressions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterloom.functions import draws, vec
from scatterloom.operators import align, rigid
from scatterloom.operators.prefix import PLACES, running_total, within
from scatterloom.operators.selections import SYSTEM

PRODUCT_BLOCK = 1 << 14


def _direction(direction, length: float) -> tuple:
    n = math.sqrt(sum(float(c) ** 2 for c in direction))
    if n == 0:
        raise ValueError("the direction of a motion must not be zero")
    return tuple(length * float(c) / n for c in direction)


def linear(displace=1.0, direction=(1.0, 0.0, 0.0), sampling=1) -> vec.Vec:
    """The shift of each frame in a steady motion: ``displace * sampling`` along ``direction`` per frame."""
    return vec.scale(F.col("frame"), vec.literal(_direction(direction, displace * sampling)))


def oscillation(displace=1.0, frequency=0.001, direction=(1.0, 0.0, 0.0), sampling=1) -> vec.Vec:
    """The shift of each frame in a sine in time along ``direction``."""
    wave = F.sin(F.col("frame") * (2 * math.pi * frequency * sampling))
    return vec.scale(wave, vec.literal(_direction(direction, displace)))


def motion_linear(df, displace=1.0, direction=(1.0, 0.0, 0.0), sampling=1, selection=SYSTEM) -> DataFrame:
    """Steady motion: ``displace * sampling`` along ``direction`` per frame."""
    return align.translate(df, linear(displace, direction, sampling), selection)


def motion_fixed(df, displace=1.0, direction=(1.0, 0.0, 0.0), selection=SYSTEM) -> DataFrame:
    """The same offset in every frame."""
    return align.translate(df, vec.literal(_direction(direction, displace)), selection)


def motion_oscillation(
    df, displace=1.0, frequency=0.001, direction=(1.0, 0.0, 0.0), sampling=1, selection=SYSTEM
) -> DataFrame:
    """A sine in time along ``direction``."""
    return align.translate(df, oscillation(displace, frequency, direction, sampling), selection)


# -- walks --------------------------------------------------------------------------------


def randomwalk_steps(spark: SparkSession, n_frames: int, displace=1.0, seed=0, sampling=1) -> DataFrame:
    """Steps of length ``displace`` in random directions."""
    d = draws.on_sphere(F.col("id") * sampling, seed, 0)
    return spark.range(n_frames).select(
        F.col("id").alias("frame"), *((F.lit(displace) * c).alias(f"d{k}") for k, c in zip("xyz", d))
    )


def brownian_steps(spark: SparkSession, n_frames: int, displace=1.0, seed=0, sampling=1) -> DataFrame:
    """Steps of normally distributed length in random directions."""
    index = F.col("id") * sampling
    size = F.lit(displace) * draws.normal(index, seed, 1)
    d = draws.on_sphere(index, seed, 0)
    return spark.range(n_frames).select(
        F.col("id").alias("frame"), *((size * c).alias(f"d{k}") for k, c in zip("xyz", d))
    )


def walk(steps: DataFrame, block: int | None = None, n_frames: int = PLACES) -> DataFrame:
    """``(frame, tx, ty, tz)``: steps ``(frame, dx, dy, dz)`` summed up to and including the frame."""
    options = {"n": n_frames} if block is None else {"block": block}
    summed = running_total(steps, "frame", ["dx", "dy", "dz"], **options)
    return summed.select("frame", *(F.col(f"d{c}").alias(f"t{c}") for c in "xyz"))


def motion_walk(df, shifts: DataFrame, selection=SYSTEM, n_frames=None) -> DataFrame:
    """Translate ``selection`` by the shift of its frame."""
    joined = align.join_per_frame(df, shifts.select("frame", "tx", "ty", "tz"), n_frames)
    t = vec.Vec(*(F.coalesce(F.col(f"t{c}"), F.lit(0.0)) for c in "xyz"))
    return align.translate(joined, t, selection).drop("tx", "ty", "tz")


def motion_randomwalk(df, n_frames: int, displace=1.0, seed=0, sampling=1, selection=SYSTEM) -> DataFrame:
    steps = randomwalk_steps(df.sparkSession, n_frames, displace, seed, sampling)
    return motion_walk(df, walk(steps, n_frames=n_frames), selection, n_frames)


def motion_brownian(df, n_frames: int, displace=1.0, seed=0, sampling=1, selection=SYSTEM) -> DataFrame:
    steps = brownian_steps(df.sparkSession, n_frames, displace, seed, sampling)
    return motion_walk(df, walk(steps, n_frames=n_frames), selection, n_frames)


# -- rotations ------------------------------------------------------------------------------


def rotation_steps(spark: SparkSession, n_frames: int, displace=1.0, seed=0, sampling=1) -> DataFrame:
    """Three normally distributed angles in degrees per frame."""
    index = F.col("id") * sampling
    return spark.range(n_frames).select(
        F.col("id").alias("frame"),
        *((F.lit(displace) * draws.normal(index, seed, k)).alias(f"a{k + 1}") for k in range(3)),
    )


def _turns(angles: np.ndarray) -> np.ndarray:
    """Product of turns in the xy, xz and yz planes, for row vectors; angles in degrees."""
    rad = np.deg2rad(angles)
    out = np.broadcast_to(np.eye(3), (len(rad), 3, 3)).copy()
    for k, (i, j, sign) in enumerate(((0, 1, 1), (0, 2, -1), (1, 2, 1))):
        turn = np.broadcast_to(np.eye(3), (len(rad), 3, 3)).copy()
        turn[:, i, i] = turn[:, j, j] = np.cos(rad[:, k])
        turn[:, i, j] = sign * np.sin(rad[:, k])
        turn[:, j, i] = -turn[:, i, j]
        out = out @ turn
    return out


def _chain(matrices: np.ndarray) -> np.ndarray:
    """Inclusive running products, by doubling."""
    out, shift = matrices.copy(), 1
    while shift < len(out):
        out[shift:] = out[:-shift] @ out[shift:]
        shift *= 2
    return out


def _flat(frames, matrices) -> pd.DataFrame:
    out = pd.DataFrame(matrices.reshape(-1, 9), columns=align.MATRIX)
    out.insert(0, "frame", np.asarray(frames, dtype=np.int64))
    return out


def rotation_walk(steps: DataFrame, block: int = PRODUCT_BLOCK, n_frames: int | None = None) -> DataFrame:
    """``(frame, r00..r22)``: the ordered product of the turns of all frames so far.

    A tree of blocks: products inside blocks of frames, and the blocks' own products multiplied up in the same way, level by
    level, until one block holds a level. ``n_frames`` is looked up where it isn't known.
    """
    if n_frames is None:
        n_frames = (steps.agg(F.max("frame")).first()[0] or 0) + 1
    ddl = "frame BIGINT, " + ", ".join(f"{c} DOUBLE" for c in align.MATRIX)
    turns = within(steps, "frame", n_frames).select("frame", F.array("a1", "a2", "a3").alias("__a"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        return _flat(pdf["frame"], _chain(_turns(np.stack(pdf["__a"].to_list()))))

    return _products(turns, inside, ddl, max(2, block), n_frames)


def _across(pdf: pd.DataFrame) -> pd.DataFrame:
    """Running products of matrices, inside a block."""
    pdf = pdf.sort_values("frame")
    return _flat(pdf["frame"], _chain(pdf[align.MATRIX].to_numpy().reshape(-1, 3, 3)))


def _products(rows: DataFrame, inside, ddl: str, block: int, n: int) -> DataFrame:
    """Inclusive running products along ``frame``; ``inside`` makes those of one block."""
    number = F.expr(f"frame div {int(block)}")
    local = rows.groupBy(number.alias("__block")).applyInPandas(lambda pdf: inside(pdf), ddl)
    if n <= block:
        return local
    local = local.withColumn("__block", number)
    ends = local.groupBy("__block").agg(
        *(F.max_by(c, "frame").alias(c) for c in align.MATRIX)
    ).withColumnRenamed("__block", "frame")
    upto = _products(ends, _across, ddl, block, -(-n // block))
    # what a block passes on to the next one
    before = upto.select((F.col("frame") + 1).alias("__block"), *(F.col(c).alias(f"p{c}") for c in align.MATRIX))
    joined = local.join(before, "__block", "left")

    def product(i, j):
        total = sum(
            (F.col(f"pr{i}{k}") * F.col(f"r{k}{j}") for k in range(3)), start=F.lit(0.0)
        )
        return F.when(F.col("pr00").isNull(), F.col(f"r{i}{j}")).otherwise(total)

    return joined.select(
        "frame", *(product(i, j).alias(f"r{i}{j}") for i in range(3) for j in range(3))
    )


def motion_rotation(df, rotations: DataFrame, selection=SYSTEM, reference=None,
                    reference_selection=SYSTEM, n_frames=None) -> DataFrame:
    """Turn ``selection`` about the centre of the reference by the rotation of its frame.

    Without a reference the centre of ``reference_selection`` in the current frame is used.
    """
    about = None if reference is None else rigid.Reference.of(reference)
    return rigid.move(df, [rigid.Turn(rotations, selection, about, reference_selection)], n_frames)


def motion_rotbrownian(df, n_frames: int, displace=1.0, seed=0, sampling=1, selection=SYSTEM,
                       reference=None, reference_selection=SYSTEM) -> DataFrame:
    steps = rotation_steps(df.sparkSession, n_frames, displace, seed, sampling)
    return motion_rotation(
        df, rotation_walk(steps, n_frames=n_frames), selection, reference, reference_selection, n_frames
    )
