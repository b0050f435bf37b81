"""Per-frame centres, alignment and affine motion of coordinates.

The input is *tagged* coordinates: ``frame, atom_id, x, y, z, mass`` and one boolean
column per selection (``selections.tag_atoms`` on the atoms, joined once by
``atom_id``). The alignments are steps of `rigid`, which composes chains of them: each function here is a chain of one step,
which reads the coordinates once when it is called and leaves a join by ``frame`` in the plan. For several steps at once use `rigid.move`.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scatterloom.functions import vec
from scatterloom.operators import rigid
from scatterloom.operators.params import localize, on_driver
from scatterloom.operators.rigid import MATRIX, best_rotations, join_per_frame
from scatterloom.operators.selections import SYSTEM, is_in


def tagged(coords: DataFrame, atoms: DataFrame) -> DataFrame:
    """Coordinates with the mass and the selection flags of their atom."""
    extra = [c for c in atoms.columns if c == "atom_id" or c not in coords.columns]
    return coords.join(rigid.shipped(localize(atoms.select(*extra))), "atom_id")


def _centre_sums(member, prefix="c"):
    """Aggregates for the weighted centre of the rows where ``member`` holds."""
    m = F.when(member, F.col("mass"))
    return [
        (F.sum(m * F.col(c)) / F.sum(m)).alias(f"{prefix}{c}") for c in "xyz"
    ]


def center_of_mass(df: DataFrame, selection: str = SYSTEM) -> DataFrame:
    """``(frame, cx, cy, cz)``; an empty selection has its centre at the origin."""
    sums = df.groupBy("frame").agg(*_centre_sums(is_in(selection)))
    return sums.na.fill(0.0, ["cx", "cy", "cz"])


def translate(df: DataFrame, shift: vec.Vec, selection: str = SYSTEM) -> DataFrame:
    """Add ``shift`` to the selected atoms."""
    moved = vec.add(vec.columns(), shift)
    return df.withColumns(
        {c: F.when(is_in(selection), new).otherwise(F.col(c)) for c, new in zip("xyz", moved)}
    )


def _row_times_matrix(v: vec.Vec, matrix=MATRIX) -> vec.Vec:
    """Row vector times the 3x3 matrix held in nine columns."""
    m = [F.col(c) for c in matrix]
    return vec.Vec(*(v.x * m[j] + v.y * m[3 + j] + v.z * m[6 + j] for j in range(3)))


def affine(df: DataFrame, matrices: DataFrame, selection: str = SYSTEM, n_frames: int | None = None) -> DataFrame:
    """Row vector times matrix plus shift, per frame, for the selected atoms.

    ``matrices`` has ``frame``, the nine columns ``r00..r22`` and ``tx, ty, tz``.
    """
    joined = join_per_frame(df, matrices.select("frame", *MATRIX, "tx", "ty", "tz"), n_frames)
    moved = vec.add(_row_times_matrix(vec.columns()), vec.columns("tx", "ty", "tz"))
    hit = is_in(selection) & F.col("r00").isNotNull()
    return joined.withColumns(
        {c: F.when(hit, new).otherwise(F.col(c)) for c, new in zip("xyz", moved)}
    ).drop(*MATRIX, "tx", "ty", "tz")


def reorient(df: DataFrame, axis1, axis2) -> DataFrame:
    """Turn everything so that ``axis1`` points along x and ``axis2`` lies in the xy plane."""
    e = vec.frame_onto_xy(axis1, axis2)
    v = vec.columns()
    return df.withColumns({c: vec.dot(v, vec.literal(b)) for c, b in zip("xyz", e)})


def with_representation(df: DataFrame, kind: str = "cartesian", axis=(0.0, 0.0, 1.0)) -> DataFrame:
    """Coordinates as x,y,z or r,phi,theta or (about ``axis``) r,phi,z."""
    if kind == "cartesian":
        return df
    if kind == "spherical":
        names, values = ("r", "phi", "theta"), vec.to_sphere(vec.columns())
    elif kind == "cylindrical":
        names = ("r", "phi", "z")
        values = vec.to_cylinder(vec.project(vec.columns(), vec.axis_base(axis)))
    else:
        raise ValueError(f"no representation called {kind!r}")
    rest = [c for c in df.columns if c not in "xyz"]
    return df.select(*rest, *(v.alias(n) for n, v in zip(names, values)))


# -- references -------------------------------------------------------------------------


def reference_coords(
    df: DataFrame, frame: int = 0, selection: str = SYSTEM, n_frames: int | None = None
) -> DataFrame:
    """One frame as reference ``(atom_id, ux, uy, uz, mass)``; beyond the end the last frame.

    For frame 0, or with ``n_frames``, the scan is asked for that frame only; else the last one is looked up by the
    query. A frame of up to ``params.PART_ROWS`` atoms is read once, here, and travels with the plan.
    """
    number = F.lit(frame).cast("bigint")
    if n_frames is not None:
        number = F.lit(max(0, min(frame, n_frames - 1))).cast("bigint")
    elif frame > 0:
        number = F.least(number, df.agg(F.max("frame").alias("n")).scalar())
    at = df.where((F.col("frame") == number) & is_in(selection))
    return localize(at.select("atom_id", *(F.col(c).alias(f"u{c}") for c in "xyz"), "mass"))


def _reference_centre(reference: DataFrame) -> vec.Vec:
    """The weighted centre of a reference as three constants of the query."""
    m = F.col("mass")
    c = reference.agg(
        F.struct(
            *(F.coalesce(F.sum(m * F.col(f"u{k}")) / F.sum(m), F.lit(0.0)).alias(k) for k in "xyz")
        ).alias("c")
    ).scalar()
    return vec.Vec(c["x"], c["y"], c["z"])


# -- alignments -------------------------------------------------------------------------


def align_center(df, selection=SYSTEM, reference_selection=SYSTEM, n_frames=None) -> DataFrame:
    """Move ``selection`` so that the current centre of the reference selection is the origin."""
    return rigid.move(df, [rigid.Centre(selection, reference_selection)], n_frames)


def align_fittrans(df, reference: DataFrame | None = None, selection=SYSTEM, n_frames=None) -> DataFrame:
    """Move ``selection`` so that its centre is the centre of the reference.

    Without a reference the whole current frame serves as one.
    """
    target = None if reference is None else rigid.Reference.of(reference)
    return rigid.move(df, [rigid.Onto(target, selection)], n_frames)


def fit_sums(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Per frame: centre over the reference atoms and the nine weighted covariance sums.

    ``k{a}{b}`` is the sum of mass * (reference - its centre)_a * position_b, which
    equals the covariance because the reference part sums to zero.
    """
    u0 = _reference_centre(reference)
    u = vec.sub(vec.columns("ux", "uy", "uz"), u0)
    centred = reference.select(
        "atom_id", *(c.alias(f"u{n}") for n, c in zip("xyz", u))
    )
    if on_driver(reference) is not None:
        centred = F.broadcast(centred)
    matched = df.join(centred, "atom_id")
    m, v = F.col("mass"), vec.columns()
    sums = [
        F.sum(m * F.col(f"u{a}") * v[j]).alias(f"k{i}{j}")
        for i, a in enumerate("xyz")
        for j in range(3)
    ]
    return matched.groupBy("frame").agg(
        F.count("*").alias("n_atoms"), *_centre_sums(F.lit(True)), *sums
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _rotation(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for k in parts:
        m = np.array(k.to_list(), dtype=np.float64).reshape(-1, 3, 3)
        yield pd.Series(list(best_rotations(m).reshape(-1, 9)))


def fit_rotations(df: DataFrame, reference: DataFrame) -> DataFrame:
    """One row per frame: centre ``cx, cy, cz`` and rotation ``r00..r22`` acting on columns."""
    n_reference = reference.agg(F.count("*").alias("n")).scalar()
    sums = fit_sums(df, reference)
    k = F.array(*(F.col(f"k{i}{j}") for i in range(3) for j in range(3)))
    complete = F.when(F.col("n_atoms") == n_reference, k).otherwise(
        F.raise_error("fit needs the same atoms in the frame and in the reference")
    )
    turned = sums.withColumn("__r", _rotation(complete))
    return turned.select(
        "frame", "cx", "cy", "cz", *(F.col("__r")[i].alias(c) for i, c in enumerate(MATRIX))
    )


def align_fitrottrans(
    df, reference, selection=SYSTEM, reference_selection=SYSTEM, n_frames=None, apply_to="common"
) -> DataFrame:
    """Least-squares rotation and translation on to the reference.

    By default only atoms in both ``selection`` and the reference selection move. Without a
    reference a frame would be fitted to itself, which changes nothing.
    """
    if reference is None:
        return df
    step = rigid.Fit(rigid.Reference.of(reference), selection, reference_selection, apply_to=apply_to)
    return rigid.move(df, [step], n_frames)


def align_fitrot(
    df, reference, selection=SYSTEM, reference_selection=SYSTEM, n_frames=None, apply_to="common"
) -> DataFrame:
    """Least-squares rotation about the own centre, which stays where it is."""
    if reference is None:
        return df
    step = rigid.Fit(rigid.Reference.of(reference), selection, reference_selection, True, apply_to)
    return rigid.move(df, [step], n_frames)
