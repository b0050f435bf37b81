"""Preparing coordinates: alignments, motions, alignments again, reduction, representation."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from scatterloom.operators import align, rigid
from scatterloom.operators.selections import SYSTEM, Selections, is_in, tag_atoms

Step = rigid.Step | Callable[[DataFrame], DataFrame]


def prepare_coordinates(
    coords: DataFrame,
    atoms: DataFrame,
    selections: Selections,
    *,
    pre: Sequence[Step] = (),
    motions: Sequence[Step] = (),
    post: Sequence[Step] = (),
    uses: Sequence[str] = (),
    target: str = SYSTEM,
    representation: str = "cartesian",
    axis=(0.0, 0.0, 1.0),
    n_frames: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Apply the steps in the fixed order pre-alignments, motions, post-alignments; then
    reduce to ``target`` and convert.

    Steps of `rigid` that follow one another are composed, so all of them together read the coordinates twice; ``n_frames`` and
    ``buckets`` are those of `rigid.move`. A step may also be a function of tagged coordinates, for instance
    ``lambda df: align.align_center(df, "protein", "core")``; ``uses`` names every
    selection the steps refer to. Where that does not include the whole system, atoms in
    none of the selections are dropped before the first step.
    """
    steps = [*pre, *motions, *post]
    needed = list(dict.fromkeys([*uses, target]))
    tags = tag_atoms(atoms, selections, needed)
    if SYSTEM not in needed and (uses or not steps):
        wanted = is_in(needed[0])
        for name in needed[1:]:
            wanted = wanted | is_in(name)
        tags = tags.where(wanted)
    df = align.tagged(coords, tags)
    for composed, run in itertools.groupby(steps, lambda s: isinstance(s, rigid.Step)):
        if composed:
            df = rigid.move(df, list(run), n_frames, buckets)
        else:
            for step in run:
                df = step(df)
    df = df.where(is_in(target)) if target != SYSTEM else df
    keep = ["frame", "atom_id", "x", "y", "z"] + [c for c in ("species", "label") if c in df.columns]
    return align.with_representation(df.select(*keep), representation, axis)

