"""Chains of alignments and motions as one map per frame and cell of atoms.

Every alignment and every motion moves the atoms of a selection, in one frame, by one affine map (a row vector times a
matrix, plus a shift). All that it asks about the frame are sums which such maps carry along: of mass, of mass times
position, and of reference position times mass times position. So the sums are gathered once, for each *cell* (the atoms
that are in the same selections), the steps are composed on them, and the coordinates are moved by the composed map:
a chain of any length reads the trajectory twice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scatterloom.functions import vec
from scatterloom.operators.params import PART_ROWS, local_table, localize, on_driver
from scatterloom.operators.selections import SYSTEM, is_in
from scatterloom.operators.staging import cluster_by_frame
from scatterloom.scratch import write_and_reread

MATRIX = [f"r{i}{j}" for i in range(3) for j in range(3)]
SHIFT = ["tx", "ty", "tz"]
MAP = [*MATRIX, *SHIFT]


def shipped(params: DataFrame) -> DataFrame:
    """A table whose size has been checked is broadcast; a larger one is joined as the optimizer likes."""
    return params if on_driver(params) is None else F.broadcast(params)


def join_per_frame(df: DataFrame, per_frame: DataFrame, n_frames: int | None = None, buckets: int | None = None) -> DataFrame:
    """Join with a table of one row per frame, which is evaluated here.

    Up to ``PART_ROWS`` frames it is broadcast, after a look at its size; a larger one is written to
    the scratch folder and joined as the optimizer likes, which splits a frame with too many rows. Where ``df`` comes in
    ``buckets`` by frame (`staging.cluster_by_frame`), the larger one is written in the same buckets, and neither side is shuffled.
    """
    if n_frames is None or n_frames > PART_ROWS:
        per_frame = cluster_by_frame(per_frame, buckets) if buckets else write_and_reread(per_frame, "per-frame")
    return df.join(shipped(localize(per_frame)), "frame", "left")


def best_rotations(k: np.ndarray) -> np.ndarray:
    """Proper rotations R that make R v closest to u, for stacked K = sum u v^T."""
    left, _, right = np.linalg.svd(k)
    sign = np.sign(np.linalg.det(left @ right))
    left[:, :, 2] *= sign[:, None]
    return left @ right


# -- what the steps ask about frames -------------------------------------------------------


class Moments:
    """Sums of some frames, by frame and cell, and what they become as cells are moved."""

    def __init__(self, cells: np.ndarray, names: Sequence[str], sums: dict[str, np.ndarray], references: int):
        self.cells, self.names, self.sums, self.references = cells, list(names), sums, references
        shape = sums["n"].shape
        self.matrix = np.broadcast_to(np.eye(3), (*shape, 3, 3)).copy()
        self.shift = np.zeros((*shape, 3))

    def members(self, selection: str) -> np.ndarray:
        """Which cells belong to a selection."""
        if selection == SYSTEM:
            return np.ones(len(self.cells), bool)
        return self.cells >> self.names.index(selection) & 1 == 1

    def centre(self, selection: str) -> np.ndarray:
        """The weighted centre in each frame; an empty selection has its centre at the origin."""
        of = self.members(selection)
        n, mass, first = (self.sums[k][:, of].sum(1) for k in ("n", "m", "x"))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n[:, None] > 0, first / mass[:, None], 0.0)

    def move(self, cells: np.ndarray, matrix: np.ndarray | None, shift: np.ndarray, hit: np.ndarray | None = None) -> None:
        """Move the atoms of ``cells`` by ``matrix`` and ``shift`` of each frame, in the frames of ``hit`` only if that is given."""
        if matrix is None:
            matrix = np.broadcast_to(np.eye(3), (len(shift), 3, 3))
        if hit is not None:
            matrix = np.where(hit[:, None, None], matrix, np.eye(3))
            shift = np.where(hit[:, None], shift, 0.0)
        m, s = matrix[:, None], shift[:, None]
        rows = lambda v: (v[:, cells][..., None, :] @ m)[..., 0, :]
        self.matrix[:, cells] = self.matrix[:, cells] @ m
        self.shift[:, cells] = rows(self.shift) + s
        weights = [("m", "x")] + [(f"m{i}", f"x{i}") for i in range(self.references)]
        for mass, first in weights:
            self.sums[first][:, cells] = rows(self.sums[first]) + self.sums[mass][:, cells, None] * s
        for i in range(self.references):
            k, u = self.sums[f"k{i}"], self.sums[f"u{i}"]
            k[:, cells] = k[:, cells] @ m + u[:, cells, :, None] * s[..., None, :]


@dataclass(frozen=True, eq=False)
class Reference:
    """Coordinates to fit on to: ``atom_id, ux, uy, uz, mass`` (`align.reference_coords`), with their number and centre."""

    coords: DataFrame
    n: int
    centre: tuple[float, float, float]

    @classmethod
    def of(cls, coords: "DataFrame | Reference") -> "Reference":
        if isinstance(coords, Reference):
            return coords
        m = F.col("mass")
        row = coords.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(m * F.col(f"u{c}")) / F.sum(m), F.lit(0.0)).alias(c) for c in "xyz")).first()
        return cls(coords, row["n"], (row["x"], row["y"], row["z"]))


class Step:
    """One step of a chain; ``selection`` names the atoms that move."""

    selection: str = SYSTEM
    reference: Reference | None = None

    def uses(self) -> list[str]:
        """The selections whose membership matters."""
        return [self.selection]

    def per_frame(self) -> DataFrame | dict[str, Column]:
        """Numbers given for each frame: a table with ``frame``, or columns that are functions of ``frame``."""
        return {}

    def take(self, state: Moments, given: dict[str, np.ndarray], reference: int | None) -> None:
        raise NotImplementedError


@dataclass(frozen=True, eq=False)
class Centre(Step):
    """Move ``selection`` so that the current centre of the reference selection is the origin."""

    selection: str = SYSTEM
    reference_selection: str = SYSTEM

    def uses(self):
        return [self.selection, self.reference_selection]

    def take(self, state, given, reference):
        state.move(state.members(self.selection), None, -state.centre(self.reference_selection))


@dataclass(frozen=True, eq=False)
class Onto(Step):
    """Move ``selection`` so that its centre is the centre of the reference, or of the whole current frame."""

    target: Reference | None = None
    selection: str = SYSTEM

    def take(self, state, given, reference):
        to = state.centre(SYSTEM) if self.target is None else np.array(self.target.centre)
        state.move(state.members(self.selection), None, to - state.centre(self.selection))


@dataclass(frozen=True, eq=False)
class Fit(Step):
    """Least-squares rotation on to the reference, with the translation or (``keep_centre``) about the own centre.

    ``apply_to='common'`` moves atoms in both selections, ``'selection'`` all of ``selection``. A frame without atoms of the
    reference stays; one with some of them raises.
    """

    reference: Reference
    selection: str = SYSTEM
    reference_selection: str = SYSTEM
    keep_centre: bool = False
    apply_to: str = "common"

    def __post_init__(self):
        if self.apply_to not in ("common", "selection"):
            raise ValueError("apply_to is 'common' or 'selection'")

    def uses(self):
        return [self.selection, self.reference_selection]

    def take(self, state, given, reference):
        n, mass, first, k = (state.sums[f"{c}{reference}"].sum(1) for c in "nmxk")
        if ((n > 0) & (n != self.reference.n)).any():
            raise ValueError("fit needs the same atoms in the frame and in the reference")
        hit = n > 0
        with np.errstate(invalid="ignore", divide="ignore"):
            centre = np.where(hit[:, None], first / mass[:, None], 0.0)
        turn = best_rotations(k).transpose(0, 2, 1)
        target = centre if self.keep_centre else np.array(self.reference.centre)
        cells = state.members(self.selection)
        if self.apply_to == "common":
            cells = cells & state.members(self.reference_selection)
        state.move(cells, turn, target - (centre[:, None] @ turn)[:, 0], hit)


@dataclass(frozen=True, eq=False)
class Shift(Step):
    """Move ``selection`` by a vector of each frame: columns that are functions of ``frame``, or a table ``frame, tx, ty, tz``."""

    shift: vec.Vec | DataFrame
    selection: str = SYSTEM

    def per_frame(self):
        if isinstance(self.shift, DataFrame):
            return self.shift.select("frame", *SHIFT)
        return dict(zip(SHIFT, self.shift))

    def take(self, state, given, reference):
        by = np.stack([given[c] for c in SHIFT], 1)
        state.move(state.members(self.selection), None, np.where(np.isnan(by), 0.0, by))


@dataclass(frozen=True, eq=False)
class Turn(Step):
    """Turn ``selection`` by the matrices ``frame, r00..r22`` about a fixed centre, or the current one of the reference selection."""

    rotations: DataFrame
    selection: str = SYSTEM
    about: Reference | None = None
    reference_selection: str = SYSTEM

    def uses(self):
        return [self.selection, self.reference_selection]

    def per_frame(self):
        return self.rotations.select("frame", *MATRIX)

    def take(self, state, given, reference):
        turn = np.stack([given[c] for c in MATRIX], 1).reshape(-1, 3, 3)
        hit = ~np.isnan(turn[:, 0, 0])
        centre = state.centre(self.reference_selection) if self.about is None else np.broadcast_to(np.array(self.about.centre), (len(turn), 3))
        state.move(state.members(self.selection), turn, centre - (centre[:, None] @ turn)[:, 0], hit)


# -- evaluation ------------------------------------------------------------------------------


def _gathered(df: DataFrame, cell: Column, references: Sequence[Reference]) -> DataFrame:
    """One aggregate over the coordinates: ``frame, cell`` and the sums of `Moments`, flat."""
    m, x = F.col("mass").cast("double"), {c: F.col(c) for c in "xyz"}
    sums = {"n": F.count("*"), "m": F.sum(m)} | {f"x_{c}": F.sum(m * x[c]) for c in "xyz"}
    for i, ref in enumerate(references):
        u = [(F.col(f"u{c}") - F.lit(at)).alias(f"u{i}{c}") for c, at in zip("xyz", ref.centre)]
        df = df.join(shipped_like(ref.coords, ref.coords.select("atom_id", *u)), "atom_id", "left")
        has, w = F.col(f"u{i}x").isNotNull(), {a: m * F.col(f"u{i}{a}") for a in "xyz"}
        sums |= {f"n{i}": F.count(F.when(has, 1)), f"m{i}": F.sum(F.when(has, m))}
        sums |= {f"x{i}_{c}": F.sum(F.when(has, m * x[c])) for c in "xyz"}
        sums |= {f"u{i}_{a}": F.sum(w[a]) for a in "xyz"}
        sums |= {f"k{i}_{a}{c}": F.sum(w[a] * x[c]) for a in "xyz" for c in "xyz"}
    return df.groupBy("frame", cell.alias("cell")).agg(*(e.alias(n) for n, e in sums.items()))


def shipped_like(checked: DataFrame, made: DataFrame) -> DataFrame:
    """``made``, which is as large as ``checked``, broadcast where the size of that has been checked."""
    return made if on_driver(checked) is None else F.broadcast(made)


def _dense(long: pa.Table, cells: np.ndarray, references: int) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Frames, their sums by frame and cell, and the first row's other columns of each frame, from a row per frame and cell."""
    column = lambda c: long.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy()
    frames, first, at = np.unique(long.column("frame").to_numpy(), return_index=True, return_inverse=True)
    cell = np.searchsorted(cells, long.column("cell").to_numpy())

    def spread(names: list[str], shape: tuple = ()) -> np.ndarray:
        out = np.zeros((len(frames), len(cells), len(names)))
        out[at, cell] = np.nan_to_num(np.stack([column(n) for n in names], 1), nan=0.0, posinf=np.inf, neginf=-np.inf)
        return out.reshape(*out.shape[:2], *shape)

    sums = {}
    for tag in ["", *map(str, range(references))]:
        sums |= {f"n{tag}": spread([f"n{tag}"]), f"m{tag}": spread([f"m{tag}"]), f"x{tag}": spread([f"x{tag}_{c}" for c in "xyz"], (3,))}
        if tag:
            sums |= {f"u{tag}": spread([f"u{tag}_{c}" for c in "xyz"], (3,)), f"k{tag}": spread([f"k{tag}_{a}{c}" for a in "xyz" for c in "xyz"], (3, 3))}
    return frames, sums, {c: column(c)[first] for c in long.column_names if c.startswith("s")}


def _composed(long: pa.Table, cells: np.ndarray, names: Sequence[str], steps: Sequence[Step], places: Sequence[int | None], n_refs: int) -> pa.RecordBatch:
    """``frame`` and ``maps``, the twelve numbers of each cell's composed map one after the other."""
    frames, sums, given = _dense(long, cells, n_refs)
    state = Moments(cells, names, sums, n_refs)
    for i, (step, ref) in enumerate(zip(steps, places)):
        step.take(state, {c[len(f"s{i}_") :]: v for c, v in given.items() if c.startswith(f"s{i}_")}, ref)
    flat = np.concatenate([state.matrix.reshape(*state.shift.shape[:2], 9), state.shift], 2)
    width = flat.shape[1] * 12
    offsets = pa.array(np.arange(len(frames) + 1) * width, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(frames, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))], ["frame", "maps"])


def _portable(steps: Sequence[Step]) -> list[Step]:
    """Steps as tasks get them: what a frame is given comes as columns by then, so tables stay behind."""
    out = []
    for s in steps:
        kept = object.__new__(type(s))
        for k, v in vars(s).items():
            bare = Reference(None, v.n, v.centre) if isinstance(v, Reference) else None if isinstance(v, (DataFrame, vec.Vec)) else v
            object.__setattr__(kept, k, bare)
        out.append(kept)
    return out


def composed_maps(df: DataFrame, steps: Sequence[Step], cell: Column, names: Sequence[str], n_frames: int | None = None) -> tuple[DataFrame, list[int]]:
    """``frame, maps`` of a chain, and the cells that ``maps`` holds twelve numbers of in this order.

    The sums are gathered here, in one read of ``df``. Up to ``PART_ROWS`` of them are composed on the driver; more stay a
    table, in the scratch folder, and are composed by tasks.
    """
    numbered: list[Reference] = []
    places: list[int | None] = []
    for s in steps:
        if isinstance(s.reference, Reference) and s.reference not in numbered:
            numbered.append(s.reference)
        places.append(numbered.index(s.reference) if s.reference is not None else None)
    sums = _gathered(df, cell, numbered)
    for i, s in enumerate(steps):
        told = s.per_frame()
        if isinstance(told, DataFrame):
            told = told.select("frame", *(F.col(c).alias(f"s{i}_{c}") for c in told.columns if c != "frame"))
            sums = sums.join(told, "frame", "left")
        else:
            sums = sums.withColumns({f"s{i}_{c}": e.cast("double") for c, e in told.items()})
    if n_frames is None or n_frames > PART_ROWS:
        sums = write_and_reread(sums, "moments")
    sums = localize(sums)
    steps = _portable(steps)
    spark, found = df.sparkSession, on_driver(sums)
    if found is not None:
        cells = np.unique(found.column("cell").to_numpy())
        made = _composed(found, cells, names, steps, places, len(numbered))
        return local_table(spark, list(zip(made.column(0).to_pylist(), made.column(1).to_pylist())), "frame bigint, maps array<double>"), cells.tolist()
    cells = np.sort(np.array([r["cell"] for r in sums.select("cell").distinct().collect()], np.int64))
    columns = [c for c in sums.columns if c != "frame"]
    whole = sums.groupBy("frame").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    n_refs = len(numbered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            rows = lists.flatten()
            frame = np.repeat(b.column(0).to_numpy(), lists.value_lengths().to_numpy())
            long = pa.table([pa.array(frame), *(rows.field(c) for c in columns)], names=["frame", *columns])
            yield _composed(long, cells, names, steps, places, n_refs)

    return whole.mapInArrow(run, "frame bigint, maps array<double>"), cells.tolist()


def move(df: DataFrame, steps: Sequence[Step], n_frames: int | None = None, buckets: int | None = None) -> DataFrame:
    """Tagged coordinates after a chain of steps.

    ``df`` is read once here, for the sums, and once by whoever reads the result, however long the chain is. The maps are
    joined by frame alone, see `join_per_frame`.
    """
    if not steps:
        return df
    names = [n for n in dict.fromkeys(n for s in steps for n in s.uses()) if n != SYSTEM]
    cell = sum((F.when(is_in(n), F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(names)), start=F.lit(0)).cast("bigint")
    maps, cells = composed_maps(df, steps, cell, names, n_frames)
    joined = join_per_frame(df, maps, n_frames, buckets)
    at = F.lit(0)
    if len(cells) > 1:
        at = (F.array_position(F.array(*map(F.lit, cells)), cell).cast("int") - 1) * 12
    number = lambda k: F.get("maps", at + F.lit(k))
    v = vec.columns()
    moved = {c: v.x * number(j) + v.y * number(3 + j) + v.z * number(6 + j) + number(9 + j) for j, c in enumerate("xyz")}
    return joined.withColumns(moved).select(*df.columns)
