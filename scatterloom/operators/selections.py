"""Named sets of atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "system"  # reserved: all atoms


def _whole(pattern) -> str:
    return f"^(?:{pattern})$"


def sel_index(atoms: DataFrame, ids) -> DataFrame:
    """Atoms by index; ``ids`` is a list or a table with ``atom_id``."""
    if isinstance(ids, DataFrame):
        return atoms.join(ids.select("atom_id"), "atom_id", "left_semi").select("atom_id")
    return atoms.where(F.col("atom_id").isin([int(i) for i in ids])).select("atom_id")


def sel_range(atoms: DataFrame, first: int, last: int) -> DataFrame:
    """Atoms ``first..last``, both included."""
    if last < first:
        raise ValueError(f"range ends before it starts: {first}..{last}")
    return atoms.where(F.col("atom_id").between(first, last)).select("atom_id")


def sel_lexical(atoms: DataFrame, pattern: str, column: str = "label") -> DataFrame:
    """Atoms whose element label matches the whole pattern."""
    return atoms.where(F.col(column).rlike(_whole(pattern))).select("atom_id")


def sel_pdb(atoms: DataFrame, column: str = "beta", pattern: str = r"1|1\.0|1\.00") -> DataFrame:
    """Atoms by the beta or segid column of the structure file, whole match."""
    if column not in ("beta", "segid"):
        raise ValueError("a structure selection works on beta or segid only")
    return atoms.where(F.trim(F.col(column)).rlike(_whole(pattern))).select("atom_id")


class Selections:
    """A registry of selections backed by one relation ``(selection, atom_id)``.

    Names are unique; ``system`` always means all atoms, and a user selection of that
    name is kept as ``system_user``.
    """

    def __init__(self, atoms: DataFrame):
        self.atoms = atoms
        self._sets: dict[str, DataFrame] = {}

    def add(self, name: str, atom_ids: DataFrame) -> "Selections":
        if name == SYSTEM:
            name = f"{SYSTEM}_user"
        if name in self._sets:
            raise ValueError(f"selection defined twice: {name}")
        self._sets[name] = atom_ids.select("atom_id")
        return self

    def add_all(self, selections: DataFrame, names) -> "Selections":
        """Register several selections of a relation ``(selection, atom_id)``."""
        for name in names:
            self.add(name, selections.where(F.col("selection") == name))
        return self

    def rename(self, old: str, new: str) -> "Selections":
        atom_ids = self[old]
        if new in self._sets or new == SYSTEM or old == SYSTEM:
            raise ValueError(f"cannot rename {old} to {new}")
        del self._sets[old]
        self._sets[new] = atom_ids
        return self

    def __contains__(self, name: str) -> bool:
        return name == SYSTEM or name in self._sets

    def __getitem__(self, name: str) -> DataFrame:
        if name == SYSTEM:
            return self.atoms.select("atom_id")
        if name not in self._sets:
            raise KeyError(f"unknown selection: {name}")
        return self._sets[name]

    def names(self) -> list[str]:
        return [SYSTEM, *self._sets]

    def table(self, names=None) -> DataFrame:
        """The relation ``(selection, atom_id)`` of the named selections (default: all)."""
        out = None
        for name in names if names is not None else self.names():
            part = self[name].distinct().select(F.lit(name).alias("selection"), "atom_id")
            out = part if out is None else out.unionByName(part)
        return out


def tag_atoms(atoms: DataFrame, selections: Selections, names) -> DataFrame:
    """``atoms`` with one boolean column per selection, named by :func:`flag`.

    One shuffle by ``atom_id`` serves all selections of a pipeline.
    """
    names = [n for n in dict.fromkeys(names) if n != SYSTEM]
    for n in names:
        selections[n]
    if not names:
        return atoms
    members = selections.table(names).groupBy("atom_id").agg(
        *(F.bool_or(F.col("selection") == n).alias(flag(n)) for n in names)
    )
    return atoms.join(members, "atom_id", "left").na.fill(False, [flag(n) for n in names])


def flag(name: str) -> str:
    return f"in_{name}"


def is_in(name: str) -> Column:
    """Condition "atom is in the selection" on a table made by :func:`tag_atoms`."""
    return F.lit(True) if name == SYSTEM else F.col(flag(name))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Atoms in both selections."""
    return a.select("atom_id").intersect(b.select("atom_id"))


def restrict(coords: DataFrame, selection: DataFrame) -> DataFrame:
    """Coordinates of the selected atoms."""
    return coords.join(selection.select("atom_id"), "atom_id", "left_semi")


def check_frames(coords: DataFrame, atoms: DataFrame) -> DataFrame:
    """Frames whose number of atoms differs from the structure's; empty when all is well."""
    expected = atoms.agg(F.count("*").alias("n")).scalar()
    return (
        coords.groupBy("frame")
        .agg(F.count("*").alias("n_atoms"))
        .withColumn("expected", expected)
        .where(F.col("n_atoms") != F.col("expected"))
    )
