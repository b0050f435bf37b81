"""Choosing, joining and repeating frames, and the two storage layouts.

All of these work on any table with a ``frame`` column: coordinates, frame blocks,
or the frame index of trajectory files (so that dropped frames are never read).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ATOMS = 1 << 16
RANGE_BLOCK = 1 << 16


def _count_of(df: DataFrame) -> Column:
    return df.agg(F.coalesce(F.max("frame") + 1, F.lit(0)).alias("n")).scalar()


def explode_range(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """A row with ``name`` (bigint) for each whole number from ``first`` to ``last``, none if there is none; no row holds a long array."""
    lo, hi = first.cast("bigint"), last.cast("bigint")
    blocks = df.where(lo <= hi).withColumn("__lo", F.explode(F.sequence(lo, hi, F.lit(RANGE_BLOCK).cast("bigint"))))
    upto = F.least(F.col("__lo") + (RANGE_BLOCK - 1), hi)
    return blocks.withColumn(name, F.explode(F.sequence(F.col("__lo"), upto))).drop("__lo")


def trim_frames(df: DataFrame, first: int = 0, last: int | None = None, stride: int = 1) -> DataFrame:
    """Keep frames ``first..last`` (both included) whose number is a multiple of ``stride``.

    The multiple is of the original number, not of the distance from ``first``. Kept
    frames are renumbered from 0.
    """
    if stride < 1 or first < 0:
        raise ValueError("stride must be at least 1 and first at least 0")
    keep = F.col("frame") >= first
    if last is not None:
        keep = keep & (F.col("frame") <= last)
    if stride > 1:
        keep = keep & (F.col("frame") % stride == 0)
    start = -(-first // stride)
    number = F.expr(f"frame div {int(stride)}") - start
    return df.where(keep).withColumn("frame", number)


def concat_framesets(framesets: list[DataFrame], counts: list[int] | None = None) -> DataFrame:
    """One trajectory after another; frame numbers continue.

    ``counts`` gives the frames in each set where the caller knows them; otherwise
    they are looked up by the same query.
    """
    if not framesets:
        raise ValueError("no framesets given")
    out, offset = framesets[0], None
    for i, df in enumerate(framesets[1:]):
        size = F.lit(counts[i]) if counts else _count_of(framesets[i])
        offset = size if offset is None else offset + size
        out = out.unionByName(df.withColumn("frame", (F.col("frame") + offset).cast("bigint")))
    return out


def clone_frames(df: DataFrame, copies: int, n_frames: int | None = None) -> DataFrame:
    """The whole trajectory ``copies`` times in a row; 0 copies give no frames."""
    if copies < 0:
        raise ValueError("copies must not be negative")
    if copies == 0:
        return df.where(F.lit(False))
    size = F.lit(n_frames) if n_frames is not None else _count_of(df)
    numbered = df.withColumn("__size", size).withColumn(
        "__copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    )
    return numbered.withColumn(
        "frame", (F.col("frame") + F.col("__copy") * F.col("__size")).cast("bigint")
    ).drop("__copy", "__size")


def locate_frames(df: DataFrame, framesets: DataFrame) -> DataFrame:
    """Add ``frameset`` and ``local_frame`` from ``framesets(frameset, offset, n)``.

    A range lookup by blocks of as many frames as a set has on average: a set has a row for each block that it reaches into, about two in
    all, a frame meets the sets of its block, and those that hold it are kept.
    """
    held = framesets.where("n > 0")
    sets, total = held.agg(F.count("*"), F.sum("n")).first()
    block = max(1, (total or 0) // max(1, sets))
    ends = (F.expr(f"offset div {block}"), F.expr(f"(offset + n - 1) div {block}"))
    reach = explode_range(held, *ends, "__block").select(
        "__block", "frameset", F.col("offset").cast("bigint").alias("__first"), F.col("n").alias("__n")
    )
    met = df.withColumn("__block", F.expr(f"frame div {block}")).join(reach, "__block")
    local = (F.col("frame") - F.col("__first")).cast("bigint")
    rest = [c for c in df.columns if c != "frame"]
    return met.where((local >= 0) & (local < F.col("__n"))).select("frame", *rest, "frameset", local.alias("local_frame"))


def keep_frames(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Frames listed in ``chosen(position, frame)``, renumbered by position; repeats repeat."""
    return (
        df.join(chosen.select("position", "frame"), "frame")
        .withColumn("frame", F.col("position").cast("bigint"))
        .drop("position")
    )


def pack_blocks(coords: DataFrame, block_atoms: int = BLOCK_ATOMS) -> DataFrame:
    """``coords`` as frame blocks: arrays of at most ``block_atoms`` consecutive atoms."""
    first = (F.floor(F.col("atom_id") / block_atoms) * block_atoms).cast("bigint")
    atom = F.struct("atom_id", *(F.col(c).cast("float").alias(c) for c in "xyz"))
    packed = coords.groupBy("frame", first.alias("first_atom")).agg(
        F.array_sort(F.collect_list(atom)).alias("a")
    )
    return packed.select("frame", "first_atom", *(F.col(f"a.{c}").alias(c) for c in "xyz"))


def explode_blocks(blocks: DataFrame) -> DataFrame:
    """Frame blocks as one row per atom."""
    rows = blocks.select(
        "frame", "first_atom", F.posexplode(F.arrays_zip("x", "y", "z")).alias("pos", "c")
    )
    return rows.select(
        "frame",
        (F.col("first_atom") + F.col("pos")).alias("atom_id"),
        *(F.col(f"c.{c}").cast("double").alias(c) for c in "xyz"),
    )
