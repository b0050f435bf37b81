"""Running totals over a dense integer order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
PLACES = 1 << 32  # positions of an order whose length nobody knows


def within(df: DataFrame, order: str, n: int) -> DataFrame:
    """The same rows; a position that isn't one of 0..n-1 raises when it is read."""
    told = F.concat(F.lit("position "), F.col(order).cast("string"), F.lit(f" in an order of {n}"))
    sound = (F.col(order) >= 0) & (F.col(order) < n)
    return df.withColumn(order, F.when(sound, F.col(order)).otherwise(F.raise_error(told).cast(df.schema[order].dataType)))


def running_total(
    df: DataFrame, order: str, values: list[str], keys: list[str] = (), block: int = BLOCK, n: int | None = None
) -> DataFrame:
    """Inclusive running sum of each column in ``values`` along ``order``, whole numbers from 0 to ``n`` - 1.

    A tree of blocks: sums inside blocks of ``block`` consecutive positions, and the totals of the blocks summed up in the
    same way, level by level, until one block holds a level. So no task takes more than ``block`` rows of a key. Where the
    caller doesn't name ``n`` (``PLACES`` will do for anything), it is looked up here.
    """
    if n is None:
        n = (df.agg(F.max(order)).first()[0] or 0) + 1
    return _level(within(df, order, n), order, list(values), list(keys), max(2, block), n, Window.currentRow)


def _level(df: DataFrame, order: str, values: list[str], keys: list[str], block: int, n: int, last: int) -> DataFrame:
    """Sums from the first position to the ``last`` one, counted from the own."""
    rows = df.withColumn("__block", F.expr(f"`{order}` div {int(block)}"))
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, last)
    summed = rows.withColumns({v: F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    if n <= block:
        return summed.select(*df.columns)
    totals = rows.groupBy(*keys, F.col("__block").alias("__place")).agg(*(F.sum(v).alias(v) for v in values))
    before = _level(totals, "__place", values, keys, block, -(-n // block), -1)
    before = before.select(*keys, F.col("__place").alias("__block"), *(F.col(v).alias(f"__{v}") for v in values))
    return summed.join(before, [*keys, "__block"]).select(
        *(
            (F.col(c) + F.col(f"__{c}")).alias(c) if c in values else F.col(c)
            for c in df.columns
        )
    )
