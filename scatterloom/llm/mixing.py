"""Interleaving sources at target weights: Pfair windows, earliest deadline first. DataFrame functions only."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

#: Characters of a block, and shares that are dealt out among the sources, more if the smallest one gets fewer than LEAST of them, up to MAX_PERIOD.
BLOCK_CHARS, PERIOD = 50_000, 1024
LEAST, MAX_PERIOD = 16, 1 << 20
#: Sources at most: their shares and the slots of a period pass through the driver.
MAX_SOURCES = 1 << 14
#: Leading hexadecimal digits of an id's hash that make a bucket: a source has 16^DIGITS, so no task numbers more than a small part of it.
DIGITS = 3


def source_of(df: DataFrame, source_col: str) -> Column:
    """The source as text; null and empty are one source."""
    return F.coalesce(df[source_col].cast("string"), F.lit(""))


def shares_by_size(df: DataFrame, source_col: str = "source", text_col: str = "text", power: float = 0.5, period: int = PERIOD) -> dict[str, int]:
    """Whole shares, 1 at least, in proportion to each source's characters to the power of ``power``; about ``period`` in all.

    The period is doubled until the smallest source has LEAST shares or it is MAX_PERIOD, so rounding moves a weight by a part in 2 LEAST at most. Sources of a
    smaller weight than one in MAX_PERIOD have a share of it nevertheless.
    """
    sizes = df.groupBy(source_of(df, source_col).alias("source")).agg(F.sum(F.length(whole_text(df, text_col))).alias("size"))
    rows = sizes.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: give each a share, or join small ones")
    weights = {r["source"]: float(max(1, r["size"])) ** power for r in rows}
    total = sum(weights[s] for s in sorted(weights))
    while weights and period * min(weights.values()) / total < LEAST and 2 * period <= MAX_PERIOD:
        period *= 2
    return {s: max(1, int(period * weights[s] / total + 0.5)) for s in sorted(weights)}


def period_slots(shares: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of the blocks of one period, which has a slot for each share.

    With D slots and c shares, block j may run from slot floor(j D / c) on and must have run before slot ceil((j + 1) D / c). Every slot goes
    to the released block with the earliest deadline, of equal ones to the first source by name. All deadlines are met, and a source is never a
    block or more ahead of its share or behind it. The next period is the same again.
    """
    slots = sum(shares.values())
    # waiting: (release, source, block); ready: (deadline, source, block, release)
    waiting = [(0, s, 0) for s in sorted(shares)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * slots // shares[s]), s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        out.append((s, j, t, release, deadline))
        if j + 1 < shares[s]:
            heapq.heappush(waiting, ((j + 1) * slots // shares[s], s, j + 1))
    return out


def mix(df: DataFrame, shares: dict[str, int], block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``df`` with ``mix_block, mix_slot, mix_release, mix_deadline`` and ``mix_start`` (bigint), which replace columns of these names; (mix_slot, mix_start) is the mixed order.

    The rows of a source are put in the order of a hash of their id (of equal ids, by text) and cut into blocks of ``block_chars`` characters: a row is
    in the block in which it starts, ``mix_start`` is the number of characters of its source before it. Blocks get slots, see `period_slots`. ``shares`` gives each source whole shares of 1 or more; a source
    that it doesn't name raises. All rows stay: when a source has run out its slots are left empty. Null and empty sources are one source,
    named by an empty text; null texts are empty and take no room; a null id has an order of its own, the first. Columns that begin with ``__`` are the operator's own.

    Places are sums in two steps: totals of the buckets of a source, and sums within a bucket, so a source of any size is numbered by many tasks.
    """
    spark = df.sparkSession
    if any(c < 1 or c != int(c) for c in shares.values()):
        raise ValueError("shares must be whole numbers of 1 or more")
    hashed = F.coalesce(F.md5(df[id_col].cast("string").cast("binary")), F.lit("0" * 32))
    made = ["mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_start"]
    rows = df.withColumns({"__source": source_of(df, source_col), "__hash": hashed, "__chars": F.length(whole_text(df, text_col)).cast("bigint")}).drop(*made)
    rows = rows.withColumn("__bucket", F.substring("__hash", 1, DIGITS))
    sizes = rows.groupBy("__source", "__bucket").agg(F.sum("__chars").alias("__size"))
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__source", "__bucket", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__source", "__bucket").orderBy("__hash", F.asc_nulls_first(id_col), F.asc_nulls_first(text_col)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum("__chars").over(inside), F.lit(0)))
    rows = rows.join(offsets, ["__source", "__bucket"]).withColumn("mix_start", F.col("__offset") + F.col("__inside"))
    rows = rows.withColumn("mix_block", F.floor(F.col("mix_start") / block_chars).cast("bigint"))
    # the slots of a period: a constant of the plan, bounded by the shares
    period = sum(shares.values())
    table = spark.createDataFrame(period_slots(shares), "__name string, __turn bigint, __slot bigint, __release bigint, __deadline bigint")
    counts = spark.createDataFrame(list(shares.items()), "__named string, __shares bigint")
    rows = rows.join(F.broadcast(counts), F.col("__source") == F.col("__named"), "left")
    unnamed = F.raise_error(F.concat(F.lit("no share for source "), "__source")).cast("bigint")
    rows = rows.withColumn("__shares", F.coalesce("__shares", unnamed)).withColumn("__round", F.floor(F.col("mix_block") / F.col("__shares")) * F.lit(period))
    rows = rows.join(F.broadcast(table), (F.col("__source") == F.col("__name")) & (F.col("mix_block") % F.col("__shares") == F.col("__turn")), "left")
    rows = rows.withColumns({f"mix_{c}": F.col("__round") + F.col(f"__{c}") for c in ("slot", "release", "deadline")})
    own = ["__source", "__hash", "__chars", "__bucket", "__offset", "__inside", "__named", "__shares", "__round", "__name", "__turn", "__slot", "__release", "__deadline"]
    return rows.drop(*own)


def in_mixed_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of `mix` dealt into files and sorted in the mixed order, which written files keep."""
    order = ["mix_slot", "mix_start", id_col]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)
