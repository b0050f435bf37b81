"""Layouts of a trajectory in the cluster and on disk."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterloom.operators.params import local_table
from scatterloom.scratch import scratch_path

FRAMES_PER_FOLDER = 10_000
ATOMS_PER_FOLDER = 10_000
SERIES_BLOCK = 1 << 16


SHARES = 4  # parts that a task's fair share of rows is cut into


def spread_frames(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of a frame together in one task, but those of a very large frame dealt out evenly.

    For work that adds up per frame and can add up its parts later. A frame counts as
    very large when it holds more than a quarter of a task's share of all rows; there are
    fewer than four times as many of those as tasks, so they can be broadcast. It is dealt out
    in parts of about that quarter, so all of them together have at most eight times as many parts as tasks.
    """
    n = partitions or _tasks(df)
    large = _large_frames(df, n)
    if large is None:
        return df.repartition(n, "frame")
    return _deal(df.join(F.broadcast(large), "frame", "left"), n).select(*df.columns)


def split_frames(df: DataFrame, partitions: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of `spread_frames` in two tables: frames that are whole in their task, and very large ones, if there are any.

    What is added up per frame is final for the first table as it leaves the task; only that of the second is still in parts.
    """
    n = partitions or _tasks(df)
    large = _large_frames(df, n)
    if large is None:
        return df.repartition(n, "frame"), None
    whole = df.join(F.broadcast(large), "frame", "left_anti").repartition(n, "frame")
    return whole.select(*df.columns), _deal(df.join(F.broadcast(large), "frame"), n).select(*df.columns)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _large_frames(df: DataFrame, n: int) -> DataFrame | None:
    """``frame, __parts``: the very large frames for ``n`` tasks, and how many quarters of a task's share each one makes."""
    most = SHARES * n
    largest = df.groupBy("frame").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "frame").limit(most).collect()
    total = df.count() if largest else 0
    large = [(r["frame"], -(-r["rows"] * most // total)) for r in largest if r["rows"] * most > total]
    if not large:
        return None
    return local_table(df.sparkSession, large, f"frame {df.schema['frame'].dataType.simpleString()}, __parts bigint")


def _deal(marked: DataFrame, n: int) -> DataFrame:
    """Rows of frames with ``__parts`` dealt out in as many parts, other frames whole."""
    # numbered in order of the rows themselves: a task that is repeated on rows in another order deals them out as before
    salt = F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__parts")))
    marked = marked.sortWithinPartitions("__parts", *(c for c in marked.columns if c != "__parts"))
    return marked.withColumn("__salt", salt).repartition(n, "frame", "__salt")


def cluster_by_frame(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` written in ``buckets`` by frame, as a table of the session in the scratch folder.

    What is joined or grouped by frame afterwards stays where it lies: two tables in the same number of buckets are joined without a
    shuffle. A bucket takes whole frames, so this is for trajectories whose frames are of like size, as those of one system are.
    """
    spark = df.sparkSession
    name = f"scatterloom_by_frame_{uuid.uuid4().hex}"
    whole = df.withColumn("frame", F.col("frame").cast("bigint"))
    writer = whole.repartition(buckets, "frame").write.bucketBy(buckets, "frame").sortBy("frame")
    writer.option("path", scratch_path(spark, "by-frame")).saveAsTable(name)
    return spark.table(name)


def stage_frames(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Contiguous frame ranges per task, sorted."""
    args = ["frame", "atom_id"] if "atom_id" in df.columns else ["frame"]
    spread = df.repartitionByRange(partitions, *args) if partitions else df.repartitionByRange(*args)
    return spread.sortWithinPartitions(*args)


def stage_atoms(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """All frames of an atom in one task, in time order."""
    spread = df.repartition(partitions, "atom_id") if partitions else df.repartition("atom_id")
    return spread.sortWithinPartitions("atom_id", "frame")


def atom_series(df: DataFrame, block: int = SERIES_BLOCK) -> DataFrame:
    """Time series of each atom as arrays of at most ``block`` consecutive frames."""
    first = (F.expr(f"frame div {int(block)}") * block).alias("first_frame")
    packed = df.groupBy("atom_id", first).agg(
        F.array_sort(F.collect_list(F.struct("frame", "x", "y", "z"))).alias("s")
    )
    return packed.select(
        "atom_id", "first_frame", *(F.col(f"s.{c}").alias(c) for c in ("frame", "x", "y", "z"))
    )


def dump_coordinates(df: DataFrame, path: str, mode: str = "frame", partitions: int | None = None) -> None:
    """Write coordinates as Parquet in frame or in atom order."""
    if mode == "frame":
        keys, size = ["frame", "atom_id"], FRAMES_PER_FOLDER
    elif mode == "atom":
        keys, size = ["atom_id", "frame"], ATOMS_PER_FOLDER
    else:
        raise ValueError("mode is 'frame' or 'atom'")
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    bucket = f"{keys[0]}_block"
    blocked = spread.withColumn(bucket, F.expr(f"{keys[0]} div {size}"))
    blocked.sortWithinPartitions(bucket, *keys).write.partitionBy(bucket).parquet(path)


def read_dump(spark, path: str) -> DataFrame:
    """Coordinates written by :func:`dump_coordinates`."""
    df = spark.read.parquet(path)
    return df.drop("frame_block", "atom_id_block")


def xyz_lines(df: DataFrame) -> DataFrame:
    """``(frame, ord, value)``: the lines of an XYZ text dump, two headers per frame."""
    heads = df.groupBy("frame").agg(F.count("*").alias("n"))
    heads = heads.select(
        "frame",
        F.inline(
            F.array(
                F.struct(F.lit(-2).cast("bigint").alias("ord"), F.col("n").cast("string").alias("value")),
                F.struct(
                    F.lit(-1).cast("bigint").alias("ord"), F.concat(F.lit("frame "), "frame").alias("value")
                ),
            )
        ),
    )
    body = df.select(
        "frame", F.col("atom_id").alias("ord"), F.concat_ws(" ", "atom_id", "x", "y", "z").alias("value")
    )
    return heads.unionByName(body)


def write_xyz(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Text dump; the part files in name order hold the frames in order."""
    lines = xyz_lines(df)
    keys = ["frame", "ord"]
    spread = lines.repartitionByRange(partitions, *keys) if partitions else lines.repartitionByRange(*keys)
    spread.sortWithinPartitions(*keys).select("value").write.text(path)
