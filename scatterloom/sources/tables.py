"""Parameter tables from text, and selections from index files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scatterloom.functions import vec
from scatterloom.operators import qspace
from scatterloom.operators.params import local_table
from scatterloom.schema import ELEMENTS
from scatterloom.scratch import write_and_reread
from scatterloom.sources import files


def parse_numbers(lines: DataFrame, id_name: str, names, kind: str) -> DataFrame:
    """``(id, names...)`` from ``(id, value)`` lines of white-space separated numbers."""
    words = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != "").select(
        F.col("id").alias(id_name), *(words.getItem(i).cast(kind).alias(n) for i, n in enumerate(names))
    )


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    found = files.scan_lines(files.paths_table(spark, path), files.FILLED_LINE)
    return files.number_lines(found, "id").select("id", "value")


def parse_vectors(lines: DataFrame) -> DataFrame:
    """Scattering vectors from ``(id, value)`` lines ``x y z``."""
    q = parse_numbers(lines, "q_id", ["qx", "qy", "qz"], "double")
    return q.withColumn("ql", vec.length(vec.columns("qx", "qy", "qz")))


def parse_orientations(lines: DataFrame) -> DataFrame:
    """Orientations from ``(id, value)`` lines ``x y z``, scaled to length 1."""
    return qspace.orient_given(parse_numbers(lines, "m_id", ["x", "y", "z"], "double"))


def parse_moments(lines: DataFrame) -> DataFrame:
    """Moments from ``(id, value)`` lines ``major minor``."""
    return parse_numbers(lines, "m_id", ["l", "m"], "bigint")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return parse_vectors(_numbered(spark, path))


def read_orientations(spark: SparkSession, path: str) -> DataFrame:
    return parse_orientations(_numbered(spark, path))


def read_moments(spark: SparkSession, path: str) -> DataFrame:
    return parse_moments(_numbered(spark, path))


def element_table(spark: SparkSession, source) -> DataFrame:
    """Element constants from a JSON or Parquet path, or from rows."""
    if not isinstance(source, str):
        return local_table(spark, source, ELEMENTS)
    if source.endswith(".json") or source.endswith(".jsonl"):
        return spark.read.schema(ELEMENTS).json(source)
    return spark.read.schema(ELEMENTS).parquet(source)


def parse_ndx(lines: DataFrame, pattern: str = ".*") -> DataFrame:
    """``(selection, atom_id)`` from the lines of an index file.

    ``lines`` has ``ord, path, chunk, idx, value`` (see ``files.scan_lines``). A line
    with ``[ name ]`` opens a selection; the 1-based numbers after it belong to it. The
    name a chunk starts with is the last one opened in the chunks before it, so chunks
    are worked off independently.
    """
    name = F.when(
        F.col("value").contains("["),
        F.regexp_extract(F.when(F.col("value").contains("]"), F.col("value")).otherwise(
            F.raise_error(F.concat(F.lit("missing ] in index file: "), F.col("value")))
        ), r"\[\s*([^\]\s]*)", 1),
    )
    rows = lines.withColumn("__name", name)
    last = rows.groupBy("ord", "path", "chunk").agg(
        F.max_by("__name", F.when(F.col("__name").isNotNull(), F.col("idx"))).alias("__last")
    )
    before = Window.partitionBy("ord", "path").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    opened = last.select(
        "ord", "path", "chunk", F.last("__last", ignorenulls=True).over(before).alias("__open")
    )
    inside = Window.partitionBy("ord", "path", "chunk").orderBy("idx").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    named = rows.withColumn("__current", F.last("__name", ignorenulls=True).over(inside))
    named = named.join(opened, ["ord", "path", "chunk"]).select(
        F.coalesce("__current", "__open").alias("selection"), "value", "__name"
    )
    numbers = named.where(
        F.col("__name").isNull() & F.col("selection").isNotNull() & (F.trim("value") != "")
    ).where(F.col("selection").rlike(f"^(?:{pattern})$"))
    words = numbers.select("selection", F.explode(F.split(F.trim("value"), r"\s+")).alias("n"))
    return words.select("selection", (F.col("n").cast("bigint") - 1).alias("atom_id"))


def sel_ndx(
    spark: SparkSession, path: str, pattern: str = ".*", chunk_bytes: int = files.CHUNK_BYTES
) -> DataFrame:
    """All selections of an index file whose name matches the whole pattern."""
    lines = files.scan_lines(files.paths_table(spark, path), chunk_bytes=chunk_bytes)
    return parse_ndx(write_and_reread(lines, "lines"), pattern)  # the file is read once
