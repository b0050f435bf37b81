"""Pairing data with parameter tables (scattering vectors, orientations, species).

A parameter table is described by the user, not by the trajectory, so it is small;
still its size is checked before it is shipped, and a larger one is worked off in
several passes over the data.
"""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART_ROWS = 100_000  # rows of a parameter table shipped to every task at once


def local_table(spark: SparkSession, rows, ddl: str) -> DataFrame:
    """Rows given on the driver as a table that is part of the plan itself."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = spark.createDataFrame([], ddl).schema
    columns = list(zip(*rows)) if rows else [[] for _ in shape]
    arrow = to_arrow_schema(shape)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return _as_plan(spark, pa.Table.from_arrays(arrays, schema=arrow), shape)


def _as_plan(spark: SparkSession, table: pa.Table, shape) -> DataFrame:
    df = spark.createDataFrame(table, shape)
    df._rows_on_driver = table
    return df


def on_driver(params: DataFrame) -> pa.Table | None:
    """The rows of a table made by :func:`localize` or :func:`local_table`, else nothing."""
    return getattr(params, "_rows_on_driver", None)


def _up_to(params: DataFrame, limit: int) -> DataFrame | None:
    """The table as part of the plan if it has at most ``limit`` rows."""
    table = on_driver(params)
    if table is not None:
        return params if table.num_rows <= limit else None
    table = params.limit(limit + 1).toArrow()
    if table.num_rows > limit:
        return None
    return _as_plan(params.sparkSession, table, params.schema)


def localize(params: DataFrame, limit: int = PART_ROWS) -> DataFrame:
    """A small parameter table evaluated once; a large one is left as it is."""
    small = _up_to(params, limit)
    return params if small is None else small


def bounded_parts(params: DataFrame, keys, limit: int = PART_ROWS) -> list[DataFrame]:
    """Split ``params`` by ``keys`` into parts of about ``limit`` rows or fewer."""
    small = _up_to(params, limit)
    if small is not None:
        return [small]
    n = math.ceil(2 * params.count() / limit)
    part = F.pmod(F.xxhash64(*keys), F.lit(n))
    return [params.where(part == i) for i in range(n)]


def union_all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def fan_out(df: DataFrame, params: DataFrame, keys, limit: int = PART_ROWS) -> DataFrame:
    """Every row of ``df`` with every row of the parameter table ``params``.

    The table travels as one array value and is expanded next to the data row, so
    nothing is shuffled and the expansion is pipelined into what follows.
    """
    grown = []
    for part in bounded_parts(params, keys, limit):
        packed = part.agg(F.collect_list(F.struct(*part.columns)).alias("p"))
        grown.append(
            df.withColumn("__params", packed.scalar())
            .select(*df.columns, F.inline("__params"))
        )
    return union_all(grown)
