"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..deploy import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the package is sent to the executors first."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(df: DataFrame, text: str = "text") -> Column:
    """The text column, an empty text for null."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


_kept: dict[Hashable, Any] = {}


def kept(name: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task. It keeps one thing only, so a chain of operators takes no more memory than its largest."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_texts(df: DataFrame, id_col: str, text_col: str, columns: dict[str, str], fn) -> DataFrame:
    """The id column as it is and ``columns`` (name: type) that ``fn``, given a list of whole texts, returns as lists; batch by batch, without a shuffle.

    Ids stay in Arrow: pandas would turn large ones next to a null into floating point.
    """
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in columns.items())).fields])
    kinds = [f.type for f in to_arrow_schema(schema)][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = fn(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, made, kinds)], schema.names)

    rows = df.select(df[id_col].alias("id"), whole_text(df, text_col).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
