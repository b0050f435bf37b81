"""Byte-range access to files on any filesystem that executors can reach.

Files are cut into ranges that become rows of a table; a task opens the file itself
and reads its ranges. So one large file is read by many tasks, and a lost task is
simply run again.
"""

from __future__ import annotations

import hashlib
import io
import re

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scatterloom.operators.params import local_table
from scatterloom.scratch import write_and_reread

CHUNK_BYTES = 64 << 20
SIGNATURE_HALF = 1 << 20  # bytes taken from each end of a file
BATCH_LINES = 1 << 16


def resolve(path: str):
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def open_file(path: str, buffer: int = 1 << 20) -> io.BufferedReader:
    fs, name = resolve(path)
    return io.BufferedReader(fs.open_input_file(name), buffer)


def file_size(path: str) -> int:
    fs, name = resolve(path)
    info = fs.get_file_info(name)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def list_folder(path: str) -> list[str]:
    """Data files in a folder and the folders below it, in the order of their paths; markers and drafts are left out."""
    fs, name = resolve(path)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    found = fs.get_file_info(pafs.FileSelector(name, recursive=True))
    below = len(name.rstrip("/")) + 1
    return sorted(
        prefix + i.path for i in found
        if i.type == pafs.FileType.File and not any(x.startswith(("_", ".")) for x in i.path[below:].split("/"))
    )


def paths_table(spark: SparkSession, paths) -> DataFrame:
    """``(ord, path)`` from a path, a folder, a list of paths or a table of that form."""
    if isinstance(paths, DataFrame):
        return paths.select("ord", "path")
    if isinstance(paths, str):
        fs, name = resolve(paths)
        if fs.get_file_info(name).type == pafs.FileType.Directory:
            folder, paths = paths, list_folder(paths)
            if not paths:
                raise FileNotFoundError(f"no data files in {folder}")
    paths = [paths] if isinstance(paths, str) else list(paths)
    return local_table(spark, list(enumerate(paths)), "ord bigint, path string")


def spread(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Hand the rows of a small work list to many tasks."""
    n = partitions or 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *keys)


def map_paths(paths: DataFrame, fn, out: str) -> DataFrame:
    """``fn(ord, path) -> list of tuples`` on every file."""
    names = [f.split()[0] for f in out.split(",")]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [r for o, p in zip(pdf["ord"], pdf["path"]) for r in fn(o, p)]
            yield pd.DataFrame(rows, columns=names)

    return spread(paths, "path").mapInPandas(run, out)


def chunks(paths: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(ord, path, size, chunk)``: byte ranges to read, spread over tasks."""
    sized = map_paths(
        paths.select("ord", "path"),
        lambda o, p: [(o, p, file_size(p))],
        "ord bigint, path string, size bigint",
    )
    cut = sized.where("size > 0").withColumn(
        "chunk", F.explode(F.expr(f"sequence(0L, (size - 1) div {int(chunk_bytes)})"))
    )
    return spread(cut, "path", "chunk")


def line_pattern(*starts: bytes) -> bytes:
    """Lines that begin with one of the given bytes."""
    return rb"(?m)^(?:" + b"|".join(re.escape(x) for x in starts) + rb")[^\n]*\n?"


ANY_LINE = rb"[^\n]*\n|[^\n]+"
FILLED_LINE = rb"(?m)^[^\n]*[^\s][^\n]*\n?"


def lines_of(path: str, start: int, end: int, pattern: bytes = ANY_LINE):
    """Yield (offset, offset of the next line, line) for matching lines that begin in [start, end)."""
    base = max(0, start - 1)
    with open_file(path) as f:
        f.seek(base)
        data = f.read(end - base)
        if not data.endswith(b"\n"):
            data += f.readline()
    # a range that does not start a line leaves its first part to the range before
    first = 0 if start == 0 else data.find(b"\n") + 1 or len(data)
    for found in re.compile(pattern).finditer(data, first):
        yield base + found.start(), base + found.end(), found.group()


def scan_lines(paths: DataFrame, pattern: bytes = ANY_LINE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(ord, path, size, chunk, idx, offset, next_offset, value)`` for each line that
    matches; ``idx`` counts them within the chunk."""
    out = (
        "ord bigint, path string, size bigint, chunk bigint, idx bigint,"
        " offset bigint, next_offset bigint, value string"
    )
    names = [c.split()[0] for c in out.split(",")]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lo = row["chunk"] * chunk_bytes
                hi = min(lo + chunk_bytes, row["size"])
                found, n = [], 0
                for a, b, line in lines_of(row["path"], lo, hi, pattern):
                    found.append((a, b, line.rstrip(b"\r\n").decode("utf-8", "replace")))
                    n += 1
                    if len(found) == BATCH_LINES:
                        yield _batch(row, found, n, names)
                        found = []
                if found:
                    yield _batch(row, found, n, names)

    return chunks(paths, chunk_bytes).mapInArrow(run, out)


def _batch(row, found, n, names):
    k = len(found)
    fixed = [pa.array([row[c]] * k) for c in ("ord", "path", "size", "chunk")]
    a, b, text = zip(*found)
    idx = pa.array(np.arange(n - k, n, dtype=np.int64))
    return pa.RecordBatch.from_arrays([*fixed, idx, pa.array(a), pa.array(b), pa.array(text)], names)


def number_lines(lines: DataFrame, name: str) -> DataFrame:
    """Add ``name``: the number of a line within its file, from counts per chunk.

    The matching lines are written to the scratch folder first, so that the files are read
    once for the counts and the rows.
    """
    lines = write_and_reread(lines, "lines")
    counts = lines.groupBy("ord", "path", "chunk").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("ord", "path").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        "ord", "path", "chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    return (
        lines.join(offsets, ["ord", "path", "chunk"])
        .withColumn(name, F.col("idx") + F.col("__before"))
        .drop("__before")
    )


def signature(path: str) -> str:
    """Digest of the first and the last MiB, or of the whole of a smaller file."""
    size = file_size(path)
    digest = hashlib.sha256()
    with open_file(path) as f:
        if size <= 2 * SIGNATURE_HALF:
            digest.update(f.read())
        else:
            digest.update(f.read(SIGNATURE_HALF))
            f.seek(size - SIGNATURE_HALF)
            digest.update(f.read(SIGNATURE_HALF))
    return digest.hexdigest()


def signatures(paths: DataFrame) -> DataFrame:
    """``(ord, path, signature)``."""
    return map_paths(
        paths.select("ord", "path"),
        lambda o, p: [(o, p, signature(p))],
        "ord bigint, path string, signature string",
    )
