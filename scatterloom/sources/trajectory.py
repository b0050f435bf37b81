"""Trajectories from files: an index of frames first, then the frames that are wanted.

The index is a table ``(ord, path, frame, byte_offset, signature)``. Cutting, joining
and choosing frames is done on it (``operators.frames``), so what is not kept is never
read, and reading is one task per group of index rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterloom.operators.frames import clone_frames, concat_framesets, explode_range, keep_frames, trim_frames
from scatterloom.operators.params import local_table, localize
from scatterloom.operators.prefix import PLACES, running_total
from scatterloom.operators.rigid import shipped
from scatterloom.scratch import write_and_reread
from scatterloom.sources import files, formats

SLICE_ATOMS = 1 << 20
RUN_BYTES = 4 << 20  # neighbouring frames read at once
INDEX = ["ord", "path", "frame", "byte_offset"]


def detect_format(spark: SparkSession, paths) -> DataFrame:
    """``(ord, path, format)`` with format ``dcd``, ``pdb`` or NULL."""

    def sniff(ord_, path):
        kind = "dcd" if formats.is_dcd(path) else "pdb" if formats.is_pdb(path) else None
        return [(ord_, path, kind)]

    return files.map_paths(
        files.paths_table(spark, paths), sniff, "ord bigint, path string, format string"
    )


def _dcd_index(paths: DataFrame) -> DataFrame:
    def head(ord_, path):
        d = formats.checked_layout(path)
        return [(ord_, path, d.n_frames, d.first, d.size)]

    heads = files.map_paths(
        paths, head, "ord bigint, path string, n bigint, first bigint, size bigint"
    )
    rows = explode_range(heads, F.lit(0), F.col("n") - 1, "frame")
    return rows.select("ord", "path", "frame", (F.col("first") + F.col("frame") * F.col("size")).alias("byte_offset"))


def _pdb_index(paths: DataFrame, chunk_bytes: int) -> DataFrame:
    """A frame starts at the top of the file and after each line that begins with END."""

    def check(ord_, path):
        if not formats.is_pdb(path):
            raise ValueError(f"not a PDB file: {path}")
        return [(ord_, path)]

    checked = files.map_paths(paths, check, "ord bigint, path string")
    ends = files.number_lines(
        files.scan_lines(checked, files.line_pattern(formats.END), chunk_bytes), "n"
    )
    later = ends.where("next_offset < size").select(
        "ord", "path", (F.col("n") + 1).alias("frame"), F.col("next_offset").alias("byte_offset")
    )
    zero = F.lit(0).cast("bigint")
    return paths.select("ord", "path", zero.alias("frame"), zero.alias("byte_offset")).unionByName(later)


def build_frame_index(
    spark: SparkSession, paths, fmt: str, keep: DataFrame | None = None,
    chunk_bytes: int = files.CHUNK_BYTES, signed: bool = True,
) -> DataFrame:
    """Frames of each file with their byte offset and the signature of the file.

    ``keep(position, frame)`` chooses and orders frames. Write the result as Parquet to
    use it again; :func:`stale_files` tells whether it still fits.
    """
    table = files.paths_table(spark, paths)
    if fmt == "dcd":
        index = _dcd_index(table)
    elif fmt == "pdb":
        index = _pdb_index(table, chunk_bytes)
    else:
        raise ValueError(f"no reader for format {fmt!r}")
    if keep is not None:
        index = keep_frames(index, keep)
    if not signed:
        return index.select(*INDEX)
    return index.join(files.signatures(table), ["ord", "path"]).select(*INDEX, "signature")


def stale_files(index: DataFrame) -> DataFrame:
    """``(path, signature, found)`` of files that changed since the index was built."""
    known = index.groupBy("ord", "path").agg(F.first("signature").alias("signature"))
    now = files.signatures(known.select("ord", "path")).withColumnRenamed("signature", "found")
    return known.join(now, ["ord", "path"]).where("signature != found").select("path", "signature", "found")


def validate_frame_index(index: DataFrame) -> DataFrame:
    """The index itself; raises if a file it describes has changed."""
    bad = [r["path"] for r in stale_files(index).limit(10).collect()]
    if bad:
        raise ValueError(f"frame index is out of date for {bad}")
    return index


def index_changes(index: DataFrame, paths) -> DataFrame:
    """``(path, state)``: what has become of the files of an index, or of those named now: ``same``, ``changed``, ``new`` or ``gone``."""
    known = index.groupBy("path").agg(F.first("signature").alias("known"))
    now = files.signatures(files.paths_table(index.sparkSession, paths)).select("path", F.col("signature").alias("found")).distinct()
    state = F.when(F.col("found").isNull(), "gone").when(F.col("known").isNull(), "new").when(F.col("known") != F.col("found"), "changed").otherwise("same")
    return known.join(now, "path", "full").select("path", state.alias("state"))


def refresh_frame_index(index: DataFrame, paths, fmt: str, chunk_bytes: int = files.CHUNK_BYTES) -> DataFrame:
    """The index of the files named now, made from a stored one: frames of files with the signature they had are taken over,
    those of gone files are left out, and only new and changed files are scanned.

    Of an unchanged file only the ends are read, for its signature. ``index`` holds whole files, as `build_frame_index` makes them.
    """
    spark = index.sparkSession
    now = write_and_reread(files.signatures(files.paths_table(spark, paths)), "signatures")
    known = index.select("path", "signature").distinct()
    taken = index.drop("ord").join(now, ["path", "signature"]).select(*INDEX, "signature")
    rest = localize(now.join(known, ["path", "signature"], "left_anti").select("ord", "path"))
    if rest.isEmpty():
        return taken
    return taken.unionByName(build_frame_index(spark, rest, fmt, chunk_bytes=chunk_bytes))


def join_files(
    index: DataFrame, first: int = 0, last: int | None = None, stride: int = 1, clones: int = 1
) -> DataFrame:
    """One trajectory of all files in ``ord`` order: each cut alike, each ``clones`` times."""
    if clones < 1:
        return index.where(F.lit(False))
    cut = trim_frames(index, first, last, stride)
    sizes = cut.groupBy("ord").agg(F.count("*").alias("n")).withColumn("upto", F.col("n"))
    starts = running_total(sizes, "ord", ["upto"], n=PLACES).select(
        "ord", "n", (F.col("upto") - F.col("n")).alias("before")
    )
    copied = cut.join(starts, "ord").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.lit(clones - 1)))
    )
    number = F.lit(clones) * F.col("before") + F.col("copy") * F.col("n") + F.col("frame")
    return copied.withColumn("frame", number.cast("bigint")).select(*index.columns)


def frameset_list(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, path)`` of a text file that names trajectory files; lines with # are skipped."""
    lines = files.scan_lines(files.paths_table(spark, path), files.FILLED_LINE)
    lines = lines.where(~F.col("value").startswith("#"))
    numbered = files.number_lines(lines, "line")
    named = numbered.select("line", F.split(F.trim("value"), r"\s+").alias("names"))
    upto = running_total(named.withColumn("upto", F.size("names")), "line", ["upto"], n=PLACES)
    before = F.col("upto") - F.size("names")
    names = upto.select(before.alias("before"), F.posexplode("names").alias("pos", "path"))
    return names.select((F.col("before") + F.col("pos")).cast("bigint").alias("ord"), "path")


def _work(index: DataFrame) -> DataFrame:
    """Index rows in runs of neighbouring frames, several to a task."""
    n = 4 * index.sparkSession.sparkContext.defaultParallelism
    order = ["path", "byte_offset", "frame"]
    return index.select(*INDEX).repartitionByRange(n, *order).sortWithinPartitions(*order)


def _of_a_file(batches, most: int = 4096):
    """Yield (path, [(frame, byte offset), ..]) for up to ``most`` index rows in a row that belong to one file."""
    path, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["path"] != path or len(rows) >= most):
                yield path, rows
                rows = []
            path = row["path"]
            rows.append((row["frame"], row["byte_offset"]))
    if rows:
        yield path, rows


COORDINATES = pa.schema([("frame", pa.int64()), ("atom_id", pa.int64())] + [(c, pa.float64()) for c in "xyz"])


def _coordinates(frames, atoms, xyz) -> pa.RecordBatch:
    whole = (pa.array(np.asarray(v, dtype=np.int64)) for v in (frames, atoms))
    return pa.RecordBatch.from_arrays([*whole, *(pa.array(v.astype(np.float64)) for v in xyz)], schema=COORDINATES)


def dcd_rows(f, d: formats.DcdLayout, found):
    """Coordinates of the frames ``found`` (frame, byte offset) of an open file, neighbouring ones in one read."""

    def at_once(run):
        """Frames that lie next to each other, as one batch; a frame beyond RUN_BYTES in slices of atoms."""
        if d.size > RUN_BYTES:
            for frame, at in run:
                for lo in range(0, d.n_atoms, SLICE_ATOMS):
                    hi = min(lo + SLICE_ATOMS, d.n_atoms)
                    xyz = [formats.dcd_block(f, at, b, lo, hi) for b in (d.x, d.y, d.z)]
                    yield _coordinates(np.full(hi - lo, frame), np.arange(lo, hi), xyz)
            return
        xyz = formats.dcd_frames(f, run[0][1], len(run), d)
        yield _coordinates(np.repeat([frame for frame, _ in run], d.n_atoms), np.tile(np.arange(d.n_atoms), len(run)), xyz)

    most, waiting = max(1, RUN_BYTES // d.size), []
    for frame, at in found:
        if waiting and (at != waiting[-1][1] + d.size or len(waiting) >= most):
            yield from at_once(waiting)
            waiting = []
        waiting.append((frame, at))
    if waiting:
        yield from at_once(waiting)


def _read_dcd(index: DataFrame) -> DataFrame:
    def run(batches):
        for path, found in _of_a_file(batches):
            with formats.open_file(path) as f:
                yield from dcd_rows(f, formats.dcd_layout(path), found)

    return _work(index).mapInArrow(
        run, "frame bigint, atom_id bigint, x double, y double, z double"
    )


def pdb_rows(f, found):
    """Coordinates of the frames ``found`` (frame, byte offset) of an open text file, many small frames in a batch."""
    numbers, atoms, parts, held = [], [], [], 0

    def out():
        return _coordinates(np.concatenate(numbers), np.concatenate(atoms), [np.concatenate(c) for c in zip(*parts)])

    guess = 1 << 16
    for frame, at in found:
        first = size = 0
        for size, xyz in formats.pdb_blocks(f, at, guess):
            n = len(xyz[0])
            numbers.append(np.full(n, frame))
            atoms.append(np.arange(first, first + n))
            parts.append(xyz)
            first, held = first + n, held + n
            if held >= files.BATCH_LINES:
                yield out()
                numbers, atoms, parts, held = [], [], [], 0
        guess = max(256, size + 64)  # the next frame is about as long
    if held:
        yield out()


def _read_pdb(index: DataFrame) -> DataFrame:
    def run(batches):
        for path, found in _of_a_file(batches):
            with formats.open_file(path) as f:
                yield from pdb_rows(f, found)

    return _work(index).mapInArrow(run, "frame bigint, atom_id bigint, x double, y double, z double")


def _field(name: str, columns=formats.ATOM_COLUMNS):
    return F.trim(F.substring("value", *columns[name]))


def read_indexed(index: DataFrame, fmt: str) -> DataFrame:
    """``(frame, atom_id, x, y, z)`` of the frames in an index."""
    if fmt not in ("dcd", "pdb"):
        raise ValueError(f"no reader for format {fmt!r}")
    return (_read_dcd if fmt == "dcd" else _read_pdb)(index)


def read_frames(
    spark: SparkSession, paths, fmt: str, first: int = 0, last: int | None = None,
    stride: int = 1, clones: int = 1,
) -> DataFrame:
    """Trajectory of one or more files, or of Parquet tables of coordinates or frame blocks.

    ``paths`` is a path, a list of paths or a table ``(ord, path)``. Several follow one after another, each cut alike and
    then taken ``clones`` times. A Parquet path is a whole table, of however many files.
    """
    if fmt == "parquet":
        if isinstance(paths, DataFrame):  # a list that a user wrote down: a plan of one scan for each
            paths = [r["path"] for r in localize(paths.orderBy("ord")).collect()]
        paths = [paths] if isinstance(paths, str) else list(paths)
        if not paths:
            raise FileNotFoundError("no tables are named")
        return _read_tables(spark, paths, first, last, stride, clones)
    index = build_frame_index(spark, paths, fmt, signed=False)
    if fmt == "pdb":
        index = write_and_reread(index, "frame-index")  # finding the frames reads whole files
    return read_indexed(join_files(index, first, last, stride, clones), fmt)


def _read_tables(spark: SparkSession, paths: list[str], first: int, last: int | None, stride: int, clones: int) -> DataFrame:
    """Parquet tables one after another, each cut alike and cloned, as one scan: the offset of a row's frame comes with its file.

    Tables of unlike columns, or cut into folders by a column, are read one by one.
    """
    tables = [spark.read.parquet(p) for p in paths]
    files_of = [t.inputFiles() for t in tables]
    shape = tables[0].schema
    in_folders = any("=" in f.rsplit("/", 2)[-2] for found in files_of for f in found)
    if len(paths) == 1 or in_folders or clones < 1 or any(t.schema != shape for t in tables):
        cut = [trim_frames(t, first, last, stride) for t in tables]
        return concat_framesets([clone_frames(df, clones) for df in cut])
    bare = lambda name: F.regexp_replace(name, "^([A-Za-z0-9]+):/+", "$1:/")  # the two are not spelled alike
    named = local_table(spark, [(f, n) for n, found in enumerate(files_of) for f in found], "__file string, __set bigint")
    named = named.withColumn("__file", bare("__file")).distinct()
    scan = spark.read.schema(shape).parquet(*dict.fromkeys(paths))
    rows = scan.select("*", bare("_metadata.file_path").alias("__file")).join(shipped(localize(named)), "__file")
    cut = trim_frames(rows, first, last, stride)
    sizes = localize(cut.groupBy("__set").agg((F.max("frame") + 1).alias("__n")))
    before = running_total(sizes.withColumn("__before", F.col("__n") * clones), "__set", ["__before"], n=len(paths))
    before = localize(before.select("__set", "__n", (F.col("__before") - F.col("__n") * clones).alias("__before")))
    copied = cut.join(shipped(before), "__set").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(clones - 1))))
    number = F.col("__before") + F.col("__copy") * F.col("__n") + F.col("frame")
    return copied.withColumn("frame", number.cast("bigint")).select(*(f.name for f in shape))


def read_frame_list(spark: SparkSession, list_path: str, fmt: str, **cut) -> DataFrame:
    """Trajectory of all the files named in a list file."""
    return read_frames(spark, frameset_list(spark, list_path), fmt, **cut)


def read_structures(
    spark: SparkSession, paths, chunk_bytes: int = files.CHUNK_BYTES
) -> DataFrame:
    """``(ord, atom_id, pdb_name, beta, segid)`` of structure files; atoms count from 0 in each.

    The atoms of a file are those before its first END line.
    """
    pattern = files.line_pattern(formats.ATOM, formats.END)
    lines = files.scan_lines(files.paths_table(spark, paths), pattern, chunk_bytes)
    numbered = files.number_lines(lines, "atom_id")
    is_end = F.col("value").startswith(formats.END.decode())
    ends = numbered.where(is_end).groupBy("ord").agg(F.min("atom_id").alias("n_atoms"))
    return (
        numbered.where(~is_end)
        .join(ends, "ord", "left")
        .where(F.col("n_atoms").isNull() | (F.col("atom_id") < F.col("n_atoms")))
        .select("ord", "atom_id", *(_field(c).alias(c) for c in ("pdb_name", "beta", "segid")))
    )


def read_structure(spark: SparkSession, path: str, chunk_bytes: int = files.CHUNK_BYTES) -> DataFrame:
    """``(atom_id, pdb_name, beta, segid)`` of one structure file."""
    return read_structures(spark, [path], chunk_bytes).drop("ord")


CELL = [f"{v}{c}" for v in "abc" for c in "xyz"]


def read_unit_cells(index: DataFrame, fmt: str) -> DataFrame:
    """``(frame, ax..cz)`` of the indexed frames; a PDB frame without a cell has the first of its file."""
    if fmt == "dcd":
        out = "frame bigint, " + ", ".join(f"{c} double" for c in CELL)

        def run(batches):
            for path, rows in _of_a_file(batches):
                d = formats.dcd_layout(path)
                with formats.open_file(path) as f:
                    found = [{"frame": frame, **dict(zip(CELL, formats.dcd_cell(f, at, d)))} for frame, at in rows]
                yield pa.RecordBatch.from_pylist(found)

        return _work(index).mapInArrow(run, out)

    def lines(batches):
        for path, rows in _of_a_file(batches):
            with formats.open_file(path) as f:
                found = [(frame, next(iter(list(formats.pdb_frame(f, at, formats.CELL))[-1:]), None)) for frame, at in rows]
            yield pa.RecordBatch.from_pylist(
                [{"path": path, "frame": frame, "own": line and line.decode("utf-8", "replace")} for frame, line in found],
                schema=pa.schema([("path", pa.string()), ("frame", pa.int64()), ("own", pa.string())]),
            )

    own = _work(index).mapInArrow(lines, "path string, frame bigint, own string")
    # the first cell of each file, found in one scan of byte ranges by many tasks
    paths = index.groupBy("path").agg(F.min("ord").alias("ord"))
    firsts = files.scan_lines(paths.select("ord", "path"), files.line_pattern(formats.CELL))
    firsts = firsts.groupBy("path").agg(F.min_by("value", "offset").alias("first"))
    return cell_vectors(own.join(firsts, "path", "left").select("frame", F.coalesce("own", "first", F.lit("")).alias("value")))


def cell_vectors(lines: DataFrame) -> DataFrame:
    """Cell vectors from the lengths and the angles (degrees) of ``(frame, value)`` lines."""
    v = {
        c: F.coalesce(_field(c, formats.CELL_COLUMNS).try_cast("double"), F.lit(0.0))
        for c in formats.CELL_COLUMNS
    }
    al, be, ga = (v[k] * (2 * math.pi / 360) for k in ("alpha", "beta", "gamma"))
    zero = F.lit(0.0)
    vectors = [
        v["a"], zero, zero,
        v["b"] * F.cos(ga), v["b"] * F.sin(ga), zero,
        v["c"] * F.cos(be), v["c"] * F.cos(al) * F.sin(be), v["c"] * F.sin(al) * F.sin(be),
    ]
    return lines.select("frame", *(c.alias(n) for n, c in zip(CELL, vectors)))
