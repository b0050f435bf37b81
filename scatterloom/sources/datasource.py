"""Trajectory files as a data source of Spark: ``spark.read.format("trajectory").load(path)``.

The options ``first``, ``last`` and ``frames`` choose frames; only their byte ranges are opened.
Planning looks at the heads of files, or, with ``index``, at the footers of a stored frame index; ranges are dealt to
tasks, and a task looks up the frames of its own range.

Conditions of a query are not taken in by the reader: Spark keeps what a Python source has accepted with the table and not with the scan, so
a second scan of the same DataFrame, without conditions or with others, would get the first one's frames.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scatterloom.deploy import ship
from scatterloom.sources import files, formats
from scatterloom.sources.trajectory import COORDINATES, dcd_rows, pdb_rows

NAME = "trajectory"
#: Bytes of frames that a task reads, unless ``partition_bytes`` says otherwise.
PARTITION_BYTES = 64 << 20
BUFFER = 1 << 13  # a wanted frame may lie alone


@dataclass
class Wanted:
    """Frames from ``lo`` to ``hi``, and of ``chosen`` only."""

    lo: int = 0
    hi: int | None = None
    chosen: frozenset[int] | None = None

    @classmethod
    def of(cls, options: dict[str, str]) -> Wanted:
        last, frames = options.get("last"), options.get("frames")
        return cls(int(options.get("first", 0)), None if last is None else int(last), None if frames is None else frozenset(map(int, json.loads(frames))))

    def ranges(self, first: int, last: int, most: int) -> Iterator[tuple[int, int]]:
        """Runs of at most ``most`` wanted frames between ``first`` and ``last`` (both included)."""
        lo, hi = max(first, self.lo), last if self.hi is None else min(last, self.hi)
        if self.chosen is None:
            for at in range(lo, hi + 1, most):
                yield at, min(at + most - 1, hi)
            return
        run: list[int] = []
        for frame in sorted(f for f in self.chosen if lo <= f <= hi):
            if run and (frame != run[-1] + 1 or len(run) >= most):
                yield run[0], run[-1]
                run = []
            run.append(frame)
        if run:
            yield run[0], run[-1]


@dataclass
class Frames(InputPartition):
    """Frames ``lo..hi`` of a file whose first frame is number ``base``, or of an index (``path`` empty)."""

    path: str
    base: int
    lo: int
    hi: int


class TrajectoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.wanted = Wanted.of(options)

    def _paths(self) -> list[str]:
        path = self.options.get("path")
        if path is None:
            paths = json.loads(self.options.get("paths", "[]"))
        else:
            fs, name = files.resolve(path)
            paths = files.list_folder(path) if fs.get_file_info(name).type == files.pafs.FileType.Directory else [path]
        if not paths:
            raise FileNotFoundError("no trajectory files are named")
        return paths

    def _index(self) -> pads.Dataset:
        fs, name = files.resolve(self.options["index"])
        return pads.dataset(name, format="parquet", filesystem=fs)

    def partitions(self) -> list[InputPartition]:
        size = int(self.options.get("partition_bytes", PARTITION_BYTES))
        out: list[InputPartition] = []
        if "index" in self.options:
            groups = []
            for piece in self._index().get_fragments():
                for g in piece.row_groups:
                    told = g.statistics.get("frame")
                    if g.num_rows and told:
                        groups.append((int(told["min"]), int(told["max"])))
            if groups:
                most = max(1, int(self.options.get("frames_per_task", 1024)))
                out = [Frames("", 0, lo, hi) for lo, hi in self.wanted.ranges(min(g[0] for g in groups), max(g[1] for g in groups), most)]
            return out or [Frames("", 0, 0, -1)]
        base = 0
        for path in self._paths():
            d = formats.checked_layout(path)
            found = self.wanted.ranges(base, base + d.n_frames - 1, max(1, size // d.size))
            out += [Frames(path, base, lo, hi) for lo, hi in found]
            base += d.n_frames
        return out or [Frames("", 0, 0, -1)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        if partition.hi < partition.lo:
            return
        if partition.path:
            d = formats.dcd_layout(partition.path)
            rows = [(frame, d.first + (frame - partition.base) * d.size) for frame in range(partition.lo, partition.hi + 1)]
            with files.open_file(partition.path, BUFFER) as f:
                yield from dcd_rows(f, d, rows)
            return
        between = (pads.field("frame") >= partition.lo) & (pads.field("frame") <= partition.hi)
        rows = self._index().to_table(columns=["path", "frame", "byte_offset"], filter=between).sort_by([("path", "ascending"), ("byte_offset", "ascending")]).to_pylist()
        by_file: dict[str, list[tuple[int, int]]] = {}
        for r in rows:
            by_file.setdefault(r["path"], []).append((r["frame"], r["byte_offset"]))
        for path, found in by_file.items():
            with files.open_file(path, BUFFER) as f:
                if self.options.get("files") == "pdb":
                    yield from pdb_rows(f, found)
                else:
                    yield from dcd_rows(f, formats.dcd_layout(path), found)


class TrajectorySource(DataSource):
    """Options: ``path`` (a file or a folder) or ``paths`` (a list as JSON) of binary trajectory files; or ``index``, a stored frame index
    (`trajectory.build_frame_index`, also joined, cut or renumbered) with ``files`` = ``dcd`` or ``pdb`` and ``frames_per_task``. ``first`` and ``last`` (both included) and
    ``frames`` (a list as JSON) choose frames by the numbers that they have in the result."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'double'}" for f in COORDINATES)

    def reader(self, schema) -> DataSourceReader:
        return TrajectoryReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make ``trajectory`` a format of this session."""
    ship(spark)
    spark.dataSource.register(TrajectorySource)
