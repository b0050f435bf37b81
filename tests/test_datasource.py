"""Trajectory files as a data source: the same rows as the other reader, and only the bytes that are asked for."""

import json

import numpy as np
import pytest

from scatterloom.sources import datasource, files, formats, trajectory


@pytest.fixture(scope="module")
def source(spark):
    datasource.register(spark)
    return spark


def dcd(path, frames, atoms, start=0):
    """A binary trajectory without cells; x is the frame's number, y the atom's."""
    mark = lambda data: len(data).to_bytes(4, "little") + data + len(data).to_bytes(4, "little")
    head = bytearray(84)
    head[:4] = b"CORD"
    head[4:8] = frames.to_bytes(4, "little")
    body = mark(bytes(head)) + mark(b"\1\0\0\0" + b" " * 80) + mark(atoms.to_bytes(4, "little"))
    for f in range(start, start + frames):
        for v in (np.full(atoms, f), np.arange(atoms), np.full(atoms, 0.5)):
            body += mark(v.astype("<f4").tobytes())
    path.write_bytes(body)
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_same_rows_as_the_reader_of_an_index(source, tmp_path):
    paths = [dcd(tmp_path / "a.dcd", 7, 5), dcd(tmp_path / "b.dcd", 4, 5, 7)]
    want = rows(trajectory.read_frames(source, paths, "dcd"))
    df = source.read.format("trajectory").option("paths", json.dumps(paths)).option("partition_bytes", "150").load()
    assert rows(df) == want and df.columns == ["frame", "atom_id", "x", "y", "z"] and df.rdd.getNumPartitions() > 5
    assert rows(source.read.format("trajectory").load(str(tmp_path))) == want


def test_scans_of_one_table_do_not_share_conditions(source, tmp_path):
    dcd(tmp_path / "a.dcd", 30, 3)
    df = source.read.format("trajectory").load(str(tmp_path / "a.dcd"))
    df.createOrReplaceTempView("trajectory_rows")
    for condition, want in (("frame = 3", [3]), ("frame > 27", [28, 29]), ("frame = 2 OR frame = 5", [2, 5]), ("true", list(range(30))), ("frame < -1", [])):
        got = source.sql(f"SELECT DISTINCT frame FROM trajectory_rows WHERE {condition} ORDER BY frame").collect()
        assert [r.frame for r in got] == want, condition
    assert df.where("frame = 1").unionAll(df.where("frame = 2")).count() == 6


def test_options_choose_frames(source, tmp_path):
    dcd(tmp_path / "a.dcd", 30, 3)
    for options, want in (({"first": 27}, [27, 28, 29]), ({"first": 4, "last": 6}, [4, 5, 6]), ({"frames": "[9, 1, 2, 99]"}, [1, 2, 9]), ({"frames": "[3, 8]", "last": 5}, [3]), ({"first": 40}, [])):
        df = source.read.format("trajectory").options(**options).load(str(tmp_path / "a.dcd"))
        assert sorted({r.frame for r in df.collect()}) == want


def test_only_the_wanted_ranges_are_read(tmp_path, monkeypatch):
    n, atoms = 4000, 1000
    path = dcd(tmp_path / "a.dcd", n, atoms)
    size = 3 * (4 * atoms + 8)
    read = []
    plain = files.resolve

    class Counting:
        """A file system that counts what is read."""

        def __init__(self, fs):
            self.fs = fs

        def get_file_info(self, name):
            return self.fs.get_file_info(name)

        def open_input_file(self, name):
            f = self.fs.open_input_file(name)

            class Raw:
                closed = property(lambda s: f.closed)
                readable, writable, seekable = (lambda s: True), (lambda s: False), (lambda s: True)
                seek, tell, close, flush = (lambda s, *a: f.seek(*a)), (lambda s: f.tell()), (lambda s: f.close()), (lambda s: None)

                def readinto(self, b):
                    data = f.read(len(b))
                    read.append(len(data))
                    b[: len(data)] = data
                    return len(data)

            return Raw()

    monkeypatch.setattr(files, "resolve", lambda p: (Counting(plain(p)[0]), plain(p)[1]))
    monkeypatch.setattr(files, "open_file", lambda p, buffer=8192: files.io.BufferedReader(files.resolve(p)[0].open_input_file(files.resolve(p)[1]), 8192))
    monkeypatch.setattr(formats, "open_file", files.open_file)
    for options, frames in (({"frames": "[77]"}, 1), ({"first": "100", "last": "149"}, 50), ({"frames": "[5, 900, 3999]"}, 3)):
        reader = datasource.TrajectorySource({"path": path, **options}).reader(None)
        read.clear()
        found = [b for p in reader.partitions() for b in reader.read(p)]
        assert sum(b.num_rows for b in found) == frames * atoms
        assert sum(read) < frames * (size + 8192) + 200_000 < n * size / 20


def test_files_of_an_index(source, tmp_path):
    paths = [dcd(tmp_path / "a.dcd", 7, 5), dcd(tmp_path / "b.dcd", 4, 5, 7)]
    index = trajectory.join_files(trajectory.build_frame_index(source, paths, "dcd"), first=1, stride=2)
    index.write.parquet(str(tmp_path / "index"))
    df = source.read.format("trajectory").option("index", str(tmp_path / "index")).option("files", "dcd").option("frames_per_task", 2).load()
    assert rows(df) == rows(trajectory.read_indexed(index, "dcd"))
    one = source.read.format("trajectory").option("index", str(tmp_path / "index")).option("files", "dcd").option("frames", "[1, 3]").load()
    assert rows(one) == rows(trajectory.read_indexed(index.where("frame in (1, 3)"), "dcd"))


def test_text_files_of_an_index(source, tmp_path):
    line = "ATOM  {:5d}  CA  GLY A{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00  0.00\n"
    text = "REMARK  first\n" + "".join("".join(line.format(a, a, f + a / 8, -a, 0.25 * f) for a in range(4)) + ("END\n" if f % 2 else "ENDMDL\n") for f in range(6))
    (tmp_path / "a.pdb").write_text(text + "ATOM      1  CA  GLY A   1       9.000   8.000   7.000")
    index = trajectory.build_frame_index(source, [str(tmp_path / "a.pdb")], "pdb")
    index.write.parquet(str(tmp_path / "index"))
    df = source.read.format("trajectory").option("index", str(tmp_path / "index")).option("files", "pdb").load()
    want = rows(trajectory.read_indexed(index, "pdb"))
    assert len(want) == 25 and rows(df) == want and rows(df.where("frame in (2, 6)")) == [r for r in want if r[0] in (2, 6)]


def test_odd_text_frames():
    assert [len(v) for v in formats.pdb_xyz(b"")] == [0, 0, 0]
    assert [len(v) for v in formats.pdb_xyz(b"END\nATOM      1  CA  GLY A   1       9.000   8.000   7.000\n")] == [0, 0, 0]
    with pytest.raises(ValueError):
        formats.pdb_xyz(b"ATOM      1  CA\n")


def test_nothing_named(source):
    with pytest.raises(Exception, match="no trajectory files"):
        source.read.format("trajectory").option("paths", "[]").load().collect()
