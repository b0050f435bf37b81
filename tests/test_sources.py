"""File readers against small files written here."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterloom.operators.params import local_table
from scatterloom.sources import files, formats, tables, trajectory
from workload.tables import dcd_bytes

FRAMES = np.array(
    [[[f + a + k / 10 for k in range(3)] for a in range(4)] for f in range(3)], dtype=np.float64
)


def pdb_text(end_last=True):
    lines = ["TITLE     four atoms", "CRYST1   10.000   20.000   30.000  90.00  90.00  90.00 P 1"]
    for f, frame in enumerate(FRAMES):
        for a, (x, y, z) in enumerate(frame):
            lines.append(
                f"ATOM  {a + 1:5d} {'CA' if a % 2 else 'N':<4s} MOL  {1:4d}    {x:8.3f}{y:8.3f}{z:8.3f}"
                f"{1:6.2f}{a % 2:6.2f}      {'AB'[a // 2] * 2:<4s}"
            )
            lines.append("HETATM    9 X    not an atom record")
        if f < 2 or end_last:
            lines.append("ENDMDL" if f == 0 else "END")
        if f == 0:
            lines.append("CRYST1   11.000   20.000   30.000  90.00  90.00  60.00 P 1")
    return "\n".join(lines) + "\n"


def as_array(df):
    rows = df.orderBy("frame", "atom_id").collect()
    n = len({r["frame"] for r in rows})
    return np.array([[r["x"], r["y"], r["z"]] for r in rows]).reshape(n, -1, 3)


@pytest.mark.parametrize("end_last", [True, False])
@pytest.mark.parametrize("chunk", [17, 200, 1 << 20])
def test_pdb(spark, tmp_path, end_last, chunk):
    path = str(tmp_path / "a.pdb")
    open(path, "w").write(pdb_text(end_last))
    index = trajectory.build_frame_index(spark, path, "pdb", chunk_bytes=chunk)
    assert sorted(r["frame"] for r in index.collect()) == [0, 1, 2]
    assert np.allclose(as_array(trajectory.read_indexed(index, "pdb")), FRAMES)


def test_pdb_cells(spark, tmp_path):
    path = str(tmp_path / "a.pdb")
    open(path, "w").write(pdb_text())
    index = trajectory.build_frame_index(spark, path, "pdb")
    cells = {r["frame"]: r for r in trajectory.read_unit_cells(index, "pdb").collect()}
    assert [cells[f]["ax"] for f in range(3)] == [10.0, 11.0, 10.0]
    assert np.isclose(cells[1]["bx"], 10.0) and np.isclose(cells[1]["by"], 20 * np.sqrt(3) / 2)
    assert np.isclose(cells[0]["cz"], 30.0) and np.isclose(cells[0]["cx"], 0.0)


@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_structure(spark, tmp_path, chunk):
    path = str(tmp_path / "a.pdb")
    open(path, "w").write(pdb_text())
    rows = trajectory.read_structure(spark, path, chunk).orderBy("atom_id").collect()
    assert [tuple(r) for r in rows] == [
        (0, "N", "0.00", "AA"), (1, "CA", "1.00", "AA"), (2, "N", "0.00", "BB"), (3, "CA", "1.00", "BB"),
    ]


@pytest.mark.parametrize("cell", [False, True])
@pytest.mark.parametrize("extra", [False, True])
def test_dcd(spark, tmp_path, cell, extra):
    path = str(tmp_path / "a.dcd")
    open(path, "wb").write(dcd_bytes(list(FRAMES), cell, extra))
    index = trajectory.build_frame_index(spark, path, "dcd")
    assert np.allclose(as_array(trajectory.read_indexed(index, "dcd")), FRAMES, atol=1e-6)
    cells = {r["frame"]: r for r in trajectory.read_unit_cells(index, "dcd").collect()}
    assert cells[2]["ax"] == (2.0 if cell else 0.0)
    assert cells[2]["bx"] == (2.125 if cell else 0.0)


def test_wrong_format_is_refused(spark, tmp_path):
    path = str(tmp_path / "a.dcd")
    open(path, "w").write("not a trajectory\n")
    for fmt in ("dcd", "pdb"):
        with pytest.raises(Exception, match="not a"):
            trajectory.build_frame_index(spark, path, fmt).collect()
    assert trajectory.detect_format(spark, path).first()["format"] is None


def test_list_trim_and_clones(spark, tmp_path):
    for name, shift in (("a", 0), ("b", 100)):
        open(tmp_path / f"{name}.dcd", "wb").write(dcd_bytes([f + shift for f in FRAMES]))
    listing = tmp_path / "all.txt"
    listing.write_text(f"# files\n{tmp_path}/a.dcd\n\n{tmp_path}/b.dcd\n")
    df = trajectory.read_frame_list(spark, str(listing), "dcd", first=1, clones=2)
    a, b = FRAMES[1:], FRAMES[1:] + 100
    assert np.allclose(as_array(df), np.concatenate([a, a, b, b]), atol=1e-4)


def test_only_kept_frames_are_read(spark, tmp_path):
    path = str(tmp_path / "a.dcd")
    data = dcd_bytes(list(FRAMES))
    open(path, "wb").write(data)
    keep = local_table(spark, [(0, 0), (1, 0)], "position bigint, frame bigint")
    index = trajectory.build_frame_index(spark, path, "dcd", keep)
    index = spark.createDataFrame(index.toPandas())
    open(path, "wb").write(data[: len(data) - 100])  # the last frame is damaged
    assert np.allclose(as_array(trajectory.read_indexed(index, "dcd")), FRAMES[[0, 0]], atol=1e-6)
    with pytest.raises(ValueError, match="out of date"):
        trajectory.validate_frame_index(index)


def test_signature_covers_both_ends(tmp_path):
    path = str(tmp_path / "big")
    data = bytearray(3 << 20)
    open(path, "wb").write(data)
    old = files.signature(path)
    data[-1] = 1
    open(path, "wb").write(data)
    assert files.signature(path) != old


@pytest.mark.parametrize("chunk", [5, 33, 1 << 20])
def test_lines_and_numbers(spark, tmp_path, chunk):
    path = tmp_path / "t.txt"
    lines = [f"line {i} " + "x" * (i % 13) for i in range(40)]
    path.write_text("\n".join(lines))
    df = files.number_lines(files.scan_lines(files.paths_table(spark, str(path)), chunk_bytes=chunk), "n")
    got = [r["value"] for r in df.orderBy("n").collect()]
    assert got == lines
    assert [r["n"] for r in df.orderBy("n").collect()] == list(range(40))


@pytest.mark.parametrize("chunk", [7, 40, 1 << 20])
def test_ndx(spark, tmp_path, chunk):
    path = tmp_path / "g.ndx"
    path.write_text("1 2 3\n[ one ]\n1 2 3\n  7 8\n\n[ two ] \n10\n[none]\n[ one_more ]\n4 5\n")
    got = {(r[0], r[1]) for r in tables.sel_ndx(spark, str(path), "one.*|none", chunk).collect()}
    assert got == {("one", i) for i in (0, 1, 2, 6, 7)} | {("one_more", 3), ("one_more", 4)}
    everything = tables.sel_ndx(spark, str(path), chunk_bytes=chunk).count()
    assert everything == 8


def test_ndx_without_closing_bracket(spark, tmp_path):
    path = tmp_path / "g.ndx"
    path.write_text("[ one\n1 2\n")
    with pytest.raises(Exception, match="missing ]"):
        tables.sel_ndx(spark, str(path)).collect()


def test_parameter_files(spark, tmp_path):
    path = tmp_path / "v.txt"
    path.write_text("1 2 2\n\n 0 0 0 \n3e0 0 4\n")
    q = tables.read_vectors(spark, str(path)).orderBy("q_id").collect()
    assert [(r["q_id"], r["ql"]) for r in q] == [(0, 3.0), (1, 0.0), (2, 5.0)]
    o = tables.read_orientations(spark, str(path)).orderBy("m_id").collect()
    assert tuple(o[1])[1:] == (0.0, 0.0, 0.0) and np.isclose(o[2]["uz"], 0.8)
    path.write_text("0 0\n2 -1\n")
    assert [tuple(r) for r in tables.read_moments(spark, str(path)).orderBy("m_id").collect()] == [(0, 0, 0), (1, 2, -1)]


def test_elements_from_json(spark, tmp_path):
    from workload.tables import ELEMENT_ROWS

    df = tables.element_table(spark, ELEMENT_ROWS)
    out = str(tmp_path / "e.json")
    df.write.json(out)
    again = tables.element_table(spark, out)
    assert again.exceptAll(df).isEmpty() and again.count() == len(ELEMENT_ROWS)
    assert df.where(F.size("sf_params") == 15).count() == 1


@pytest.mark.parametrize("guess", [1, 50, 1 << 16])
def test_text_frames_in_blocks_of_lines(spark, tmp_path, guess):
    (tmp_path / "a.pdb").write_text(pdb_text())
    index = trajectory.build_frame_index(spark, [str(tmp_path / "a.pdb")], "pdb").orderBy("frame").collect()
    with formats.open_file(str(tmp_path / "a.pdb")) as f:
        for r in index[:3]:
            parts = [xyz for _, xyz in formats.pdb_blocks(f, r["byte_offset"], guess)]
            got = np.stack([np.concatenate(c) for c in zip(*parts)], axis=1)
            assert np.allclose(got, FRAMES[r["frame"]])


def test_cells_at_slanted_angles_and_without(spark, tmp_path):
    atom = "ATOM      1 CA   MOL     1       1.000   2.000   3.000\n"
    cell = "CRYST1   11.000   20.000   30.000  80.00  70.00  60.00 P 1\n"
    (tmp_path / "a.pdb").write_text(atom + "END\n" + atom + cell + "END\n" + atom + "END\n")
    (tmp_path / "b.pdb").write_text(atom + "END\n" + atom)
    index = trajectory.join_files(trajectory.build_frame_index(spark, [str(tmp_path / n) for n in ("a.pdb", "b.pdb")], "pdb"))
    cells = {r["frame"]: tuple(r)[1:] for r in trajectory.read_unit_cells(index, "pdb").collect()}
    al, be, ga = np.deg2rad([80, 70, 60])
    slanted = (11, 0, 0, 20 * np.cos(ga), 20 * np.sin(ga), 0, 30 * np.cos(be), 30 * np.cos(al) * np.sin(be), 30 * np.sin(al) * np.sin(be))
    assert len(cells) == 5 and all(np.allclose(cells[f], slanted) for f in range(3)) and all(np.allclose(cells[f], 0) for f in (3, 4))


def test_only_new_and_changed_files_are_scanned(spark, tmp_path, monkeypatch):
    paths = [str(tmp_path / f"{n}.pdb") for n in "abcd"]
    for p in paths[:3]:
        open(p, "w").write(pdb_text())
    trajectory.build_frame_index(spark, paths[:3], "pdb").write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    open(paths[1], "w").write(pdb_text() + pdb_text())
    open(paths[3], "w").write(pdb_text(False))
    now = [paths[3], paths[1], paths[0]]
    scanned, build = [], trajectory.build_frame_index
    monkeypatch.setattr(trajectory, "build_frame_index", lambda s, table, *a, **k: scanned.extend(r["path"] for r in table.collect()) or build(s, table, *a, **k))
    got = trajectory.refresh_frame_index(index, now, "pdb")
    assert sorted(scanned) == [paths[1], paths[3]]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, build(spark, now, "pdb").collect()))
    states = {r["path"]: r["state"] for r in trajectory.index_changes(index, now).collect()}
    assert states == dict(zip(paths, ("same", "changed", "gone", "new")))
    scanned.clear()
    again = trajectory.refresh_frame_index(build(spark, now, "pdb"), now, "pdb")
    assert not scanned and again.count() == got.count()
