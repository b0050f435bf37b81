"""Input that must not pass silently, and ways that must not differ."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterloom.operators import align, frames, qspace
from scatterloom.operators.params import local_table
from scatterloom.plans import self_signal, series
from scatterloom.plans.signal import read_signal, resume, scatter, write_signal
from scatterloom.sources import files, formats, trajectory
from test_signals import NF, world  # noqa: F401
from test_sources import FRAMES, as_array, pdb_text
from workload.tables import dcd_bytes

COORDS = "frame bigint, atom_id bigint, x double, y double, z double"


def table(spark, path, frames=4, shift=0.0, parts=3):
    rows = [(f, a, f + a / 10 + shift, 0.0, 1.0) for f in range(frames) for a in range(2)]
    local_table(spark, rows, COORDS).repartition(parts).write.parquet(path)


@pytest.mark.parametrize("clones", [0, 1, 3])
def test_parquet_clones(spark, tmp_path, clones):
    path = str(tmp_path / "t")
    table(spark, path)
    df = trajectory.read_frames(spark, path, "parquet", first=1, clones=clones)
    got = sorted((r["frame"], r["atom_id"], r["x"]) for r in df.collect())
    assert got == [(k * 3 + f - 1, a, f + a / 10) for k in range(clones) for f in range(1, 4) for a in range(2)]


def test_parquet_tables_of_a_list(spark, tmp_path):
    for name, shift in (("b", 0.0), ("a", 100.0)):
        table(spark, str(tmp_path / name), shift=shift)
    (tmp_path / "list").write_text(f"{tmp_path}/b {tmp_path}/a\n")
    df = trajectory.read_frame_list(spark, str(tmp_path / "list"), "parquet", clones=2)
    firsts = [r["x"] for r in df.where("atom_id = 0").orderBy("frame").collect()]
    assert firsts == [float(f) for f in range(4)] * 2 + [100.0 + f for f in range(4)] * 2


def test_folders_below_folders(spark, tmp_path):
    for name in ("x/2/a.pdb", "x/1/b.pdb", "x/_temporary/c.pdb", "x/.hidden/d.pdb", "x/1/_SUCCESS"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(pdb_text())
    df = trajectory.read_frames(spark, str(tmp_path / "x"), "pdb")
    assert np.allclose(as_array(df), np.concatenate([FRAMES, FRAMES]))
    assert [p.rsplit("/", 2)[1:] for p in files.list_folder(str(tmp_path / "x"))] == [["1", "b.pdb"], ["2", "a.pdb"]]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError, match="no data files"):
        files.paths_table(spark, str(tmp_path / "empty"))


@pytest.mark.parametrize("change", [b"more", b"fewer"])
def test_dcd_head_is_held_against_the_file(spark, tmp_path, change):
    data = bytearray(dcd_bytes(list(FRAMES)))
    data[8] = {b"more": 4, b"fewer": 2}[change]
    (tmp_path / "a.dcd").write_bytes(data)
    with pytest.raises(Exception, match="its head names"):
        trajectory.read_frames(spark, str(tmp_path / "a.dcd"), "dcd").collect()


def test_names_on_a_very_long_line(spark, tmp_path):
    names = [f"f{i}" for i in range(70_000)]
    (tmp_path / "list").write_text("first\n" + " ".join(names) + "\n# none\nlast\n")
    rows = trajectory.frameset_list(spark, str(tmp_path / "list")).orderBy("ord").collect()
    assert [r["path"] for r in rows] == ["first", *names, "last"]
    assert [r["ord"] for r in rows] == list(range(70_002))


def test_formats_are_told_from_blocks(tmp_path):
    path = tmp_path / "f"
    for data, found in ((b"x" * 5000 + b"\nATOM  1", True), (b"ATOM  1", True), (b"y" * 7000 + b"ATOM  ", False), (b"", False)):
        path.write_bytes(data)
        for block in (7, 1000, 1 << 20):
            assert formats.is_pdb(str(path), block) is found


def test_many_tables_are_one_scan(spark, tmp_path):
    sizes = [3, 1, 4, 1, 5, 2]
    for k, n in enumerate(sizes):
        table(spark, str(tmp_path / f"t{k}"), frames=n, shift=100.0 * k)
    paths = [str(tmp_path / f"t{k}") for k in (0, 1, 2, 3, 4, 5, 2)]
    for cut in ({}, {"first": 1}, {"first": 1, "last": 3, "stride": 2, "clones": 2}):
        df = trajectory.read_frames(spark, paths, "parquet", **cut)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1
        first, last, stride, clones = (cut.get(k, d) for k, d in (("first", 0), ("last", 99), ("stride", 1), ("clones", 1)))
        want, frame = [], 0
        for k in (0, 1, 2, 3, 4, 5, 2):
            kept = [f for f in range(sizes[k]) if first <= f <= last and f % stride == 0]
            for _ in range(clones):
                want += [(frame + i, a, f + a / 10 + 100.0 * k) for i, f in enumerate(kept) for a in range(2)]
                frame += len(kept)
        got = sorted((r["frame"], r["atom_id"], r["x"]) for r in df.collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_frames_are_looked_up_by_ranges(spark):
    sets = [(0, 0, 3), (1, 3, 0), (2, 3, 400), (3, 403, 1), (4, 500, 7)]
    table = local_table(spark, sets, "frameset bigint, offset bigint, n bigint")
    df = spark.range(0, 520, 3).select(F.col("id").alias("frame"), F.lit("x").alias("offset"))
    got = sorted(tuple(r) for r in frames.locate_frames(df, table).collect())
    assert got == [(f, "x", s, f - o) for f in range(0, 520, 3) for s, o, n in sets if o <= f < o + n]
    assert frames.locate_frames(df, table.where("n = 0")).isEmpty()


@pytest.mark.parametrize("frame", [-1, 5])
@pytest.mark.parametrize("in_task", [0, 1 << 18])
def test_frames_out_of_range_raise(spark, frame, in_task):
    rows = [(0, f, 1.0, 0.0) for f in range(5)] + [(0, frame, 9.0, 0.0)]
    df = local_table(spark, rows, "q_id bigint, frame bigint, re double, im double")
    with pytest.raises(Exception, match="in a series of 5"):
        series.autocorrelate(df, ["q_id"], 5, in_task=in_task).collect()


@pytest.mark.parametrize("in_task", [0, 1 << 18])
def test_two_values_for_a_frame_raise(spark, world, in_task):  # noqa: F811
    df = local_table(spark, [(0, 1, 1.0, 0.0), (0, 1, 2.0, 0.0)], "q_id bigint, frame bigint, re double, im double")
    with pytest.raises(Exception, match="two values"):
        series.autocorrelate(df, ["q_id"], 5, in_task=in_task).collect()
    coords, q, factors, *_ = world
    twice = coords.unionByName(coords.where("frame = 3 and atom_id = 1"))
    with pytest.raises(Exception, match="two values"):
        self_signal.self_sums(twice, factors, qspace.subvectors_none(q), NF, in_task=in_task).collect()


@pytest.mark.parametrize("kind", ["all", "self"])
def test_coordinates_out_of_range_raise(world, kind):  # noqa: F811
    coords, q, factors, *_ = world
    for moved in (F.col("frame") - 1, F.col("frame") + 1):
        with pytest.raises(Exception, match=f"in a series of {NF}"):
            scatter(coords.withColumn("frame", moved), q, factors, NF, kind=kind).fqt.collect()


def test_direct_runs_at_any_length(spark):
    n = 9000
    a = np.random.default_rng(3).normal(size=n)
    df = local_table(spark, [(0, f, float(x), 0.0) for f, x in enumerate(a)], "q_id bigint, frame bigint, re double, im double")
    want = np.correlate(a, a, "full")[n - 1 :] / (n - np.arange(n))
    for in_task in (series.SERIES_IN_TASK, 1000):
        got = series.autocorrelate(df, ["q_id"], n, "direct", in_task=in_task).orderBy("frame").collect()
        assert np.allclose([r["re"] for r in got], want)


def test_resume_from_nothing_to_nothing_left(world, tmp_path):  # noqa: F811
    coords, q, factors, *_ = world
    spark, path = q.sparkSession, str(tmp_path / "result")
    fqt, fq = read_signal(spark, path)
    assert fqt.isEmpty() and fq.isEmpty()
    assert resume(coords, q.where("q_id < 2"), factors, NF, path, {"run": 1}) is not None
    assert resume(coords, q, factors, NF, path) is not None
    assert resume(coords, q, factors, NF, path) is None
    want = {(r["q_id"], r["tau"]): (r["re"], r["im"]) for r in scatter(coords, q, factors, NF).fqt.collect()}
    found = read_signal(spark, path)[0].collect()
    assert len(found) == len(want) and all(np.allclose((r["re"], r["im"]), want[r["q_id"], r["tau"]]) for r in found)


def test_no_append_of_another_length(world, tmp_path):  # noqa: F811
    coords, q, factors, *_ = world
    path = str(tmp_path / "result")
    write_signal(scatter(coords, q.where("q_id = 0"), factors, NF), path)
    longer = scatter(coords, q.where("q_id = 1"), factors, NF + 1)
    with pytest.raises(ValueError, match="lags"):
        write_signal(longer, path)
    assert read_signal(q.sparkSession, path)[0].count() == NF


def test_reference_reads_one_frame(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, path, frames=30)
    df = spark.read.parquet(path).withColumn("mass", F.lit(1.0))
    for frame, n, want in ((0, None, 0), (7, 30, 7), (99, 30, 29), (99, None, 29)):
        rows = align.reference_coords(df, frame, n_frames=n).orderBy("atom_id").collect()
        assert [r["ux"] for r in rows] == [want, want + 0.1]
    fitted = align.align_fitrottrans(df, align.reference_coords(df, 0), n_frames=30)
    plan = fitted._jdf.queryExecution().executedPlan().toString()
    # the reference and the sums of the frames travel with the plan
    assert len(re.findall("FileScan parquet", plan)) == 1 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("n_frames", [30, None])
def test_chains_of_steps_plan_one_scan(spark, tmp_path, n_frames):
    path = str(tmp_path / "t")
    table(spark, path, frames=30)
    df = spark.read.parquet(path).withColumn("mass", F.lit(1.0)).withColumn("in_first", F.col("atom_id") == 0)
    for k in range(1, 6):
        df = align.align_center(df, reference_selection="first" if k % 2 else "system", n_frames=n_frames)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall("FileScan parquet", plan)) == 1 and plan.count("BroadcastHashJoin") == k
    rows = {(r["frame"], r["atom_id"]): r["x"] for r in df.collect()}
    assert len(rows) == 60 and all(np.allclose((rows[f, 0], rows[f, 1]), (0.0, 0.1)) for f in range(30))

