"""Amplitudes and signals: physical identities and agreement of the ways to compute them."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scatterloom.functions.waves import PlaneWaves
from scatterloom.operators import align, qspace
from scatterloom.operators.params import local_table
from scatterloom.plans import amplitude, kernel, self_signal, series
from scatterloom.plans.signal import Multipole, Vectors, check_length, read_signal, scatter, write_signal

NF, NA = 12, 6


@pytest.fixture(scope="module")
def world(spark):
    xyz = np.random.default_rng(2).normal(size=(NF, NA, 3)) * 2
    kind = ["A", "B"]
    rows = [(f, a, kind[a % 2], *map(float, p)) for f, fr in enumerate(xyz) for a, p in enumerate(fr)]
    coords = local_table(
        spark, rows, "frame bigint, atom_id bigint, species string, x double, y double, z double"
    )
    q = qspace.q_from_scans(spark, [qspace.scan((0.6, 0.0, 0.8), 0.3, 1.5, 3)])
    f = np.array([[1.0, 0.5], [0.8, 0.25], [0.6, 0.125]])
    factors = local_table(
        spark, [(i, s, float(f[i, k])) for i in range(3) for k, s in enumerate(kind)],
        "q_id bigint, species string, f double",
    )
    return coords, q, factors, xyz, f[:, np.arange(NA) % 2]


QV = np.outer(0.3 + 0.6 * np.arange(3), [0.6, 0.0, 0.8])


def by_frame(df, n_q=3, m=None):
    out = {}
    for r in df.collect():
        key = r["q_id"] if m is None else (r["q_id"], r["m_id"])
        out.setdefault(key, np.zeros(NF, complex))[r["frame"]] = r["re"] + 1j * r["im"]
    return out


@pytest.mark.parametrize("engine", ["kernel", "sql"])
@pytest.mark.parametrize("parts", [1, 5])
def test_coherent_amplitude(world, engine, parts):
    coords, q, factors, xyz, f = world
    got = by_frame(amplitude.amplitude_all(coords.repartition(parts), factors, qspace.subvectors_none(q), engine))
    for i in range(3):
        assert np.allclose(got[i], (f[i] * np.exp(1j * xyz @ QV[i])).sum(1), atol=1e-9)


def test_several_passes_give_the_same(world, monkeypatch):
    coords, q, factors, *_ = world
    sub = qspace.subvectors_sphere(q, qspace.orient_sphere(q.sparkSession, 9, 1))
    once = by_frame(amplitude.amplitude_all(coords, factors, sub), m=True)
    monkeypatch.setattr(kernel, "VECTOR_ROWS", 6)
    tiled = amplitude.amplitude_all(coords.repartition(2), factors, sub)
    assert tiled._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    monkeypatch.setattr(kernel, "PASS_ROWS", 10)
    for engine in ("tiles", "kernel", "sql"):
        many = by_frame(tiled if engine == "tiles" else amplitude.amplitude_all(coords, factors, sub, engine), m=True)
        assert once.keys() == many.keys() and all(np.allclose(once[k], many[k]) for k in once)


def test_one_read_for_many_vectors(world):
    coords, q, factors, *_ = world
    sub = qspace.subvectors_sphere(q, qspace.orient_sphere(q.sparkSession, 14_000, 1))  # 42,000 vectors, three tiles
    df = amplitude.amplitude_all(coords, factors, sub)
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert df.groupBy("q_id").count().orderBy("q_id").collect()[0]["count"] == 14_000 * NF


def test_many_species_make_smaller_passes(world, monkeypatch):
    _, _, factors, *_ = world
    monkeypatch.setattr(kernel, "FACTOR_CELLS", 10)
    assert kernel.pass_rows(factors) == 5 and kernel.pass_rows(factors.where("f > 0")) == 5


def test_partial_sums_are_flushed_at_the_bound(monkeypatch):
    monkeypatch.setattr(kernel, "HELD_CELLS", 20)
    monkeypatch.setattr(kernel, "SLICE_CELLS", 8)
    rng = np.random.default_rng(0)
    q = rng.normal(size=(5, 3))
    frame, xyz = rng.integers(0, 40, 300), rng.normal(size=(3, 300))
    factors = kernel.Factors(pd.DataFrame([("A", i, 1.0 + i) for i in range(5)], columns=["species", "q_id", "f"]), np.arange(5))
    waves = PlaneWaves(q, np.arange(5))
    sums, out = kernel.FrameSums(np.arange(5), np.zeros(5, int)), []
    for lo in range(0, 300, 50):
        cut = slice(lo, lo + 50)
        batch = pa.RecordBatch.from_arrays(
            [pa.array(frame[cut]), pa.array(["A"] * 50), *(pa.array(v[cut]) for v in xyz)],
            ["frame", "species", "x", "y", "z"],
        )
        out += list(kernel.batch_sums(batch, ["x", "y", "z"], factors, waves, sums))
    out += list(sums.flush())
    assert len(out) > 1
    got = pa.Table.from_batches(out).to_pandas().groupby(["q_id", "frame"])[["re", "im"]].sum()
    wave = np.exp(1j * xyz.T @ q.T) * (1.0 + np.arange(5))
    for (i, fr), row in got.iterrows():
        assert np.isclose(row["re"] + 1j * row["im"], wave[frame == fr, i].sum())


def test_missing_factor_fails(world):
    coords, q, factors, *_ = world
    for engine in ("kernel", "sql"):
        with pytest.raises(Exception, match="no factors for species"):
            df = amplitude.amplitude_all(coords, factors.where("species = 'A'"), qspace.subvectors_none(q), engine)
            df.collect()


def test_opposite_vector_gives_the_conjugate(world):
    coords, q, factors, *_ = world
    minus = q.select("q_id", *((-F.col(c)).alias(c) for c in ("qx", "qy", "qz")), "ql")
    a = by_frame(amplitude.amplitude_all(coords, factors, qspace.subvectors_none(q)))
    b = by_frame(amplitude.amplitude_all(coords, factors, qspace.subvectors_none(minus)))
    assert all(np.allclose(a[i], b[i].conj()) for i in a)


def test_intensity_does_not_change_with_a_shift(world):
    coords, q, factors, *_ = world
    moved = coords.withColumn("x", F.col("x") + 3.7).withColumn("z", F.col("z") - 11.0)

    def intensity(c):
        return by_frame(series.square(amplitude.amplitude_all(c, factors, qspace.subvectors_none(q))))

    a, b = intensity(coords), intensity(moved)
    assert all(np.allclose(a[i], b[i]) for i in a)


def debye(xyz, f, ql):
    d = np.linalg.norm(xyz[:, :, None] - xyz[:, None], axis=-1)
    return (np.sinc(ql * d / math.pi) * f[:, None] * f[None, :]).sum((1, 2))


def test_sphere_multipoles_add_up_to_the_debye_sum(world):
    coords, q, factors, xyz, f = world
    s = scatter(coords, q, factors, NF, average=Multipole(qspace.moments_sphere(q.sparkSession, 20)), dsp="square")
    got = {(r["q_id"], r["tau"]): r["re"] for r in s.fqt.collect()}
    for i in range(3):
        want = debye(xyz, f[i], 0.3 + 0.6 * i)
        assert np.allclose([got[i, t] for t in range(NF)], want, atol=1e-9)


def test_many_orientations_come_near_the_debye_sum(world):
    coords, q, factors, xyz, f = world
    s = scatter(coords, q, factors, NF, average=Vectors(qspace.orient_sphere(q.sparkSession, 3000, 5)), dsp="square")
    got = np.mean([r["re"] for r in s.fqt.where("q_id = 1").collect()])
    assert abs(got / debye(xyz, f[1], 0.9).mean() - 1) < 0.03


@pytest.mark.parametrize("axis", [(0.0, 0.0, 1.0), (1.0, 2.0, 2.0)])
def test_cylinder_multipoles_add_up_to_the_circle_average(world, axis):
    coords, q, factors, *_ = world
    spark = q.sparkSession
    one = scatter(coords, q, factors, NF, average=Multipole(qspace.moments_cylinder(spark, 20), "cylinder", axis), dsp="square")
    two = scatter(coords, q, factors, NF, average=Vectors(qspace.orient_raster(spark, 1), "cylinder", axis), dsp="square")
    a = {(r["q_id"], r["tau"]): r["re"] for r in one.fqt.collect()}
    b = {(r["q_id"], r["tau"]): r["re"] for r in two.fqt.collect()}
    assert a.keys() == b.keys() and all(np.isclose(a[k], b[k], atol=1e-8) for k in a)


def correlate(a):
    n = len(a)
    return np.array([np.mean(a[: n - k].conj() * a[k:]) for k in range(n)])


@pytest.mark.parametrize("n", [1, 2, 5, 100, 257])
def test_autocorrelation_ways(spark, n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(2, n)) + 1j * rng.normal(size=(2, n))
    rows = [(k, f, float(a[k, f].real), float(a[k, f].imag)) for k in range(2) for f in range(n)]
    df = local_table(spark, rows, "q_id bigint, frame bigint, re double, im double")
    for options in ({}, {"method": "direct"}, {"in_task": 0}, {"method": "direct", "in_task": 0}, {"method": "direct", "in_task": 90}):
        got = np.zeros((2, n), complex)
        found = series.autocorrelate(df, ["q_id"], n, **options).collect()
        assert len(found) == 2 * n
        for r in found:
            got[r["q_id"], r["frame"]] = r["re"] + 1j * r["im"]
        assert np.allclose(got, [correlate(x) for x in a], atol=1e-10)
        assert np.isclose(got[0, 0].real, np.mean(np.abs(a[0]) ** 2))


def test_missing_frames_count_as_zero(spark):
    df = local_table(spark, [(0, 1, 2.0, 0.0), (0, 3, 4.0, 0.0)], "q_id bigint, frame bigint, re double, im double")
    want = correlate(np.array([0, 2, 0, 4, 0], complex)).real
    for options in ({}, {"in_task": 0}, {"method": "direct", "in_task": 1}):
        rows = series.autocorrelate(df, ["q_id"], 5, **options).orderBy("frame").collect()
        assert np.allclose([r["re"] for r in rows], want)


def test_long_series_spread_over_tasks(spark):
    n = 5000
    a = np.random.default_rng(9).normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"q_id": 0, "frame": np.arange(n), "re": a, "im": 0.0}))
    rows = series.autocorrelate(df, ["q_id"], n, in_task=1000).orderBy("frame").collect()
    assert np.allclose([r["re"] for r in rows], series._correlate_fft(a).real, atol=1e-10)


@pytest.mark.parametrize("dsp", ["plain", "square", "autocorrelate"])
@pytest.mark.parametrize("method", ["fft", "direct"])
def test_self_signal(world, dsp, method):
    coords, q, factors, xyz, f = world
    average = Vectors(qspace.orient_sphere(q.sparkSession, 4, 2))
    s = scatter(coords.repartition(5), q, factors, NF, kind="self", average=average, dsp=dsp, method=method)
    sub = {(r["q_id"], r["m_id"]): np.array([r["qx"], r["qy"], r["qz"]]) for r in qspace.subvectors_sphere(q, average.orientations).collect()}
    got = {(r["q_id"], r["tau"]): r["re"] + 1j * r["im"] for r in s.fqt.collect()}
    means = {r["q_id"]: r for r in s.summary.collect()}
    change = {"plain": lambda a: a, "square": lambda a: np.abs(a) ** 2 + 0j, "autocorrelate": correlate}[dsp]
    for i in range(3):
        moved = np.array([change(f[i, a] * np.exp(1j * xyz[:, a] @ sub[i, m])) for m in range(4) for a in range(NA)])
        assert np.allclose([got[i, t] for t in range(NF)], moved.sum(0) / 4, atol=1e-9)
        mean = moved.mean(1)
        assert np.isclose(means[i]["fq_re"], mean.sum().real / 4)
        assert np.isclose(means[i]["fq2_re"], (np.abs(mean) ** 2).sum() / 4)
        assert np.isclose(means[i]["fq0_re"], moved[:, 0].sum().real / 4)


def test_self_signal_in_several_tiles_is_one_branch(world, monkeypatch):
    coords, q, factors, *_ = world
    sub = qspace.subvectors_sphere(q, qspace.orient_sphere(q.sparkSession, 7, 2))
    once = {tuple(r)[:2]: (r["re"], r["im"]) for r in self_signal.self_sums(coords, factors, sub, NF).collect()}
    monkeypatch.setattr(kernel, "HELD_CELLS", 10 * NF)
    df = self_signal.self_sums(coords, factors, sub, NF)
    many = {tuple(r)[:2]: (r["re"], r["im"]) for r in df.collect()}
    assert once.keys() == many.keys() and all(np.allclose(once[k], many[k]) for k in once)
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning(tile") == 1


def test_factors_must_cover_all_vectors(world):
    coords, q, factors, *_ = world
    with pytest.raises(ValueError, match="some of the vectors"):
        amplitude.amplitude_all(coords, factors.where("not (q_id = 1 and species = 'B')"), qspace.subvectors_none(q))


@pytest.mark.parametrize("dsp", ["plain", "square", "autocorrelate"])
@pytest.mark.parametrize("method", ["fft", "direct"])
def test_long_self_series(world, dsp, method):
    coords, q, factors, *_ = world
    sub = qspace.subvectors_sphere(q, qspace.orient_sphere(q.sparkSession, 3, 2))
    short = coords.where("not (atom_id = 1 and frame > 2)")  # frames that lack an atom
    for rows, sizes in ((coords.repartition(3), (0, 3)), (short, (NF - 1,)), (short.where("frame < 2"), (3,))):
        a = {tuple(r)[:2]: (r["re"], r["im"]) for r in self_signal.self_sums(rows, factors, sub, NF, dsp, method).collect()}
        for in_task in sizes:
            b = {tuple(r)[:2]: (r["re"], r["im"]) for r in self_signal.self_sums(rows, factors, sub, NF, dsp, method, in_task).collect()}
            assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-9) for k in a)


def test_self_series_of_half_a_million_frames(spark):
    n = 1 << 19
    at = lambda k, a: F.sin(F.col("frame") * (0.001 * k + 0.01 * a)) * 2 + F.cos(F.col("frame") * 0.37 * k)
    atom = lambda a: F.struct(F.lit(a).cast("bigint").alias("atom_id"), *(at(k + 1, a).alias(c) for k, c in enumerate("xyz")))
    coords = spark.range(n).select(F.col("id").alias("frame")).select("frame", F.inline(F.array(atom(0), atom(1)))).withColumn("species", F.lit("A"))
    q = np.array([[0.3, 0.1, 0.0], [0.0, 0.5, 0.2]])
    vectors = local_table(spark, [(i, 0, *map(float, v)) for i, v in enumerate(q)], "q_id bigint, m_id bigint, qx double, qy double, qz double")
    factors = local_table(spark, [(i, "A", 2.0) for i in range(len(q))], "q_id bigint, species string, f double")
    sums = self_signal.self_sums(coords, factors, vectors, n, in_task=1 << 17)
    plan = sums._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1  # no table of single-atom series
    got = sums.toPandas()
    assert len(got) == len(q) * (n + 2)
    f = np.arange(n)
    want = np.zeros((len(q), n), complex)
    mean, mean2 = np.zeros(len(q), complex), np.zeros(len(q))
    for a in range(2):
        xyz = np.array([np.sin(f * (0.001 * k + 0.01 * a)) * 2 + np.cos(f * 0.37 * k) for k in (1, 2, 3)])
        c = series._correlate_fft(2.0 * np.exp(1j * (q @ xyz)).T).T
        want += c
        mean += c.mean(1)
        mean2 += np.abs(c.mean(1)) ** 2
    for i in range(len(q)):
        rows = got[got.q_id == i].set_index("tau")
        assert np.allclose((rows.re + 1j * rows.im).loc[f], want[i], atol=1e-8)
        assert np.isclose(rows.re[self_signal.MEAN], mean[i].real, atol=1e-9) and np.isclose(rows.re[self_signal.MEAN_SQUARED], mean2[i], atol=1e-9)


def test_guards(world):
    coords, q, factors, *_ = world
    with pytest.raises(ValueError, match="no frames"):
        scatter(coords, q, factors, 0)
    with pytest.raises(ValueError, match="no atoms"):
        scatter(coords.where("false"), q, factors, NF)
    with pytest.raises(ValueError, match="no scattering vectors"):
        scatter(coords, q.where("false"), factors, NF)
    with pytest.raises(ValueError):
        scatter(coords, q, factors, NF, dsp="cubic")
    with pytest.raises(ValueError):
        scatter(coords, q, factors, NF, kind="both")
    with pytest.raises(ValueError):
        scatter(coords, q, factors, NF, kind="self", average=Multipole(qspace.moments_sphere(q.sparkSession, 1)))


def test_broken_append_is_not_seen_and_can_be_repeated(world, tmp_path):
    coords, q, factors, *_ = world
    path = str(tmp_path / "result")
    spark = q.sparkSession
    write_signal(scatter(coords, q.where("q_id = 0"), factors, NF), path, {"note": "first"})
    rest = scatter(coords, q.where("q_id > 0"), factors, NF)
    # an append that stops after the first of its tables
    rest.fqt.withColumn("run_id", F.lit("broken")).withColumn("q_block", F.lit(0).cast("bigint")).write.mode(
        "append"
    ).partitionBy("q_block").parquet(f"{path}/fqt")
    fqt, fq = read_signal(spark, path)
    assert {r[0] for r in fqt.select("q_id").distinct().collect()} == {0}
    todo = qspace.pending_vectors(q, fq)
    assert sorted(r["q_id"] for r in todo.collect()) == [1, 2]
    write_signal(scatter(coords, todo, factors, NF), path)
    fqt, fq = read_signal(spark, path)
    assert fqt.count() == 3 * NF and fq.count() == 3
    assert qspace.pending_vectors(q, fq).isEmpty()
    assert check_length(fqt, NF).isEmpty() and check_length(fqt, NF + 1).count() == 3
    assert spark.read.parquet(f"{path}/meta").count() == 1


def test_representation_feeds_multipoles(world):
    coords, *_ = world
    ball = align.with_representation(coords, "spherical")
    assert ball.columns == ["frame", "atom_id", "species", "r", "phi", "theta"]
    assert ball.where("phi < 0 or phi >= 6.283185307179587 or theta < 0").isEmpty()
