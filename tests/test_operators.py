"""Operators against brute force on small fixtures, and their errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterloom.operators import align, elements, frames, motions, params, qspace, selections, staging
from scatterloom.operators.params import local_table
from scatterloom.operators.prefix import running_total
from scatterloom.scratch import scratch_root
from scatterloom.sources.tables import element_table
from workload import tables as t


def coords(spark, xyz):
    rows = [(f, a, *map(float, p)) for f, frame in enumerate(xyz) for a, p in enumerate(frame)]
    return local_table(spark, rows, "frame bigint, atom_id bigint, x double, y double, z double")


@pytest.fixture(scope="module")
def small(spark):
    return np.random.default_rng(5).normal(size=(6, 5, 3)) * 4


def test_running_total(spark):
    v = np.random.default_rng(0).normal(size=1000)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i bigint, v double")
    for block in (1, 7, 64, 5000):
        got = [r["v"] for r in running_total(df, "i", ["v"], block=block).orderBy("i").collect()]
        assert np.allclose(got, np.cumsum(v))


def test_trim_is_relative_to_the_original_numbers(spark):
    df = spark.range(20).withColumnRenamed("id", "frame").withColumn("old", F.col("frame"))
    got = frames.trim_frames(df, 4, 16, 3).orderBy("frame").collect()
    assert [(r["frame"], r["old"]) for r in got] == [(0, 6), (1, 9), (2, 12), (3, 15)]
    assert frames.trim_frames(df, 30).count() == 0


def test_no_clones_no_frames(spark):
    df = spark.range(3).withColumnRenamed("id", "frame")
    assert frames.clone_frames(df, 0).count() == 0
    with pytest.raises(ValueError):
        frames.clone_frames(df, -1)


def test_selection_errors(spark):
    atoms = spark.range(5).withColumnRenamed("id", "atom_id")
    with pytest.raises(ValueError):
        selections.sel_range(atoms, 3, 2)
    named = selections.Selections(atoms).add("a", selections.sel_index(atoms, [4, 0, 4]))
    assert named["a"].count() == 2
    with pytest.raises(ValueError, match="twice"):
        named.add("a", atoms)
    with pytest.raises(KeyError, match="unknown"):
        named["b"]
    with pytest.raises(ValueError):
        selections.sel_pdb(atoms, "name")


def test_ambiguous_and_unknown_names_fail(spark):
    atoms = local_table(spark, [(0, "AB")], "atom_id bigint, pdb_name string")
    table = t.elements(spark, {"A": "A.*", "B": ".*B", "C": "C", "N": "N", "R": "R"})
    with pytest.raises(Exception, match="matches 2 elements"):
        elements.resolve_labels(atoms, table).collect()
    atoms = local_table(spark, [(0, "Z")], "atom_id bigint, pdb_name string")
    with pytest.raises(Exception, match="matches 0 elements"):
        elements.resolve_labels(atoms, table).collect()


def test_unknown_type_codes_fail(spark):
    table = element_table(spark, [("A", "A", 1.0, 7, [1.0], 1, [1.0], 0, [1.0])])
    assert [r["problem"] for r in elements.validate_elements(table).collect()] == ["volume type not known"]
    species = elements.species_table(table.select("label"), table)
    with pytest.raises(Exception, match="volume type not known"):
        elements.effective_factors(species, qspace.q_single(spark), 1.0).collect()


def test_background_may_be_a_query(spark):
    atoms = local_table(spark, [("A",), ("A",), ("B",)], "label string")
    table = t.elements(spark)
    density = elements.background_density(atoms, table)
    q = qspace.q_single(spark, 0.0)
    species = elements.species_table(atoms, table)
    f = elements.effective_factors(species, q, density.scalar())
    by = {r["species"]: r["f"] for r in f.collect()}
    assert np.isclose(2 * by["A"] + by["B"], 0.0)  # the mean contrast vanishes


def test_scans(spark):
    def lengths(*scans):
        return [r["ql"] for r in qspace.q_from_scans(spark, list(scans)).orderBy("q_id").collect()]

    assert lengths(qspace.scan(points=0)) == []
    assert lengths(qspace.scan(lo=1.0, hi=2.0, points=1)) == [1.5]
    assert lengths(qspace.scan(lo=1.0, hi=2.0, points=2)) == [1.0, 2.0]
    assert np.allclose(lengths(qspace.scan(lo=0.0, hi=4.0, points=5, exponent=2.0)), [0, 0.25, 1, 2.25, 4])
    assert lengths(qspace.scan(points=3), qspace.scan(points=0)) == []
    with pytest.raises(ValueError):
        lengths(*[qspace.scan(points=2)] * 4)


def test_moments(spark):
    assert qspace.moments_sphere(spark, 20).count() == 441
    got = [tuple(r) for r in qspace.moments_sphere(spark, 2).orderBy("m_id").collect()]
    assert got == [(i, l, m) for i, (l, m) in enumerate((l, m) for l in range(3) for m in range(-l, l + 1))]
    got = [tuple(r)[1:] for r in qspace.moments_cylinder(spark, 2).orderBy("m_id").collect()]
    assert got == [(0, 0)] + [(l, m) for l in (1, 2) for m in range(4)]
    assert qspace.validate_moments(qspace.moments_cylinder(spark, 5), "cylinder").isEmpty()


def test_large_parameter_tables_take_several_passes(spark):
    left, right = spark.range(4), spark.range(50).withColumnRenamed("id", "k")
    assert len(params.bounded_parts(right, ["k"], 10)) == 10
    got = {tuple(r) for r in params.fan_out(left, right, ["k"], 10).collect()}
    assert got == {(i, k) for i in range(4) for k in range(50)}


def test_spread_frames_splits_a_hot_frame(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).cast("bigint").alias("frame"),
        # the large frame consists of copies of one row
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("atom_id"),
    )
    out = staging.spread_frames(df, 16).withColumn("p", F.spark_partition_id())
    assert out.drop("p").exceptAll(df).isEmpty() and out.count() == 30000
    assert out.where("frame = 7").select("p").distinct().count() > 8
    assert out.where("frame = 8").select("p").distinct().count() == 1
    assert out.groupBy("p").count().agg(F.max("count")).first()[0] < 2 * 30000 / 16


def test_spread_frames_deals_a_frame_in_few_parts(spark):
    # twenty frames, all of them larger than a quarter of a task's share
    df = spark.range(20000).select(F.expr("id % 20").alias("frame"), F.col("id").alias("atom_id"))
    for out in (staging.spread_frames(df, 16), staging.split_frames(df, 16)[1]):
        assert out.exceptAll(df).isEmpty() and out.count() == 20000
        parts = out.withColumn("p", F.spark_partition_id()).select("frame", "p").distinct()
        assert 20 < parts.count() <= 8 * 16


def test_split_frames_keeps_frames_whole_or_deals_them(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1000 == 5, None).otherwise(F.col("id") % 1000).cast("bigint").alias("frame"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("atom_id"),
    )
    whole, dealt = staging.split_frames(df, 16)
    assert whole.unionByName(dealt).exceptAll(df).isEmpty() and whole.count() + dealt.count() == 30000
    assert {r["frame"] for r in dealt.select("frame").distinct().collect()} == {7}
    places = [tuple(r) for r in whole.withColumn("p", F.spark_partition_id()).select("frame", "p").distinct().collect()]
    assert len(places) == len({frame for frame, _ in places}) and None in {frame for frame, _ in places}
    assert dealt.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 8
    even, rest = staging.split_frames(df.where("frame > 7"), 16)
    assert rest is None and even.exceptAll(df.where("frame > 7")).isEmpty() and even.count() == df.where("frame > 7").count()


def test_frame_ranges_are_contiguous_and_sorted(spark, small):
    rows = staging.stage_frames(coords(spark, small), 3).withColumn("p", F.spark_partition_id()).collect()
    got = [(r["p"], r["frame"], r["atom_id"]) for r in rows]
    assert got == sorted(got)
    assert [k[1:] for k in got] == [(f, a) for f in range(6) for a in range(5)]


def test_staging_orders(spark, small):
    df = coords(spark, small)
    rows = staging.stage_atoms(df, 2).withColumn("p", F.spark_partition_id()).collect()
    place = {}
    for r in rows:
        place.setdefault(r["atom_id"], set()).add(r["p"])
    assert all(len(p) == 1 for p in place.values())
    got = [(r["p"], r["atom_id"], r["frame"]) for r in rows]
    assert got == sorted(got)


def test_xyz_dump(spark, small, tmp_path):
    out = str(tmp_path / "xyz")
    staging.write_xyz(coords(spark, small), out, 3)
    text = "".join(p.read_text() for p in sorted((tmp_path / "xyz").glob("part-*"))).splitlines()
    assert len(text) == 6 * 7
    for f in range(6):
        head, comment, *body = text[7 * f : 7 * f + 7]
        assert head == "5" and comment == f"frame {f}"
        got = np.array([[float(w) for w in line.split()] for line in body])
        assert np.allclose(got[:, 1:], small[f]) and list(got[:, 0]) == list(range(5))


def with_mass(spark, xyz, masses):
    atoms = local_table(spark, [(i, float(m)) for i, m in enumerate(masses)], "atom_id bigint, mass double")
    return align.tagged(coords(spark, xyz), atoms)


def test_center_of_empty_selection_is_the_origin(spark, small):
    df = with_mass(spark, small, range(1, 6)).withColumn("in_none", F.lit(False))
    assert {tuple(r)[1:] for r in align.center_of_mass(df, "none").collect()} == {(0.0, 0.0, 0.0)}


def to_array(df):
    rows = df.orderBy("frame", "atom_id").collect()
    n = len({r["frame"] for r in rows})
    return np.array([[r["x"], r["y"], r["z"]] for r in rows]).reshape(n, -1, 3)


def best_rotation(v, u, m):
    """Reference solution by quaternions, independent of the decomposition under test."""
    k = (m[:, None] * v).T @ u
    d = np.array([k[1, 2] - k[2, 1], k[2, 0] - k[0, 2], k[0, 1] - k[1, 0]])
    n = np.zeros((4, 4))
    n[0, 0] = np.trace(k)
    n[0, 1:] = n[1:, 0] = d
    n[1:, 1:] = k + k.T - np.trace(k) * np.eye(3)
    w, x, y, z = np.linalg.eigh(n)[1][:, -1]
    return np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ])


def test_least_squares_fit(spark, small):
    m = np.arange(1.0, 6.0)
    df = with_mass(spark, small, m)
    ref = align.reference_coords(df, 2)
    got = to_array(align.align_fitrottrans(df, ref, n_frames=6))
    ref_com = (m[:, None] * small[2]).sum(0) / m.sum()
    for f in range(6):
        com = (m[:, None] * small[f]).sum(0) / m.sum()
        r = best_rotation(small[f] - com, small[2] - ref_com, m)
        assert np.allclose(got[f], (small[f] - com) @ r.T + ref_com, atol=1e-9)
    turned = to_array(align.align_fitrot(df, ref, n_frames=6))
    assert np.allclose((m[:, None] * turned).sum(1), (m[:, None] * small).sum(1))


def test_fit_needs_the_same_atoms(spark, small):
    df = with_mass(spark, small, range(1, 6))
    ref = align.reference_coords(df, 0)
    short = df.where("not (frame = 3 and atom_id = 4)")
    with pytest.raises(Exception, match="same atoms"):
        align.align_fitrottrans(short, ref).collect()


def test_rotation_walk_is_the_ordered_product(spark):
    steps = motions.rotation_steps(spark, 50, 20.0, seed=4)
    angles = np.array([tuple(r)[1:] for r in steps.orderBy("frame").collect()])
    want, total = [], np.eye(3)
    for m in motions._turns(angles):
        total = total @ m
        want.append(total)
    for block in (1, 8, 64):
        rows = motions.rotation_walk(steps, block).orderBy("frame").collect()
        got = np.array([[r[c] for c in align.MATRIX] for r in rows]).reshape(-1, 3, 3)
        assert np.allclose(got, want)


def test_rotation_about_the_centre_keeps_it(spark, small):
    m = np.arange(1.0, 6.0)
    moved = to_array(motions.motion_rotbrownian(with_mass(spark, small, m), 6, 30.0, seed=1))
    assert not np.allclose(moved, small)
    assert np.allclose((m[:, None] * moved).sum(1), (m[:, None] * small).sum(1))


def test_scratch_folder_comes_from_the_session(spark, tmp_path):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert scratch_root(spark) == named.rstrip("/")
    else:
        assert scratch_root(spark) == scratch_root(spark)
        spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))
        assert str(tmp_path / "shared") in scratch_root(spark)


def test_totals_are_a_tree_without_one_task_for_all(spark):
    n = 300
    df = spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("v"))
    out = running_total(df, "i", ["v"], block=4, n=n)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Window [") == 5 and "SinglePartition" not in plan  # 300, 75, 19, 5 and 2 places
    assert np.allclose([r["v"] for r in out.orderBy("i").collect()], np.cumsum(np.arange(n) % 7))
    sparse = running_total(df.where("i % 50 = 3"), "i", ["v"], block=4, n=n).orderBy("i").collect()
    assert np.allclose([r["v"] for r in sparse], np.cumsum([i % 7 for i in range(3, n, 50)]))
    with pytest.raises(Exception, match="in an order of 299"):
        running_total(df, "i", ["v"], n=n - 1).collect()


def test_rotations_multiply_up_in_a_tree(spark):
    steps = motions.rotation_steps(spark, 50, 20.0, seed=4)
    want = {tuple(r)[0]: tuple(r)[1:] for r in motions.rotation_walk(steps, 64, 50).collect()}
    walked = motions.rotation_walk(steps, 3, 50)
    plan = walked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FlatMapGroupsInPandas") >= 4
    got = {tuple(r)[0]: tuple(r)[1:] for r in walked.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)


def test_patterns_with_letters_in_front_meet_names_by_these(spark):
    patterns = {"H": "H.*", "HE": "HE", "C": "C[A-Z]?", "CL": "CL+", "N": "N?", "X": "A|B", "O": "O{2}", "one": "[0-9]H"}
    names = ["H", "HE", "H1", "C", "CA", "CL", "CLL", "CLLL", "", "N", "A", "B", "OO", "O", "1H", "H|", "CAA"]
    table = spark.createDataFrame(list(patterns.items()), "label string, name_regex string")
    atoms = spark.createDataFrame([(n,) for n in [*names, None]], "pdb_name string")
    import re

    want = {n: sum(re.fullmatch(p, n) is not None for p in patterns.values()) for n in names} | {None: 0}
    assert {r["pdb_name"]: r["n_elements"] for r in elements.match_counts(atoms, table, "pdb_name").collect()} == want
    begun = elements._patterns(table).where("__prefix <> ''")
    assert {r["label"]: r["__prefix"] for r in begun.collect()} == {"H": "H", "HE": "HE", "C": "C", "CL": "C"}
