"""Chains of rigid steps: composed maps against one step after the other, reads of files, joins without a shuffle."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterloom.functions import vec
from scatterloom.operators import align, motions, rigid, staging
from scatterloom.plans.coordinates import prepare_coordinates
from scatterloom.operators.selections import Selections, sel_range

FRAMES, ATOMS = 12, 9


def coordinates(spark, frames=FRAMES, atoms=ATOMS):
    """Tagged coordinates with the overlapping selections a (0..4), b (3..6) and none."""
    number = F.col("frame") * atoms + F.col("atom_id")
    rows = spark.range(frames * atoms).select((F.col("id") / atoms).cast("bigint").alias("frame"), (F.col("id") % atoms).alias("atom_id"))
    return rows.select(
        "*", *((F.sin(number * k) * 3 + k).alias(c) for c, k in zip("xyz", (1.0, 1.7, 2.3))), (F.col("atom_id") + 1.0).alias("mass"),
        F.col("atom_id").between(0, 4).alias("in_a"), F.col("atom_id").between(3, 6).alias("in_b"), F.lit(False).alias("in_none"),
    )


def steps_of(spark, df):
    """All kinds of steps, as steps and as functions of arrays by frame."""
    ref, part = rigid.Reference.of(align.reference_coords(df, 2)), rigid.Reference.of(align.reference_coords(df, 1, "b"))
    shifts = spark.range(0, FRAMES, 2).select(F.col("id").alias("frame"), *((F.col("id") * k).cast("double").alias(c) for c, k in zip(rigid.SHIFT, (0.1, -0.2, 0.3))))
    turns = motions.rotation_walk(motions.rotation_steps(spark, FRAMES - 1, 20.0, seed=3), 4)
    return [
        rigid.Centre("system", "a"), rigid.Shift(motions.linear(0.2, (1.0, 2.0, 0.0)), "b"), rigid.Fit(ref, "a"), rigid.Shift(shifts, "a"), rigid.Turn(turns, "b", None, "a"),
        rigid.Onto(part, "a"), rigid.Fit(part, "system", "b", apply_to="selection"), rigid.Turn(turns, "a", part), rigid.Fit(part, "a", "b", True),
        rigid.Shift(motions.oscillation(0.5, 0.1)), rigid.Onto(None, "b"), rigid.Centre("b", "none"), rigid.Centre("none", "a"),
    ]


def to_array(df):
    rows = df.orderBy("frame", "atom_id").collect()
    return np.array([[r["x"], r["y"], r["z"]] for r in rows]).reshape(-1, ATOMS, 3)


def plain(spark, df, steps):
    """One step after the other, on arrays."""
    x = to_array(df)
    m = np.arange(1.0, ATOMS + 1)
    sel = {"system": np.ones(ATOMS, bool), "a": np.arange(ATOMS) <= 4, "b": (np.arange(ATOMS) >= 3) & (np.arange(ATOMS) <= 6), "none": np.zeros(ATOMS, bool)}
    com = lambda v, of: (m[of, None] * v[of]).sum(0) / m[of].sum() if of.any() else np.zeros(3)
    for s in steps:
        given = {}
        if isinstance(s, (rigid.Shift, rigid.Turn)):
            told = s.per_frame()
            table = told if not isinstance(told, dict) else spark.range(FRAMES).select(F.col("id").alias("frame")).select("frame", *(e.alias(c) for c, e in told.items()))
            given = {r["frame"]: np.array(tuple(r)[1:]) for r in table.collect()}
        for f, v in enumerate(x):
            of = sel[s.selection]
            if isinstance(s, rigid.Centre):
                v[of] -= com(v.copy(), sel[s.reference_selection])
            elif isinstance(s, rigid.Onto):
                v[of] += (com(v, sel["system"]) if s.target is None else np.array(s.target.centre)) - com(v, of)
            elif isinstance(s, rigid.Shift) and f in given:
                v[of] += given[f]
            elif isinstance(s, rigid.Turn) and f in given:
                c = com(v, sel[s.reference_selection]) if s.about is None else np.array(s.about.centre)
                v[of] = (v[of] - c) @ given[f].reshape(3, 3) + c
            elif isinstance(s, rigid.Fit):
                u = {r["atom_id"]: (r["ux"], r["uy"], r["uz"]) for r in s.reference.coords.collect()}
                at = np.array(sorted(u))
                own, to = (m[at, None] * v[at]).sum(0) / m[at].sum(), np.array(s.reference.centre)
                k = np.einsum("n,na,nb->ab", m[at], np.array([u[i] for i in at]) - to, v[at] - own)
                turn = rigid.best_rotations(k[None])[0].T
                moved = of & sel[s.reference_selection] if s.apply_to == "common" else of
                v[moved] = (v[moved] - own) @ turn + (own if s.keep_centre else to)
    return x


@pytest.mark.parametrize("as_table", [False, True])
def test_chain_equals_one_step_after_the_other(spark, as_table, monkeypatch):
    df = coordinates(spark)
    steps = steps_of(spark, df)
    want = plain(spark, df, steps)
    if as_table:  # as with more frames than the driver takes
        monkeypatch.setattr(rigid, "localize", lambda table: table)
    moved = rigid.move(df, steps, None if as_table else FRAMES)
    assert moved.columns == df.columns
    assert np.allclose(to_array(moved), want, atol=1e-9)


def test_prepared_coordinates_compose_runs_of_steps(spark):
    df = coordinates(spark)
    atoms = df.where("frame = 0").select("atom_id", "mass")
    named = Selections(atoms)
    named.add("a", sel_range(atoms, 0, 4)).add("b", sel_range(atoms, 3, 6))
    ref = rigid.Reference.of(align.reference_coords(df, 0, "b"))
    pre, moving, post = [rigid.Centre("system", "a"), lambda d: align.align_center(d, "b", "a")], [rigid.Shift(motions.linear(0.3), "a")], [rigid.Fit(ref, "system", "b", apply_to="selection")]
    made = prepare_coordinates(df.select("frame", "atom_id", "x", "y", "z"), atoms, named, pre=pre, motions=moving, post=post, uses=["system", "a", "b"], n_frames=FRAMES)
    want = plain(spark, df, [pre[0], rigid.Centre("b", "a"), *moving, *post])
    assert np.allclose(to_array(made), want, atol=1e-9)


def bytes_read(spark):
    return sum(e.totalInputBytes() for e in (lambda s: [s.apply(i) for i in range(s.size())])(spark._jsc.sc().statusStore().executorList(False)))


def test_a_chain_of_any_length_reads_the_files_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    coordinates(spark, 2000).repartition(4).write.parquet(path)
    df = spark.read.parquet(path)
    cost = {}
    for k in (1, 6):
        before = bytes_read(spark)
        steps = [rigid.Centre("system", "a"), rigid.Shift(motions.linear(0.1), "b")] * k
        moved = rigid.move(df, steps, 2000)
        moved.write.format("noop").mode("overwrite").save()
        cost[k] = bytes_read(spark) - before
        plan = moved._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall("FileScan parquet", plan)) == 1 and plan.count("BroadcastHashJoin") == 1
    before = bytes_read(spark)
    df.write.format("noop").mode("overwrite").save()
    once = bytes_read(spark) - before
    assert once > 0 and cost[1] <= 2.1 * once and cost[6] <= 2.1 * once


def test_a_million_frames_in_buckets_are_not_shuffled(spark):
    """Steps one by one, each a table of a million rows, on coordinates that were brought together by frame once."""
    n = 1_000_000
    df = spark.range(2 * n).select((F.col("id") % n).alias("frame"), F.expr(f"id div {n}").alias("atom_id"), *(F.sin(F.col("id") * k).alias(c) for c, k in zip("xyz", (1.0, 2.0, 3.0))))
    df = staging.cluster_by_frame(df.withColumn("mass", F.lit(1.0)).withColumn("in_a", F.col("atom_id") == 0), 8)
    moved = rigid.move(df, [rigid.Centre("system", "a"), rigid.Shift(motions.linear(0.5), "a")], n, 8)
    moved = rigid.move(moved, [rigid.Centre("a", "a")], n, 8)
    shifts = motions.walk(motions.randomwalk_steps(spark, n, 0.1, seed=2))
    moved = align.join_per_frame(moved, shifts, n, 8)
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 3
    got = moved.where("atom_id = 0").agg(F.count("*"), F.max(F.abs("x") + F.abs("y") + F.abs("z")), F.count("tx")).first()
    assert tuple(got) == (n, 0.0, n)
    other = moved.where("atom_id = 1 and frame < 1000").join(df.where("atom_id = 0").select("frame", F.col("x").alias("ox")), "frame").join(df.where("atom_id = 1").select("frame", F.col("x").alias("nx")), "frame")
    assert other.where(F.abs(F.col("x") - (F.col("nx") - F.col("ox"))) > 1e-9).isEmpty() and other.count() == 1000


def test_fit_of_frames_without_reference_atoms(spark):
    df = coordinates(spark)
    ref = rigid.Reference.of(align.reference_coords(df, 0, "b"))
    gone = df.where("not (frame = 3 and in_b)")
    moved = rigid.move(gone, [rigid.Fit(ref, apply_to="selection")], FRAMES)
    same = moved.where("frame = 3").join(gone.select("frame", "atom_id", F.col("x").alias("ox")), ["frame", "atom_id"])
    assert same.count() == ATOMS - 4 and same.where("x <> ox").isEmpty()
    with pytest.raises(ValueError, match="same atoms"):
        rigid.move(df.where("not (frame = 3 and atom_id = 4)"), [rigid.Fit(ref)], FRAMES)


def test_no_steps_and_bad_arguments(spark):
    df = coordinates(spark)
    assert rigid.move(df, []) is df
    with pytest.raises(ValueError):
        rigid.Fit(None, apply_to="some")
    shift = vec.literal((1.0, 0.0, 0.0))
    assert np.allclose(to_array(rigid.move(df, [rigid.Shift(shift)], FRAMES)), to_array(df) + (1.0, 0.0, 0.0))
