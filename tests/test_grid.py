"""Amplitudes on a grid by a nonuniform transform against the sum over atoms and vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterloom.operators.params import local_table
from scatterloom.plans import amplitude, grid, kernel

SKEW = ((0.31, 0.02, 0.0), (0.05, 0.27, -0.03), (0.0, 0.04, 0.4))


@pytest.mark.parametrize("counts", [(16, 16, 16), (1, 1, 1), (5, 1, 12), (3, 7, 2)])
@pytest.mark.parametrize("origin", [(0.0, 0.0, 0.0), (-2.0, 0.7, 1.3)])
def test_transform_is_the_sum(counts, origin):
    xyz = np.random.default_rng(sum(counts)).normal(size=(3, 1500)) * 40
    g = grid.Grid(SKEW, counts, origin)
    i = np.indices(counts).reshape(3, -1)
    q = np.array(origin)[:, None] + np.array(SKEW).T @ i
    want = np.exp(1j * (q.T @ xyz)).sum(1)
    assert np.abs(grid.Transform(g)(xyz) - want).max() < 1e-7 * xyz.shape[1]


def test_far_fewer_waves_than_the_sum(monkeypatch):
    waves = []
    exp = np.exp
    monkeypatch.setattr(np, "exp", lambda v: waves.append(np.size(v)) or exp(v))
    n, atoms = 16**3, 2000
    grid.Transform(grid.Grid(SKEW, (16, 16, 16)))(np.zeros((3, atoms)))
    assert sum(waves) < n * atoms / 100


def test_amplitudes_of_frames(spark, monkeypatch):
    rows = spark.range(7 * 40).select(F.expr("id div 40").alias("frame"), (F.col("id") % 40).alias("atom_id"), *((F.sin(F.col("id") * k) * 9).alias(c) for c, k in zip("xyz", (1.0, 2.0, 3.0))))
    rows = rows.withColumn("species", F.when(F.col("atom_id") % 3 == 0, "A").otherwise("B"))
    hot = rows.unionByName(rows.where("frame = 3").withColumn("atom_id", F.col("atom_id") + 40)).repartition(5)
    g = grid.Grid(SKEW, (4, 3, 5), (0.1, 0.0, -0.2))
    q = grid.grid_vectors(spark, g)
    factors = local_table(spark, [(i, s, (i + 1) * w) for i in range(60) for s, w in (("A", 1.0), ("B", -0.5))], "q_id bigint, species string, f double")
    want = {tuple(r)[:3]: (r["re"], r["im"]) for r in amplitude.amplitude_all(hot, factors, q.withColumn("m_id", F.lit(0).cast("bigint"))).select("q_id", "m_id", "frame", "re", "im").collect()}
    for rows_at_once in (None, 20):
        if rows_at_once:  # several slabs
            monkeypatch.setattr(kernel, "pass_rows", lambda f: rows_at_once)
        got = {tuple(r)[:3]: (r["re"], r["im"]) for r in grid.amplitude_grid(hot, factors, g).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


def test_whole_frames_are_not_shuffled_again(spark, monkeypatch):
    rows = spark.range(400 * 5).select(F.expr("id div 5").alias("frame"), *((F.sin(F.col("id") * k) * 9).alias(c) for c, k in zip("xyz", (1.0, 2.0, 3.0))))
    rows = rows.withColumn("species", F.when(F.col("x") > 0, "A").otherwise("B"))
    twice = rows.unionByName(rows.where("frame = 8"))
    hot = twice.unionByName(spark.range(3000).select(F.lit(3).cast("bigint").alias("frame"), *(F.lit(1.0 + k).alias(c) for k, c in enumerate("xyz")), F.lit("A").alias("species")))
    g = grid.Grid(SKEW, (3, 2, 4))
    q = grid.grid_vectors(spark, g).withColumn("m_id", F.lit(0).cast("bigint"))
    factors = local_table(spark, [(i, s, (i + 1) * w) for i in range(24) for s, w in (("A", 1.0), ("B", -0.5))], "q_id bigint, species string, f double")
    add_up = kernel.add_up
    for some in (twice, hot):
        added = []
        monkeypatch.setattr(kernel, "add_up", lambda df: added.append(df) or add_up(df))
        found = grid.amplitude_grid(some, factors, g)
        if some is twice:
            assert not added and "hashpartitioning(q_id" not in found._jdf.queryExecution().toString()
        else:  # only the parts of the large frame are added up
            assert len(added) == 1 and {r["frame"] for r in added[0].select("frame").distinct().collect()} == {3}
        got = [tuple(r) for r in found.select("q_id", "m_id", "frame", "re", "im").collect()]
        assert len(got) == len({r[:3] for r in got}) == 400 * 24
        want = amplitude.amplitude_all(some, factors, q).select("q_id", "m_id", "frame", "re", "im").collect()
        assert np.allclose(sorted(got), sorted(map(tuple, want)), atol=1e-4)


def test_bad_grids():
    for bad in (dict(steps=SKEW[:2], counts=(1, 1, 1)), dict(steps=SKEW, counts=(0, 1, 1)), dict(steps=SKEW, counts=(1, 1))):
        with pytest.raises(ValueError):
            grid.Grid(**bad)
