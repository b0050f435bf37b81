"""Appends to a result: all or nothing, whoever comes first, by many tasks."""

import threading

import pytest
from pyspark.sql import functions as F

from scatterloom.operators.params import local_table
from scatterloom.plans import signal as plans
from scatterloom.plans.signal import Signal, compact_signal, read_signal, superseded, write_signal


def made(spark, ids, lags, value=1.0):
    """A signal of vectors ``ids`` whose rows tell who made them."""
    q = local_table(spark, [(i, float(i), 0.0, 0.0) for i in ids], "q_id bigint, qx double, qy double, qz double")
    rows = q.crossJoin(spark.range(lags).withColumnRenamed("id", "tau"))
    fqt = rows.select("q_id", "qx", "qy", "qz", "tau", F.lit(value).alias("re"), F.lit(0.0).alias("im"))
    return Signal(q, fqt, q.select("*", *(F.lit(value).alias(c) for c in plans.PARTS)), lags)


def test_the_earlier_of_two_appends_counts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "result")
    write_signal(made(spark, [0], 5), path)
    commit, at = plans._commit, threading.Event()

    def late(session, where, run):
        if not at.is_set():  # while the first append is about to be committed the other one starts and ends
            at.set()
            write_signal(made(spark, [2, 3], 5, 20.0), path)
        commit(session, where, run)

    monkeypatch.setattr(plans, "_commit", late)
    with pytest.raises(RuntimeError, match=r"\[2\] first"):
        write_signal(made(spark, [1, 2], 5, 10.0), path)
    fqt, fq = read_signal(spark, path)
    assert {r["q_id"]: r["re"] for r in fqt.collect()} == {0: 1.0, 1: 10.0, 2: 20.0, 3: 20.0} and fqt.count() == 20
    assert {r["q_id"]: r["fq0_re"] for r in fq.collect()} == {0: 1.0, 1: 10.0, 2: 20.0, 3: 20.0} and fq.count() == 4
    assert [r["q_id"] for r in superseded(spark, path).collect()] == [2]
    to = str(tmp_path / "compact")
    compact_signal(spark, path, to, 2)
    assert sorted(map(tuple, read_signal(spark, to)[0].collect())) == sorted(map(tuple, fqt.collect())) and read_signal(spark, to)[1].count() == 4
    assert len(list((tmp_path / "compact" / "fqt").rglob("part-*.parquet"))) <= 2 and superseded(spark, to).isEmpty()
    with pytest.raises(ValueError, match="already"):
        compact_signal(spark, path, to)


def test_vectors_that_are_there_are_not_appended(spark, tmp_path):
    path = str(tmp_path / "result")
    write_signal(made(spark, [0, 1], 5), path)
    with pytest.raises(ValueError, match=r"vectors \[1\] already"):
        write_signal(made(spark, [1, 2], 5), path)
    assert read_signal(spark, path)[0].count() == 10


def test_an_append_without_its_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "result")

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(plans, "_commit", lost)
        with pytest.raises(OSError):
            write_signal(made(spark, [0], 5, 7.0), path)
    assert read_signal(spark, path)[0].isEmpty()
    write_signal(made(spark, [0], 5, 8.0), path)
    assert [r["re"] for r in read_signal(spark, path)[0].collect()] == [8.0] * 5


def test_few_vectors_with_many_lags_are_written_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "result")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_signal(made(spark, range(20), 1_000_000), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "result" / "fqt").rglob("part-*.parquet"))) >= 4
    fqt = read_signal(spark, path)[0]
    assert fqt.count() == 20_000_000 and fqt.groupBy("q_id").agg(F.count_distinct("tau").alias("n")).where("n <> 1000000").isEmpty()
