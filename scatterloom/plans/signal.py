"""From coordinates to averaged signals, and the table they are kept in."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterloom.operators import qspace
from scatterloom.operators.align import with_representation
from scatterloom.operators.params import local_table, localize, on_driver
from scatterloom.operators.staging import spread_frames
from scatterloom.plans import amplitude, self_signal, series
from scatterloom.scratch import write_and_reread

Q_PER_FOLDER = 64
LAGS_PER_TASK = 1 << 16  # of a block of vectors, when they are written
Q = ["q_id", "qx", "qy", "qz"]


@dataclass(frozen=True)
class Vectors:
    """Average over orientations ``(m_id, ux, uy, uz)``: all directions, or about an axis."""

    orientations: DataFrame
    kind: str = "sphere"
    axis: tuple = (0.0, 0.0, 1.0)


@dataclass(frozen=True)
class Multipole:
    """Average by a multipole expansion with ``moments(m_id, l, m)``."""

    moments: DataFrame
    kind: str = "sphere"
    axis: tuple = (0.0, 0.0, 1.0)
    legacy_parallel: bool = False


@dataclass(frozen=True)
class Signal:
    """``fqt`` (q, tau), ``fq0`` at tau 0, ``fq`` time mean, ``fq2`` squared time mean.

    All are lazy; only those that are used are computed.
    """

    qvectors: DataFrame
    fqt: DataFrame
    means: DataFrame
    n_frames: int
    remake: Callable[[], Signal] | None = None  # the same from amplitudes that are kept; none if they are

    @property
    def fq0(self) -> DataFrame:
        return self.means.select(*Q, "fq0_re", "fq0_im")

    @property
    def fq(self) -> DataFrame:
        return self.means.select(*Q, "fq_re", "fq_im")

    @property
    def fq2(self) -> DataFrame:
        return self.means.select(*Q, "fq2_re", "fq2_im")

    @property
    def summary(self) -> DataFrame:
        """One row per q with all three, from one pass over the series."""
        return self.means


def subvectors(qvectors: DataFrame, average: Vectors | None) -> DataFrame:
    if average is None:
        return qspace.subvectors_none(qvectors)
    if average.kind in ("sphere", "file"):
        return qspace.subvectors_sphere(qvectors, average.orientations)
    if average.kind == "cylinder":
        return qspace.subvectors_cylinder(qvectors, average.orientations, average.axis)
    raise ValueError(f"no orientation average called {average.kind!r}")


def _require(df: DataFrame, what: str) -> None:
    table = on_driver(df)
    if df.isEmpty() if table is None else table.num_rows == 0:
        raise ValueError(f"nothing to compute: no {what}")


def scatter(
    coords: DataFrame,
    qvectors: DataFrame,
    factors: DataFrame,
    n_frames: int,
    *,
    kind: str = "all",
    average: Vectors | Multipole | None = None,
    dsp: str = "autocorrelate",
    method: str = "fft",
    engine: str = "kernel",
    stage: bool = False,
    materialize: bool = False,
    check: bool = True,
    in_task: int = series.SERIES_IN_TASK,
) -> Signal:
    """The signal of a trajectory.

    ``coords`` has ``frame, species, x, y, z`` (and ``atom_id`` for ``kind='self'``).
    ``kind='all'`` sums amplitudes over atoms before the transform in time, with plain,
    oriented or multipole vectors; ``kind='self'`` sums after it.

    ``stage`` brings the rows of a frame together first, which pays where they lie
    scattered over many files or where the input has too few parts to keep all cores busy. ``materialize`` keeps the amplitudes in the
    scratch folder, so that several outputs share them; `write_signal` does so by itself.
    Frames outside 0..n_frames-1 raise.
    Series of more than ``in_task`` frames are spread over tasks.
    ``check`` looks for a first atom; switch it off where preparing the coordinates is
    costly, since that work would be started twice.
    """
    if n_frames < 1:
        raise ValueError("nothing to compute: no frames")
    qvectors, factors = localize(qvectors), localize(factors)
    given = coords
    coords = series.in_range(coords, n_frames)
    if check:
        _require(coords, "atoms")
    _require(qvectors, "scattering vectors")
    q = qvectors.select(*Q)

    if kind == "self":
        if isinstance(average, Multipole):
            raise ValueError("a self signal has no multipole expansion")
        vectors = localize(subvectors(qvectors, average))
        sums = self_signal.self_sums(coords, factors, vectors, n_frames, dsp, method, in_task)
        if materialize:
            sums = write_and_reread(sums, "self")
        lags = sums.where("tau >= 0")
        kept = {0: "fq0", self_signal.MEAN: "fq", self_signal.MEAN_SQUARED: "fq2"}
        means = sums.where(F.col("tau").isin(list(kept))).groupBy("q_id").agg(
            *(
                F.sum(F.when(F.col("tau") == tau, F.col(c))).alias(f"{name}_{c}")
                for tau, name in kept.items() for c in ("re", "im")
            )
        )
        norm = _per_orientation(vectors)
    elif kind == "all":
        coords = spread_frames(coords) if stage else coords
        if isinstance(average, Multipole):
            amplitudes, factor = _multipole(coords, factors, qvectors, average)
            norm = qvectors.select("q_id", F.lit(factor).alias("norm"))
        else:
            vectors = localize(subvectors(qvectors, average))
            amplitudes = amplitude.amplitude_all(coords, factors, vectors, engine)
            norm = _per_orientation(vectors)
        if materialize:
            amplitudes = write_and_reread(amplitudes, "amplitudes")
        keys = ["q_id", "m_id"]
        moved = series.transform(amplitudes, keys, n_frames, dsp, method, in_task)
        lags = series.reduce_series(moved)
        means = series.reduce_time(moved, keys, n_frames)
    else:
        raise ValueError("kind is 'all' or 'self'")

    table = q.join(norm, "q_id")
    fqt = lags.join(table, "q_id").select(
        *Q, F.col("tau").cast("bigint").alias("tau"),
        *((F.col(c) * F.col("norm")).alias(c) for c in ("re", "im")),
    )
    scaled = means.join(table, "q_id").select(
        *Q, *((F.col(c) * F.col("norm")).alias(c) for c in PARTS)
    )
    again = dict(kind=kind, average=average, dsp=dsp, method=method, engine=engine, stage=stage, materialize=True, check=False, in_task=in_task)
    remake = None if materialize else lambda: scatter(given, qvectors, factors, n_frames, **again)
    return Signal(q, fqt, scaled, n_frames, remake)


def _per_orientation(vectors: DataFrame) -> DataFrame:
    table = on_driver(vectors)
    if table is None:
        return vectors.groupBy("q_id").agg((1.0 / F.count("*")).alias("norm"))
    counts = table.to_pandas()["q_id"].value_counts()
    rows = [(int(q), 1.0 / int(n)) for q, n in counts.items()]
    return local_table(vectors.sparkSession, rows, "q_id bigint, norm double")


def _multipole(coords, factors, qvectors, average: Multipole):
    bad = qspace.validate_moments(average.moments, average.kind).first()
    if bad is not None:
        raise ValueError(f"{bad['problem']}: l={bad['l']}, m={bad['m']}")
    if average.kind == "sphere":
        ball = with_representation(coords, "spherical")
        found = amplitude.amplitude_multipole_sphere(ball, factors, qvectors, average.moments)
        return found, 1.0 / (4.0 * math.pi)
    if average.kind == "cylinder":
        tube = with_representation(coords, "cylindrical", average.axis)
        found = amplitude.amplitude_multipole_cylinder(
            tube, factors, qvectors, average.moments, average.axis, average.legacy_parallel
        )
        return found, 1.0 / (2.0 * math.pi)
    raise ValueError(f"no multipole expansion of kind {average.kind!r}")


# -- the result table ---------------------------------------------------------------------


def write_signal(signal: Signal, path: str, meta: dict | None = None) -> str:
    """Append a signal to the result at ``path``; returns the id of this append.

    An append counts from the moment its one row of the manifest is there, which is written last; until then :func:`read_signal` sees
    none of its rows, so a broken run can simply be repeated. Amplitudes are kept in the
    scratch folder first, so that both tables come from one pass over the trajectory. A result whose series have
    another length raises, and so do vectors that it has already; nothing is written then. If another append brings
    the same vectors in the meantime, the earlier one of the two counts, and the later one raises. Files hold a block of vectors and
    of lags, so a few vectors with very many lags are written by many tasks.
    """
    spark = signal.qvectors.sparkSession
    found = read_signal(spark, path)
    wrong = check_length(found[0], signal.n_frames).first()
    if wrong is not None:
        raise ValueError(f"the result at {path} has series of {wrong['n_lags']} lags, not {signal.n_frames}")
    known = found[1].join(signal.qvectors.select("q_id"), "q_id", "left_semi").select("q_id").limit(10).collect()
    if known:
        raise ValueError(f"the result at {path} has vectors {sorted(r['q_id'] for r in known)} already")
    if signal.remake is not None:
        signal = signal.remake()
    run = uuid.uuid4().hex
    blocks = {"fqt": ["q_block", F.expr(f"tau div {LAGS_PER_TASK}")], "fq": ["q_block"]}
    for name, df in (("fqt", signal.fqt), ("fq", signal.summary)):
        (
            df.withColumn("run_id", F.lit(run))
            .withColumn("q_block", F.expr(f"q_id div {Q_PER_FOLDER}"))
            .repartition(*blocks[name])
            .write.mode("append").partitionBy("q_block").parquet(f"{path}/{name}")
        )
        if name == "fqt" and meta is not None:
            write_meta(spark, path, run, {**meta, "n_frames": signal.n_frames})
    _commit(spark, path, run)
    lost = superseded(spark, path).where(F.col("run_id") == run).limit(10).collect()
    if lost:
        raise RuntimeError(f"another append has brought vectors {sorted(r['q_id'] for r in lost)} first; its rows count")
    return run


def _commit(spark: SparkSession, path: str, run: str) -> None:
    """The row that makes an append count: one file, which is there as a whole or not at all."""
    row = spark.range(1).select(F.lit(run).alias("run_id"), F.current_timestamp().alias("written"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _claims(spark: SparkSession, path: str) -> DataFrame:
    """``q_id, run_id, counts``: the appends that brought each vector, and which one counts: the earliest by the manifest, of equal times the smaller id."""
    runs = spark.read.parquet(f"{path}/manifest").groupBy("run_id").agg(F.min("written").alias("written"))
    claims = spark.read.parquet(f"{path}/fq").select("q_id", "run_id").distinct().join(runs, "run_id")
    first = claims.groupBy("q_id").agg(F.min_by("run_id", F.struct("written", "run_id")).alias("__first"))
    return claims.join(first, "q_id").select("q_id", "run_id", (F.col("run_id") == F.col("__first")).alias("counts"))


def superseded(spark: SparkSession, path: str) -> DataFrame:
    """``q_id, run_id``: vectors of appends that came second."""
    return _claims(spark, path).where("not counts").select("q_id", "run_id")


def compact_signal(spark: SparkSession, path: str, to: str, n_files: int = 1) -> str:
    """The result at ``path``, without rows that don't count, as one append to a new result ``to``, each table in ``n_files`` files sorted
    by vector; returns the id of the append."""
    if _exists(spark, f"{to}/fq"):
        raise ValueError(f"there is a result at {to} already")
    run = uuid.uuid4().hex
    for name, df, order in zip(("fqt", "fq"), read_signal(spark, path), (["q_id", "tau"], ["q_id"])):
        df = df.withColumns({"run_id": F.lit(run), "q_block": F.expr(f"q_id div {Q_PER_FOLDER}")})
        df.repartitionByRange(n_files, *order).sortWithinPartitions("q_block", *order).write.mode("append").partitionBy("q_block").parquet(f"{to}/{name}")
    _commit(spark, to, run)
    return run


def write_meta(spark: SparkSession, path: str, run: str, meta: dict) -> None:
    """Keep the settings and constants of a run beside its results, one row per run."""
    row = [(run, json.dumps(meta, sort_keys=True, default=str))]
    spark.createDataFrame(row, "run_id string, settings string").coalesce(1).write.mode(
        "append"
    ).parquet(f"{path}/meta")


PARTS = [f"{name}_{c}" for name in ("fq0", "fq", "fq2") for c in ("re", "im")]


def read_signal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(fqt, fq)`` of all complete appends; without rows if nothing was written yet."""
    if not _exists(spark, f"{path}/manifest"):
        q = "q_id bigint, qx double, qy double, qz double, "
        empty = (q + "tau bigint, re double, im double", q + ", ".join(f"{c} double" for c in PARTS))
        return tuple(spark.createDataFrame([], ddl) for ddl in empty)
    counted = _claims(spark, path).where("counts").select("q_id", "run_id")
    both = (spark.read.parquet(f"{path}/{name}").join(counted, ["q_id", "run_id"], "left_semi") for name in ("fqt", "fq"))
    return tuple(df.drop("run_id", "q_block") for df in both)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path that Spark can open."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def resume(coords: DataFrame, qvectors: DataFrame, factors: DataFrame, n_frames: int, path: str, meta: dict | None = None, **options) -> str | None:
    """`scatter` for the vectors that the result at ``path`` lacks, appended to it; the id of the append, or none if there was nothing left to do."""
    rest = localize(qspace.pending_vectors(qvectors, read_signal(qvectors.sparkSession, path)[1]))
    if rest.isEmpty():
        return None
    return write_signal(scatter(coords, rest, factors, n_frames, **{**options, "materialize": True}), path, meta)


def check_length(fqt: DataFrame, n_frames: int) -> DataFrame:
    """Vectors of a result whose series do not have ``n_frames`` lags; empty when all fit."""
    return (
        fqt.groupBy("q_id")
        .agg((F.max("tau") + 1).alias("n_lags"), F.count("*").alias("n_rows"))
        .where((F.col("n_lags") != n_frames) | (F.col("n_rows") != n_frames))
    )
