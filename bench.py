"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
Each query runs once to warm the workers up and is then timed, written to a sink that
discards rows.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

import check
from scatterloom.operators import align, qspace, staging
from scatterloom.plans import amplitude
from scatterloom.plans.signal import Multipole, Vectors, scatter
from workload import queries as w
from workload import tables as t

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))

POINTS = 20  # scattering vectors
ORIENTATIONS = 50
WIDE = (100, 100)  # the same where the sums themselves take most of the time


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def big_amplitude(engine, points=POINTS, orientations=ORIENTATIONS):
    def go(spark, sf):
        q = t.scan_q(spark, points)
        sub = qspace.subvectors_sphere(q, qspace.orient_sphere(spark, orientations, 1))
        return amplitude.amplitude_all(staging.spread_frames(t.li_traj(spark, sf)), t.factors(spark, q), sub, engine)

    return go


def coherent_signal(spark, sf):
    q = t.scan_q(spark, POINTS)
    avg = Vectors(qspace.orient_sphere(spark, ORIENTATIONS, 1))
    return scatter(t.li_traj(spark, sf), q, t.factors(spark, q), t.LI_FRAMES, average=avg, stage=True).fqt


def self_signal(spark, sf):
    q = t.scan_q(spark, POINTS)
    avg = Vectors(qspace.orient_sphere(spark, 10, 1))
    return scatter(t.emb_traj(spark, sf), q, t.factors(spark, q), t.n_frames(spark, sf), kind="self", average=avg).fqt


def multipole_signal(spark, sf):
    q = t.scan_q(spark, 5)
    avg = Multipole(qspace.moments_sphere(spark, 10))
    return scatter(t.li_traj(spark, sf), q, t.factors(spark, q), t.LI_FRAMES, average=avg, dsp="square", stage=True).fqt


def fitted(spark, sf):
    df = w.tagged(spark, sf)
    return align.align_fitrottrans(df, align.reference_coords(df, 0), n_frames=t.n_frames(spark, sf))


BENCH = {
    "amplitude_kernel": big_amplitude("kernel"),
    "amplitude_kernel_wide": big_amplitude("kernel", *WIDE),
    "amplitude_sql": big_amplitude("sql", 4, 10),
    "signal_coherent": coherent_signal,
    "signal_self": self_signal,
    "signal_multipole_sphere": multipole_signal,
    "align_fitrottrans": fitted,
    "prepare_steps": w.prepare_steps,
    "motion_randomwalk": w.motion_randomwalk,
    "autocorrelate_long": w.autocorrelate_long,
    "back_to_cartesian": w.back_to_cartesian,
    "check_frames": w.check_frames,
    "dcd_trajectory": w.dcd_trajectory,
}


def main() -> None:
    spark = check.session(CPUS)
    seconds = {}
    for name, make in BENCH.items():
        for _ in range(2):
            start = time.perf_counter()
            run(make(spark, SF_DIR))
            seconds[name] = round(time.perf_counter() - start, 3)
    atoms = t.li_traj(spark, SF_DIR).agg(F.count("*")).first()[0]
    rates = {
        "kernel": round(atoms * POINTS * ORIENTATIONS / seconds["amplitude_kernel"]),
        "kernel_wide": round(atoms * WIDE[0] * WIDE[1] / seconds["amplitude_kernel_wide"]),
        "sql": round(atoms * 40 / seconds["amplitude_sql"]),
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "phase_evaluations_per_sec": rates,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
