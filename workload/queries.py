"""The registered queries. ``@query(name, sql)`` pairs a Spark query with reference SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterloom.functions import constants, vec
from scatterloom.operators import align, frames, motions, qspace, rigid, selections, staging
from scatterloom.operators import elements as el
from scatterloom.operators.prefix import running_total
from scatterloom.plans import amplitude, grid, series
from scatterloom.plans.coordinates import prepare_coordinates
from scatterloom.plans.signal import (
    Multipole, Vectors, check_length, read_signal, resume, scatter, write_meta,
)
from scatterloom.scratch import scratch_path, write_and_reread
from scatterloom.sources import datasource, files, tables as readers, trajectory
from workload import tables as t
from workload.sql import (
    ELEMENTS, FACTORS, LI, NATION_Q, ORIENT, PI, SCAN_Q, SUPPLIER_Q, TRAJ, VOLUME,
    element_values, exclusion, normal, on_sphere, r, scattering, xyz,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round the named columns and turn -0.0 into 0.0."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def coords_out(df: DataFrame, digits: int = 6) -> DataFrame:
    return rounded(df.select("frame", "atom_id", "x", "y", "z"), "x", "y", "z", digits=digits)


def tagged(spark, sf, chosen=None) -> DataFrame:
    """The dense trajectory with masses and the selections core (0..9) and tail (7..21)."""
    atoms = t.emb_atoms(spark, sf)
    named = selections.Selections(atoms)
    named.add("core", selections.sel_range(atoms, 0, 9)).add("tail", selections.sel_range(atoms, 7, 21))
    tags = selections.tag_atoms(atoms, named, ["core", "tail"]).drop("label", "pdb_name")
    return align.tagged(t.emb_traj(spark, sf).drop("label", "species"), tags)


TAGGED = "tagged AS (SELECT *, atom_id BETWEEN 0 AND 9 AS core, atom_id BETWEEN 7 AND 21 AS tail FROM traj)"


# == sources ==================================================================================


@query("structure_scan", """SELECT row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS atom_id, substr(p_type, 1, 4) AS pdb_name,
 CAST(p_size AS VARCHAR) AS beta, substr(p_brand, 7) AS segid FROM part""")
def structure_scan(spark, sf):
    """Structure files made of the parts, one per brand."""
    atoms = t.part_atoms(spark, sf)
    line = F.format_string(
        "ATOM  %5d %-4s MOL  %4d    %8.3f%8.3f%8.3f%6.2f%6s      %-4s",
        F.col("atom_id") % 100000, F.substring("pdb_name", 1, 4), F.lit(1), F.lit(0.0), F.lit(0.0),
        F.lit(0.0), F.lit(1.0), "beta", F.substring("segid", 7, 4),
    )
    path = scratch_path(spark, "structure")
    lines = atoms.select("segid", "atom_id", line.alias("value"))
    lines.repartition("segid").sortWithinPartitions("segid", "atom_id").drop("atom_id").write.partitionBy(
        "segid"
    ).text(path)
    return trajectory.read_structures(spark, path).drop("ord")


def _pdb_files(spark, sf):
    path = scratch_path(spark, "pdb")
    n = t.n_frames(spark, sf)
    t.write_lines(t.pdb_lines(t.emb_traj(spark, sf)), path, max(2, n // 200), "frame", "ord")
    return path


@query("pdb_trajectory", f"WITH {TRAJ} SELECT frame, atom_id, {xyz(digits=3)} FROM traj")
def pdb_trajectory(spark, sf):
    """Text frames over several files, read through their index."""
    return coords_out(trajectory.read_frames(spark, _pdb_files(spark, sf), "pdb"), 3)


@query("pdb_unit_cells", """SELECT vec_id AS frame, vec_id + 1.0::DOUBLE AS ax, 0.0::DOUBLE AS ay, 0.0::DOUBLE AS az, 0.0::DOUBLE AS bx,
  round(vec_id + 2.0::DOUBLE, 3) AS by, 0.0::DOUBLE AS bz, 0.0::DOUBLE AS cx, 0.0::DOUBLE AS cy, round(vec_id + 3.0::DOUBLE, 3) AS cz FROM embeddings""")
def pdb_unit_cells(spark, sf):
    """The unit cell of each frame."""
    index = trajectory.join_files(trajectory.build_frame_index(spark, _pdb_files(spark, sf), "pdb"))
    cells = trajectory.read_unit_cells(index, "pdb")
    return rounded(cells.select("frame", *trajectory.CELL), *trajectory.CELL, digits=3)


def _dcd_files(spark, sf):
    path = scratch_path(spark, "dcd")
    t.write_dcd(t.emb_traj(spark, sf), path)
    return path


@query("dcd_trajectory", f"""WITH {TRAJ} SELECT frame, atom_id,
  {r('CAST(CAST(x AS FLOAT) AS DOUBLE)', 'x', 4)}, {r('CAST(CAST(y AS FLOAT) AS DOUBLE)', 'y', 4)},
  {r('CAST(CAST(z AS FLOAT) AS DOUBLE)', 'z', 4)} FROM traj""")
def dcd_trajectory(spark, sf):
    """S3: binary frames over several files."""
    return coords_out(trajectory.read_frames(spark, _dcd_files(spark, sf), "dcd"), 4)


@query("dcd_data_source", f"""WITH {TRAJ} SELECT frame, atom_id,
  {r('CAST(CAST(x AS FLOAT) AS DOUBLE)', 'x', 4)}, {r('CAST(CAST(y AS FLOAT) AS DOUBLE)', 'y', 4)},
  {r('CAST(CAST(z AS FLOAT) AS DOUBLE)', 'z', 4)} FROM traj""")
def dcd_data_source(spark, sf):
    """S3: the same through ``spark.read.format``."""
    datasource.register(spark)
    return coords_out(spark.read.format("trajectory").load(_dcd_files(spark, sf)), 4)


@query("refresh_index", """SELECT vec_id // {n} AS ord, 'same' AS state, count(*) AS frames, CAST(sum(vec_id % {n}) AS BIGINT) AS numbers FROM embeddings WHERE vec_id // {n} % 2 = 0 GROUP BY ALL
 UNION ALL SELECT vec_id // {n}, 'new', count(*), CAST(sum(vec_id % {n}) AS BIGINT) FROM embeddings WHERE vec_id // {n} % 2 = 1 GROUP BY ALL""".format(n=t.DCD_FRAMES))
def refresh_index(spark, sf):
    """The index of every other file, brought up to date with all of them."""
    paths = files.list_folder(_dcd_files(spark, sf))
    index = write_and_reread(trajectory.build_frame_index(spark, paths[::2], "dcd"), "index")
    rows = trajectory.refresh_frame_index(index, paths, "dcd").join(trajectory.index_changes(index, paths), "path")
    return rows.groupBy("ord", "state").agg(F.count("*").alias("frames"), F.sum("frame").alias("numbers"))


@query("detect_formats", f"""SELECT 'dcd' AS format, max(vec_id) // {t.DCD_FRAMES} + 1 AS n FROM embeddings
 UNION ALL SELECT 'pdb', count(DISTINCT p_brand) FROM part
 UNION ALL SELECT 'other', count(DISTINCT p_size) FROM part""")
def detect_formats(spark, sf):
    """Formats told apart by content."""
    atoms = t.part_atoms(spark, sf)
    pdb, other = scratch_path(spark, "pdb"), scratch_path(spark, "other")
    named = atoms.select("segid", F.concat(F.lit("ATOM  "), "atom_id").alias("value"))
    named.repartition("segid").write.partitionBy("segid").text(pdb)
    sized = atoms.select("beta", F.concat(F.lit("atom "), "atom_id").alias("value"))
    sized.repartition("beta").write.partitionBy("beta").text(other)
    paths = [f for folder in (pdb, other) for f in files.list_folder(folder)]
    found = trajectory.detect_format(spark, [*paths, *files.list_folder(_dcd_files(spark, sf))])
    kind = F.coalesce("format", F.lit("other"))
    return found.groupBy(kind.alias("format")).agg(F.count("*").alias("n"))


@query("frame_list_clones", f"""WITH {TRAJ}, kept AS (SELECT frame // {t.DCD_FRAMES} AS file, (frame % {t.DCD_FRAMES}) // 3 - 2 AS local, atom_id, x, y, z
   FROM traj WHERE frame % {t.DCD_FRAMES} >= 5 AND (frame % {t.DCD_FRAMES}) % 3 = 0),
 sizes AS (SELECT file, max(local) + 1 AS n FROM kept GROUP BY file),
 starts AS (SELECT file, n, 2 * (sum(n) OVER (ORDER BY file) - n)::BIGINT AS start FROM sizes)
 SELECT start + k * n + local AS frame, atom_id, {r('CAST(CAST(x AS FLOAT) AS DOUBLE)', 'x', 4)}, {r('CAST(CAST(y AS FLOAT) AS DOUBLE)', 'y', 4)},
  {r('CAST(CAST(z AS FLOAT) AS DOUBLE)', 'z', 4)} FROM kept JOIN starts USING (file), range(2) c(k)""")
def frame_list_clones(spark, sf):
    """S4 with L1 and L3: a list file naming trajectories, each cut and read twice."""
    names = scratch_path(spark, "list")
    lines = ["# trajectories", *files.list_folder(_dcd_files(spark, sf))]
    spark.createDataFrame([(s,) for s in lines], "value string").coalesce(1).write.text(names)
    df = trajectory.read_frame_list(spark, files.list_folder(names)[0], "dcd", first=5, stride=3, clones=2)
    return coords_out(df, 4)


@query("frame_index_keep", f"""WITH {TRAJ}, chosen AS (SELECT c_custkey AS position, (c_custkey * 7) % n AS frame FROM customer, nf)
 SELECT position AS frame, atom_id, {r('CAST(CAST(x AS FLOAT) AS DOUBLE)', 'x', 4)}, {r('CAST(CAST(y AS FLOAT) AS DOUBLE)', 'y', 4)},
  {r('CAST(CAST(z AS FLOAT) AS DOUBLE)', 'z', 4)} FROM traj JOIN chosen USING (frame)""")
def frame_index_keep(spark, sf):
    """A frame index written, checked, reduced to a list of frames and read through."""
    chosen = t.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("position"), (F.col("c_custkey") * 7 % t.n_frames(spark, sf)).alias("frame")
    )
    index_path = scratch_path(spark, "index")
    index = trajectory.join_files(trajectory.build_frame_index(spark, _dcd_files(spark, sf), "dcd"))
    index.write.parquet(index_path)
    checked = trajectory.validate_frame_index(spark.read.parquet(index_path))
    df = trajectory.read_indexed(frames.keep_frames(checked, chosen), "dcd")
    return coords_out(df, 4)


@query("frame_index_stale", """SELECT DISTINCT p_brand AS brand, CAST(substr(p_brand, 7) AS INTEGER) % 2 = 1 AS changed FROM part""")
def frame_index_stale(spark, sf):
    """Of files rewritten after their index was built, one per brand, those with other content are found."""
    atoms = t.part_atoms(spark, sf)
    odd = F.substring("segid", 7, 4).cast("int") % 2 == 1

    def written(shift):
        x = F.when(odd, shift).otherwise(0.0)
        value = F.format_string("ATOM  %5d X    MOL     1    %8.3f%8.3f%8.3f", F.col("atom_id") % 100000, x, F.lit(0.0), F.lit(0.0))
        path = scratch_path(spark, "stale")
        lines = atoms.select("segid", "atom_id", value.alias("value")).repartition("segid").sortWithinPartitions("segid", "atom_id")
        lines.drop("atom_id").write.partitionBy("segid").text(path)
        return path

    brand = F.replace(F.regexp_extract("path", "segid=([^/]+)/", 1), F.lit("%23"), F.lit("#")).alias("brand")
    before, after = written(0.0), written(1.0)
    index = trajectory.build_frame_index(spark, before, "pdb")
    now = files.paths_table(spark, after).select(brand, F.col("path").alias("now"))
    moved = index.withColumn("brand", brand).join(now, "brand").withColumn("path", F.col("now")).select(*index.columns)
    found = trajectory.stale_files(moved).select(brand, F.lit(True).alias("changed"))
    return now.select("brand").join(found, "brand", "left").select("brand", F.coalesce("changed", F.lit(False)).alias("changed"))


@query("frames_table_clones", f"""WITH {TRAJ}, kept AS (SELECT frame // 2 - 1 AS local, atom_id, x, y, z FROM traj WHERE frame >= 2 AND frame % 2 = 0),
 s AS (SELECT max(local) + 1 AS n FROM kept) SELECT k * n + local AS frame, atom_id, {xyz()} FROM kept, s, range(3) c(k)""")
def frames_table_clones(spark, sf):
    """S7 with L1 and L3: a Parquet table of several files, cut and taken three times."""
    path = scratch_path(spark, "table")
    t.emb_traj(spark, sf).select("frame", "atom_id", "x", "y", "z").repartition(5).write.parquet(path)
    return coords_out(trajectory.read_frames(spark, path, "parquet", first=2, stride=2, clones=3))


@query("frames_table_scan", f"WITH {TRAJ} SELECT frame, atom_id, {xyz()} FROM traj")
def frames_table_scan(spark, sf):
    """Coordinates written in frame order and scanned from Parquet."""
    path = scratch_path(spark, "dump")
    staging.dump_coordinates(t.emb_traj(spark, sf).drop("label", "species"), path, "frame")
    return coords_out(staging.read_dump(spark, path))


@query("atom_order_dump", f"WITH {TRAJ} SELECT frame, atom_id, {xyz()} FROM traj")
def atom_order_dump(spark, sf):
    """Coordinates written in atom order and read back."""
    path = scratch_path(spark, "dump")
    staging.dump_coordinates(t.emb_traj(spark, sf).drop("label", "species"), path, "atom")
    return coords_out(staging.read_dump(spark, path))


@query("spread_frames", f"""WITH {LI} SELECT frame, label AS species, count(*) AS n, {r('sum(x * y + z)', 's', 4)} FROM li GROUP BY ALL""")
def spread_frames(spark, sf):
    """Rows brought together by frame, the largest frames dealt out; nothing is lost."""
    df = staging.spread_frames(t.li_traj(spark, sf), 4)
    out = df.groupBy("frame", "species").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("y") + F.col("z")).alias("s"))
    return rounded(out, "s", digits=4)


@query("atom_series_arrays", f"""WITH {TRAJ} SELECT atom_id, count(*) AS n, min(frame) AS first,
  {r('sum(x * (frame + 1))', 'mx', 3)} FROM traj GROUP BY atom_id""")
def atom_series_arrays(spark, sf):
    """Time series of each atom in bounded arrays; order is checked through a weighted sum."""
    blocks = staging.atom_series(t.emb_traj(spark, sf), block=128)
    rows = blocks.select("atom_id", F.posexplode("x").alias("pos", "x"), "first_frame")
    out = rows.groupBy("atom_id").agg(
        F.count("*").alias("n"), F.min("first_frame").alias("first"),
        F.sum(F.col("x") * (F.col("first_frame") + F.col("pos") + 1)).alias("mx"),
    )
    return rounded(out, "mx", digits=3)


@query("xyz_text_lines", f"WITH {TRAJ} SELECT frame, atom_id, {xyz(digits=3)} FROM traj")
def xyz_text_lines(spark, sf):
    """T4: text dump in frame order, read back as text."""
    path = scratch_path(spark, "xyz")
    staging.write_xyz(rounded(t.emb_traj(spark, sf), "x", "y", "z", digits=3), path)
    lines = files.scan_lines(files.paths_table(spark, path))
    parts = F.split("value", " ")
    body = files.number_lines(lines, "n").where(F.size(parts) == 4)
    per = t.ATOMS_PER_VECTOR + 2
    # one running number over the part files gives the frame back
    sizes = lines.groupBy("ord").agg(F.count("*").alias("c")).withColumn("upto", F.col("c"))
    before = running_total(sizes, "ord", ["upto"]).select("ord", (F.col("upto") - F.col("c")).alias("before"))
    found = body.join(before, "ord").select(
        F.expr(f"(n + before) div {per}").alias("frame"), parts.getItem(0).cast("bigint").alias("atom_id"),
        *(parts.getItem(i + 1).cast("double").alias(c) for i, c in enumerate("xyz")),
    )
    return coords_out(found, 3)


def _text(spark, df, name):
    path = scratch_path(spark, name)
    df.select("value").write.text(path)
    return path


@query("vectors_from_text", f"""SELECT l_quantity AS qx, l_discount + 0.0 AS qy, l_tax + 0.0 AS qz,
  {r('sqrt(l_quantity*l_quantity + l_discount*l_discount + l_tax*l_tax)', 'ql')} FROM lineitem""")
def vectors_from_text(spark, sf):
    """One vector per lineitem, through text files."""
    lines = t.read(spark, sf, "lineitem").select(F.concat_ws("  ", "l_quantity", "l_discount", "l_tax").alias("value"))
    q = readers.read_vectors(spark, _text(spark, lines, "vectors"))
    return rounded(q.drop("q_id"), "qx", "qy", "qz", "ql")


@query("orientations_from_text", f"""WITH o AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE c_acctbal END AS x,
   CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE c_nationkey - 12 END::DOUBLE AS y, 0.0::DOUBLE AS z FROM customer),
 n AS (SELECT *, sqrt(x*x + y*y) AS len FROM o)
 SELECT {r('CASE WHEN len = 0 THEN 0 ELSE x / len END', 'ux')}, {r('CASE WHEN len = 0 THEN 0 ELSE y / len END', 'uy')}, 0.0::DOUBLE AS uz FROM n""")
def orientations_from_text(spark, sf):
    """Orientations from text, scaled to length 1, zero vectors kept."""
    zero = F.col("c_custkey") % 9 == 0
    lines = t.read(spark, sf, "customer").select(
        F.concat_ws(" ", F.when(zero, 0.0).otherwise(F.col("c_acctbal")),
                    F.when(zero, 0).otherwise(F.col("c_nationkey") - 12), F.lit("0")).alias("value")
    )
    o = readers.read_orientations(spark, _text(spark, lines, "orientations"))
    return rounded(o.drop("m_id"), "ux", "uy", "uz")


@query("moments_from_text", """WITH mo AS (SELECT l_linenumber::BIGINT - 2 AS l, CAST(l_quantity AS BIGINT) - 5 AS m FROM lineitem)
 SELECT 'sphere' AS kind, l, m, CASE WHEN l < 0 THEN 'l is below 0'
   ELSE 'm is outside -l to l' END AS problem, count(*) AS n
 FROM mo WHERE l < 0 OR abs(m) > l GROUP BY ALL
 UNION ALL
 SELECT 'cylinder', l, m, CASE WHEN l < 0 THEN 'l is below 0'
   WHEN m < 0 OR m > 3 THEN 'm is not one of the four kinds 0 to 3' ELSE 'l = 0 has m = 0 only' END, count(*)
 FROM mo WHERE l < 0 OR m < 0 OR m > 3 OR (l = 0 AND m <> 0) GROUP BY ALL""")
def moments_from_text(spark, sf):
    """Moments from text and their faults, for both expansions."""
    lines = t.read(spark, sf, "lineitem").select(
        F.concat_ws(" ", F.col("l_linenumber") - 2, F.col("l_quantity").cast("bigint") - 5).alias("value")
    )
    mo = readers.read_moments(spark, _text(spark, lines, "moments"))
    parts = [
        qspace.validate_moments(mo, kind).select(F.lit(kind).alias("kind"), "l", "m", "problem")
        for kind in ("sphere", "cylinder")
    ]
    return parts[0].unionByName(parts[1]).groupBy("kind", "l", "m", "problem").agg(F.count("*").alias("n"))


# == frames ===================================================================================


@query("trim_frames", f"""WITH {TRAJ} SELECT frame // 3 - 3 AS frame, atom_id, {xyz()} FROM traj, nf
  WHERE frame >= 7 AND frame <= n - 10 AND frame % 3 = 0""")
def trim_frames(spark, sf):
    """L1: first 7, last n-10, every number divisible by 3."""
    df = frames.trim_frames(t.emb_traj(spark, sf), 7, t.n_frames(spark, sf) - 10, 3)
    return coords_out(df)


@query("concat_framesets", f"""WITH {TRAJ}, k AS (SELECT count(*) AS n5 FROM embeddings WHERE vec_id % 5 = 0)
 SELECT frame, atom_id, {xyz()} FROM traj
 UNION ALL SELECT frame // 5 + n, atom_id, {xyz()} FROM traj, nf WHERE frame % 5 = 0
 UNION ALL SELECT frame + n + n5, atom_id, {xyz()} FROM traj, nf, k""")
def concat_framesets(spark, sf):
    """L2: three framesets one after another."""
    traj = t.emb_traj(spark, sf)
    return coords_out(frames.concat_framesets([traj, frames.trim_frames(traj, stride=5), traj]))


@query("clone_frames", f"WITH {TRAJ} SELECT frame + k*n AS frame, atom_id, {xyz()} FROM traj, nf, range(3) c(k)")
def clone_frames(spark, sf):
    """L3: the trajectory three times over."""
    return coords_out(frames.clone_frames(t.emb_traj(spark, sf), 3))


@query("locate_frames", """WITH nf AS (SELECT count(*) AS n FROM embeddings),
 sets AS (SELECT n_nationkey AS frameset, n_nationkey * ((n + 24) // 25) AS lo, (n + 24) // 25 AS c FROM nation, nf)
 SELECT vec_id AS frame, frameset, vec_id - lo AS local_frame, label FROM embeddings, sets
 WHERE vec_id >= lo AND vec_id < lo + c""")
def locate_frames(spark, sf):
    """L4: which of 25 framesets a frame is in, and where."""
    size = -(-t.n_frames(spark, sf) // 25)
    sets = t.read(spark, sf, "nation").select(
        F.col("n_nationkey").alias("frameset"),
        (F.col("n_nationkey") * F.lit(size).cast("bigint")).alias("offset"),
        F.lit(size).cast("bigint").alias("n"),
    )
    df = t.read(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), "label")
    return frames.locate_frames(df, sets)


@query("keep_frames", f"""WITH {TRAJ}, chosen AS (SELECT c_custkey AS position, (c_custkey * 7) % n AS frame FROM customer, nf)
 SELECT position AS frame, atom_id, {xyz()} FROM traj JOIN chosen USING (frame)""")
def keep_frames(spark, sf):
    """Frames chosen by a list, in its order and with its repeats."""
    chosen = t.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("position"), (F.col("c_custkey") * 7 % t.n_frames(spark, sf)).alias("frame")
    )
    return coords_out(frames.keep_frames(t.emb_traj(spark, sf), chosen))


@query("frame_blocks", f"""WITH {TRAJ} SELECT frame, atom_id, {r('CAST(CAST(x AS FLOAT) AS DOUBLE)', 'x', 4)},
  {r('CAST(CAST(y AS FLOAT) AS DOUBLE)', 'y', 4)}, {r('CAST(CAST(z AS FLOAT) AS DOUBLE)', 'z', 4)} FROM traj""")
def frame_blocks(spark, sf):
    """Coordinates packed into frame blocks of 8 atoms and unpacked."""
    return coords_out(frames.explode_blocks(frames.pack_blocks(t.emb_traj(spark, sf), 8)), 4)


# == selections ===============================================================================


@query("select_index", "SELECT p_partkey AS atom_id FROM part WHERE p_partkey IN (SELECT o_custkey FROM orders)")
def select_index(spark, sf):
    """Atoms by a list of indices, with repeats in the list."""
    ids = t.read(spark, sf, "orders").select(F.col("o_custkey").alias("atom_id"))
    return selections.sel_index(t.part_atoms(spark, sf), ids)


@query("select_range", "SELECT p_partkey AS atom_id FROM part WHERE p_partkey BETWEEN 25 AND (SELECT max(p_partkey) - 25 FROM part)")
def select_range(spark, sf):
    """A range of indices, both ends included."""
    atoms = t.part_atoms(spark, sf)
    return selections.sel_range(atoms, 25, atoms.agg(F.max("atom_id")).first()[0] - 25)


@query("select_lexical", "SELECT p_partkey AS atom_id FROM part WHERE p_type IN ('PROMO', 'SMALL')")
def select_lexical(spark, sf):
    """The whole label must match."""
    return selections.sel_lexical(t.part_atoms(spark, sf), "P.*O|SMALL|STAND", "pdb_name")


@query("select_ndx", "SELECT p_brand AS selection, p_partkey AS atom_id FROM part WHERE regexp_full_match(p_brand, 'Brand#1.*')")
def select_ndx(spark, sf):
    """An index file with one group per brand, cut into small chunks."""
    atoms = t.part_atoms(spark, sf)
    heads = atoms.select("segid").distinct().select(
        "segid", F.lit(-1).cast("bigint").alias("k"), F.concat(F.lit("[ "), "segid", F.lit(" ]")).alias("value")
    )
    # several numbers to a line
    body = atoms.groupBy("segid", F.expr("atom_id div 100").alias("k")).agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list("atom_id")), lambda i: (i + 1).cast("string"))).alias("value")
    )
    path = scratch_path(spark, "ndx")
    t.write_lines(heads.unionByName(body), path, 3, "segid", "k")
    return readers.sel_ndx(spark, path, "Brand#1.*", chunk_bytes=256)


@query("select_pdb", """SELECT 'beta' AS selection, p_partkey AS atom_id FROM part WHERE p_size = 1
 UNION ALL SELECT 'segid', p_partkey FROM part WHERE p_brand IN ('Brand#2', 'Brand#20', 'Brand#21', 'Brand#22', 'Brand#23', 'Brand#24', 'Brand#25')""")
def select_pdb(spark, sf):
    """P5: by the beta column (default pattern) and by the segid column."""
    atoms = t.part_atoms(spark, sf)
    by_beta = selections.sel_pdb(atoms).select(F.lit("beta").alias("selection"), "atom_id")
    by_segid = selections.sel_pdb(atoms, "segid", "Brand#2[0-9]?").select(F.lit("segid").alias("selection"), "atom_id")
    return by_beta.unionByName(by_segid)


@query("selection_registry", """SELECT 'system' AS selection, count(*) AS n, sum(p_partkey)::BIGINT AS ids FROM part
 UNION ALL SELECT 'system_user', count(*), sum(p_partkey)::BIGINT FROM part WHERE p_size < 10
 UNION ALL SELECT 'promo', count(*), sum(p_partkey)::BIGINT FROM part WHERE p_type = 'PROMO'""")
def selection_registry(spark, sf):
    """A registry with the reserved name and a renamed selection."""
    atoms = t.part_atoms(spark, sf)
    named = selections.Selections(atoms)
    named.add("system", atoms.where(F.col("beta").cast("int") < 10))
    named.add("x", selections.sel_lexical(atoms, "PROMO", "pdb_name")).rename("x", "promo")
    return named.table().groupBy("selection").agg(F.count("*").alias("n"), F.sum("atom_id").alias("ids"))


@query("restrict_intersection", f"WITH {TRAJ} SELECT frame, atom_id, {xyz()} FROM traj WHERE atom_id BETWEEN 7 AND 9 AND label IN ('A', 'B')")
def restrict_intersection(spark, sf):
    """Coordinates reduced to the intersection of three selections."""
    atoms = t.emb_atoms(spark, sf)
    both = selections.intersect(selections.sel_range(atoms, 0, 9), selections.sel_range(atoms, 7, 21))
    both = selections.intersect(both, selections.sel_lexical(atoms, "A|B"))
    return coords_out(selections.restrict(t.emb_traj(spark, sf), both))


@query("check_frames", f"""WITH {LI}, e AS (SELECT count(*) AS expected FROM supplier)
 SELECT frame, n_atoms, expected FROM (SELECT frame, count(*) AS n_atoms FROM li GROUP BY frame), e WHERE n_atoms <> expected""")
def check_frames(spark, sf):
    """Frames with another number of atoms than the structure."""
    return selections.check_frames(t.li_traj(spark, sf), t.read(spark, sf, "supplier"))


# == lookups and factors ======================================================================

PARTS = element_values(t.PART_PATTERNS)
LABELLED = """atoms AS (SELECT p_partkey AS atom_id, label FROM part
  JOIN elements ON regexp_full_match(p_type, name_regex))"""


def labelled_parts(spark, sf):
    return el.resolve_labels(t.part_atoms(spark, sf), t.elements(spark, t.PART_PATTERNS))


@query("resolve_labels", f"WITH {PARTS}, {LABELLED} SELECT atom_id, label FROM atoms")
def resolve_labels(spark, sf):
    """Element of each atom by the one pattern that matches its name."""
    return labelled_parts(spark, sf).select("atom_id", "label")


@query("label_match_counts", f"""WITH {PARTS} SELECT p_name AS pdb_name, count(label) AS n_elements
 FROM (SELECT DISTINCT p_name FROM part) LEFT JOIN elements ON regexp_full_match(upper(p_name), name_regex || '.*') GROUP BY p_name""")
def label_match_counts(spark, sf):
    """Number of matching elements per name."""
    names = t.read(spark, sf, "part").select(F.upper("p_name").alias("pdb_name"), F.col("p_name").alias("raw"))
    patterns = t.elements(spark, {k: f"{v}.*" if "|" not in v else f"{v.split('|')[0]}|{v.split('|')[1]}.*" for k, v in t.PART_PATTERNS.items()})
    counts = el.match_counts(names, patterns, "pdb_name")
    return names.distinct().join(counts, "pdb_name").select(F.col("raw").alias("pdb_name"), "n_elements")


@query("atom_constants", f"""WITH {PARTS}, {LABELLED} SELECT atom_id, atoms.label, mass, vol_type, excl_type, sf_type,
  {r('sf_params[1]', 'sf0')} FROM atoms JOIN elements USING (label)""")
def atom_constants(spark, sf):
    """The constants of each atom."""
    atoms = el.with_constants(labelled_parts(spark, sf), t.elements(spark, t.PART_PATTERNS))
    return atoms.select(
        "atom_id", "label", "mass", "vol_type", "excl_type", "sf_type", F.col("sf_params")[0].alias("sf0")
    )


KAPPA = """kap AS (SELECT p_partkey AS atom_id, CASE WHEN p_brand = 'Brand#2' THEN 1.1::DOUBLE
   WHEN p_size < 10 THEN 0.8::DOUBLE WHEN p_brand = 'Brand#1' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS kappa FROM part)"""


def part_kappas(spark, sf):
    atoms = t.part_atoms(spark, sf)
    named = selections.Selections(atoms)
    for brand in ("Brand#1", "Brand#2"):
        named.add(brand, selections.sel_pdb(atoms, "segid", brand))
    named.add("small", atoms.where(F.col("beta").cast("int") < 10))
    return el.kappa_table(atoms, t.kappas(spark), named.table(["Brand#1", "Brand#2", "small"]))


@query("kappa_per_atom", f"WITH {KAPPA} SELECT * FROM kap")
def kappa_per_atom(spark, sf):
    """Volume scale with later entries overriding earlier ones."""
    return part_kappas(spark, sf)


@query("reference_frame", f"""WITH {TRAJ} SELECT a.frame, a.atom_id, {r('a.x - b.x', 'dx')}, {r('a.y - b.y', 'dy')}, {r('a.z - b.z', 'dz')}
 FROM traj a JOIN traj b USING (atom_id), nf WHERE b.frame = n - 1""")
def reference_frame(spark, sf):
    """Displacement from a reference frame beyond the end, which means the last."""
    df = tagged(spark, sf)
    ref = align.reference_coords(df, t.n_frames(spark, sf) + 50)
    out = df.join(ref.drop("mass"), "atom_id").select(
        "frame", "atom_id", *((F.col(c) - F.col(f"u{c}")).alias(f"d{c}") for c in "xyz")
    )
    return rounded(out, "dx", "dy", "dz")


@query("volumes", f"""WITH {PARTS}, {LABELLED}, {KAPPA}
 SELECT atom_id, {r(f'kappa * {VOLUME}', 'volume')} FROM atoms JOIN kap USING (atom_id) JOIN elements USING (label)""")
def volumes(spark, sf):
    """M1: scaled volume of each atom."""
    atoms = labelled_parts(spark, sf).join(part_kappas(spark, sf), "atom_id")
    df = el.with_constants(atoms, t.elements(spark, t.PART_PATTERNS))
    v = F.col("kappa") * constants.volume(F.col("vol_type"), F.col("vol_params"))
    return rounded(df.select("atom_id", v.alias("volume")), "volume")


@query("effective_factors", f"""WITH {SUPPLIER_Q}, {PARTS}, {LABELLED}, {KAPPA},
 kinds AS (SELECT DISTINCT label, kappa FROM atoms JOIN kap USING (atom_id)),
 k AS (SELECT * FROM kinds JOIN elements USING (label))
 SELECT q_id, label, kappa, {r(f"{scattering('ql')} - 0.3 * {exclusion('ql', f'(kappa * {VOLUME})')}", 'f')} FROM k, q""")
def effective_factors(spark, sf):
    """M2-M6: factors of every species (element and volume scale) at every length of q."""
    elements = t.elements(spark, t.PART_PATTERNS)
    atoms = labelled_parts(spark, sf).join(part_kappas(spark, sf), "atom_id")
    species = el.species_table(atoms, elements)
    f = el.effective_factors(species, t.supplier_q(spark, sf), 0.3)
    out = f.join(species.select("species", "label", "kappa"), "species").select("q_id", "label", "kappa", "f")
    return rounded(out, "f")


@query("background_density", f"""WITH {PARTS}, {LABELLED}, {KAPPA}
 SELECT {r(f"sum({scattering('0.0::DOUBLE')}) / sum({exclusion('0.0::DOUBLE', f'(kappa * {VOLUME})')})", 'density')}
 FROM atoms JOIN kap USING (atom_id) JOIN elements USING (label)""")
def background_density(spark, sf):
    """M7: mean density of the background over all atoms."""
    atoms = labelled_parts(spark, sf).join(part_kappas(spark, sf), "atom_id")
    return rounded(el.background_density(atoms, t.elements(spark, t.PART_PATTERNS)), "density")


@query("validate_elements", """WITH e AS (SELECT p_name || p_partkey AS label, p_size, p_partkey FROM part),
 bad AS (SELECT label, CASE WHEN p_size % 5 = 0 THEN 'mass missing' END AS p FROM e
  UNION ALL SELECT label, CASE WHEN p_size % 7 = 0 THEN 'volume type missing' END FROM e
  UNION ALL SELECT label, CASE WHEN p_size % 11 = 0 THEN 'exclusion constants missing' END FROM e
  UNION ALL SELECT label, CASE WHEN p_size % 4 = 3 THEN 'scattering type not known' END FROM e
  UNION ALL SELECT label, CASE WHEN p_size % 4 IN (1, 2) AND (p_partkey % 20) < CASE p_size % 4 WHEN 1 THEN 15 ELSE 9 END
     AND p_partkey % 20 > 0 THEN 'scattering constants incomplete' END FROM e
  UNION ALL SELECT label, CASE WHEN p_partkey % 20 = 0 THEN 'scattering constants missing' END FROM e)
 SELECT label, p AS problem FROM bad WHERE p IS NOT NULL""")
def validate_elements(spark, sf):
    """M8: missing constants, on an element table with one element per part."""
    size, key = F.col("p_size"), F.col("p_partkey")
    one = F.array(F.lit(1.0))
    table = t.read(spark, sf, "part").select(
        F.concat("p_name", "p_partkey").alias("label"), F.lit("X").alias("name_regex"),
        F.when(size % 5 != 0, 1.0).alias("mass"),
        F.when(size % 7 != 0, 0).alias("vol_type"), one.alias("vol_params"),
        F.lit(1).alias("excl_type"), F.when(size % 11 != 0, one).alias("excl_params"),
        (size % 4).alias("sf_type"),
        F.array_repeat(F.lit(1.0), (key % 20).cast("int")).alias("sf_params"),
    )
    return el.validate_elements(table)


# == scattering vectors =======================================================================


@query("scan_vectors", f"""WITH s AS (SELECT s_suppkey AS scan_id, s_acctbal / 7013 AS lo, s_nationkey / 5.0::DOUBLE AS hi, s_suppkey % 7 AS n FROM supplier),
 j AS (SELECT scan_id, q_id, CASE WHEN n = 1 THEN (lo + hi)/2 WHEN q_id = 0 THEN lo WHEN q_id = n - 1 THEN hi
   ELSE lo + pow(q_id / (n - 1)::DOUBLE, 2) * (hi - lo) END AS v FROM s, range(7) k(q_id) WHERE q_id < n)
 SELECT scan_id, q_id, {r('0.6 * v', 'qx')}, {r('0.8 * v', 'qz')}, {r('abs(v)', 'ql')} FROM j""")
def scan_vectors(spark, sf):
    """One scan per supplier with 0 to 6 points and exponent 2."""
    specs = t.read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("scan_id"),
        F.array(qspace.scan((0.6, 0.0, 0.8), F.col("s_acctbal") / 7013, F.col("s_nationkey") / 5.0,
                            F.col("s_suppkey") % 7, 2.0)).alias("scans"),
    )
    q = qspace.q_grid(specs, ["scan_id"])
    return rounded(q.select("scan_id", "q_id", "qx", "qz", "ql"), "qx", "qz", "ql")


@query("scan_products", f"""WITH s AS (SELECT s_suppkey AS grid_id, s_acctbal / 7013 AS hi FROM supplier)
 SELECT grid_id, (i * 4 + j) * 2 + k AS q_id, {r('hi * i / 2.0::DOUBLE', 'qx')}, {r('0.1 + 0.3 * j', 'qy')}, {r('-1.0 + 2.0 * k', 'qz')}
 FROM s, range(3) a(i), range(4) b(j), range(2) c(k)""")
def scan_products(spark, sf):
    """Three scans per supplier, all sums of their vectors."""
    specs = t.read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("grid_id"),
        F.array(
            qspace.scan((1.0, 0.0, 0.0), 0.0, F.col("s_acctbal") / 7013, 3),
            qspace.scan((0.0, 1.0, 0.0), 0.1, 1.0, 4),
            qspace.scan((0.0, 0.0, 1.0), -1.0, 1.0, 2),
        ).alias("scans"),
    )
    q = qspace.q_grid(specs, ["grid_id"])
    return rounded(q.drop("ql"), "qx", "qy", "qz")


def _sub_out(df):
    return rounded(df.select("q_id", "m_id", "qx", "qy", "qz"), "qx", "qy", "qz")


@query("subvectors_plain", f"WITH {SUPPLIER_Q} SELECT q_id, 0::BIGINT AS m_id, {r('qx', 'qx')}, {r('qy', 'qy')}, {r('qz', 'qz')} FROM q")
def subvectors_plain(spark, sf):
    """Vectors without averaging."""
    return _sub_out(qspace.subvectors_none(t.supplier_q(spark, sf)))


@query("subvectors_sphere", f"WITH {SUPPLIER_Q}, {ORIENT} SELECT q_id, m_id, {r('ql*ux', 'qx')}, {r('ql*uy', 'qy')}, {r('ql*uz', 'qz')} FROM q, orient")
def subvectors_sphere(spark, sf):
    """Eight given orientations of each vector."""
    return _sub_out(qspace.subvectors_sphere(t.supplier_q(spark, sf), t.directions(spark)))


_SPHERE = on_sphere("m_id", 7, 0)


@query("subvectors_random_sphere", f"""WITH {SUPPLIER_Q}, o AS (SELECT m_id, {_SPHERE[0]} AS ux, {_SPHERE[1]} AS uy, {_SPHERE[2]} AS uz FROM range(16) g(m_id))
 SELECT q_id, m_id, {r('ql*ux', 'qx')}, {r('ql*uy', 'qy')}, {r('ql*uz', 'qz')} FROM q, o""")
def subvectors_random_sphere(spark, sf):
    """Seeded random orientations on the sphere."""
    return _sub_out(qspace.subvectors_sphere(t.supplier_q(spark, sf), qspace.orient_sphere(spark, 16, 7)))


# axis (1, 2, 2) / 3 and its base
_EZ = (1 / 3, 2 / 3, 2 / 3)
_ER = (-2 / math.sqrt(5), 1 / math.sqrt(5), 0.0)
_EP = (-2 / (3 * math.sqrt(5)), -4 / (3 * math.sqrt(5)), 5 / (3 * math.sqrt(5)))


def _dot_sql(e):
    return f"(qx*{e[0]!r} + qy*{e[1]!r} + qz*{e[2]!r})"


@query("subvectors_circle", f"""WITH {SUPPLIER_Q},
 p AS (SELECT q_id, {_dot_sql(_EZ)} AS qa, sqrt(pow({_dot_sql(_ER)}, 2) + pow({_dot_sql(_EP)}, 2)) AS qr FROM q),
 o AS (SELECT m_id, 2*{PI}*m_id/360.0::DOUBLE AS phi FROM range(360) g(m_id))
 SELECT q_id, m_id, {r(f'qa*{_EZ[0]!r} + qr*(cos(phi)*{_ER[0]!r} + sin(phi)*{_EP[0]!r})', 'qx')},
  {r(f'qa*{_EZ[1]!r} + qr*(cos(phi)*{_ER[1]!r} + sin(phi)*{_EP[1]!r})', 'qy')},
  {r(f'qa*{_EZ[2]!r} + qr*(cos(phi)*{_ER[2]!r} + sin(phi)*{_EP[2]!r})', 'qz')} FROM p, o""")
def subvectors_circle(spark, sf):
    """Each vector turned about a slanted axis in 360 steps."""
    return _sub_out(qspace.subvectors_cylinder(t.supplier_q(spark, sf), qspace.orient_raster(spark, 1), (1.0, 2.0, 2.0)))


@query("subvectors_parallel", f"""WITH {SUPPLIER_Q}, o AS (SELECT m_id, 2*{PI}*{on_sphere('m_id', 3, 0)[2].replace('(2*', '(1*', 1).replace(' - 1)', ')')} AS phi FROM range(12) g(m_id))
 SELECT q_id, 0::BIGINT AS m_id, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, {r('qz', 'qz')} FROM q WHERE qx = 0 AND qy = 0
 UNION ALL SELECT q_id, m_id, {r('sqrt(qx*qx + qy*qy)*cos(phi)', 'qx')}, {r('sqrt(qx*qx + qy*qy)*sin(phi)', 'qy')}, {r('qz', 'qz')}
 FROM q, o WHERE NOT (qx = 0 AND qy = 0)""")
def subvectors_parallel(spark, sf):
    """Random directions about z; vectors along the axis appear once."""
    return _sub_out(qspace.subvectors_cylinder(t.supplier_q(spark, sf), qspace.orient_circle(spark, 12, 3)))


@query("pending_vectors", f"""WITH {SUPPLIER_Q} SELECT q_id, {r('qx', 'qx')}, {r('qy', 'qy')}, {r('qz', 'qz')} FROM q
 WHERE (qx, qy, qz) NOT IN (SELECT (qx, qy, qz) FROM q WHERE qx < 0.5)""")
def pending_vectors(spark, sf):
    """Vectors that a result does not hold yet."""
    q = t.supplier_q(spark, sf)
    done = q.where("qx < 0.5").select("qx", "qy", "qz")
    return rounded(qspace.pending_vectors(q, done.unionByName(done)).drop("ql"), "qx", "qy", "qz")


# == geometry =================================================================================


@query("vector_algebra", f"""WITH {LI}, v AS (SELECT frame, x, y, z, z + 1 AS a, x - 2 AS b, y * 0.5 AS c FROM li)
 SELECT frame, {r('sum(x*a + y*b + z*c)', 'dot', 4)}, {r('sum(y*c - z*b)', 'cx', 4)}, {r('sum(z*a - x*c)', 'cy', 4)},
  {r('sum(x*b - y*a)', 'cz', 4)}, {r('sum(sqrt((x+a)*(x+a) + (y+b)*(y+b) + (z+c)*(z+c)))', 'len', 4)},
  {r('sum(2*(x-a))', 'dx', 4)} FROM v GROUP BY frame""")
def vector_algebra(spark, sf):
    """Dot, cross, sum, difference, scale and length of two vectors per atom."""
    u = vec.columns()
    w = vec.Vec(u.z + 1, u.x - 2, u.y * 0.5)
    cross = vec.cross(u, w)
    out = t.li_traj(spark, sf).groupBy("frame").agg(
        F.sum(vec.dot(u, w)).alias("dot"), F.sum(cross.x).alias("cx"), F.sum(cross.y).alias("cy"),
        F.sum(cross.z).alias("cz"), F.sum(vec.length(vec.add(u, w))).alias("len"),
        F.sum(vec.scale(2, vec.sub(u, w)).x).alias("dx"),
    )
    return rounded(out, "dot", "cx", "cy", "cz", "len", "dx", digits=4)


def _azimuth_sql(y, x):
    return f"(CASE WHEN atan2({y}, {x}) < 0 THEN atan2({y}, {x}) + 2*{PI} ELSE atan2({y}, {x}) END)"


@query("cylindrical", f"""WITH {TRAJ}, p AS (SELECT frame, atom_id, {_dot_sql(_ER).replace('q', '')} AS a, {_dot_sql(_EP).replace('q', '')} AS b, {_dot_sql(_EZ).replace('q', '')} AS c FROM traj)
 SELECT frame, atom_id, {r('sqrt(a*a + b*b)', 'r')}, {r(_azimuth_sql('b', 'a'), 'phi')}, {r('c', 'z')} FROM p""")
def cylindrical(spark, sf):
    """Cylinder coordinates about a slanted axis."""
    df = align.with_representation(t.emb_traj(spark, sf), "cylindrical", (1.0, 2.0, 2.0))
    return rounded(df.select("frame", "atom_id", "r", "phi", "z"), "r", "phi", "z")


@query("spherical", f"""WITH {TRAJ} SELECT frame, atom_id, {r('sqrt(x*x + y*y + z*z)', 'r')}, {r(_azimuth_sql('y', 'x'), 'phi')},
  {r('acos(z / sqrt(x*x + y*y + z*z))', 'theta')} FROM traj""")
def spherical(spark, sf):
    """Spherical coordinates."""
    df = align.with_representation(t.emb_traj(spark, sf), "spherical")
    return rounded(df.select("frame", "atom_id", "r", "phi", "theta"), "r", "phi", "theta")


@query("back_to_cartesian", f"""WITH {LI} SELECT frame, {r('sum(x)', 'sx', 4)}, {r('sum(y)', 'sy', 4)}, {r('sum(z)', 'sz', 4)},
  {r('sum(x)', 'cx', 4)}, {r('sum(y)', 'cy', 4)}, {r('sum(z)', 'cz', 4)} FROM li GROUP BY frame""")
def back_to_cartesian(spark, sf):
    """C4: to spherical and cylinder coordinates and back gives the same vectors."""
    s = vec.from_sphere(*vec.to_sphere(vec.columns()))
    c = vec.from_cylinder(*vec.to_cylinder(vec.columns()))
    out = t.li_traj(spark, sf).groupBy("frame").agg(
        *(F.sum(e).alias(f"s{n}") for n, e in zip("xyz", s)), *(F.sum(e).alias(f"c{n}") for n, e in zip("xyz", c))
    )
    return rounded(out, "sx", "sy", "sz", "cx", "cy", "cz", digits=4)


@query("rotate_axis", f"""WITH {TRAJ} SELECT frame, atom_id, {r('x', 'xx')}, {r('cos(0.7)*y - sin(0.7)*z', 'xy')}, {r('sin(0.7)*y + cos(0.7)*z', 'xz')},
  {r('cos(0.7)*x + sin(0.7)*z', 'yx')}, {r('cos(0.7)*z - sin(0.7)*x', 'yz')},
  {r('cos(0.7)*x - sin(0.7)*y', 'zx')}, {r('sin(0.7)*x + cos(0.7)*y', 'zy')} FROM traj""")
def rotate_axis(spark, sf):
    """Turns about x, y and z."""
    v = vec.columns()
    x, y, z = (vec.rotate(v, a, 0.7) for a in "xyz")
    out = t.emb_traj(spark, sf).select(
        "frame", "atom_id", x.x.alias("xx"), x.y.alias("xy"), x.z.alias("xz"),
        y.x.alias("yx"), y.z.alias("yz"), z.x.alias("zx"), z.y.alias("zy"),
    )
    return rounded(out, "xx", "xy", "xz", "yx", "yz", "zx", "zy")


@query("translate_selection", f"WITH {TRAJ}, {TAGGED} SELECT frame, atom_id, {r('CASE WHEN core THEN x + 1.5 ELSE x END', 'x')}, {r('CASE WHEN core THEN y - 2 ELSE y END', 'y')}, {r('z', 'z')} FROM tagged")
def translate_selection(spark, sf):
    """One selection moved, the rest left."""
    return coords_out(align.translate(tagged(spark, sf), vec.literal((1.5, -2.0, 0.0)), "core"))


@query("affine_selection", f"""WITH {TRAJ}, {TAGGED}, m AS (SELECT *, frame / 100.0::DOUBLE AS a FROM tagged)
 SELECT frame, atom_id, {r('CASE WHEN tail THEN x*cos(a) - y*sin(a) + a ELSE x END', 'x')},
  {r('CASE WHEN tail THEN x*sin(a) + y*cos(a) ELSE y END', 'y')}, {r('CASE WHEN tail THEN 2*z - 1 ELSE z END', 'z')} FROM m""")
def affine_selection(spark, sf):
    """A matrix and a shift for each frame, applied to one selection."""
    a = F.col("vec_id") / 100.0
    rows = {
        "r00": F.cos(a), "r01": F.sin(a), "r02": F.lit(0.0), "r10": -F.sin(a), "r11": F.cos(a), "r12": F.lit(0.0),
        "r20": F.lit(0.0), "r21": F.lit(0.0), "r22": F.lit(2.0), "tx": a, "ty": F.lit(0.0), "tz": F.lit(-1.0),
    }
    matrices = t.read(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), *(c.alias(n) for n, c in rows.items()))
    return coords_out(align.affine(tagged(spark, sf), matrices, "tail", t.n_frames(spark, sf)))


@query("reorient", f"WITH {TRAJ} SELECT frame, atom_id, {r('y', 'x')}, {r('z', 'y')}, {r('x', 'z')} FROM traj")
def reorient(spark, sf):
    """Y becomes x and a direction in the yz plane comes to lie in the xy plane."""
    return coords_out(align.reorient(t.emb_traj(spark, sf), (0.0, 3.0, 0.0), (0.0, 5.0, 2.0)))


# == alignment ================================================================================


def _com(where: str, name: str = "com") -> str:
    return f"{name} AS (SELECT frame, sum(mass*x)/sum(mass) AS cx, sum(mass*y)/sum(mass) AS cy, sum(mass*z)/sum(mass) AS cz FROM tagged WHERE {where} GROUP BY frame)"


@query("center_of_mass", f"WITH {TRAJ}, {TAGGED}, {_com('tail')} SELECT frame, {r('cx', 'cx')}, {r('cy', 'cy')}, {r('cz', 'cz')} FROM com")
def center_of_mass(spark, sf):
    """A1: weighted centre of a selection in each frame."""
    return rounded(align.center_of_mass(tagged(spark, sf), "tail"), "cx", "cy", "cz")


@query("align_center", f"""WITH {TRAJ}, {TAGGED}, {_com('core')}
 SELECT frame, atom_id, {r('CASE WHEN tail THEN x - cx ELSE x END', 'x')}, {r('CASE WHEN tail THEN y - cy ELSE y END', 'y')},
  {r('CASE WHEN tail THEN z - cz ELSE z END', 'z')} FROM tagged JOIN com USING (frame)""")
def align_center(spark, sf):
    """A2: the tail moved by the centre of the core."""
    return coords_out(align.align_center(tagged(spark, sf), "tail", "core", t.n_frames(spark, sf)))


@query("align_fittrans", f"""WITH {TRAJ}, {TAGGED}, {_com('core')},
 ref AS (SELECT sum(mass*x)/sum(mass) AS rx, sum(mass*y)/sum(mass) AS ry, sum(mass*z)/sum(mass) AS rz FROM tagged WHERE frame = 3 AND tail)
 SELECT frame, atom_id, {r('CASE WHEN core THEN x - cx + rx ELSE x END', 'x')}, {r('CASE WHEN core THEN y - cy + ry ELSE y END', 'y')},
  {r('CASE WHEN core THEN z - cz + rz ELSE z END', 'z')} FROM tagged JOIN com USING (frame), ref""")
def align_fittrans(spark, sf):
    """A3: the core moved to the centre the tail has in frame 3."""
    df = tagged(spark, sf)
    ref = align.reference_coords(df, 3, "tail")
    return coords_out(align.align_fittrans(df, ref, "core", t.n_frames(spark, sf)))


@query("align_fittrans_instant", f"""WITH {TRAJ}, {TAGGED}, {_com('core')}, {_com('true', 'every').replace(' AS cx', ' AS ax').replace(' AS cy', ' AS ay').replace(' AS cz', ' AS az')}
 SELECT frame, atom_id, {r('CASE WHEN core THEN x - cx + ax ELSE x END', 'x')}, {r('CASE WHEN core THEN y - cy + ay ELSE y END', 'y')},
  {r('CASE WHEN core THEN z - cz + az ELSE z END', 'z')} FROM tagged JOIN com USING (frame) JOIN every USING (frame)""")
def align_fittrans_instant(spark, sf):
    """The reference is the whole current frame."""
    return coords_out(align.align_fittrans(tagged(spark, sf), None, "core", t.n_frames(spark, sf)))


_K = ", ".join(
    r(f"sum(m.mass * (u.{a} - c{a}) * (m.{b} - p{b}))", f"k{i}{j}", 4)
    for i, a in enumerate("xyz") for j, b in enumerate("xyz")
)


@query("fit_covariance", f"""WITH {TRAJ}, {TAGGED}, u AS (SELECT * FROM tagged WHERE frame = 0 AND tail),
 c AS (SELECT sum(mass*x)/sum(mass) AS cx, sum(mass*y)/sum(mass) AS cy, sum(mass*z)/sum(mass) AS cz FROM u),
 p AS (SELECT frame, sum(mass*x)/sum(mass) AS px, sum(mass*y)/sum(mass) AS py, sum(mass*z)/sum(mass) AS pz FROM tagged WHERE tail GROUP BY frame)
 SELECT m.frame, count(*) AS n_atoms, {_K} FROM tagged m JOIN u USING (atom_id) JOIN p ON p.frame = m.frame, c GROUP BY m.frame""")
def fit_covariance(spark, sf):
    """A4: the weighted covariance sums of a least-squares fit."""
    df = tagged(spark, sf)
    sums = align.fit_sums(df, align.reference_coords(df, 0, "tail"))
    names = [f"k{i}{j}" for i in range(3) for j in range(3)]
    return rounded(sums.select("frame", "n_atoms", *names), *names, digits=4)


def turned_copies(spark, sf):
    """Each frame is frame 0 turned by angles of its own and shifted."""
    df = tagged(spark, sf)
    first = df.where("frame = 0").drop("frame")
    angle = t.read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("frame"), *(F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate(("a", "b", "c")))
    )
    grown = angle.withColumn("atom_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(t.ATOMS_PER_VECTOR - 1).cast("bigint"))))
    both = grown.join(first, "atom_id")
    v = vec.rotate(vec.rotate(vec.columns(), "x", F.col("a") * 5), "z", F.col("b") * 5)
    v = vec.add(v, vec.Vec(F.col("a"), F.col("b"), F.col("c")))
    return both.select("frame", "atom_id", *(e.alias(n) for n, e in zip("xyz", v)), "mass", "in_core", "in_tail"), df


@query("align_fitrottrans", f"""WITH {TRAJ}, z0 AS (SELECT atom_id, x, y, z FROM traj WHERE frame = 0),
 e AS (SELECT vec_id AS frame, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)
 SELECT frame, atom_id, {xyz(digits=5)} FROM e, z0 WHERE atom_id >= 7
 UNION ALL SELECT frame, atom_id, {r('a + cos(5*b)*x - sin(5*b)*(cos(5*a)*y - sin(5*a)*z)', 'x', 5)},
   {r('b + sin(5*b)*x + cos(5*b)*(cos(5*a)*y - sin(5*a)*z)', 'y', 5)}, {r('c + sin(5*a)*y + cos(5*a)*z', 'z', 5)} FROM e, z0 WHERE atom_id < 7""")
def align_fitrottrans(spark, sf):
    """A4: copies of a frame, turned and shifted, are brought back on to it; atoms outside the reference selection stay where they are."""
    copies, df = turned_copies(spark, sf)
    ref = align.reference_coords(df, 0, "tail")
    fitted = align.align_fitrottrans(copies, ref, "system", "tail", t.n_frames(spark, sf))
    return coords_out(fitted, 5)


@query("align_fitrot", f"""WITH {TRAJ}, z0 AS (SELECT atom_id, x, y, z, mass FROM traj WHERE frame = 0),
 c AS (SELECT sum(mass*x)/sum(mass) AS cx, sum(mass*y)/sum(mass) AS cy, sum(mass*z)/sum(mass) AS cz FROM z0),
 e AS (SELECT vec_id AS frame, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings),
 o AS (SELECT frame, a + cos(5*b)*cx - sin(5*b)*(cos(5*a)*cy - sin(5*a)*cz) AS ox,
    b + sin(5*b)*cx + cos(5*b)*(cos(5*a)*cy - sin(5*a)*cz) AS oy, e.c + sin(5*a)*cy + cos(5*a)*cz AS oz FROM e, c)
 SELECT frame, atom_id, {r('x - cx + ox', 'x', 5)}, {r('y - cy + oy', 'y', 5)}, {r('z - cz + oz', 'z', 5)} FROM z0, o, c""")
def align_fitrot(spark, sf):
    """A5: the same copies are turned back about their own centres."""
    copies, df = turned_copies(spark, sf)
    return coords_out(align.align_fitrot(copies, align.reference_coords(df, 0), n_frames=t.n_frames(spark, sf)), 5)


@query("prepare_steps", f"""WITH {TRAJ}, {TAGGED}, {_com('core')},
 s1 AS (SELECT frame, atom_id, mass, core, tail, x - cx AS x, y - cy AS y, z - cz AS z FROM tagged JOIN com USING (frame)),
 s2 AS (SELECT frame, atom_id, mass, core, tail, CASE WHEN core THEN x + frame*0.02 ELSE x END AS x, y, z FROM s1),
 c2 AS (SELECT frame, sum(mass*x)/sum(mass) AS cx, sum(mass*y)/sum(mass) AS cy, sum(mass*z)/sum(mass) AS cz FROM s2 WHERE tail GROUP BY frame),
 s3 AS (SELECT frame, atom_id, tail, x - cx AS x, y - cy AS y, z - cz AS z FROM s2 JOIN c2 USING (frame))
 SELECT frame, atom_id, {r('sqrt(x*x + y*y + z*z)', 'r')}, {r(_azimuth_sql('y', 'x'), 'phi')}, {r('acos(z / sqrt(x*x + y*y + z*z))', 'theta')} FROM s3 WHERE tail""")
def prepare_steps(spark, sf):
    """Centre, add a motion, centre again, reduce, convert."""
    n = t.n_frames(spark, sf)
    atoms = t.emb_atoms(spark, sf)
    named = selections.Selections(atoms)
    named.add("core", selections.sel_range(atoms, 0, 9)).add("tail", selections.sel_range(atoms, 7, 21))
    df = prepare_coordinates(
        t.emb_traj(spark, sf).drop("label", "species"), atoms, named,
        pre=[lambda d: align.align_center(d, "system", "core", n)],
        motions=[lambda d: motions.motion_linear(d, 0.02, selection="core")],
        post=[lambda d: align.align_center(d, "system", "tail", n)],
        uses=["system", "core", "tail"], target="tail", representation="spherical",
    )
    return rounded(df.select("frame", "atom_id", "r", "phi", "theta"), "r", "phi", "theta")


@query("prepare_rigid_chain", f"""WITH {TRAJ}, z0 AS (SELECT atom_id, x, y, z, mass FROM traj WHERE frame = 0),
 s AS (SELECT vec_id AS frame, atom_id, mass, x - CASE WHEN atom_id > 9 THEN 0.02*vec_id ELSE 0 END AS x, y, z FROM embeddings, z0),
 c AS (SELECT frame, sum(mass*x)/sum(mass) AS cx, sum(mass*y)/sum(mass) AS cy, sum(mass*z)/sum(mass) AS cz FROM s WHERE atom_id >= 7 GROUP BY frame)
 SELECT frame, atom_id, {r('x - cx', 'x', 5)}, {r('y - cy', 'y', 5)}, {r('z - cz', 'z', 5)} FROM s JOIN c USING (frame)""")
def prepare_rigid_chain(spark, sf):
    """Copies of a frame, turned and shifted, are fitted on to it by one selection, the other one drifts off, all is fitted to that
    one and centred on the first: four steps, one map per frame."""
    n = t.n_frames(spark, sf)
    copies, df = turned_copies(spark, sf)
    tail, core = (rigid.Reference.of(align.reference_coords(df, 0, name)) for name in ("tail", "core"))
    chain = [
        rigid.Fit(tail, "system", "tail", apply_to="selection"), rigid.Shift(motions.linear(0.02), "core"),
        rigid.Fit(core, "system", "core", apply_to="selection"), rigid.Centre("system", "tail"),
    ]
    return coords_out(rigid.move(copies, chain, n), 5)


@query("clustered_frames", f"""WITH {TRAJ}, {TAGGED}, {_com('core')} SELECT frame, atom_id, {r('CASE WHEN tail THEN x - cx ELSE x END', 'x')},
   {r('CASE WHEN tail THEN y - cy ELSE y END', 'y')}, {r('CASE WHEN tail THEN z - cz ELSE z END', 'z')} FROM tagged JOIN com USING (frame)""")
def clustered_frames(spark, sf):
    """The trajectory in buckets by frame, with a table of all frames in the same buckets."""
    df = staging.cluster_by_frame(tagged(spark, sf), 8)
    return coords_out(rigid.move(df, [rigid.Centre("tail", "core")], None, 8))


# == motions ==================================================================================


@query("motion_linear", f"WITH {TRAJ} SELECT frame, atom_id, {r('x + frame*0.05*2*0.6', 'x')}, {r('y + frame*0.05*2*0.8', 'y')}, {r('z', 'z')} FROM traj")
def motion_linear(spark, sf):
    """W1."""
    return coords_out(motions.motion_linear(t.emb_traj(spark, sf), 0.05, (3.0, 4.0, 0.0), sampling=2))


@query("motion_fixed", f"WITH {TRAJ}, {TAGGED} SELECT frame, atom_id, {r('x', 'x')}, {r('y', 'y')}, {r('CASE WHEN core THEN z + 2.5 ELSE z END', 'z')} FROM tagged")
def motion_fixed(spark, sf):
    """W2."""
    return coords_out(motions.motion_fixed(tagged(spark, sf), 2.5, (0.0, 0.0, 7.0), "core"))


@query("motion_oscillation", f"WITH {TRAJ} SELECT frame, atom_id, {r('x', 'x')}, {r(f'y + 1.5*sin(2*{PI}*frame*0.01*3)', 'y')}, {r('z', 'z')} FROM traj")
def motion_oscillation(spark, sf):
    """W3."""
    return coords_out(motions.motion_oscillation(t.emb_traj(spark, sf), 1.5, 0.01, (0.0, 2.0, 0.0), sampling=3))


def _walk_sql(steps: tuple, extra: str = "") -> str:
    d = ", ".join(f"{e} AS d{c}" for c, e in zip("xyz", steps))
    run = ", ".join(f"sum(d{c}) OVER (ORDER BY frame) AS t{c}" for c in "xyz")
    return f"st AS (SELECT frame, {d} FROM (SELECT vec_id AS frame FROM embeddings)), w AS (SELECT frame, {run} FROM st)"


@query("motion_randomwalk", f"""WITH {TRAJ}, {_walk_sql(tuple(f'0.1*{e}' for e in on_sphere('(frame*2)', 5, 0)))}
 SELECT frame, atom_id, {r('x + tx', 'x')}, {r('y + ty', 'y')}, {r('z + tz', 'z')} FROM traj JOIN w USING (frame)""")
def motion_randomwalk(spark, sf):
    """Steps of equal length, summed over blocks of frames."""
    n = t.n_frames(spark, sf)
    shifts = motions.walk(motions.randomwalk_steps(spark, n, 0.1, seed=5, sampling=2), block=64)
    return coords_out(motions.motion_walk(t.emb_traj(spark, sf), shifts, n_frames=n))


@query("motion_brownian", f"""WITH {TRAJ}, {_walk_sql(tuple(f"0.1*{normal('frame', 5, 1)}*{e}" for e in on_sphere('frame', 5, 0)))}
 SELECT frame, atom_id, {r('x + tx', 'x')}, {r('y + ty', 'y')}, {r('z + tz', 'z')} FROM traj JOIN w USING (frame)""")
def motion_brownian(spark, sf):
    """Steps of normally distributed length."""
    return coords_out(motions.motion_brownian(t.emb_traj(spark, sf), t.n_frames(spark, sf), 0.1, seed=5))


@query("walk_of_given_steps", f"""WITH st AS (SELECT vec_id AS frame, CAST(embedding[1] AS DOUBLE) AS dx, CAST(embedding[2] AS DOUBLE) AS dy, CAST(embedding[64] AS DOUBLE) AS dz FROM embeddings)
 SELECT frame, {r('sum(dx) OVER (ORDER BY frame)', 'tx')}, {r('sum(dy) OVER (ORDER BY frame)', 'ty')}, {r('sum(dz) OVER (ORDER BY frame)', 'tz')} FROM st""")
def walk_of_given_steps(spark, sf):
    """Cumulative sum of given steps."""
    steps = t.read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("frame"), *(F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in ((0, "dx"), (1, "dy"), (63, "dz")))
    )
    return rounded(motions.walk(steps, block=50), "tx", "ty", "tz")


def _turn_sql() -> str:
    """Recursive product of the turns of all frames, row by row."""
    a = [f"(3.0*{normal('vec_id', 9, k)}*{PI}/180)" for k in range(3)]
    # turn in xy, then xz, then yz, for row vectors
    step = {
        "m00": "cos(a1)*cos(a2)", "m01": "sin(a1)*cos(a3) + cos(a1)*sin(a2)*sin(a3)", "m02": "sin(a1)*sin(a3) - cos(a1)*sin(a2)*cos(a3)",
        "m10": "-sin(a1)*cos(a2)", "m11": "cos(a1)*cos(a3) - sin(a1)*sin(a2)*sin(a3)", "m12": "cos(a1)*sin(a3) + sin(a1)*sin(a2)*cos(a3)",
        "m20": "sin(a2)", "m21": "-cos(a2)*sin(a3)", "m22": "cos(a2)*cos(a3)",
    }
    m = ", ".join(f"{e} AS {n}" for n, e in step.items())
    prod = ", ".join(" + ".join(f"p.r{i}{k}*s.m{k}{j}" for k in range(3)) + f" AS r{i}{j}" for i in range(3) for j in range(3))
    start = ", ".join(f"m{i}{j} AS r{i}{j}" for i in range(3) for j in range(3))
    return f"""ang AS (SELECT vec_id AS frame, {a[0]} AS a1, {a[1]} AS a2, {a[2]} AS a3 FROM embeddings),
 step AS (SELECT frame, {m} FROM ang),
 rot AS (SELECT frame, {start} FROM step WHERE frame = 0
   UNION ALL SELECT s.frame, {prod} FROM rot p JOIN step s ON s.frame = p.frame + 1)"""


@query("motion_rotbrownian", f"""WITH RECURSIVE {TRAJ}, {TAGGED}, {_com('true')}, {_turn_sql()},
 v AS (SELECT frame, atom_id, x - cx AS x, y - cy AS y, z - cz AS z, cx, cy, cz FROM tagged JOIN com USING (frame))
 SELECT frame, atom_id, {r('cx + x*r00 + y*r10 + z*r20', 'x')}, {r('cy + x*r01 + y*r11 + z*r21', 'y')}, {r('cz + x*r02 + y*r12 + z*r22', 'z')}
 FROM v JOIN rot USING (frame)""")
def motion_rotbrownian(spark, sf):
    """Random turns about the current centre, multiplied up over blocks of frames."""
    n = t.n_frames(spark, sf)
    turns = motions.rotation_walk(motions.rotation_steps(spark, n, 3.0, seed=9), block=100)
    return coords_out(motions.motion_rotation(tagged(spark, sf), turns, n_frames=n))


# == amplitudes ===============================================================================

LI_FACTORS = f"{ELEMENTS}, {FACTORS}"
SUB8 = f"{ORIENT}, sub AS (SELECT q_id, m_id, ql*ux AS qx, ql*uy AS qy, ql*uz AS qz FROM q, orient)"
SUB1 = "sub AS (SELECT q_id, 0::BIGINT AS m_id, qx, qy, qz FROM q)"


def _amp_sql(source: str) -> str:
    return f"""amp AS (SELECT s.q_id, s.m_id, c.frame, sum(f*cos(c.x*s.qx + c.y*s.qy + c.z*s.qz)) AS re,
   sum(f*sin(c.x*s.qx + c.y*s.qy + c.z*s.qz)) AS im
 FROM {source} c JOIN factors USING (label) JOIN sub s USING (q_id) GROUP BY ALL)"""


def _amp_out(df, digits=5):
    return rounded(df.select("q_id", "m_id", "frame", "re", "im"), "re", "im", digits=digits)


AMP_COLS = f"q_id, m_id, frame, {r('re', 're', 5)}, {r('im', 'im', 5)}"
AMP_ALL = f"WITH {LI}, {SCAN_Q}, {LI_FACTORS}, {SUB8}, {_amp_sql('li')} SELECT {AMP_COLS} FROM amp"


def _li_amp(spark, sf, engine):
    q = t.scan_q(spark)
    sub = qspace.subvectors_sphere(q, t.directions(spark))
    return amplitude.amplitude_all(t.li_traj(spark, sf), t.factors(spark, q), sub, engine)


@query("amplitude_all_kernel", AMP_ALL)
def amplitude_all_kernel(spark, sf):
    """Coherent amplitude of every lineitem frame, Arrow engine."""
    return _amp_out(_li_amp(spark, sf, "kernel"))


@query("amplitude_all_sql", AMP_ALL)
def amplitude_all_sql(spark, sf):
    """The same by expressions only."""
    return _amp_out(_li_amp(spark, sf, "sql"))


@query("amplitude_single", f"""WITH {LI}, q AS (SELECT 0::BIGINT AS q_id, 1.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qz, 1.0::DOUBLE AS ql),
 {LI_FACTORS}, {SUB1}, {_amp_sql('li')} SELECT {AMP_COLS} FROM amp""")
def amplitude_single(spark, sf):
    """F1, G1: one vector, by default (1, 0, 0)."""
    q = qspace.q_single(spark)
    return _amp_out(amplitude.amplitude_all(t.li_traj(spark, sf), t.factors(spark, q), qspace.subvectors_none(q)))


@query("amplitude_grid", f"""WITH {TRAJ}, q AS (SELECT j AS q_id, 0.05 + 0.11*(j // 256) AS qx, 0.02*(j // 256) + 0.13*(j // 16 % 16) AS qy, 0.03*(j // 16 % 16) + 0.17*(j % 16) AS qz,
   sqrt(pow(0.05 + 0.11*(j // 256), 2) + pow(0.02*(j // 256) + 0.13*(j // 16 % 16), 2) + pow(0.03*(j // 16 % 16) + 0.17*(j % 16), 2)) AS ql FROM range(4096) r(j)),
 {LI_FACTORS}, c AS (SELECT q_id, frame, sum(f*cos(x*qx + y*qy + z*qz)) AS re, sum(f*sin(x*qx + y*qy + z*qz)) AS im FROM traj JOIN factors USING (label) JOIN q USING (q_id) GROUP BY ALL)
 SELECT q_id, count(*) AS n_frames, {r('avg(re)', 're', 5)}, {r('avg(im)', 'im', 5)}, {r('avg(re*re + im*im)', 'power', 4)} FROM c GROUP BY q_id""")
def amplitude_grid(spark, sf):
    """amplitudes of every frame on a grid of 16 x 16 x 16 vectors, as means over the frames."""
    g = grid.Grid(((0.11, 0.02, 0.0), (0.0, 0.13, 0.03), (0.0, 0.0, 0.17)), (16, 16, 16), (0.05, 0.0, 0.0))
    amplitudes = grid.amplitude_grid(t.emb_traj(spark, sf), t.factors(spark, grid.grid_vectors(spark, g)), g)
    power = F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power")
    means = amplitudes.groupBy("q_id").agg(F.count("*").alias("n_frames"), F.avg("re").alias("re"), F.avg("im").alias("im"), power)
    return rounded(rounded(means, "re", "im", digits=5), "power", digits=4)


@query("amplitude_self", f"""WITH {TRAJ}, {SCAN_Q}, {LI_FACTORS}, {SUB1}
 SELECT q_id, m_id, atom_id, frame, {r('f*cos(x*qx + y*qy + z*qz)', 're')}, {r('f*sin(x*qx + y*qy + z*qz)', 'im')}
 FROM traj JOIN factors USING (label) JOIN sub USING (q_id)""")
def amplitude_self(spark, sf):
    """amplitude of every single atom."""
    q = t.scan_q(spark)
    df = amplitude.amplitude_self(t.emb_traj(spark, sf), t.factors(spark, q), qspace.subvectors_none(q))
    return rounded(df.select("q_id", "m_id", "atom_id", "frame", "re", "im"), "re", "im")


# real and imaginary part of the conjugate harmonics up to l = 1, in terms of the unit vector
_N0, _N1 = math.sqrt(1 / (4 * math.pi)), math.sqrt(3 / (8 * math.pi))
_N10 = math.sqrt(3 / (4 * math.pi))
BALL = f"""ball AS (SELECT frame, label, sqrt(x*x + y*y + z*z) AS d, x / sqrt(x*x + y*y + z*z) AS ux,
   y / sqrt(x*x + y*y + z*z) AS uy, z / sqrt(x*x + y*y + z*z) AS uz FROM traj),
 yl AS (SELECT *, {_N0!r} AS y00, {_N1!r}*ux AS y1mr, {_N1!r}*uy AS y1mi, {_N10!r}*uz AS y10, -{_N1!r}*ux AS y1pr, {_N1!r}*uy AS y1pi FROM ball),
 jl AS (SELECT q_id, frame, f, sin(ql*d)/(ql*d) AS j0, sin(ql*d)/(ql*d)/(ql*d) - cos(ql*d)/(ql*d) AS j1, yl.* EXCLUDE (frame)
   FROM yl JOIN factors USING (label) JOIN q USING (q_id)),
 amp AS (
  SELECT q_id, 0::BIGINT AS m_id, frame, 4*{PI}*sum(f*j0*y00) AS re, 0.0::DOUBLE AS im FROM jl GROUP BY ALL
  UNION ALL SELECT q_id, 1::BIGINT, frame, -4*{PI}*sum(f*j1*y1mi), 4*{PI}*sum(f*j1*y1mr) FROM jl GROUP BY ALL
  UNION ALL SELECT q_id, 2::BIGINT, frame, 0.0::DOUBLE, 4*{PI}*sum(f*j1*y10) FROM jl GROUP BY ALL
  UNION ALL SELECT q_id, 3::BIGINT, frame, -4*{PI}*sum(f*j1*y1pi), 4*{PI}*sum(f*j1*y1pr) FROM jl GROUP BY ALL)"""


@query("amplitude_multipole_sphere", f"WITH {TRAJ}, {SCAN_Q}, {LI_FACTORS}, {BALL} SELECT {AMP_COLS} FROM amp")
def amplitude_multipole_sphere(spark, sf):
    """Spherical multipoles up to order 1."""
    q = t.scan_q(spark)
    ball = align.with_representation(t.emb_traj(spark, sf), "spherical")
    return _amp_out(amplitude.amplitude_multipole_sphere(ball, t.factors(spark, q), q, qspace.moments_sphere(spark, 1)))


NODES = 64
TILT_Q = """q AS (
  SELECT j AS q_id, 0.6*(0.1 + (j / 4.0::DOUBLE) * 1.9) AS qx, 0.0::DOUBLE AS qy, 0.8*(0.1 + (j / 4.0::DOUBLE) * 1.9) AS qz,
         0.1 + (j / 4.0::DOUBLE) * 1.9 AS ql
  FROM range(5) r(j))"""


def _cylinder_sql(height: str) -> str:
    return f"""nodes AS (SELECT 2*{PI}*k/{NODES} AS w FROM range({NODES}) g(k)),
 tube AS (SELECT q_id, frame, atom_id, f, sqrt(x*x + y*y) * qx AS p, atan2(y, x) AS psi, z * qz AS h
   FROM traj JOIN factors USING (label) JOIN q USING (q_id)),
 jn AS (SELECT q_id, frame, atom_id, any_value(f) AS f, any_value(psi) AS psi, any_value({height}) AS h,
   avg(cos(p*sin(w))) AS j0, avg(cos(w - p*sin(w))) AS j1, avg(cos(2*w - p*sin(w))) AS j2 FROM tube, nodes GROUP BY q_id, frame, atom_id),
 wave AS (SELECT q_id, frame, 0::BIGINT AS m_id, f*j0 AS a, 0.0::DOUBLE AS b, h FROM jn
   UNION ALL SELECT q_id, frame, 1::BIGINT, -sqrt(2.0)*f*j2*cos(2*psi), 0.0, h FROM jn
   UNION ALL SELECT q_id, frame, 2::BIGINT, -sqrt(2.0)*f*j2*sin(2*psi), 0.0, h FROM jn
   UNION ALL SELECT q_id, frame, 3::BIGINT, 0.0, sqrt(2.0)*f*j1*cos(psi), h FROM jn
   UNION ALL SELECT q_id, frame, 4::BIGINT, 0.0, sqrt(2.0)*f*j1*sin(psi), h FROM jn),
 amp AS (SELECT q_id, m_id, frame, sqrt(2*{PI})*sum(a*cos(h) - b*sin(h)) AS re, sqrt(2*{PI})*sum(a*sin(h) + b*cos(h)) AS im FROM wave GROUP BY ALL)"""


def tilted_q(spark):
    return qspace.q_from_scans(spark, [qspace.scan((0.6, 0.0, 0.8), 0.1, 2.0, 5)])


def _cylinder(spark, sf, legacy):
    q = tilted_q(spark)
    tube = align.with_representation(t.emb_traj(spark, sf), "cylindrical")
    return _amp_out(amplitude.amplitude_multipole_cylinder(
        tube, t.factors(spark, q), q, qspace.moments_cylinder(spark, 1), legacy_parallel=legacy
    ))


@query("amplitude_multipole_cylinder", f"WITH {TRAJ}, {TILT_Q}, {LI_FACTORS}, {_cylinder_sql('h')} SELECT {AMP_COLS} FROM amp")
def amplitude_multipole_cylinder(spark, sf):
    """Cylinder multipoles up to order 1."""
    return _cylinder(spark, sf, False)


@query("amplitude_multipole_cylinder_abs", f"WITH {TRAJ}, {TILT_Q}, {LI_FACTORS}, {_cylinder_sql('abs(h)')} SELECT {AMP_COLS} FROM amp")
def amplitude_multipole_cylinder_abs(spark, sf):
    """F4 with the phase along the axis always positive."""
    return _cylinder(spark, sf, True)


# == series and signals =======================================================================

EMB_AMP = f"{TRAJ}, {SCAN_Q}, {LI_FACTORS}, {SUB8}, {_amp_sql('traj')}"


def _corr_sql(keys: str) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    cols = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""corr AS (SELECT {cols}, b.frame - a.frame AS frame, avg(a.re*b.re + a.im*b.im) AS re, avg(a.re*b.im - a.im*b.re) AS im
 FROM amp a JOIN amp b ON {on} AND b.frame >= a.frame GROUP BY ALL)"""


def _emb_amp(spark, sf):
    q = t.scan_q(spark)
    sub = qspace.subvectors_sphere(q, t.directions(spark))
    return amplitude.amplitude_all(t.emb_traj(spark, sf), t.factors(spark, q), sub)


CORR = f"WITH {EMB_AMP}, {_corr_sql('q_id, m_id')} SELECT {AMP_COLS} FROM corr"


@query("autocorrelate_fft", CORR)
def autocorrelate_fft(spark, sf):
    """Autocorrelation of each amplitude series by transform."""
    return _amp_out(series.autocorrelate(_emb_amp(spark, sf), ["q_id", "m_id"], t.n_frames(spark, sf)))


@query("autocorrelate_direct", CORR)
def autocorrelate_direct(spark, sf):
    """The same by the quadratic sum."""
    return _amp_out(series.autocorrelate(_emb_amp(spark, sf), ["q_id", "m_id"], t.n_frames(spark, sf), "direct"))


@query("autocorrelate_long", CORR)
def autocorrelate_long(spark, sf):
    """The same with each series spread over tasks, as for series too long for one."""
    return _amp_out(series.autocorrelate(_emb_amp(spark, sf), ["q_id", "m_id"], t.n_frames(spark, sf), in_task=0))


@query("autocorrelate_direct_blocks", CORR)
def autocorrelate_direct_blocks(spark, sf):
    """The quadratic sum with each series cut into blocks, a task for every pair of them."""
    n = t.n_frames(spark, sf)
    return _amp_out(series.autocorrelate(_emb_amp(spark, sf), ["q_id", "m_id"], n, "direct", in_task=-(-n // 5)))


@query("square_series", f"WITH {EMB_AMP} SELECT q_id, m_id, frame, {r('re*re + im*im', 're', 5)}, 0.0::DOUBLE AS im FROM amp")
def square_series(spark, sf):
    """D2."""
    return _amp_out(series.square(_emb_amp(spark, sf)))


@query("series_arithmetic", f"""WITH {EMB_AMP}, s AS (SELECT q_id, m_id, re*2.5 + re*re + im*im AS re, im*2.5 AS im FROM amp)
 SELECT q_id, m_id, {r('sum(re)', 're', 4)}, {r('sum(im)', 'im', 4)} FROM s GROUP BY ALL""")
def series_arithmetic(spark, sf):
    """Scale, add and total."""
    amp = _emb_amp(spark, sf)
    both = series.add(series.scale(amp, 2.5), series.square(amp), ["q_id", "m_id", "frame"])
    return rounded(series.total(both, ["q_id", "m_id"]), "re", "im", digits=4)


@query("dense_series", f"""WITH {LI}, g AS (SELECT DISTINCT label FROM li), sel AS (SELECT label, frame, sum(x) AS re, sum(y) AS im FROM li GROUP BY ALL)
 SELECT g.label AS species, f AS frame, {r('coalesce(re, 0)', 're', 4)}, {r('coalesce(im, 0)', 'im', 4)}
 FROM g CROSS JOIN range(600) k(f) LEFT JOIN sel ON sel.label = g.label AND sel.frame = f""")
def dense_series(spark, sf):
    """Frames without a value filled with zero."""
    sums = t.li_traj(spark, sf).groupBy("species", "frame").agg(F.sum("x").alias("re"), F.sum("y").alias("im"))
    return rounded(series.dense(sums, ["species"], t.LI_FRAMES + 100), "re", "im", digits=4)


def _fqt_out(df, digits=5):
    return rounded(df.select("q_id", "qx", "qy", "qz", "tau", "re", "im"), "qx", "qy", "qz", "re", "im", digits=digits)


def _fq_out(df, digits=5):
    names = ["qx", "qy", "qz", "fq0_re", "fq0_im", "fq_re", "fq_im", "fq2_re", "fq2_im"]
    return rounded(df.select("q_id", *names), *names, digits=digits)


def _fqt_sql(table: str, norm: str, digits: int = 5) -> str:
    return f"""SELECT q_id, {r('qx', 'qx', digits)}, {r('qy', 'qy', digits)}, {r('qz', 'qz', digits)}, frame AS tau,
  {r(f'sum(re)*{norm}', 're', digits)}, {r(f'sum(im)*{norm}', 'im', digits)} FROM {table} JOIN q USING (q_id) GROUP BY q_id, qx, qy, qz, frame"""


def _fq_sql(table: str, norm: str, keys: str, n: str = "(SELECT n FROM nf)", digits: int = 5) -> str:
    return f"""fm AS (SELECT {keys}, sum(re)/{n} AS mr, sum(im)/{n} AS mi FROM {table} GROUP BY ALL),
 f1 AS (SELECT q_id, sum(mr)*{norm} AS fq_re, sum(mi)*{norm} AS fq_im, sum(mr*mr + mi*mi)*{norm} AS fq2_re FROM fm GROUP BY q_id),
 f0 AS (SELECT q_id, sum(re)*{norm} AS fq0_re, sum(im)*{norm} AS fq0_im FROM {table} WHERE frame = 0 GROUP BY q_id)
 SELECT q_id, {r('qx', 'qx', digits)}, {r('qy', 'qy', digits)}, {r('qz', 'qz', digits)}, {r('fq0_re', 'fq0_re', digits)}, {r('fq0_im', 'fq0_im', digits)},
  {r('fq_re', 'fq_re', digits)}, {r('fq_im', 'fq_im', digits)}, {r('fq2_re', 'fq2_re', digits)}, 0.0::DOUBLE AS fq2_im FROM q JOIN f0 USING (q_id) JOIN f1 USING (q_id)"""


def coherent(spark, sf, dsp="autocorrelate", average=True, **options):
    q = t.scan_q(spark)
    avg = Vectors(t.directions(spark)) if average else None
    return scatter(t.emb_traj(spark, sf), q, t.factors(spark, q), t.n_frames(spark, sf), average=avg, dsp=dsp, **options)


@query("signal_coherent", f"WITH {EMB_AMP}, {_corr_sql('q_id, m_id')} {_fqt_sql('corr', '(1/8.0::DOUBLE)')}")
def signal_coherent(spark, sf):
    """Coherent signal with autocorrelation and orientation average."""
    return _fqt_out(coherent(spark, sf).fqt)


@query("signal_coherent_means", f"WITH {EMB_AMP}, {_corr_sql('q_id, m_id')}, {_fq_sql('corr', '(1/8.0::DOUBLE)', 'q_id, m_id')}")
def signal_coherent_means(spark, sf):
    """Its value at lag 0, time mean and squared time mean; amplitudes kept in between."""
    return _fq_out(coherent(spark, sf, materialize=True).summary)


@query("signal_plain", f"WITH {TRAJ}, {SCAN_Q}, {LI_FACTORS}, {SUB1}, {_amp_sql('traj')} {_fqt_sql('amp', '1')}")
def signal_plain(spark, sf):
    """Amplitudes as they are, no average."""
    return _fqt_out(coherent(spark, sf, "plain", average=False).fqt)


@query("signal_plain_means", f"WITH {EMB_AMP}, {_fq_sql('amp', '(1/8.0::DOUBLE)', 'q_id, m_id')}")
def signal_plain_means(spark, sf):
    """With plain amplitudes the squared time mean is the elastic part."""
    return _fq_out(coherent(spark, sf, "plain").summary)


@query("signal_square_lineitem", f"""WITH {LI}, {SCAN_Q}, {LI_FACTORS}, {SUB8}, {_amp_sql('li')},
 sq AS (SELECT q_id, m_id, frame, re*re + im*im AS re, 0.0::DOUBLE AS im FROM amp) {_fqt_sql('sq', '(1/8.0::DOUBLE)', 3)}""")
def signal_square_lineitem(spark, sf):
    """Intensities of the large trajectory."""
    q = t.scan_q(spark)
    s = scatter(t.li_traj(spark, sf), q, t.factors(spark, q), t.LI_FRAMES, average=Vectors(t.directions(spark)), dsp="square")
    return _fqt_out(s.fqt, 3)


SELF_AMP = f"""{TRAJ}, {SCAN_Q}, {LI_FACTORS}, {SUB1}, amp AS (SELECT q_id, m_id, atom_id, frame,
   f*cos(x*qx + y*qy + z*qz) AS re, f*sin(x*qx + y*qy + z*qz) AS im FROM traj JOIN factors USING (label) JOIN sub USING (q_id))"""


def incoherent(spark, sf, dsp="autocorrelate", **options):
    q = t.scan_q(spark)
    return scatter(t.emb_traj(spark, sf), q, t.factors(spark, q), t.n_frames(spark, sf), kind="self", dsp=dsp, **options)


@query("signal_self", f"WITH {SELF_AMP}, {_corr_sql('q_id, m_id, atom_id')} {_fqt_sql('corr', '1')}")
def signal_self(spark, sf):
    """Self signal with autocorrelation, summed over atoms in their tasks."""
    return _fqt_out(incoherent(spark, sf).fqt)


@query("signal_self_means", f"WITH {SELF_AMP}, {_corr_sql('q_id, m_id, atom_id')}, {_fq_sql('corr', '1', 'q_id, m_id, atom_id')}")
def signal_self_means(spark, sf):
    """D8, D10."""
    return _fq_out(incoherent(spark, sf).summary)


@query("signal_self_blocks", f"WITH {SELF_AMP}, {_corr_sql('q_id, m_id, atom_id')} {_fqt_sql('corr', '1')}")
def signal_self_blocks(spark, sf):
    """The same by pairs of blocks of frames, as for series too long for a task."""
    return _fqt_out(incoherent(spark, sf, in_task=-(-t.n_frames(spark, sf) // 3)).fqt)


@query("signal_self_blocks_means", f"WITH {SELF_AMP}, {_corr_sql('q_id, m_id, atom_id')}, {_fq_sql('corr', '1', 'q_id, m_id, atom_id')}")
def signal_self_blocks_means(spark, sf):
    """An atom's mean from its parts of all pairs of blocks."""
    return _fq_out(incoherent(spark, sf, in_task=-(-t.n_frames(spark, sf) // 3)).summary)


@query("signal_self_plain", f"WITH {SELF_AMP}, {_fq_sql('amp', '1', 'q_id, m_id, atom_id')}")
def signal_self_plain(spark, sf):
    """The incoherent elastic part."""
    return _fq_out(incoherent(spark, sf, "plain").summary)


@query("signal_multipole_debye", f"""WITH {TRAJ}, q AS (SELECT j AS q_id, 0.05 + 0.2*j AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qz, 0.05 + 0.2*j AS ql FROM range(3) r(j)), {LI_FACTORS},
 d AS (SELECT a.frame, a.label AS la, b.label AS lb, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM traj a JOIN traj b USING (frame)),
 s AS (SELECT q.q_id, qx, qy, qz, frame, sum(fa.f * fb.f * CASE WHEN d = 0 THEN 1.0 ELSE sin(q.ql*d) / (q.ql*d) END) AS v
  FROM d JOIN factors fa ON fa.label = la JOIN factors fb ON fb.label = lb AND fb.q_id = fa.q_id JOIN q ON q.q_id = fa.q_id GROUP BY ALL)
 SELECT q_id, qx, qy, qz, frame AS tau, {r('v', 're', 4)}, 0.0::DOUBLE AS im FROM s""")
def signal_multipole_debye(spark, sf):
    """Multipoles up to order 8 add up to the average over all orientations, which is a sum over pairs of atoms."""
    q = qspace.q_from_scans(spark, [qspace.scan((1.0, 0.0, 0.0), 0.05, 0.45, 3, 1.0)])
    s = scatter(t.emb_traj(spark, sf), q, t.factors(spark, q), t.n_frames(spark, sf),
                average=Multipole(qspace.moments_sphere(spark, 8)), dsp="square")
    return _fqt_out(s.fqt, 4)


@query("signal_multipole_sphere", f"""WITH {TRAJ}, {SCAN_Q}, {LI_FACTORS}, {BALL}, sq AS (SELECT q_id, m_id, frame, re*re + im*im AS re, 0.0::DOUBLE AS im FROM amp)
 {_fqt_sql('sq', f'(1/(4*{PI}))', 4)}""")
def signal_multipole_sphere(spark, sf):
    """Intensities by spherical multipoles."""
    q = t.scan_q(spark)
    s = scatter(t.emb_traj(spark, sf), q, t.factors(spark, q), t.n_frames(spark, sf),
                average=Multipole(qspace.moments_sphere(spark, 1)), dsp="square")
    return _fqt_out(s.fqt, 4)


@query("signal_multipole_cylinder", f"""WITH {TRAJ}, {TILT_Q}, {LI_FACTORS}, {_cylinder_sql('h')}, sq AS (SELECT q_id, m_id, frame, re*re + im*im AS re, 0.0::DOUBLE AS im FROM amp)
 {_fqt_sql('sq', f'(1/(2*{PI}))', 4)}""")
def signal_multipole_cylinder(spark, sf):
    """Intensities by cylinder multipoles."""
    q = tilted_q(spark)
    s = scatter(t.emb_traj(spark, sf), q, t.factors(spark, q), t.n_frames(spark, sf),
                average=Multipole(qspace.moments_cylinder(spark, 1), "cylinder"), dsp="square")
    return _fqt_out(s.fqt, 4)


NATION_AMP = f"{LI}, {NATION_Q}, {LI_FACTORS}, {SUB1}, {_amp_sql('li')}"
LI_N = "(SELECT 500.0::DOUBLE)"


@query("result_resume", f"""WITH {NATION_AMP}, sq AS (SELECT q_id, m_id, frame, re*re + im*im AS re, 0.0::DOUBLE AS im FROM amp), {_fq_sql('sq', '1', 'q_id, m_id', LI_N, 2)}""")
def result_resume(spark, sf):
    """A result begun, resumed for the vectors that it lacks, and resumed with nothing left to do."""
    return _fq_out(read_signal(spark, _resumed(spark, sf))[1], 2)


@query("result_series", f"""WITH {NATION_AMP}, sq AS (SELECT q_id, m_id, frame, re*re + im*im AS re, 0.0::DOUBLE AS im FROM amp) {_fqt_sql('sq', '1', 2)}""")
def result_series(spark, sf):
    """The series of the same result."""
    return _fqt_out(read_signal(spark, _resumed(spark, sf))[0], 2)


def _resumed(spark, sf):
    path = scratch_path(spark, "signal")
    traj, q = t.li_traj(spark, sf), t.nation_q(spark, sf)
    f = t.factors(spark, q)
    for some in (q.where("qx < 1"), q, q):
        last = resume(traj, some, f, t.LI_FRAMES, path, {"dsp": "square", "elements": t.ELEMENT_ROWS}, dsp="square")
    assert last is None
    return path


@query("files_to_result", f"""WITH {TRAJ}, {SCAN_Q}, {LI_FACTORS}, {SUB1}, part AS (SELECT frame // 2 AS frame, label, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y,
   CAST(CAST(z AS FLOAT) AS DOUBLE) AS z, mass FROM traj WHERE frame % 2 = 0),
 c AS (SELECT frame, sum(mass*x)/sum(mass) AS cx, sum(mass*y)/sum(mass) AS cy, sum(mass*z)/sum(mass) AS cz FROM part GROUP BY frame),
 moved AS (SELECT frame, label, x - cx AS x, y - cy AS y, z - cz AS z FROM part JOIN c USING (frame)), {_amp_sql('moved')},
 sq AS (SELECT q_id, m_id, frame, re*re + im*im AS re, 0.0::DOUBLE AS im FROM amp) {_fqt_sql('sq', '1', 3)}""")
def files_to_result(spark, sf):
    """From a structure file and trajectory files to a result that is read back."""
    structure = scratch_path(spark, "structure")
    line = F.format_string("ATOM  %5d %-4s MOL     1    %8.3f%8.3f%8.3f", "atom_id", "pdb_name", F.lit(0.0), F.lit(0.0), F.lit(0.0))
    t.emb_atoms(spark, sf).select("atom_id", line.alias("value")).coalesce(1).sortWithinPartitions("atom_id").drop("atom_id").write.text(structure)
    q, elements = t.scan_q(spark), t.elements(spark)
    atoms = el.resolve_labels(trajectory.read_structure(spark, files.list_folder(structure)[0]), elements)
    atoms = el.with_constants(atoms, elements).withColumn("species", F.col("label"))
    coords = trajectory.read_frames(spark, _dcd_files(spark, sf), "dcd", stride=2)
    ready = prepare_coordinates(coords, atoms, selections.Selections(atoms), pre=[align.align_center])
    path = scratch_path(spark, "signal")
    resume(ready, q, t.factors(spark, q), -(-t.n_frames(spark, sf) // 2), path, dsp="square")
    return _fqt_out(read_signal(spark, path)[0], 3)


@query("result_shape", """SELECT l_linenumber::BIGINT AS q_id, CAST(max(l_quantity) AS BIGINT) + 1 AS n_lags, count(DISTINCT l_quantity) AS n_rows
 FROM lineitem GROUP BY l_linenumber HAVING max(l_quantity) + 1 <> 51 OR count(DISTINCT l_quantity) <> 51""")
def result_shape(spark, sf):
    """K3: vectors of a result whose series have another length than the trajectory."""
    result = t.read(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("q_id"), F.col("l_quantity").cast("bigint").alias("tau")
    )
    return check_length(result.distinct(), 51)


@query("result_meta", "SELECT n_name AS name, n_regionkey::BIGINT AS value FROM nation")
def result_meta(spark, sf):
    """K2: the settings of a run kept beside its results, and read back."""
    path = scratch_path(spark, "signal")
    nations = t.read(spark, sf, "nation").select("n_name", "n_regionkey").collect()  # always 25 rows
    write_meta(spark, path, "run", {r["n_name"]: r["n_regionkey"] for r in nations})
    settings = F.from_json("settings", "map<string,bigint>")
    return spark.read.parquet(f"{path}/meta").select(F.explode(settings).alias("name", "value"))
