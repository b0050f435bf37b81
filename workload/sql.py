"""Pieces of reference SQL shared by the queries."""

from __future__ import annotations

from workload.tables import ATOMS_PER_VECTOR, DIRECTIONS, ELEMENT_ROWS, LI_FRAMES

PI = "3.141592653589793"

TRAJ = f"""traj AS (
  SELECT vec_id AS frame, a AS atom_id,
         10 * CAST(embedding[(3*a) % 64 + 1] AS DOUBLE) AS x,
         10 * CAST(embedding[(3*a + 1) % 64 + 1] AS DOUBLE) AS y,
         10 * CAST(embedding[(3*a + 2) % 64 + 1] AS DOUBLE) AS z,
         ['A','B','C'][a % 3 + 1] AS label,
         [1.0::DOUBLE, 12.0, 16.0][a % 3 + 1] AS mass
  FROM embeddings, range({ATOMS_PER_VECTOR}) r(a)),
nf AS (SELECT max(vec_id) + 1 AS n FROM embeddings)"""

LI = f"""li AS (
  SELECT l_orderkey % {LI_FRAMES} AS frame, l_quantity / 5 AS x, l_discount * 100 AS y,
         l_tax * 100 AS z, l_returnflag AS label
  FROM lineitem)"""

SUPPLIER_Q = """q AS (
  SELECT q_id, qx, qy, qz, sqrt(qx*qx + qy*qy + qz*qz) AS ql FROM (
    SELECT s_suppkey AS q_id,
           CASE WHEN s_suppkey % 5 = 0 THEN 0.0::DOUBLE ELSE s_acctbal / 5000 END AS qx,
           CASE WHEN s_suppkey % 5 = 0 THEN 0.0::DOUBLE ELSE (s_nationkey - 12) / 10.0::DOUBLE END AS qy,
           (s_suppkey % 7 + 1) / 4.0::DOUBLE AS qz
    FROM supplier))"""

NATION_Q = """q AS (
  SELECT q_id, qx, qy, qz, sqrt(qx*qx + qy*qy + qz*qz) AS ql FROM (
    SELECT n_nationkey::BIGINT AS q_id, (n_nationkey + 1) / 13.0::DOUBLE AS qx,
           (n_regionkey - 2) / 3.0::DOUBLE AS qy, 0.25::DOUBLE AS qz FROM nation))"""

SCAN_Q = """q AS (
  SELECT j AS q_id, 0.1 + (j / 4.0::DOUBLE) * 1.9 AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qz,
         0.1 + (j / 4.0::DOUBLE) * 1.9 AS ql
  FROM range(5) r(j))"""

ORIENT = "orient AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}::BIGINT, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for i, (x, y, z) in enumerate(DIRECTIONS)
) + ") t(m_id, ux, uy, uz))"


def element_values(patterns: dict | None = None) -> str:
    def array(v):
        return "[" + ", ".join(f"{x!r}::DOUBLE" for x in v) + "]"

    rows = ", ".join(
        f"('{l}', '{(patterns or {}).get(l, rx)}', {m!r}::DOUBLE, {vt}, {array(v)}, {et}, {array(e)}, {st}, {array(s)})"
        for l, rx, m, vt, v, et, e, st, s in ELEMENT_ROWS
    )
    return (
        f"elements AS (SELECT * FROM (VALUES {rows}) t(label, name_regex, mass, vol_type, vol_params,"
        " excl_type, excl_params, sf_type, sf_params))"
    )


ELEMENTS = element_values()

VOLUME = f"""(CASE vol_type WHEN 0 THEN vol_params[1]
  WHEN 1 THEN 4.0/3.0*{PI}*pow(vol_params[1], 3)
  WHEN 2 THEN pow({PI}, 1.5)*pow(vol_params[1], 3) END)"""


def exclusion(q: str, v: str = VOLUME) -> str:
    return f"""(CASE excl_type WHEN 0 THEN excl_params[1]
  WHEN 1 THEN {v} * excl_params[1]
  WHEN 2 THEN {v} * exp(-pow({v}, 2.0/3.0)*({q})*({q})/(4*{PI})) * excl_params[1] END)"""


def scattering(q: str) -> str:
    shells = " + ".join(
        f"""(CASE WHEN sf_params[{j}] <> 0 THEN sf_params[{j + 5}] *
  pow(pow(2*sf_params[{j}]/sf_params[{j + 10}], sf_params[{j + 10}] + 0.5)
      / sqrt(CAST(factorial(CAST(2*sf_params[{j + 10}] AS INTEGER)) AS DOUBLE))
      * pow({q}, sf_params[{j + 10}] - 1.0) * exp(-sf_params[{j}]*({q})/sf_params[{j + 10}]), 2)
  ELSE 0 END)"""
        for j in range(1, 6)
    )
    waves = " + ".join(f"sf_params[{2 * i + 1}]*exp(-sf_params[{2 * i + 2}]*({q})*({q}))" for i in range(4))
    return f"""(CASE sf_type WHEN 0 THEN sf_params[1]
  WHEN 1 THEN ({shells})/(4*{PI})
  WHEN 2 THEN {waves} + sf_params[9] END)"""


FACTORS = f"factors AS (SELECT q_id, label, {scattering('ql')} AS f FROM elements, q)"


def r(expr: str, name: str, digits: int = 6) -> str:
    """Rounded and free of negative zeros."""
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def xyz(prefix: str = "", digits: int = 6) -> str:
    return ", ".join(r(f"{prefix}{c}", c, digits) for c in "xyz")


def uniform(index: str, seed: int, stream: int) -> str:
    return (
        f"((('0x' || substr(md5('{seed}:{stream}:' || CAST({index} AS VARCHAR)), 1, 13))::BIGINT::DOUBLE"
        f" + 0.5) / {float(16**13)!r})"
    )


def on_sphere(index: str, seed: int, stream: int) -> tuple[str, str, str]:
    z = f"(2*{uniform(index, seed, 2 * stream)} - 1)"
    phi = f"(2*{PI}*{uniform(index, seed, 2 * stream + 1)})"
    return f"(sqrt(1 - {z}*{z})*cos({phi}))", f"(sqrt(1 - {z}*{z})*sin({phi}))", z


def normal(index: str, seed: int, stream: int) -> str:
    u1, u2 = uniform(index, seed, 2 * stream), uniform(index, seed, 2 * stream + 1)
    return f"(sqrt(-2*ln({u1}))*cos(2*{PI}*{u2}))"
