"""Column layouts of the tables the library exchanges, as DDL."""

from __future__ import annotations

ELEMENTS = (
    "label STRING, name_regex STRING, mass DOUBLE,"
    " vol_type INT, vol_params ARRAY<DOUBLE>, excl_type INT, excl_params ARRAY<DOUBLE>,"
    " sf_type INT, sf_params ARRAY<DOUBLE>"
)
KAPPAS = "selection STRING, value DOUBLE, ord INT"
QVECTORS = "q_id BIGINT, qx DOUBLE, qy DOUBLE, qz DOUBLE, ql DOUBLE"
AMPLITUDES = "q_id BIGINT, m_id BIGINT, frame BIGINT, re DOUBLE, im DOUBLE"
