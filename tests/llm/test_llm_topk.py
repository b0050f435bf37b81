import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterloom.llm import topk


def brute(rows, asks, k):
    whole = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(64 * x) for x in v]
        whole[i] = min(w, whole.get(i, w))
    out = []
    for q in sorted(whole):
        if asks(q):
            others = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(others)]
    return out


@pytest.mark.parametrize("blocks", [(3, 5), (512, 4096)])
def test_same_as_brute_force(spark, blocks):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.where(draw.random(6) < 0.5, 0, draw.integers(-2, 3, 6) / 7)]) for i in range(47)]  # many ties and zeros
    rows += [(0, [9.0] * 6), (100, None), (101, [1.0, None]), (102, [math.nan]), (103, [math.inf]), (None, [1.0]), (60, []), (80, [0.5]), (2**60, [0.1] * 7)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id bigint, embedding array<double>, id int, vector double").repartition(3)
    got = topk.top_k(topk.whole_vectors(df), F.col("id") % 20 == 0, 7, *blocks)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda q: q % 20 == 0, 7)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (2, [1.0])], "vec_id bigint, embedding array<float>")
    vectors = topk.whole_vectors(df)
    assert sorted(map(tuple, topk.top_k(vectors, F.col("id") == 0, 20).collect())) == [(0, 1, 1, 4096), (0, 2, 2, 4096)]
    for none in (topk.top_k(vectors, F.lit(False), 20), topk.top_k(vectors.where("id < 0"), F.lit(True), 20), topk.top_k(vectors.where("id = 0"), F.lit(True), 20)):
        assert none.collect() == [] and none.columns == ["query_id", "rank", "vec_id", "score"]


def test_wide_numbers():
    big = np.array([[1 << 20, 3]]), np.array([[1 << 20, -1]])
    assert topk.scores(*big).tolist() == [[(1 << 40) - 3]]
    with pytest.raises(OverflowError):
        topk.scores(np.array([[1 << 40]]), np.array([[1 << 40]]))
