import numpy as np
import odd
from pyspark.sql import functions as F

from scatterloom.llm import quality

SF = "/root/testdata/sf0.01"


def test_accuracy_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 80 and (held.predicted == held.quality).mean() >= 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    # labels of held-out rows have no influence
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.classify(docs, turned).toPandas().set_index("doc_id").score
    assert np.array_equal(again[got.doc_id].to_numpy(), got.score.to_numpy())


def test_word_vectors_do_not_depend_on_partitions(spark):
    df = odd.documents(spark)
    one, many = (quality.word_vectors(x) for x in (df.coalesce(1), df.repartition(5)))
    assert all(np.array_equal(a, b) for a, b in zip(one, many))


def test_scores_of_a_plain_version(spark, sf):
    """Word vectors by one loop over all texts, word by word; the pooled mean; the network layer by layer."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = dict(odd.plain(docs))
    places, signs = quality.index_vectors()
    words = {i: [quality.fnv(w.lower().encode()) % quality.BUCKETS for w in quality.TOKENS(t)] for i, t in texts.items()}
    counts, sums, own = np.zeros(quality.BUCKETS), np.zeros((quality.BUCKETS, quality.DIMS)), np.zeros((quality.BUCKETS, quality.DIMS))
    for b in range(quality.BUCKETS):
        for p, s in zip(places[b], signs[b]):
            own[b, p] += s
    for ws in words.values():
        for i, w in enumerate(ws):
            counts[w] += 1
            for k in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= k < len(ws):
                    sums[w] += own[ws[k]]
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    vectors, weights = unit(unit(sums) + unit(own)), 1 / np.sqrt(1 + 100 * counts / counts.sum())
    x = {i: np.average(vectors[ws], axis=0, weights=weights[ws]) if ws else np.zeros(quality.DIMS) for i, ws in words.items()}
    ids = [r.doc_id for r in labels.where(~quality.held_out(F.col("doc_id"))).orderBy("doc_id").collect() if r.doc_id in x]
    known = {r.doc_id: r.quality for r in labels.collect()}
    net = quality.learn(docs, labels).net
    plain = quality.fit(np.array([x[i] for i in ids]), np.array([float(known[i]) for i in ids]))
    assert np.allclose(plain.w1, net.w1, atol=1e-3)
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    for i, v in x.items():
        hidden = np.tanh(((v - net.mean) / net.scale) @ net.w1 + net.b1)
        assert abs(got[i] - 1 / (1 + np.exp(-(hidden @ net.w2 + net.b2) / net.temperature))) < 1e-5


def test_odd_rows(spark):
    df = odd.documents(spark)
    labels = spark.createDataFrame([(1, 1), (7, 0), (9, 0), (9, 1), (None, 1), (3, None), (99, 1), (12, 1), (10, 2)], "doc_id bigint, quality int")
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        got = quality.classify(df, known).collect()
        assert sorted(repr(r.doc_id) for r in got) == sorted(repr(i) for i, _ in odd.plain(df))
        assert all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert quality.classify(odd.empty(spark), labels).collect() == []


def test_temperature_calibrates():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(4000, 5))
    y = (draw.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = quality.fit(x, y).probability(x)
    for lo in np.arange(0, 1, 0.2):
        at = (p >= lo) & (p < lo + 0.2)
        assert abs(p[at].mean() - y[at].mean()) < 0.08
