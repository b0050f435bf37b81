"""Quality of documents: random-indexing word vectors, pooled, and a small network with calibrated probabilities."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, map_texts, whole_text

#: Words share this many vectors by hash, so the vectors of any corpus take BUCKETS x DIMS numbers.
BUCKETS, DIMS = 1 << 14, 64
#: Nonzero entries of an index vector, and how far a word's context reaches to either side.
NONZERO, REACH = 4, 2
#: Labelled rows that the network is fitted on at most; of more, those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Tokens whose codes a worker keeps.
TOKENS_KEPT = 500_000

#: The tokens of a text: runs of letters and digits, and runs of signs.
TOKENS = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+").findall


def fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h ^ h >> 29


class Tokens(dict):
    """The bucket of a token; the same on every executor."""

    def __missing__(self, token: str) -> int:
        if len(self) >= TOKENS_KEPT:
            self.clear()
        bucket = self[token] = fnv(token.lower().encode()) % BUCKETS
        return bucket


def buckets_of(text: str) -> np.ndarray:
    """Buckets of the tokens of a text in order."""
    found = TOKENS(text)
    return np.fromiter(map(kept("tokens", Tokens).__getitem__, found), np.int64, len(found))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each bucket's index vector."""
    draw = np.random.default_rng(20)
    return draw.integers(0, DIMS, (BUCKETS, NONZERO)), draw.choice([-1, 1], (BUCKETS, NONZERO))


def context_sums(texts: Iterable[str], places: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of buckets, and sums of the index vectors of their neighbours."""
    counts, sums = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS * DIMS)
    flat: list[np.ndarray] = []
    gap = np.full(REACH, -1)  # keeps texts apart

    def flush() -> None:
        ids = np.concatenate(flat)
        flat.clear()
        counts[:] += np.bincount(ids[ids >= 0], minlength=BUCKETS)
        for step in range(1, REACH + 1):
            left, right = ids[:-step], ids[step:]
            both = (left >= 0) & (right >= 0)
            left, right = left[both], right[both]
            for word, near in ((left, right), (right, left)):
                for j in range(NONZERO):
                    sums[:] += np.bincount(word * DIMS + places[near, j], signs[near, j], BUCKETS * DIMS)

    size = 0
    for text in texts:
        ids = buckets_of(text)
        flat += [ids, gap]
        size += len(ids)
        if size > 500_000:
            flush()
            size = 0
    if flat:
        flush()
    return counts, sums.reshape(BUCKETS, DIMS).astype(np.int64)


def word_vectors(df: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (BUCKETS x DIMS) and weights of all buckets, from every text of ``df``.

    A task sums what its texts hold, in whole numbers, and Spark adds the sums up by bucket, so the result
    doesn't depend on how rows are dealt. The table that reaches the driver has BUCKETS rows at any size of the corpus.
    """
    places, signs = index_vectors()
    fields = [f"v{d}" for d in range(DIMS)]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ["bucket", "n", *fields]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = context_sums((t for b in batches for t in b["text"]), places, signs)
        at = np.flatnonzero(counts)
        yield pd.DataFrame(np.column_stack((at, counts[at], sums[at])), columns=schema.names)

    parts = df.select(whole_text(df, text_col).alias("text")).mapInPandas(run, schema)
    table = parts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in schema.names[1:])).toPandas()
    counts, sums = np.zeros(BUCKETS), np.zeros((BUCKETS, DIMS))
    at = table["bucket"].to_numpy()
    counts[at], sums[at] = table["n"].to_numpy(), table[fields].to_numpy()
    own = np.zeros((BUCKETS, DIMS))
    np.add.at(own, (np.arange(BUCKETS)[:, None], places), signs)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    weight = 1 / np.sqrt(1 + 100 * counts / max(1.0, counts.sum()))  # frequent words count for less
    return unit(unit(sums) + unit(own)).astype(np.float32), weight.astype(np.float32)


def pooled(texts: Iterable[str], vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row per text: the weighted mean of its words' vectors, zeros without words."""
    rows = []
    for text in texts:
        ids = buckets_of(text)
        mean, weight = np.zeros(vectors.shape[1]), 0.0
        for lo in range(0, len(ids), 1 << 16):  # a very long text takes no more memory than its tokens
            w = weights[ids[lo : lo + (1 << 16)]]
            mean += w @ vectors[ids[lo : lo + (1 << 16)]]
            weight += float(w.sum())
        rows.append(mean / max(weight, 1e-9))
    return np.array(rows).reshape(len(rows), vectors.shape[1])


@dataclass
class Network:
    """Two layers on standardised inputs; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 0.01, seed: int = 7) -> Network:
    """Fits on four fifths of the rows and sets the temperature on the others. Without rows of both labels every score is the share of label 1 (0.5 without any)."""
    n, d = x.shape
    if not n or y.min() == y.max():
        p = min(max(float(y.mean()) if n else 0.5, 0.01), 0.99)
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    draw = np.random.default_rng(seed)
    order = draw.permutation(n)
    held, used = order[: n // 5], order[n // 5 :]
    net = Network(x[used].mean(0), x[used].std(0) + 1e-3, draw.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), draw.normal(0, hidden**-0.5, hidden), 0.0)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    z, t = (x - net.mean) / net.scale, 0
    for _ in range(epochs):
        for at in np.array_split(draw.permutation(used), max(1, len(used) // 128)):
            h = np.tanh(z[at] @ params[0] + params[1])
            e = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -50, 50))) - y[at]) / len(at)
            back = np.outer(e, params[2]) * (1 - h * h)
            t += 1
            for p, (m, v), g in zip(params, moments, (z[at].T @ back + 1e-4 * params[0], back.sum(0), h.T @ e + 1e-4 * params[2], e.sum(keepdims=True)), strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    net.b2 = float(params[3][0])
    if len(held) and y[held].min() != y[held].max():
        logit, grid = net.logit(x[held]), np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [np.logaddexp(0, -np.where(y[held] == 1, logit, -logit) / g).mean() for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """What scoring needs; its size doesn't depend on the corpus."""

    vectors: np.ndarray
    weights: np.ndarray
    net: Network

    def score(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``id_col`` (of any type, a struct of whole rows for instance) and ``score`` of each row; a null text counts as empty, and empty texts get a score like any other."""
        return map_texts(df, id_col, text_col, {"score": "double"}, lambda texts: [self.net.probability(pooled(texts, self.vectors, self.weights))])


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model with word vectors from all texts of ``df`` and a network fitted on at most ``sample`` labelled rows.

    ``labels`` has ``id_col`` and ``label_col`` (0 or 1; rows with another or no label, or no id, aren't used; of several labels of an id
    the smallest counts; ids that aren't in ``df`` don't matter). Labels of held-out rows are never read. Other columns of either table are ignored.
    """
    vectors, weights = word_vectors(df, text_col)
    ids = labels.where(labels[label_col].isin(0, 1) & labels[id_col].isNotNull() & ~held_out(labels[id_col]))
    ids = ids.groupBy(ids[id_col].alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(sample)
    sampled = df.select(df[id_col].alias("id"), df[text_col].alias("text")).join(F.broadcast(ids), "id").withColumn("row", F.struct("id", "y"))
    known = map_texts(sampled, "row", "text", {"x": "array<double>"}, lambda texts: [list(pooled(texts, vectors, weights))])
    # a labelled text that repeats counts once, so the sample bounds this table, too
    known = known.groupBy("row.id").agg(F.min(F.struct("row.y", "x")).alias("r")).select("id", "r.y", "r.x").toPandas().sort_values("id", ignore_index=True)
    x = np.array(known["x"].tolist()).reshape(len(known), DIMS)
    return Model(vectors, weights, fit(x, known["y"].to_numpy(np.float64)))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """``id_col, held_out, score, predicted`` of each row of ``df``, see `learn` and `Model.score`. Null ids are not
    held out. Rows that repeat come back as often. Other columns are left out.
    """
    scored = learn(df, labels, id_col, text_col, label_col, sample).score(df, id_col, text_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
