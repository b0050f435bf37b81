"""Exact top-k by inner product, term at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block of queries and of a block of candidates: a task holds one score array of their product.
QUERY_ROWS, CANDIDATE_ROWS = 512, 4096


def whole_vectors(df: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` and ``vector`` = floor(scale * x) of each component, as bigint.

    Rows whose id or vector is null, or whose vector holds a null, NaN or infinite component, are
    left out. An id that repeats stands for one row: the one with the smallest vector.
    """
    x = df[vector_col].cast("array<double>")
    sound = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.where(df[id_col].isNotNull() & x.isNotNull() & sound)
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("bigint"))
    return rows.select(df[id_col].cast("bigint").alias("id"), whole.alias("vector")).groupBy("id").agg(F.min("vector").alias("vector"))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of vectors, short ones filled with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def postings(rows: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(term, places of the rows that hold it, weights) for each term that any row holds."""
    found = ((term, np.flatnonzero(rows[:, term])) for term in range(rows.shape[1]))
    return [(term, at, rows[at, term]) for term, at in found if len(at)]


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products, candidates x queries: each term of the queries scatters its postings into the score array.

    Counts in 32 bits where no sum can leave them, else in 64; sums that could leave 64 bits raise.
    """
    top = [int(np.abs(m.astype(object)).max()) if m.size else 0 for m in (queries, candidates)]
    bound = top[0] * top[1] * max(1, queries.shape[1])
    if bound >= 1 << 63:
        raise OverflowError("components are too large for scores of 64 bits")
    kind = np.int32 if bound < 1 << 31 else np.int64
    queries = queries.astype(kind)
    out = np.zeros((len(candidates), len(queries)), kind)
    by_term = {term: (at, weights) for term, at, weights in postings(queries)}
    for term, at, weights in postings(candidates.astype(kind)):
        if term not in by_term:
            continue
        columns, query_weights = by_term[term]
        if 2 * len(columns) >= len(queries):  # most queries hold the term: whole rows of the array, zeros for the others
            out[at] += weights[:, None] * queries[:, term]
        else:
            out[at[:, None], columns] += weights[:, None] * query_weights
    return out


def select(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, of equal ones the smaller ids, unordered."""
    if len(score) <= k:
        return np.arange(len(score))
    least = np.partition(score, len(score) - k)[len(score) - k]
    above = np.flatnonzero(score > least)
    level = np.flatnonzero(score == least)
    rest = k - len(above)
    if rest < len(level):
        level = level[np.argpartition(ids[level], rest - 1)[:rest]]
    return np.concatenate((above, level))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of each query, ties to the smaller id.

    ``vectors`` has unique ``id`` and ``vector`` (array of bigint; lengths may differ, what is missing counts as 0),
    see `whole_vectors`; ``is_query`` is a condition on it. A query that has fewer than k others gets all
    of them; an empty table gives no rows.

    Queries and candidates are dealt into blocks by a hash of the id. Every block of queries meets every block of
    candidates in a task of its own, which scatters postings into a dense score array of bounded size and keeps the k
    best per query. Spark merges these with a window whose limit is applied before the shuffle, too.
    """
    spark = vectors.sparkSession
    marked = vectors.select("id", "vector", is_query.alias("asks"))
    n, asked = marked.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    q_blocks, c_blocks = max(1, -(-asked // query_rows)), max(1, -(-n // candidate_rows))
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    own = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    queries = marked.where("asks").select("id", "vector", own(q_blocks).alias("qb")).select("*", each(c_blocks).alias("cb"))
    candidates = marked.select("id", "vector", own(c_blocks).alias("cb")).select("*", each(q_blocks).alias("qb"))
    tasks = min(q_blocks * c_blocks, 4 * max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])

    def block(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({x: np.array([], np.int64) for x in schema.names})
        width = max(q["vector"].map(len).max(), c["vector"].map(len).max())
        ids, out = c["id"].to_numpy(), []
        all_scores = scores(matrix(q["vector"], width), matrix(c["vector"], width)).T
        for query, row in zip(q["id"].to_numpy(), all_scores, strict=True):
            others = np.flatnonzero(ids != query)
            score = row[others].astype(np.int64)
            at = select(score, ids[others], k)
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[others][at], "score": score[at]}))
        return pd.concat(out)

    grid = [x.repartition(tasks, "qb", "cb").groupBy("qb", "cb") for x in (queries, candidates)]
    best = grid[0].cogroup(grid[1]).applyInPandas(block, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
