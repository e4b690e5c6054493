"""Exact top-k search: a pivot table bounds every score, and candidates are taken in the order of bounds.

Scores are inner products of integer vectors. With the distances of all vectors to some pivots, the
triangle inequality bounds the distance of a query and a candidate from below by the largest
difference of their distances to a pivot, and thereby their inner product
``(|q|^2 + |c|^2 - d^2) / 2`` from above. A query takes the candidates of a block from the
highest bound down and stops for good once its k-th best score is above the next bound, so results
are exact whatever the pivots. Scores with a bounded sample give every query a first threshold.

Candidates stay where they were read; blocks of queries of bounded size are sent to them, one pass for
each, and the best of every block of candidates meet in a ranking per query, which Spark
cuts to ``k`` rows before the shuffle.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part; vectors of
different length are not compared, nor are rows with the same id; queries or candidates with a null id take no
part; equal rows are one; ties go to the smaller id; fewer than ``k`` candidates give fewer rows. Scores
must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewright.llm.tables import shipped

SCALE, K, EVERY = 1024, 10, 100
PIVOTS, SAMPLE = 24, 256
#: Queries in a block that is sent to the candidates, and candidates bounded at once.
QUERY_BLOCK, CANDIDATE_BLOCK = 1 << 14, 1 << 12
#: Candidates scored between two looks at the stopping rule.
STEP = 64
RESULT = "query_id long, vec_id long, score long"
#: Below it sums of products are exact as doubles.
EXACT = 2.0**52


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v``: every component as floor(SCALE * x)."""
    as_double = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), as_double.alias("v")).where("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad).select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE).cast("long")).alias("v")).distinct()


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    return np.concatenate([np.asarray(v, np.int64) for v in vectors]).reshape(len(vectors), width) if len(vectors) else np.zeros((0, width), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: by floating point where that is exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances to the pivots."""
    x, p = a.astype(np.float64), pivots.astype(np.float64)
    square = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * (x @ p.T)
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Far from each other: each next pivot is the one farthest from those chosen."""
    chosen = [0]
    nearest = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


class QueryBlock:
    """Some queries of one width with their rows of the pivot table and first thresholds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.pivots = choose_pivots(sample)
        self.table = distances(vectors, self.pivots)
        self.squares = (vectors.astype(np.float64) ** 2).sum(1)
        # the k-th best score within the sample; one row of it may be the query itself
        self.least = np.full(len(ids), -np.inf)
        scores = np.where(sample_ids[None, :] == ids[:, None], -np.inf, products(vectors, sample).astype(np.float64))
        if scores.shape[1] > k:
            self.least = np.sort(scores, axis=1)[:, -k]

    def best_of(self, ids: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """For each query the ``k`` best of some candidates that can be among its ``k`` best of all."""
        table, squares = distances(vectors, self.pivots), (vectors.astype(np.float64) ** 2).sum(1)
        for q in range(len(self.ids)):
            lower = np.abs(table - self.table[q]).max(1)
            total = self.squares[q] + squares
            # rounding must never put a bound below the score
            upper = (total - lower * lower) / 2 + 1e-9 * total + 1
            upper[ids == self.ids[q]] = -np.inf
            open_ = np.flatnonzero(upper >= self.least[q])
            open_ = open_[np.argsort(-upper[open_], kind="stable")]
            found_ids, found, least = np.zeros(0, np.int64), np.zeros(0, np.int64), self.least[q]
            for start in range(0, len(open_), STEP):
                part = open_[start : start + STEP]
                if upper[part[0]] < least or upper[part[0]] == -np.inf:
                    break
                part = part[upper[part] > -np.inf]
                found_ids = np.concatenate([found_ids, ids[part]])
                found = np.concatenate([found, products(self.vectors[q : q + 1], vectors[part])[0]])
                kept = np.lexsort((found_ids, -found))[: self.k]
                found_ids, found = found_ids[kept], found[kept]
                if len(found) == self.k:
                    least = max(least, float(found[-1]))
            yield from ((int(self.ids[q]), int(i), int(s)) for i, s in zip(found_ids, found, strict=True) if s >= self.least[q])


def _blocks(queries: DataFrame, width: int, block: int) -> Iterator[pd.DataFrame]:
    """The queries of a width in blocks, read from Spark as they are needed."""
    part: list = []
    for row in queries.where(F.size("v") == width).toLocalIterator(prefetchPartitions=True):
        part.append(row)
        if len(part) == block:
            yield pd.DataFrame(part, columns=["vec_id", "v"])
            part = []
    if part:
        yield pd.DataFrame(part, columns=["vec_id", "v"])


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the ``k`` best of each row whose id ``every`` divides."""
    spark, rows = vectors.sparkSession, integer_vectors(vectors)
    queries = rows.where(F.col("vec_id") % every == 0)
    widths = [r[0] for r in queries.select(F.size("v")).distinct().collect()]
    passes = []
    for width in sorted(widths):
        same = rows.where(F.size("v") == width)
        drawn = same.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).toPandas()
        sample_ids, sample = drawn["vec_id"].to_numpy(np.int64), matrix(drawn["v"], width)
        # several rows of one id would be several scores of one candidate in the sample
        once = np.unique(sample_ids, return_index=True)[1]
        for asked in _blocks(queries, width, query_block):
            block = QueryBlock(asked["vec_id"].to_numpy(np.int64), matrix(asked["v"], width), sample_ids[once], sample[once], k)
            passes.append(same.mapInPandas(_search(shipped(spark, block), width), RESULT))
    if not passes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = reduce(DataFrame.union, passes)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def _search(shared, width: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = shared()
        for batch in batches:
            for start in range(0, len(batch), CANDIDATE_BLOCK):
                part = batch.iloc[start : start + CANDIDATE_BLOCK]
                found = block.best_of(part["vec_id"].to_numpy(np.int64), matrix(part["v"], width))
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return search
