"""Hard negatives: rows of another label that score nearly as high with an anchor as a row of its own label.

1. Codes. A vector is turned by a random rotation and coded by the signs of its components. Beside the code its
   alignment is stored, the inner product of code and vector, and the length of the residual, of what the code times the
   alignment leaves; the residual is coded again with the next rotation, ``STAGES`` times in all.
2. Estimates. Anchors are rotated alike and cut to ``PLANES`` bits a component, so their products with a code are
   popcounts. What rounding can add is known, and what the residual can add is at most its length times that of
   the part of the anchor across the code (Cauchy-Schwarz). So a score lies in a certain interval, which gets
   narrower stage by stage; nothing is left to chance.
3. Search. A candidate goes when its interval misses the asked range of scores, or lies below the lower ends of as
   many others as are asked for. Those that are left are scored by their integers.

Blocks of anchors meet chunks of candidates, both of bounded size and numbered by hashes: a grid of Spark groups. First
the positives of every anchor are searched, then, in the ranges that their scores give, the negatives; the best
of each cell meet in a ranking.

Defined cases: rows with a null id, label or vector, or with a null, NaN or infinite component take no part; equal rows
are one; rows of one id never meet, and unlike rows of an anchor's id are anchors by themselves; vectors of different
length are not compared; an anchor without positives, and a positive without negatives in its range, gives no
row; ties go to the smaller id; an empty table gives no rows. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.scratch import written

#: Rules of the registered query: anchors are rows whose id it divides; numbers of positives and negatives; the range of
#: a negative's score in hundredths of the positive's.
EVERY, POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 100, 5, 10, 30, 90, 256
#: Codes of a vector, and bits of a rotated component of an anchor.
STAGES, PLANES = 6, 8
#: Components that are rotated together.
ROTATED = 256
#: Anchors and candidates in a cell.
ANCHOR_BLOCK, CANDIDATE_CHUNK = 1 << 13, 1 << 12
#: Below it sums of products are exact as doubles.
EXACT = 2.0**52

CODED = "vec_id long, label long, width int, v binary, codes binary, align binary, rest binary, norm double"
FOUND = "anchor_id long, anchor_hash long, positive_id long, other_id long, positive_score long, score long"


def integer_rows(vectors: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``label`` and ``v``, every component as floor(scale * x); rows that take part, once each."""
    as_double = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), as_double.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.where("vec_id is not null and label is not null and v is not null").where(~bad)
    return whole.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v")).distinct()


# --- codes ----------------------------------------------------------------------------------------


@cache
def _rotation(width: int, stage: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """A shuffle of the components, and random rotations of runs of them; the same wherever it is made."""
    rng = np.random.default_rng([width, stage])
    order = rng.permutation(width)
    sizes = [min(ROTATED, width - start) for start in range(0, width, ROTATED)]
    return order, tuple(np.linalg.qr(rng.standard_normal((n, n)))[0] for n in sizes)


def rotated(x: np.ndarray, stage: int) -> np.ndarray:
    order, parts = _rotation(x.shape[1], stage)
    out = np.empty(x.shape)
    for i, part in enumerate(parts):
        at = order[i * ROTATED : (i + 1) * ROTATED]
        out[:, i * ROTATED : i * ROTATED + len(at)] = x[:, at] @ part
    return out


def turned_back(y: np.ndarray, stage: int) -> np.ndarray:
    order, parts = _rotation(y.shape[1], stage)
    out = np.empty(y.shape)
    for i, part in enumerate(parts):
        at = order[i * ROTATED : (i + 1) * ROTATED]
        out[:, at] = y[:, i * ROTATED : i * ROTATED + len(at)] @ part.T
    return out


def as_words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    short = -bits.shape[-1] % 64
    padded = np.concatenate([bits, np.zeros((*bits.shape[:-1], short), bool)], axis=-1)
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


def encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (row, stage, word), alignments and lengths of residuals (row, stage) of integer vectors."""
    n, width = v.shape
    left, root = v.astype(np.float64), max(1.0, width**0.5)
    codes = np.zeros((n, STAGES, -(-width // 64)), np.uint64)
    align, rest = np.zeros((n, STAGES)), np.zeros((n, STAGES))
    for stage in range(STAGES):
        y = rotated(left, stage)
        signs = y >= 0
        codes[:, stage] = as_words(signs)
        align[:, stage] = np.abs(y).sum(1) / root
        left = left - turned_back(np.where(signs, 1, -1) * (align[:, stage] / root)[:, None], stage)
        rest[:, stage] = np.sqrt((left * left).sum(1))
    return codes, align, rest


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("v")
        sizes = np.diff(vectors.offsets.to_numpy())
        flat, starts = vectors.values.to_numpy(), vectors.offsets.to_numpy()[:-1]
        ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        for width in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == width)
            v = flat[starts[at][:, None] + np.arange(width)].astype(np.int64)
            codes, align, rest = encode(v)
            columns = [
                pa.array(ids[at]),
                pa.array(labels[at]),
                pa.array(np.full(len(at), width, np.int32)),
                *[pa.array([row.tobytes() for row in x], pa.binary()) for x in (v, codes, align, rest)],
                pa.array(np.sqrt((v.astype(np.float64) ** 2).sum(1))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "width", "v", "codes", "align", "rest", "norm"])


def coded(rows: DataFrame) -> DataFrame:
    """The table of codes: made once, read by every search."""
    return written(rows.select("vec_id", "label", "v").mapInArrow(_coded, CODED))


# --- estimates and search -------------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray, kind, shape: tuple) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(shape)


class Candidates:
    """A chunk of coded rows of one width."""

    def __init__(self, table: pa.Table, width: int) -> None:
        n = len(table)
        self.ids, self.labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        self.v = _matrix(table["v"], np.int64, (n, width))
        self.codes = _matrix(table["codes"], np.uint64, (n, STAGES, -(-width // 64)))
        self.align = _matrix(table["align"], np.float64, (n, STAGES))
        self.rest = _matrix(table["rest"], np.float64, (n, STAGES))
        self.norm = table["norm"].to_numpy()
        self.largest = float(np.abs(self.v).max()) if self.v.size else 0.0

    def scores(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Integer inner products, by floating point where that is exact."""
        if query.size and self.largest * float(np.abs(query).max()) * query.size < EXACT:
            return (self.v[at].astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
        return self.v[at] @ query


class Query:
    """An anchor, rotated and cut to bits for each stage."""

    def __init__(self, v: np.ndarray) -> None:
        self.v, self.square = v, float((v.astype(np.float64) ** 2).sum())
        self.root = max(1.0, len(v) ** 0.5)
        self.stages = [self._cut(rotated(v[None, :].astype(np.float64), stage)[0]) for stage in range(STAGES)]

    def _cut(self, q: np.ndarray) -> tuple[np.ndarray, float, float, float, float]:
        """Bit planes, lowest value, step, sum of the cut values, and what cutting can change in a product with a code."""
        if not len(q):
            return np.zeros((PLANES, 0), np.uint64), 0.0, 0.0, 0.0, 0.0
        low, step = float(q.min()), float(np.ptp(q)) / (2**PLANES - 1)
        cut = np.rint((q - low) / step).astype(np.int64) if step else np.zeros(len(q), np.int64)
        planes = as_words(((cut[None, :] >> np.arange(PLANES)[:, None]) & 1).astype(bool))
        return planes, low, step, low * len(q) + step * float(cut.sum()), float(np.abs(q - low - step * cut).sum()) / self.root

    def product(self, codes: np.ndarray, stage: int) -> tuple[np.ndarray, float]:
        """Estimated products with codes, by popcounts, and their largest error."""
        planes, low, step, total, error = self.stages[stage]
        set_bits = np.bitwise_count(codes).sum(1, dtype=np.int64)
        weighed = np.zeros(len(codes), np.int64)
        for j in range(PLANES):
            weighed += np.bitwise_count(codes & planes[j]).sum(1, dtype=np.int64) << j
        return (2 * (low * set_bits + step * weighed) - total) / self.root, error

    def best(self, rows: Candidates, at: np.ndarray, ranges: list[tuple[float, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (of ``at``) that can be among the ``k`` best within any of the ranges of scores, and their scores."""
        estimate, slack = np.zeros(len(at)), np.zeros(len(at))
        for stage in range(STAGES):
            if len(at) <= k * len(ranges):
                break
            product, error = self.product(rows.codes[at, stage], stage)
            align = rows.align[at, stage]
            estimate, slack = estimate + align * product, slack + align * error
            across = np.sqrt(np.maximum(self.square - np.maximum(np.abs(product) - error, 0) ** 2, 0))
            # rounding must never put a bound on the wrong side of the score
            width = slack + across * rows.rest[at, stage] + 1e-9 * self.square**0.5 * rows.norm[at] + 1e-3
            low, high = estimate - width, estimate + width
            alive = np.zeros(len(at), bool)
            for least, most in ranges:
                inside = (high >= least) & (low <= most)
                sure = low[(low >= least) & (high <= most)]
                if len(sure) >= k:
                    inside &= high >= np.partition(sure, -k)[-k]
                alive |= inside
            at, estimate, slack = at[alive], estimate[alive], slack[alive]
        return at, rows.scores(self.v, at)


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _cell(find):
    """A function of one cell: ``find`` yields what an anchor finds in the chunk."""

    def cell(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(anchors) and len(candidates):
            width = candidates["width"][0].as_py()
            rows = Candidates(candidates, width)
            by_label = {label: np.flatnonzero(rows.labels == label) for label in np.unique(rows.labels).tolist()}
            for anchor in anchors.to_pylist():
                query = Query(np.frombuffer(anchor["v"], np.int64))
                found += [(anchor["vec_id"], anchor["hash"], *f) for f in find(anchor, query, rows, by_label)]
        names = [c.split()[0] for c in FOUND.split(", ")]
        columns = list(zip(*found, strict=True)) or [[]] * len(names)
        return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(names, columns, strict=True)})

    return cell


def _positives(k: int):
    def find(anchor: dict, query: Query, rows: Candidates, by_label: dict) -> Iterator[tuple]:
        at = by_label.get(anchor["label"], np.zeros(0, np.int64))
        at, scores = query.best(rows, at[rows.ids[at] != anchor["vec_id"]], [(-np.inf, np.inf)], k)
        for i in _first(rows.ids[at], scores, k):
            yield None, int(rows.ids[at[i]]), None, int(scores[i])

    return find


def _negatives(k: int, low: int, high: int):
    def find(anchor: dict, query: Query, rows: Candidates, by_label: dict) -> Iterator[tuple]:
        at = np.flatnonzero((rows.labels != anchor["label"]) & (rows.ids != anchor["vec_id"]))
        ranges = sorted({(low * p["score"] / 100, high * p["score"] / 100) for p in anchor["positives"]})
        at, scores = query.best(rows, at, ranges, k)
        for positive in anchor["positives"]:
            # compared as integers, which need no rounding
            least, most = -(-low * positive["score"] // 100), high * positive["score"] // 100
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            for i in inside[_first(rows.ids[at[inside]], scores[inside], k)]:
                yield positive["id"], int(rows.ids[at[i]]), positive["score"], int(scores[i])

    return find


def _grid(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, find) -> DataFrame:
    """What all anchors find in all rows: blocks of the ones meet chunks of the others."""
    n_blocks, n_chunks = -(-max(1, n_anchors) // ANCHOR_BLOCK), -(-max(1, n_rows) // CANDIDATE_CHUNK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = lambda n: F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(n)).cast("int")
    asked = anchors.withColumn("block", number(n_blocks)).withColumn("chunk", every(n_chunks))
    met = rows.withColumn("chunk", number(n_chunks)).withColumn("block", every(n_blocks))
    cell = ["width", "block", "chunk"]
    # both come from one table; as columns of their own they cannot be taken for each other
    met = met.select(*[F.col(c).alias(c) for c in met.columns])
    return asked.groupBy(*cell).cogroup(met.groupBy(*cell)).applyInArrow(_cell(find), FOUND)


def hard_negatives(
    vectors: DataFrame,
    label: Column | None = None,
    *,
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """Of every row whose id ``every`` divides, for each of its best ``positives``: the best ``negatives`` whose score is
    between ``low`` and ``high`` hundredths of the positive's.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label``; ``label`` may give another expression for the label.
    """
    rows = coded(integer_rows(vectors, F.col("label") if label is None else label, scale))
    hashed = F.xxhash64("label", "v").alias("hash")
    anchors = rows.where(F.col("vec_id") % every == 0).select("vec_id", "label", "width", "v", hashed)
    n_rows, n_anchors = rows.count(), anchors.count()
    keys = ["anchor_id", "anchor_hash"]

    near = _grid(anchors, rows, n_anchors, n_rows, _positives(positives))
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other_id")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    kept = F.collect_list(F.struct("rank", F.col("other_id").alias("id"), "score"))
    near = near.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_hash").alias("hash")).agg(F.array_sort(kept).alias("positives"))
    anchors = written(anchors.join(near, ["vec_id", "hash"]))

    far = _grid(anchors, rows, n_anchors, n_rows, _negatives(negatives, low, high))
    order = Window.partitionBy(*keys, "positive_id", "positive_score").orderBy(F.col("score").desc(), "other_id")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return far.select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
