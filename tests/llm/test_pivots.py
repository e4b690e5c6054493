import math
import random

import pytest

from placewright.llm.pivots import top_k

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score string"


def brute(rows, every, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % every == 0:
            scores = sorted({(-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q and len(a) == len(b)})
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])}
    return out


def found(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 0, "r", "s") for i, v in rows], SCHEMA)
    return {tuple(r) for r in top_k(table, **options).select("query_id", "rank", "vec_id", "score").collect()}


@pytest.mark.parametrize("scale", [0.1, 30.0])
def test_against_brute_force(spark, scale):
    rng = random.Random(1)
    centres = [[rng.gauss(0, scale) for _ in range(12)] for _ in range(6)]
    rows = [(i, [round(x + rng.gauss(0, scale / 5), 3) for x in rng.choice(centres)]) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # many ties
    rows = [(i, [float(f"{x:.3f}") for x in v]) for i, v in rows]
    import numpy as np

    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert found(spark, rows, every=7, query_block=40) == brute(rows, 7, 10)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [1.0]), (7, [-1.0, 0.5]), (100, [1.0, 2.0])]
    assert found(spark, rows) == brute(rows, 100, 10)
    assert found(spark, [(0, [1.0])]) == set()
    assert found(spark, [(5, [1.0]), (6, [1.0])]) == set()
    assert found(spark, [(0, [1.0]), (0, [1.0]), (2, [0.5]), (2, [0.5])]) == {(0, 1, 2, 512 * 1024)}
    empty = spark.createDataFrame([], SCHEMA)
    assert top_k(empty).columns == ["query_id", "rank", "vec_id", "score"] and top_k(empty).count() == 0
